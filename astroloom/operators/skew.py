"""Per-key results when a few keys hold most rows (problem 5).

Heavy keys are found on a hash sample. They are few by construction, so tables about them may be broadcast; their
rows are cut into ordered blocks, processed block by block in parallel, while all other keys take an ordinary
shuffle. Both results are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astroloom.tables import cut, partitions

#: Rows from which a key is heavy whatever its share, and the number of heavy keys up to which that holds.
LIGHT_ROWS = 20_000_000
HEAVY_KEYS = 100_000
#: One row in SAMPLE is looked at for heavy keys.
SAMPLE = 16
#: Sampled rows per shuffle partition from which the order points of heavy keys are taken.
POINT_ROWS = 1000
#: Order points are kept in nested arrays of so many, so a row is placed with two short scans.
NEST = 64


def fair_share(spark: SparkSession) -> float:
    """The share of all rows from which a key is heavy: half of one shuffle partition's part."""
    return 1.0 / (2 * max(100, partitions(spark)))


def heavy_keys(rows: DataFrame, keys: list[str], sample_on: str, share: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """Keys that hold more than ``share`` of the sampled rows, with ``weight``, their share. At most 1 / share rows.

    The default share is :func:`fair_share`, or less where that would leave more than LIGHT_ROWS rows of a key to one task.

    The sample takes every row whose hash of ``sample_on`` falls into one of ``sample`` classes: the same rows on
    every attempt of a task. It decides only how rows travel, never what comes out. Counting is map-side first.
    """
    picked = rows.where(F.pmod(F.xxhash64(sample_on), F.lit(sample)) == 0)
    total = max(1, picked.count())
    share = share or min(fair_share(rows.sparkSession), max(LIGHT_ROWS / (total * sample), 1 / HEAVY_KEYS))
    counts = picked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > total * share)
    return counts.select(*keys, (F.col("__n") / float(total)).alias("weight"))


def split_heavy(rows: DataFrame, keys: list[str], heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the heavy keys, all other rows). ``heavy`` comes from :func:`heavy_keys` and is bounded by 1 / share."""
    marks = F.broadcast(heavy.select(*keys))
    return rows.join(marks, keys, "left_semi"), rows.join(marks, keys, "left_anti")


def order_blocks(hot: DataFrame, keys: list[str], order: list[str], heavy: DataFrame, total: int) -> DataFrame:
    """``hot`` with ``__block``: the number of sampled order points of its key that lie below the row.

    A key of weight w gets about w times four times the shuffle partitions of blocks, so a block is a fraction of
    a partition whatever the key's size; all points together are bounded by a few times the partitions and are
    broadcast. Points are rows (all order columns together), so equal values of the first column are cut as well.
    """
    many = max(100, partitions(hot.sparkSession))
    classes = max(1, total // (POINT_ROWS * many))
    ident = order[-1]
    inside = Window.partitionBy(*keys).orderBy(*order)
    sampled = hot.where(F.pmod(F.xxhash64(F.lit(7), ident), F.lit(classes)) == 0).join(F.broadcast(heavy), keys)
    ranked = sampled.withColumns({"__rank": F.row_number().over(inside), "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / F.greatest(F.lit(2), F.ceil(F.col("weight") * 4 * many))))
    point = F.struct(*order)
    picked = ranked.where(F.col("__rank") % step == 0).select(*keys, point.alias("__point"), F.floor((F.col("__rank") / step - 1) / NEST).alias("__nest"))
    nests = picked.groupBy(*keys, "__nest").agg(F.sort_array(F.collect_list("__point")).alias("__points"))
    nests = nests.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__nest", F.element_at("__points", -1).alias("end"), "__points"))).alias("__nests"))
    placed = hot.join(F.broadcast(nests), keys, "left")
    placed = placed.withColumn("__upper", F.coalesce(F.size(F.filter("__nests", lambda n: n["end"] < point)), F.lit(0)))
    inner = F.coalesce(F.size(F.filter(F.get("__nests", F.col("__upper"))["__points"], lambda p: p < point)), F.lit(0))
    return placed.withColumn("__block", (F.col("__upper") * NEST + F.greatest(inner, F.lit(0))).cast("long")).drop("__nests", "__upper")


def running_sums(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], share: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """``rows`` with running sums of ``values`` per key in the given order, named by the keys of the mapping.

    ``order`` names columns that are unique together within a key (the last one is an identifier); nulls come first.
    Keys must not be null. Heavy keys are cut into ordered blocks: sums of whole blocks are made first and
    added to the running sums inside each block, so no task sorts more than a block.
    """
    ident = order[-1]
    named = cut(rows.withColumns({f"__{n}": v for n, v in values.items()}), "ordered")
    heavy = cut(heavy_keys(named, keys, ident, share, sample), "heavy")
    hot, cold = split_heavy(named, keys, heavy)
    along = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    light = cold.withColumns({n: F.sum(f"__{n}").over(along) for n in values})
    blocked = order_blocks(hot, keys, order, heavy, named.count())
    sums = blocked.groupBy(*keys, "__block").agg(*[F.sum(f"__{n}").alias(f"__of_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*keys, "__block", *[F.coalesce(F.sum(f"__of_{n}").over(before), F.lit(0.0)).alias(f"__ahead_{n}") for n in values])
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # a few blocks per heavy key, bounded as the order points are
    full = blocked.withColumns({f"__in_{n}": F.sum(f"__{n}").over(inside) for n in values}).join(F.broadcast(ahead), [*keys, "__block"])
    full = full.withColumns({n: F.col(f"__ahead_{n}") + F.col(f"__in_{n}") for n in values})
    return light.unionByName(full.select(*light.columns)).drop(*[f"__{n}" for n in values])


def first_reaching(rows: DataFrame, keys: list[str], order: list[str], value: str, fraction: float = 0.5, share: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """Per key, in the given order, the first row at which the running sum of ``value`` reaches ``fraction`` of the key's sum.

    ``order`` names columns that together are unique within a key (the last one is an identifier); ascending, nulls
    first. Rows with a null key, a null or NaN value, or a null identifier take no part; a key without a row left
    has no result, and where the sum is 0 the first row is the result. Values should be non-negative.

    A heavy key is cut into blocks at sampled order points. Block sums (map-side first) tell in which block the
    threshold lies, and only that block is sorted; so no task holds more than one block of a key. All other keys
    are sorted within one shuffle.
    """
    ident = order[-1]
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    for column in (*keys, ident):
        good = good.where(F.col(column).isNotNull())
    good = cut(good.select(*keys, *order, F.col(value).cast("double").alias("__v")), "members")
    heavy = cut(heavy_keys(good, keys, ident, share, sample), "heavy")
    hot, cold = split_heavy(good, keys, heavy)

    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    running = cold.withColumns({"__run": F.sum("__v").over(inside), "__sum": F.sum("__v").over(whole)})
    reached = running.where(F.col("__run") >= F.col("__sum") * fraction)
    light = reached.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first")).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in order])

    blocked = order_blocks(hot, keys, order, heavy, good.count())
    sums = blocked.groupBy(*keys, "__block").agg(F.sum("__v").alias("__of_block"))
    along = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumns({"__run": F.sum("__of_block").over(along), "__sum": F.sum("__of_block").over(whole)})
    sums = sums.where(F.col("__run") >= F.col("__sum") * fraction)
    target = sums.groupBy(*keys).agg(F.min(F.struct("__block", (F.col("__run") - F.col("__of_block")).alias("ahead"), F.col("__sum").alias("sum"))).alias("t"))
    target = target.select(*keys, F.col("t.__block").alias("__block"), F.col("t.ahead").alias("__ahead"), F.col("t.sum").alias("__sum"))
    last = blocked.join(F.broadcast(target), [*keys, "__block"])  # one row per heavy key
    last = last.withColumn("__run", F.col("__ahead") + F.sum("__v").over(inside)).where(F.col("__run") >= F.col("__sum") * fraction)
    found = last.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first")).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in order])
    return light.unionByName(found)


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], sample_on: str, share: float | None = None, sample: int = SAMPLE, heavy: DataFrame | None = None) -> DataFrame:
    """Inner equi-join of ``big`` with ``small`` (at most one row per key) that no heavy key of ``big`` can unbalance.

    Heavy keys meet their rows of ``small`` by broadcast, at most 1 / share rows; the others by an ordinary shuffle.
    ``heavy`` may be given where it is known already.
    """
    heavy = heavy if heavy is not None else cut(heavy_keys(big, keys, sample_on, share, sample), "heavy")
    hot, cold = split_heavy(big, keys, heavy)
    few = small.join(F.broadcast(heavy.select(*keys)), keys, "left_semi")
    return cold.join(small, keys).unionByName(hot.join(F.broadcast(few), keys))


def skew_aggregate(rows: DataFrame, keys: list[str], *aggregates: Column, salt_on: str, salts: int = 64, final: list[Column] | None = None) -> DataFrame:
    """Two-step aggregation for functions whose partial results are large: by (keys, salt), then by keys.

    ``aggregates`` are the partial columns, ``final`` the columns that merge them (default: their sums).
    """
    part = rows.groupBy(*keys, F.pmod(F.xxhash64(salt_on), F.lit(salts)).alias("__salt")).agg(*aggregates)
    names = [c for c in part.columns if c not in (*keys, "__salt")]
    return part.groupBy(*keys).agg(*(final or [F.sum(c).alias(c) for c in names]))
