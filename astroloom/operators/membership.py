"""Group tables, memberships and catalogue order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astroloom.operators.groups import ptype_rank
from astroloom.operators.hierarchy import Forest, paths
from astroloom.operators.skew import skew_join
from astroloom.tables import cut


def lookup(rows: DataFrame, column: str, table: DataFrame, ident: str, value: str, name: str) -> DataFrame:
    """``rows`` with the ``value`` of the row of ``table`` whose ``ident`` equals ``column``; -1 where there is none.

    ``table`` holds one row per id; a null id finds nothing.
    """
    small = table.select(F.col(ident).alias("__id"), F.col(value).alias("__value"))
    return rows.join(small, rows[column] == F.col("__id"), "left").withColumn(name, F.coalesce("__value", F.lit(-1))).drop("__id", "__value")


def rekey(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Contiguous numbers from 0 for the distinct ids of ``column`` in their order; -1 for null and negative ids.

    The distinct ids are range-partitioned and counted per partition; only the partition counts pass through the
    driver, so no task sees all ids.
    """
    ids = number_rows(rows.where(F.col(column) >= 0).select(F.col(column).alias("__id")).distinct(), ["__id"], name)
    return rows.join(ids, rows[column] == F.col("__id"), "left").withColumn(name, F.coalesce(name, F.lit(-1))).drop("__id")


def number_rows(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with their place from 0 in a total ``order``, without sorting in one task.

    Rows are partitioned by ranges of the order columns and written; places are the place within the partition plus
    the counts of the partitions before. ``order`` must break all ties.
    """
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}  # one number per partition
    ahead, at = [], 0
    for part in sorted(counts):
        ahead.append((part, at))
        at += counts[part]
    if not ahead:
        return ranged.drop("__part").withColumn(name, F.lit(0).cast("long"))
    starts = F.create_map(*[F.lit(x) for pair in ahead for x in pair])
    inside = Window.partitionBy("__part").orderBy(*order)
    return ranged.withColumn(name, (F.element_at(starts, F.col("__part")) + F.row_number().over(inside) - 1).cast("long")).drop("__part")


def deepest(rows: DataFrame, ident: str, depth: str, *ties: str) -> DataFrame:
    """One row per id: the deepest membership, ties by the largest of the further columns."""
    order = Window.partitionBy(ident).orderBy(F.desc(depth), *[F.desc(t) for t in ties])
    return rows.where(F.col(ident).isNotNull()).withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def expand_runs(runs: DataFrame, keys: list[str], order: str, length: str, position: str = "position") -> DataFrame:
    """Run lengths to one row per position: runs follow each other in ``order`` within ``keys``; empty runs give none."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("__start", F.coalesce(F.sum(length).over(before), F.lit(0)))
    return placed.where(F.col(length) > 0).withColumn(position, F.explode(F.expr(f"sequence(__start, __start + {length} - 1)"))).drop("__start")


def interval_lookup(rows: DataFrame, keys: list[str], at: str, starts: DataFrame, start: str, *values: str) -> DataFrame:
    """``rows`` with the ``values`` of the last interval of the same keys that begins at or before ``at``; null before the first.

    Intervals become right-open by their successor and are cut into blocks of equal width, so the join is an
    equi-join on (keys, block).
    """
    follow = Window.partitionBy(*keys).orderBy(start)
    spans = starts.withColumn("__end", F.lead(start).over(follow))
    top = rows.groupBy(*keys).agg(F.max(at).alias("__top"))
    spans = spans.join(top, keys).withColumn("__end", F.least(F.coalesce(F.col("__end") - 1, F.col("__top")), F.col("__top"))).where(F.col(start) <= F.col("__end"))
    block = 4096
    spans = spans.select(*keys, F.col(start).alias("__start"), "__end", *values, F.explode(F.sequence(F.floor(F.col(start) / block), F.floor(F.col("__end") / block))).alias("__block"))
    tagged = rows.withColumn("__block", F.floor(F.col(at) / block))
    on = [tagged[k] == spans[k] for k in keys] + [tagged["__block"] == spans["__block"], tagged[at] >= spans["__start"], tagged[at] <= spans["__end"]]
    return tagged.join(spans, on, "left").select(*[tagged[c] for c in rows.columns], *[spans[v] for v in values])


def size_labels(members: DataFrame, root: str, pidx: str = "pidx", least: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, root, n, first, label): groups numbered in every ``by`` by size descending, then smallest member; -1 for groups below ``least``."""
    sizes = members.groupBy(*by, root).agg(F.count(F.lit(1)).alias("n"), F.min(pidx).alias("first"))
    big = number_rows(sizes.where(F.col("n") >= least), [*[F.asc(c) for c in by], F.desc("n"), F.asc("first")], "label")
    if by:
        big = cut(big, "labels")
        ahead = big.groupBy(*by).agg(F.min("label").alias("__ahead"))
        big = big.join(ahead, list(by)).withColumn("label", F.col("label") - F.col("__ahead")).drop("__ahead")
    return big.unionByName(sizes.where(F.col("n") < least).withColumn("label", F.lit(-1).cast("long")))


def csr(members: DataFrame, group: str, pidx: str = "pidx") -> DataFrame:
    """Export form: per group the sorted member list with its length and offset in group order.

    A list is as long as its group, so this is for export of groups that fit one row; use :func:`csr_order` else.
    """
    lists = members.where(F.col(group) >= 0).groupBy(group).agg(F.array_sort(F.collect_list(pidx)).alias("members"), F.count(F.lit(1)).alias("length"))
    lists = cut(lists, "lists")
    rows = number_rows(lists.select(group, "length"), [F.asc(group)], "__row").withColumn("__block", F.floor(F.col("__row") / 65536))
    inside = Window.partitionBy("__block").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__block").agg(F.sum("length").alias("__n"))
    ahead = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row per 65536 groups
    sums = sums.select("__block", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    offsets = rows.withColumn("__in", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(sums, "__block").select(group, (F.col("__ahead") + F.col("__in")).alias("offset"))
    return lists.join(offsets, group)


def csr_order(members: DataFrame, group: str, pidx: str = "pidx") -> DataFrame:
    """Members with ``slot``, their place in the concatenation of all groups; for groups of any size."""
    return number_rows(members.where(F.col(group) >= 0), [F.asc(group), F.asc(pidx)], "slot")


def inclusive(members: DataFrame, group: str, forest: Forest) -> DataFrame:
    """Members repeated for every ancestor of their group, the group itself included.

    The paths of the forest give the ancestors; the output is as large as the sum of depths over members.
    """
    chains = paths(forest).withColumnRenamed("id", group)
    return skew_join(members, chains, [group], "pidx").withColumn(group, F.explode("path")).drop("path")


def plurality(members: DataFrame, group: str, vote: str, order: list[str]) -> DataFrame:
    """(group, winner, fraction): the most frequent non-negative ``vote`` of each group and its share of those votes.

    On equal counts the vote that reaches the count first in ``order`` wins. That is the vote whose last
    member comes first, so no running count is needed. Groups without votes have winner -1 and fraction 0.
    """
    votes = members.where(F.col(vote) >= 0).groupBy(group, vote).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*order)).alias("last"))
    best = votes.groupBy(group).agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    win = votes.join(best, group).where("n = top").groupBy(group).agg(F.min(F.struct("last", vote)).alias("w"), F.first("top").alias("top"), F.first("all").alias("all"))
    every = members.select(group).distinct()
    out = every.join(win, group, "left")
    return out.select(group, F.coalesce(F.col(f"w.{vote}"), F.lit(-1)).alias("winner"), F.coalesce((F.col("top") / F.col("all")).cast("float"), F.lit(0).cast("float")).alias("fraction"))


def trim_interlopers(members: DataFrame, galaxy: str, vote: str, winners: DataFrame, min_stars: int, min_gas: int = 0) -> DataFrame:
    """Galaxy numbers with -1 for members outside their galaxy's winning subhalo and for galaxies left too small."""
    kept = members.join(winners.select(F.col(galaxy).alias("__g"), "winner"), F.col(galaxy) == F.col("__g"), "left").drop("__g")
    kept = kept.withColumn(galaxy, F.when((F.col("winner") >= 0) & (F.col(vote) != F.col("winner")), F.lit(-1)).otherwise(F.col(galaxy))).drop("winner")
    sizes = kept.where(F.col(galaxy) >= 0).groupBy(F.col(galaxy).alias("__g")).agg(F.count(F.when(F.col("ptype") == "star", 1)).alias("stars"), F.count(F.when(F.col("ptype") == "gas", 1)).alias("gas"))
    good = sizes.where((F.col("stars") >= min_stars) & (F.col("gas") >= min_gas)).select("__g")
    return kept.join(good, F.col(galaxy) == F.col("__g"), "left").withColumn(galaxy, F.coalesce("__g", F.lit(-1))).drop("__g")


def order_groups(groups: DataFrame, mass: str, ident: str, depth: str | None = None, row: str = "row") -> DataFrame:
    """Catalogue order: mass descending (nulls last), then depth, then id, as ``row`` from 0."""
    return number_rows(groups, [F.desc_nulls_last(mass), *([F.asc(depth)] if depth else []), F.asc(ident)], row)


def remap(groups: DataFrame, pointer: str, ident: str, row: str, name: str) -> DataFrame:
    """Pointers to ids as pointers to rows; null, -1 and dangling pointers become -1."""
    target = groups.select(F.col(ident).alias("__target"), F.col(row).alias("__row"))
    return groups.join(target, groups[pointer] == F.col("__target"), "left").withColumn(name, F.coalesce("__row", F.lit(-1))).drop("__target", "__row")


def galaxy_parents(galaxies: DataFrame, galaxy: str, halo: str, forest: Forest) -> DataFrame:
    """(halo, galaxy) for the galaxies of every halo and of all halos below it."""
    chains = paths(forest).withColumnRenamed("id", halo)
    return galaxies.select(galaxy, halo).join(chains, halo).select(F.explode("path").alias(halo), galaxy)


def member_order() -> list[Column]:
    """The order in which members of a group are read: by type, then index."""
    return [ptype_rank().alias("ptype_rank"), F.col("pidx")]


def select_halos(particles: DataFrame, halo: str, min_dm: int = 0, types: tuple[str, ...] | None = None) -> DataFrame:
    """Particles of halos with at least ``min_dm`` dark matter particles, where there is dark matter at all.

    Particles without a halo (null or -1) and of types not named are left out.
    """
    rows = particles.where(F.col(halo).isNotNull() & (F.col(halo) >= 0))
    if types:
        rows = rows.where(F.col("ptype").isin(*types))
    if not min_dm:
        return rows
    big = rows.groupBy(halo).agg(F.count(F.when(F.col("ptype") == "dm", 1)).alias("dm")).where(F.col("dm") >= min_dm).select(halo)
    return rows.join(big, halo, "left_semi")
