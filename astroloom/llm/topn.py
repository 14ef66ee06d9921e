"""The N highest-scoring items of every group by simultaneous bisection (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astroloom.operators.skew import heavy_keys
from astroloom.tables import cut

#: Levels of bisection per pass over the rows: each pass counts rows above 2^LEVELS - 1 midpoints.
LEVELS = 6


def order_code(score: Column) -> Column:
    """A long that orders doubles as numbers: exponent and mantissa as one integer, with the sign.

    The same steps as the bits of a double, taken by arithmetic, so that no row leaves the JVM. Both zeros have code 0,
    the infinities the two largest magnitudes.
    """
    x = F.abs(score.cast("double"))
    least = F.lit(-1022).cast("double")
    guess = F.when(x > 0, F.greatest(least, F.least(F.lit(1023.0), F.floor(F.log2(F.greatest(x, F.lit(1e-307))))))).otherwise(least)
    ratio = x / F.pow(F.lit(2.0), guess)
    exponent = F.when((ratio < 1) & (guess > least), guess - 1).when(ratio >= 2, guess + 1).otherwise(guess)
    mantissa = x / F.pow(F.lit(2.0), exponent)
    step = F.lit(float(2**52))
    normal = (exponent + 1023).cast("long") * F.lit(2**52) + ((mantissa - 1) * step).cast("long")
    tiny = ((x / F.lit(2.0**-1022)) * step).cast("long")
    code = F.when(x == float("inf"), F.lit(2047 * 2**52)).when(x < 2.0**-1022, tiny).otherwise(normal)
    return F.when(score < 0, -code).otherwise(code)


def _bisect(rows: DataFrame, groups: list[str], need: DataFrame, code: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rows tied at the cutoff, with what is still needed).

    ``need``: per group the number still wanted, ``low`` and ``high``. A pass places the rows of all unfinished
    groups between the midpoints of their range, counts them (map-side first), and finds per group the section in
    which the cutoff lies: sections above are accepted, sections below dropped, the section itself is halved again in the
    next pass, unless it holds exactly as many as are needed or only one code. Rows of hot groups meet their
    group's row by broadcast (``hot`` is bounded), so no group gathers in a task.
    """
    accepted, tied = [], []
    parts = 2**LEVELS
    while True:
        step = F.greatest(F.lit(1), F.shiftright("high", LEVELS) - F.shiftright("low", LEVELS))
        if need.isEmpty():
            break
        # equal steps; over very wide ranges as weighted means, which cannot overflow
        mean = lambda k: F.shiftright("low", LEVELS) * (parts - k) + F.shiftright("high", LEVELS) * k
        mids = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda k: F.when(step < 2**56, F.col("low") + k * step).otherwise(mean(k)))
        state = need.select(*groups, "wanted", "low", "high", mids.alias("mids"), step.alias("step"))
        hot_state = F.broadcast(state.join(F.broadcast(hot), groups, "left_semi"))
        placed = rows.where("__hot").join(hot_state, groups).unionByName(rows.where("not __hot").join(state, groups))
        placed = placed.withColumn("section", F.size(F.filter("mids", lambda m: m <= F.col(code)))).drop("mids")
        counts = placed.groupBy(*groups, "section").agg(F.count(F.lit(1)).alias("n"), F.first("wanted").alias("wanted"), F.min(code).alias("least"), F.max(code).alias("most"))
        above = Window.partitionBy(*groups).orderBy(F.desc("section")).rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("running", F.sum("n").over(above)).where("running >= wanted and running - n < wanted")
        verdict = counts.select(*groups, F.col("section").alias("at"), (F.col("wanted") - F.col("running") + F.col("n")).alias("still"), "n", "least", "most")
        hot_verdict = F.broadcast(verdict.join(F.broadcast(hot), groups, "left_semi"))
        slim = placed.drop("wanted", "low", "high", "step")
        judged = slim.where("__hot").join(hot_verdict, groups).unionByName(slim.where("not __hot").join(verdict, groups))
        judged = judged.where("section >= at").withColumn("fate", F.when(F.expr("section > at or still = n"), 1).when(F.expr("least = most"), 2).otherwise(3))
        judged = cut(judged.drop("section", "at", "n", "least", "most"), "judged")
        accepted.append(judged.where("fate = 1").drop("fate", "still"))
        tied.append(judged.where("fate = 2").drop("fate"))
        left = judged.where("fate = 3").drop("fate")
        rows = left.drop("still")
        need = left.groupBy(*groups).agg(F.first("still").alias("wanted"), F.min(code).alias("low"), F.max(code).alias("high"))
    if not accepted:
        return rows.limit(0), rows.limit(0).withColumn("still", F.lit(0).cast("long"))
    return _union(accepted), _union(tied)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def top_n(items: DataFrame, groups: list[str], ident: str, score: str, n: int = 5, share: float | None = None) -> DataFrame:
    """Per group the ``n`` items with the highest score, ties by smaller identifier, with ``rank`` from 1.

    Output: groups, ident, score, rank. Items with a null group, identifier or score, or a NaN score take no part;
    a group with fewer items than ``n`` comes out whole. Infinite scores count. Rows that repeat an identifier within a
    group are items of their own, of which any may be taken where the cutoff falls between them. The cutoff is
    refined on the score's code first and, for groups with more items at the cutoff score than are needed, on the
    identifier's. An item's other columns are joined back by the caller.
    """
    good = items.select(*groups, F.col(ident).cast("long").alias("__id"), F.col(score).cast("double").alias("__score")).dropna(subset=[*groups, "__id", "__score"])
    good = good.where(~F.isnan("__score")).withColumns({"__code": order_code(F.col("__score")), "__back": F.bitwise_not(F.col("__id"))})
    good = cut(good, "items")
    hot = cut(heavy_keys(good, groups, "__id", share).select(*groups), "hot")
    stats = cut(good.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min("__code").alias("low"), F.max("__code").alias("high")), "stats")
    marked = good.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), groups, "left").withColumn("__hot", F.coalesce("__hot", F.lit(False)))
    # groups within n items are whole; where n rows are more than a hot group's share, they meet by broadcast
    small = stats.where(F.col("n") <= n).select(*groups)
    hot_small = F.broadcast(small.join(F.broadcast(hot), groups, "left_semi"))
    whole = marked.where("not __hot").join(small, groups, "left_semi").unionByName(marked.where("__hot").join(hot_small, groups, "left_semi"))
    big = stats.where(F.col("n") > n)
    need = big.where("low < high").select(*groups, F.lit(n).cast("long").alias("wanted"), "low", "high")
    level = big.where("low = high").select(*groups, F.lit(n).cast("long").alias("still"))
    accepted, tied = _bisect(marked, groups, need, "__code", hot)
    flat = marked.where("not __hot").join(level, groups).unionByName(marked.where("__hot").join(F.broadcast(level.join(F.broadcast(hot), groups, "left_semi")), groups))
    tied = cut(tied.unionByName(flat), "tied")
    ids = cut(tied.groupBy(*groups).agg(F.first("still").alias("wanted"), F.min("__back").alias("low"), F.max("__back").alias("high")), "ids")
    by_id, rest = _bisect(tied.drop("still"), groups, ids, "__back", hot)
    # rows equal in score and identifier: any of them
    twin = Window.partitionBy(*groups).orderBy("__id")
    rest = rest.withColumn("__k", F.row_number().over(twin)).where("__k <= still").drop("__k", "still")
    columns = [*groups, "__id", "__score"]
    chosen = whole.select(*columns).unionByName(accepted.select(*columns)).unionByName(by_id.select(*columns)).unionByName(rest.select(*columns))
    order = Window.partitionBy(*groups).orderBy(F.desc("__score"), "__id")  # at most n rows a group
    return chosen.withColumn("rank", F.row_number().over(order)).withColumnsRenamed({"__id": ident, "__score": score})
