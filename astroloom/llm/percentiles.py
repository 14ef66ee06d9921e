"""Mergeable percentiles with bounded relative error from signed logarithmic buckets (problem 3)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astroloom.operators.skew import skew_join
from astroloom.tables import cut

#: Relative error of the percentiles.
ALPHA = 0.001
#: Parts of a bucket in the exact refinement.
PARTS = 4096


def bucket_of(value: Column, alpha: float = ALPHA) -> Column:
    """Signed logarithmic bucket: 0 for zero, else the index of the magnitude on a scale of fixed relative width.

    Bucket order is value order. Bounds of a bucket differ by the factor (1 + alpha) / (1 - alpha).
    """
    width = math.log1p(alpha) - math.log1p(-alpha)
    shift = math.ceil(745.2 / width) + 1  # the smallest positive double has a positive index
    index = F.ceil(F.log(F.abs(value)) / width) + shift
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, index).otherwise(-index).cast("long")


def sketch(rows: DataFrame, keys: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """Keys, ``bucket``, ``n``, ``least``, ``most``: counts per bucket with the smallest and largest value in it.

    Null, NaN and infinite values are not counted, rows with null keys form a group of their own. Counting happens
    on the map side first; what travels per key is bounded by the buckets its values occupy, not by its rows.
    """
    x = F.col(value).cast("double")
    good = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return good.groupBy(*keys, bucket_of(x, alpha).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of several partitions or days as one: bucket counts are added where ``keys`` are equal."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def percentiles(sketches: DataFrame, keys: list[str], qs: list[int]) -> DataFrame:
    """Keys, ``n``, and per q ``p<q>`` with bounds ``p<q>_low``, ``p<q>_high``, ``p<q>_bucket`` and ``p<q>_at``.

    The q-percentile is the value at rank ceil(q n / 100), at least 1. Low and high are values of the data that
    enclose it; ``p<q>`` lies within alpha of it in relation to its magnitude. ``_at`` is the rank within the bucket.
    ``sketches`` holds one row per key and bucket. The window sorts the buckets of one key, not its rows.
    """
    order = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = sketches.withColumns({"__run": F.sum("n").over(order), "__n": F.sum("n").over(Window.partitionBy(*keys))})
    columns = []
    for q in qs:
        rank = F.greatest(F.lit(1), F.floor((F.lit(q) * F.col("__n") + 99) / 100))
        here = (F.col("__run") >= rank) & (F.col("__run") - F.col("n") < rank)
        columns.append(F.max(F.when(here, F.struct("least", "most", "bucket", (rank - F.col("__run") + F.col("n")).cast("long").alias("at")))).alias(f"__{q}"))
    out = run.groupBy(*keys).agg(F.max("__n").alias("n"), *columns)
    for q in qs:
        low, high = F.col(f"__{q}.least"), F.col(f"__{q}.most")
        middle = F.when(low * high > 0, 2 * low * high / (low + high)).otherwise(low)
        out = out.withColumns({f"p{q}": middle, f"p{q}_low": low, f"p{q}_high": high, f"p{q}_bucket": F.col(f"__{q}.bucket"), f"p{q}_at": F.col(f"__{q}.at")}).drop(f"__{q}")
    return out


def exact(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame, ident: str, alpha: float = ALPHA) -> DataFrame:
    """Exact values for ``wanted`` (keys, q, bucket, at, least, most): keys, q, ``exact``.

    Only rows of wanted buckets are looked at. A wanted bucket is cut into parts of equal width between its
    smallest and largest value; counts (map-side first) tell the part that holds the rank, and only the distinct
    values of that part are put in order. Buckets that hold one value need no rows at all.
    """
    done = wanted.where("least = most").select(*keys, "q", F.col("least").alias("exact"))
    open_ = cut(wanted.where("least < most"), "wanted")
    x = F.col(value).cast("double")
    good = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*keys, F.col(ident).alias("__ident"), x.alias("__x"), bucket_of(x, alpha).alias("bucket"))
    buckets = open_.groupBy(*keys, "bucket").agg(F.first("least").alias("least"), F.first("most").alias("most"))
    inside = skew_join(good, buckets, [*keys, "bucket"], "__ident")
    part = F.least(F.lit(PARTS - 1), F.floor((F.col("__x") - F.col("least")) / (F.col("most") - F.col("least")) * PARTS)).cast("int")
    counted = cut(inside.groupBy(*keys, "bucket", part.alias("part"), "__x").agg(F.count(F.lit(1)).alias("n")), "counted")
    parts = counted.groupBy(*keys, "bucket", "part").agg(F.sum("n").alias("n"))
    along = Window.partitionBy(*keys, "bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("run", F.sum("n").over(along))
    chosen = open_.select(*keys, "q", "bucket", "at").join(parts, [*keys, "bucket"]).where("run >= at and run - n < at")
    chosen = chosen.select(*keys, "q", "bucket", "part", (F.col("at") - F.col("run") + F.col("n")).alias("at"))
    inner = Window.partitionBy(*keys, "bucket", "part").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    needed = counted.join(chosen.select(*keys, "bucket", "part").distinct(), [*keys, "bucket", "part"], "left_semi")
    ranked = needed.withColumn("run", F.sum("n").over(inner))
    found = chosen.join(ranked, [*keys, "bucket", "part"]).where("run >= at and run - n < at").select(*keys, "q", F.col("__x").alias("exact"))
    return done.unionByName(found)
