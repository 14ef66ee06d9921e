"""Group sums over particle files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 64) -> DataFrame:
    """A stream over the Parquet files of a folder with the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_masses(stream: DataFrame, keys: list[str], ident: str, stamp: str, lateness: str = "7 days") -> DataFrame:
    """Counts and mass per group, each particle id counted once within the lateness of its stamp.

    Rows without key, id, stamp or mass are left out. The state holds ids for the lateness and one row per group.
    """
    good = stream.where(F.col(ident).isNotNull() & F.col(stamp).isNotNull() & F.col("mass").isNotNull())
    for key in keys:
        good = good.where(F.col(key).isNotNull())
    once = good.withWatermark(stamp, lateness).dropDuplicatesWithinWatermark([ident])
    return once.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mass"))
