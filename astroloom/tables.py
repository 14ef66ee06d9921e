"""Reading the tables of a data directory, newest-row rule, and written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NO_HALO = -1


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table, with only the named columns read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest(df: DataFrame, key: str, stamp: str) -> DataFrame:
    """The newest row of every key.

    Rows that share ``key`` are one record; the row with the newest ``stamp`` is valid, a null stamp
    being older than any other. Rows with a null key cannot be told apart and are left out. Rows equal
    in key and stamp are taken to be equal, so any one of them is kept. One exchange on ``key``; the rank
    limit is applied before it, so repeated rows of one input partition do not travel.
    """
    order = Window.partitionBy(key).orderBy(F.col(stamp).desc_nulls_last())
    return df.where(F.col(key).isNotNull()).withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def in_halo(column: str = "haloid") -> Column:
    return F.col(column).isNotNull() & (F.col(column) != NO_HALO)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``.

    Where the session sets none, a local master gets a temporary folder that is removed at exit; on a
    cluster the setting is required, since a machine-local folder is not visible to other executors.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or getattr(context, "_astroloom_folder", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="astroloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context._astroloom_folder = f"file://{folder}"
    return context._astroloom_folder


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here and survives lost executors.

    Unlike a block-manager checkpoint the table is columnar and compressed, later reads prune columns and
    the planner knows its size. The caller decides when to remove it with :func:`drop_cut`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._astroloom_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Removes a table written by :func:`cut` that no later plan reads."""
    path = getattr(df, "_astroloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
