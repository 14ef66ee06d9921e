"""Session defaults. Only settings that the caller has not made are filled in."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(name: str = "astroloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``_`` for ``.`` or are given verbatim."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def local_session(cores: int | None = None, memory: str = "12g", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    cores = cores or os.cpu_count() or 4
    return build_session(
        master=f"local[{cores}]",
        **{
            "spark.driver.memory": memory,
            "spark.sql.shuffle.partitions": str(shuffle),
            "spark.driver.host": "127.0.0.1",
        },
    )


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, which need not find it on their own path; once per session."""
    context = spark.sparkContext
    if getattr(context, "_astroloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="astroloom-")  # on the driver, which serves it to the workers
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(os.path.join(folder, "astroloom"), "zip", root, "astroloom"))
    context._astroloom_shipped = True
