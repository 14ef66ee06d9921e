"""Tables of stellar models and filters.

A table is a folder of Parquet tables: ``grid`` (one row: version, wavelengths, log_ages, log_metals), ``models`` (one row
per grid point: metal and age places, spectrum, remaining mass fraction) and ``filters`` (name, effective wavelength and
transmission at the wavelengths). Its size is that of the grids, a few hundred megabytes at most, whatever the snapshot.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from astroloom.operators.photometry import Band, StellarModels, resolve_bands

VERSION = 1
logger = logging.getLogger("astroloom")


def write_table(spark: SparkSession, path: str, models: StellarModels, bands: list[Band]) -> None:
    """Writes a table; an existing folder is an error."""
    floats = lambda values: [float(v) for v in values]
    grid = [(models.version, floats(models.wavelengths), floats(models.log_ages), floats(models.log_metals))]
    spark.createDataFrame(grid, "version int, wavelengths array<double>, log_ages array<double>, log_metals array<double>").coalesce(1).write.parquet(f"{path}/grid.parquet")
    rows = [(j, i, floats(models.spectra[j, i]), float(models.remaining[j, i])) for j in range(len(models.log_metals)) for i in range(len(models.log_ages))]
    spark.createDataFrame(rows, "metal int, age int, spectrum array<double>, remaining double").coalesce(1).write.parquet(f"{path}/models.parquet")
    spark.createDataFrame([(b.name, float(b.effective), floats(b.transmission)) for b in bands], "name string, effective double, transmission array<double>").coalesce(1).write.parquet(f"{path}/filters.parquet")


def filters(spark: SparkSession, path: str) -> DataFrame:
    """Names and effective wavelengths of the filters of a table."""
    return spark.read.parquet(f"{path}/filters.parquet").select("name", "effective")


def read_table(spark: SparkSession, path: str, names: tuple[str, ...] = ("all",)) -> tuple[StellarModels, tuple[Band, ...]]:
    """(models, the named bands). A grid point that is missing, repeated or of another length than the grids is a ValueError.

    A table of another version is read with a warning. For names see :func:`resolve_bands`.
    """
    grid = spark.read.parquet(f"{path}/grid.parquet").first()
    if grid["version"] != VERSION:
        logger.warning("the photometry table has version %s, not %s", grid["version"], VERSION)
    waves, ages, metals = (np.array(grid[c]) for c in ("wavelengths", "log_ages", "log_metals"))
    points = spark.read.parquet(f"{path}/models.parquet").collect()  # one row per grid point
    places = {(r["metal"], r["age"]) for r in points}
    if len(points) != len(places) or places != {(j, i) for j in range(len(metals)) for i in range(len(ages))}:
        raise ValueError("the models do not fill the grid once")
    if any(len(r["spectrum"]) != len(waves) for r in points):
        raise ValueError("a spectrum does not fit the wavelengths")
    spectra, remaining = np.zeros((len(metals), len(ages), len(waves))), np.zeros((len(metals), len(ages)))
    for r in points:
        spectra[r["metal"], r["age"]], remaining[r["metal"], r["age"]] = r["spectrum"], r["remaining"]
    known = {r["name"]: r["effective"] for r in filters(spark, path).collect()}
    wanted = resolve_bands(list(names), known)
    rows = {r["name"]: r for r in spark.read.parquet(f"{path}/filters.parquet").collect()}
    if any(len(rows[n]["transmission"]) != len(waves) for n in wanted):
        raise ValueError("a filter does not fit the wavelengths")
    return StellarModels(ages, metals, waves, spectra, remaining, grid["version"]), tuple(Band(n, np.array(rows[n]["transmission"]), known[n]) for n in wanted)
