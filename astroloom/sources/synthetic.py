"""Deterministic synthetic particles and snapshots from integer hashes: the same rows on any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from astroloom.sources.formats import FORMATS, PTYPES, SWIFT_NO_HALO

# Sizes and ranges of the small test snapshots.
COUNTS = {"gas": 240, "dm": 250, "star": 50, "bh": 2}
BOX, H, SCALE_FACTOR, OMEGA_MATTER = 500.0, 0.68, 0.25, 0.3
HALOES, INTERLOPERS, SCATTER, SPEED = 3, 0.15, 0.25, 1.5
ELEMENTS = 11


def uniform(row: Column, what: str, low: float = 0.0, high: float = 1.0, seed: int = 2371434) -> Column:
    """A value in [low, high) from a hash of row, name and seed."""
    bits = F.pmod(F.xxhash64(F.lit(seed), F.lit(what), row), F.lit(1 << 53))
    return F.lit(low) + bits / float(1 << 53) * (high - low)


def normal(row: Column, what: str, mean: Column, sigma: float) -> Column:
    """Box-Muller from two hashes."""
    u, v = F.greatest(uniform(row, f"{what}.u"), F.lit(1e-12)), uniform(row, f"{what}.v")
    return mean + sigma * F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)


def particles(spark: SparkSession, counts: dict[str, int] | None = None, seed: int = 2371434) -> DataFrame:
    """Particles of all types in a few clumps with interlopers, in the engine's columns and units."""
    parts, first = [], 0
    for code, (ptype, n) in enumerate((counts or COUNTS).items()):
        row = F.col("id") + code * 10_000_000
        halo = F.when(uniform(row, "stray", seed=seed) < INTERLOPERS, F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.lit(seed), F.lit("halo"), row), F.lit(HALOES)))
        rows = spark.range(n).withColumn("halo_id", halo.cast("long"))
        for c in "xyz":
            centre = uniform(F.col("halo_id"), f"centre.{c}", 100, 400, seed)
            drift = normal(F.col("halo_id"), f"drift.{c}", F.lit(0.0), 100.0)
            rows = rows.withColumn(c, F.when(F.col("halo_id") < 0, uniform(row, c, 0, BOX, seed)).otherwise(F.pmod(normal(row, c, centre, SCATTER), F.lit(BOX))))
            rows = rows.withColumn(f"v{c}", normal(row, f"v{c}", F.when(F.col("halo_id") < 0, F.lit(0.0)).otherwise(drift), SPEED))
        value = lambda name, low, high: uniform(row, name, low, high, seed)  # noqa: B023,E731
        only = lambda kinds, column: column if ptype in kinds else F.lit(None).cast("double")  # noqa: B023,E731
        mass = value("mass", 1e6, 1e8)
        parts.append(rows.select(
            F.lit(ptype).alias("ptype"), (F.col("id") + first).alias("pidx"), "halo_id", *"xyz", "vx", "vy", "vz", mass.alias("mass"), value("potential", -1e4, -1).alias("potential"),
            only(("gas",), value("rho", 1e-26, 1e-22)).alias("rho"), only(("gas",), value("temperature", 1e3, 1e6)).alias("temperature"), only(("gas",), value("sfr", 0, 10)).alias("sfr"),
            only(("gas", "star"), value("metallicity", 0, 0.05)).alias("metallicity"), only(("gas",), value("helium_fraction", 0.2, 0.3)).alias("helium_fraction"), only(("star",), value("age", 0.05, 2)).alias("age"),
            only(("gas",), value("hi", 0, 1) * mass).alias("mass_HI"), only(("gas",), value("h2", 0, 1) * mass).alias("mass_H2"), only(("gas",), value("h", 1, 10)).alias("smoothing_length"),
            only(("bh",), value("bhmass", 1e4, 1e7)).alias("bhmass"), only(("bh",), value("bhmdot", 0, 1e-4)).alias("bhmdot"),
        ))
        first += n
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_snapshot(spark: SparkSession, path: str, simulation: str, seed: int = 2371434) -> None:
    """A small snapshot folder under a format's own column names and code units, with its header."""
    fmt = FORMATS[simulation]
    rows = particles(spark, seed=seed)
    for group, ptype in PTYPES.items():
        own = rows.where(F.col("ptype") == ptype)
        halo = F.when(F.col("halo_id") < 0, F.lit(SWIFT_NO_HALO)).otherwise(F.col("halo_id") + 1) if fmt.swift else F.col("halo_id") + 1
        scale = 1.0 if fmt.swift else H
        array = lambda name, n=ELEMENTS: F.array(*[uniform(F.col("pidx"), f"{name}{i}", 0, 0.05) for i in range(n)])
        columns = {
            "pos": F.array(*[F.col(c) * scale for c in "xyz"]), "vel": F.array("vx", "vy", "vz"), "mass": F.col("mass") / 1e10 * scale, "potential": F.col("potential"), "particle_id": F.col("pidx"), "halo_id": halo,
            "internal_energy": uniform(F.col("pidx"), "u", 1e3, 1e5), "electron_abundance": uniform(F.col("pidx"), "e", 0, 1.16), "rho": uniform(F.col("pidx"), "rho", 1e-6, 1e-2), "sfr": F.col("sfr") - 1,
            "HI_abundance": uniform(F.col("pidx"), "hi", 0, 1), "H2_fraction": uniform(F.col("pidx"), "h2", 0, 1), "temperature": F.col("temperature"), "age": uniform(F.col("pidx"), "a", 0.05, 0.25),
            "mass_HI": F.col("mass_HI") / 1e10, "mass_H2": F.col("mass_H2") / 1e10, "dust_mass": uniform(F.col("pidx"), "dust", 1e-5, 1e-3), "dust_mass_fractions": uniform(F.col("pidx"), "dustf", 0, 0.05),
            "bhmass": uniform(F.col("pidx"), "bhm", 1e-6, 1e-3), "bhmdot": uniform(F.col("pidx"), "bhd", 0, 1e-4), "smoothing_length": F.col("smoothing_length") * scale,
            "metallicity": array("Z") if "metallicity" in fmt.places else uniform(F.col("pidx"), "Z0", 0, 0.05), "helium_fraction": array("Z", len(fmt.elements) or ELEMENTS), "species_HI": array("S"), "species_H2": array("S"),
        }
        kinds = {"gas": set(columns) - {"bhmass", "bhmdot", "age"}, "star": {"pos", "vel", "mass", "potential", "particle_id", "halo_id", "age", "metallicity", "helium_fraction"}, "dm": {"pos", "vel", "mass", "potential", "particle_id", "halo_id"}, "bh": {"pos", "vel", "mass", "potential", "particle_id", "halo_id", "bhmass", "bhmdot"}}[ptype]
        named = {}
        for column in sorted(kinds & set(fmt.columns)):
            named[fmt.overrides.get((ptype, column), fmt.columns[column])] = columns[column]
        own.select(*[c.alias(n) for n, c in named.items()]).coalesce(1).write.mode("overwrite").parquet(f"{path}/{group}.parquet")
    header = {"boxsize": BOX * (1 if fmt.swift else H), "h": H, "scale_factor": SCALE_FACTOR, "omega_matter": OMEGA_MATTER, "omega_lambda": 0.7, "t_cmb": 2.73, "n_star": COUNTS["star"], "n_gas": COUNTS["gas"], "dm_mass": 1e-3 if fmt.header_dm_mass else None}
    types = ", ".join(f"{k} {'long' if k.startswith('n_') else 'double'}" for k in header)
    spark.createDataFrame([tuple(header.values())], types).coalesce(1).write.mode("overwrite").parquet(f"{path}/Header.parquet")
