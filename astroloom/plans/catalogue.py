"""Catalogues: deterministic tables of groups and memberships with units, and reading them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from astroloom.operators.hierarchy import descendants, resolve_forest
from astroloom.operators.membership import order_groups, remap
from astroloom.plans.stages import declared_columns, fill_lists

FORMAT_VERSION = 1


def finish(groups: DataFrame, mass: str, depth: str | None = None, pointers: tuple[str, ...] = ()) -> DataFrame:
    """Groups in catalogue order with ``row`` from 0 and pointers to ids turned into pointers to rows; columns that begin with '_' go."""
    ordered = order_groups(groups, mass, "id", depth)
    for p in pointers:
        ordered = remap(ordered, p, "id", "row", f"{p}_row").drop(p).withColumnRenamed(f"{p}_row", p)
    return ordered.select(*[c for c in ordered.columns if not c.startswith("_")])


def with_units(df: DataFrame, lists: dict | None = None) -> DataFrame:
    """Columns that the stages declare get unit, power of a and description as metadata."""
    known = declared_columns(lists or fill_lists())
    for name in df.columns:
        if name in known:
            out = known[name][1]
            df = df.withMetadata(name, {"unit": out.unit, "a_exponent": out.a_exponent, "description": out.description})
    return df


def write(path: str, haloes: DataFrame, galaxies: DataFrame, members: DataFrame, header: dict, config: str = "{}", overwrite: bool = False, lists: dict | None = None, codec: str = "zstd") -> None:
    """Writes haloes, galaxies, membership (kind, row, ptype, pidx), header, metadata of columns and the configuration.

    Groups are range-partitioned by row and members by (kind, row, ptype, pidx), so files are contiguous blocks.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    spark = haloes.sparkSession
    for name, df in (("haloes", haloes), ("galaxies", galaxies)):
        with_units(df, lists).repartitionByRange("row").sortWithinPartitions("row").write.mode(mode).option("compression", codec).parquet(f"{path}/{name}.parquet")
    order = ["kind", "row", "ptype", "pidx"]
    members.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).option("compression", codec).parquet(f"{path}/membership.parquet")
    rows = [(k, float(v)) for k, v in header.items()]
    spark.createDataFrame(rows, "name string, value double").coalesce(1).write.mode(mode).parquet(f"{path}/header.parquet")
    spark.createDataFrame([(FORMAT_VERSION, config)], "version int, config string").coalesce(1).write.mode(mode).parquet(f"{path}/metadata.parquet")


def recompress(spark: SparkSession, path: str, out: str, codec: str = "zstd") -> None:
    """Rewrites every table of a catalogue under another codec into a new folder."""
    for name in ("haloes", "galaxies", "membership", "header", "metadata"):
        spark.read.parquet(f"{path}/{name}.parquet").write.option("compression", codec).parquet(f"{out}/{name}.parquet")


class Groups:
    """Columns of haloes or galaxies with units."""

    def __init__(self, df: DataFrame, scale_factor: float, kind: str):
        self.df, self.scale_factor, self.kind = df, scale_factor, kind

    def keys(self) -> list[str]:
        return [c for c in self.df.columns if c != "row"]

    def attributes(self, name: str) -> dict:
        if name not in self.df.columns:
            raise KeyError(name)
        return dict(self.df.schema[name].metadata)

    def units(self, name: str) -> str:
        return self.attributes(name).get("unit", "")

    def is_comoving(self, name: str) -> bool:
        return self.attributes(name).get("a_exponent", 0) != 0

    def column(self, name: str, factor: float = 1.0, physical: bool = False) -> Column:
        power = self.attributes(name).get("a_exponent", 0) if physical else 0
        scale = factor * self.scale_factor**power
        return F.col(name) if scale == 1.0 else (F.col(name) * scale)

    def get(self, *names: str, mask: Column | str | None = None, factors: list[float] | None = None, physical: bool = False) -> DataFrame:
        """Rows in catalogue order with the named columns; ``factors`` convert units, one for each name."""
        if factors is not None and len(factors) != len(names):
            raise ValueError("one factor for each column")
        rows = self.df.where(mask) if mask is not None else self.df
        return rows.orderBy("row").select("row", *[self.column(n, f, physical).alias(n) for n, f in zip(names, factors or [1.0] * len(names))])

    def describe(self) -> list[tuple[str, str, int, str]]:
        return [(n, self.units(n), self.attributes(n).get("a_exponent", 0), self.attributes(n).get("description", "")) for n in self.keys()]


class Catalogue:
    """A written catalogue; refuses formats newer than its own."""

    def __init__(self, spark: SparkSession, path: str):
        meta = spark.read.parquet(f"{path}/metadata.parquet").first()
        if meta["version"] > FORMAT_VERSION:
            raise ValueError(f"the catalogue has format {meta['version']}, newer than {FORMAT_VERSION}")
        self.spark, self.path, self.config = spark, path, json.loads(meta["config"])
        self.header = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/header.parquet").collect()}  # header scalars
        a = self.header.get("scale_factor", 1.0)
        self.haloes = Groups(spark.read.parquet(f"{path}/haloes.parquet"), a, "haloes")
        self.galaxies = Groups(spark.read.parquet(f"{path}/galaxies.parquet"), a, "galaxies")
        self.membership = spark.read.parquet(f"{path}/membership.parquet")

    def _check(self, groups: Groups, row: int) -> None:
        if row < 0 or groups.df.where(F.col("row") == row).isEmpty():
            raise IndexError(f"no row {row} in {groups.kind}")

    def particles(self, kind: str, row: int, ptype: str) -> DataFrame:
        """Snapshot indices of one group's members of a type, ascending."""
        self._check(getattr(self, kind), row)
        return self.membership.where((F.col("kind") == kind) & (F.col("row") == row) & (F.col("ptype") == ptype)).select("pidx").orderBy("pidx")

    def _forest(self):
        return resolve_forest(self.haloes.df.select("row", "parent_halo_index"), "row", "parent_halo_index", -1)

    def subhaloes(self, row: int) -> DataFrame:
        """Rows of all haloes below a halo."""
        self._check(self.haloes, row)
        return descendants(self._forest(), F.col("id") == row).select(F.col("descendant").alias("row"))

    def galaxies_of(self, row: int) -> DataFrame:
        """Rows of the galaxies in a halo or below it; the first is the central one."""
        self._check(self.haloes, row)
        below = self.subhaloes(row).unionByName(self.spark.range(row, row + 1).toDF("row")).withColumnRenamed("row", "parent_halo_index")
        return self.galaxies.df.join(below, "parent_halo_index", "left_semi").select("row").orderBy("row")

    def member_data(self, particles: DataFrame, kind: str, rows: list[int], ptype: str, column: str) -> DataFrame:
        """(place, row, pidx, column): member values of listed groups, in the order of the list with its repeats."""
        asked = self.spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "place int, row long")
        edges = self.membership.where((F.col("kind") == kind) & (F.col("ptype") == ptype)).join(F.broadcast(asked), "row")
        return edges.join(particles.where(F.col("ptype") == ptype).select("pidx", column), "pidx").select("place", "row", "pidx", column)


class Analyser:
    """Runs the same stage functions on the members of selected groups."""

    def __init__(self, catalogue: Catalogue, particles: DataFrame):
        self.catalogue, self.particles = catalogue, particles

    def members(self, kind: str, rows: list[int]) -> DataFrame:
        """Particles of the selected groups, keyed by ``row``; only their rows are read."""
        wanted = self.catalogue.spark.createDataFrame([(r,) for r in sorted(set(rows))], "row long")
        edges = self.catalogue.membership.where(F.col("kind") == kind).join(F.broadcast(wanted), "row").select("row", "ptype", "pidx")
        return edges.join(self.particles, ["ptype", "pidx"])

    def run(self, stage, kind: str, rows: list[int], **settings) -> DataFrame:
        """A stage function of (members, keys, ...) on the selected groups, keyed by ``row``."""
        return stage(self.members(kind, rows), ["row"], **settings)

    def difference(self, result: DataFrame, kind: str, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
        """Groups whose recomputed columns differ from the stored ones."""
        stored = getattr(self.catalogue, kind).df.select("row", *[F.col(c).alias(f"stored_{c}") for c in columns])
        unequal = [~(F.col(c).eqNullSafe(F.col(f"stored_{c}"))) & (F.abs(F.col(c) - F.col(f"stored_{c}")) > tolerance * F.abs(F.col(f"stored_{c}"))) for c in columns]
        test = unequal[0]
        for u in unequal[1:]:
            test = test | u
        return result.join(stored, "row").where(F.coalesce(test, F.lit(True)))
