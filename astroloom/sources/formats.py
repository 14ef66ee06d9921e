"""Snapshot formats as column maps and expressions over columnar particle tables.

A snapshot is a folder with one Parquet table per particle type group (``PartType0`` ...) under the format's own column
names, and a one-row ``Header`` table. Reading gives the engine's names and units; derived columns are expressions, so
the scan prunes to what is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from astroloom.functions import physics as P

# Particle type groups, and the name of each column in every format.
PTYPES = {"PartType0": "gas", "PartType1": "dm", "PartType4": "star", "PartType5": "bh"}
PTYPE_CODES = {"gas": 0, "dm": 1, "star": 4, "bh": 5}
SWIFT_COLUMNS = {
    "pos": "Coordinates", "vel": "Velocities", "mass": "Masses", "potential": "Potentials", "internal_energy": "InternalEnergies", "rho": "Densities",
    "sfr": "StarFormationRates", "age": "BirthScaleFactors", "metallicity": "MetalMassFractions", "temperature": "Temperatures", "helium_fraction": "ElementMassFractions",
    "bhmass": "SubgridMasses", "bhmdot": "AccretionRates", "smoothing_length": "SmoothingLengths", "particle_id": "ParticleIDs", "halo_id": "FOFGroupIDs",
}
GADGET_COLUMNS = {
    "pos": "Coordinates", "vel": "Velocities", "mass": "Masses", "potential": "Potential", "HI_abundance": "NeutralHydrogenAbundance", "internal_energy": "InternalEnergy",
    "electron_abundance": "ElectronAbundance", "rho": "Density", "bhmass": "BH_Mass", "bhmdot": "BH_Mdot", "particle_id": "ParticleIDs",
}
SIMBA_COLUMNS = {"H2_fraction": "FractionH2", "sfr": "StarFormationRate", "age": "StellarFormationTime", "metallicity": "Metallicity", "helium_fraction": "Metallicity", "dust_mass": "Dust_Masses", "smoothing_length": "SmoothingLength", "halo_id": "HaloID"}
TNG_COLUMNS = {"sfr": "StarFormationRate", "age": "GFM_StellarFormationTime", "metallicity": "GFM_Metallicity", "helium_fraction": "GFM_Metals", "smoothing_length": "SubfindHsml"}
SIMBA_ELEMENTS = (None, "He", "C", "N", "O", "Ne", "Mg", "Si", "S", "Ca", "Fe")
TNG_ELEMENTS = ("H", "He", "C", "N", "O", "Ne", "Mg", "Si", "Fe", None)
#: The long chemistry holds all elements in order after a total and before a rest.
LONG_ELEMENTS = (None, *dict.fromkeys(s for s in P.ELEMENT_SYMBOLS.values()), None)
SWIFT_NO_HALO = 2147483647

Derived = Callable[["SnapshotFormat", Callable[[str], Column], P.Header], Column]


@dataclass(frozen=True)
class SnapshotFormat:
    name: str
    columns: dict[str, str]
    places: dict[str, int] = field(default_factory=dict)
    overrides: dict[tuple[str, str], str] = field(default_factory=dict)
    elements: tuple[str | None, ...] = ()
    element_column: str | None = None
    swift: bool = False
    derived: dict[str, Derived] = field(default_factory=dict)
    header_dm_mass: bool = False

    def decode_halo(self, raw: Column) -> Column:
        """Halo numbers from 0; -1 for none."""
        if self.swift:
            return F.when((raw == SWIFT_NO_HALO) | raw.isNull(), F.lit(-1)).otherwise(raw - 1)
        return F.coalesce(raw - 1, F.lit(-1))

    def encode_halo(self, ident: Column) -> Column:
        if self.swift:
            return F.when(ident < 0, F.lit(SWIFT_NO_HALO)).otherwise(ident + 1)
        return ident + 1


def _phase(species: str, factor: float = 1.0) -> Derived:
    def build(fmt, read, header):
        return P.clipped_fraction(1 - read("helium_fraction") - read("metallicity"), factor * read(species), read("mass"))

    return build


def _tng(which: int) -> Derived:
    def build(fmt, read, header):
        return P.neutral_and_molecular(*[read(c) for c in ("internal_energy", "sfr", "HI_abundance", "electron_abundance", "rho", "helium_fraction", "metallicity", "mass")])[which]

    return build


def _temperature(fmt, read, header):
    return P.gas_temperature(read("internal_energy"), read("electron_abundance"), read("helium_fraction"))


def _age(fmt, read, header):
    return P.stellar_age(read("age"), header.cosmology, float(header.cosmology.age(header.redshift)[0]))


def _clean_sfr(fmt, read, header):
    return F.greatest(read("sfr"), F.lit(0.0))


_SWIFT = {"swift": True, "places": {"helium_fraction": 1}, "overrides": {("bh", "mass"): "DynamicalMasses"}, "element_column": "ElementMassFractions"}
_SWIFT_DERIVED = {"sfr": _clean_sfr, "age": _age}
_GADGET_DERIVED = {"temperature": _temperature, "age": _age}
FORMATS = {
    f.name: f
    for f in (
        SnapshotFormat("SIMBA", {**GADGET_COLUMNS, **SIMBA_COLUMNS}, {"helium_fraction": 1, "metallicity": 0}, {}, SIMBA_ELEMENTS, "Metallicity", derived={**_GADGET_DERIVED, "mass_HI": _phase("HI_abundance"), "mass_H2": _phase("H2_fraction")}),
        SnapshotFormat("SIMBA-C", {**GADGET_COLUMNS, **SIMBA_COLUMNS}, {"helium_fraction": 2, "metallicity": 0}, {}, LONG_ELEMENTS, "Metallicity", derived={**_GADGET_DERIVED, "mass_HI": _phase("HI_abundance"), "mass_H2": _phase("H2_fraction")}),
        SnapshotFormat("TNG", {**GADGET_COLUMNS, **TNG_COLUMNS}, {"helium_fraction": 1}, {}, TNG_ELEMENTS, "GFM_Metals", derived={**_GADGET_DERIVED, "mass_HI": _tng(0), "mass_H2": _tng(1)}, header_dm_mass=True),
        SnapshotFormat("SWIFT-KIARA", {**SWIFT_COLUMNS, "mass_HI": "AtomicHydrogenMasses", "mass_H2": "MolecularHydrogenMasses", "dust_mass": "DustMasses"}, derived=_SWIFT_DERIVED, **_SWIFT),
        SnapshotFormat("SWIFT-EAGLE", {**SWIFT_COLUMNS, "mass_HI": "AtomicHydrogenMasses", "mass_H2": "MolecularHydrogenMasses"}, derived=_SWIFT_DERIVED, **_SWIFT),
        SnapshotFormat(
            "SWIFT-COLIBRE", {**SWIFT_COLUMNS, "dust_mass_fractions": "TotalDustMassFractions", "species_HI": "SpeciesFractions", "species_H2": "SpeciesFractions"},
            derived={**_SWIFT_DERIVED, "mass_HI": _phase("species_HI"), "mass_H2": _phase("species_H2", 2.0), "dust_mass": lambda f, read, h: read("dust_mass_fractions") * read("mass")},
            **{**_SWIFT, "places": {"helium_fraction": 1, "species_HI": 1, "species_H2": 7}},
        ),
    )
}


def build_format(name: str) -> SnapshotFormat:
    try:
        return FORMATS[name.upper()]
    except KeyError:
        raise ValueError(f"simulation type {name!r} is none of {sorted(FORMATS)}") from None


@dataclass
class Snapshot:
    """A snapshot on disk: :meth:`read` gives the named columns of one particle type in the engine's units."""

    spark: SparkSession
    path: str
    format: SnapshotFormat
    header: P.Header
    unit_factors: dict[str, float] = field(default_factory=dict)
    dm_mass: float | None = None

    def table(self, ptype: str) -> DataFrame:
        group = next(g for g, p in PTYPES.items() if p == ptype)
        return self.spark.read.parquet(f"{self.path}/{group}.parquet")

    def positions(self, ptype: str) -> DataFrame:
        """(particle_id, position): the places of a type's rows in the snapshot's files, from 0."""
        from astroloom.sources.halo_sources import file_places

        name = self.format.columns["particle_id"]
        return file_places(self.table(ptype), name, "position").select(F.col(name).cast("long").alias("particle_id"), "position")

    def factor(self, column: str) -> float:
        return self.unit_factors.get(column, 1.0 if self.format.swift else P.gadget_unit_factor(column, self.header.h, self.header.scale_factor))

    def element_names(self, ptype: str, names: list[str] | None = None) -> dict[str, int]:
        """``fraction_<symbol>`` columns with their places; from the format, or from the given full names."""
        listed = [P.ELEMENT_SYMBOLS.get(n, n) for n in names] if names else self.format.elements
        return {f"fraction_{s}": i for i, s in enumerate(listed) if s}

    def available(self, ptype: str) -> set[str]:
        have = set(self.table(ptype).columns)
        raw = {c for c, n in self.format.columns.items() if self.format.overrides.get((ptype, c), n) in have}
        if ptype == "dm" and self.dm_mass is not None:
            raw.add("mass")
        return raw | (set(self.format.derived) if ptype == "gas" else set()) | (set(self.element_names(ptype)) if self.format.element_column in have else set())

    def read(self, ptype: str, columns: list[str]) -> DataFrame:
        """The columns in the order asked for; vectors come as <name>x, <name>y, <name>z with pos as x, y, z and vel as vx, vy, vz.

        A column that the format does not know, or whose raw column is absent, is a KeyError that lists the
        elements where an element was asked for.
        """
        df = self.table(ptype)
        elements = self.element_names(ptype)

        def raw(name: str) -> Column:
            if ptype == "dm" and name == "mass" and self.format.header_dm_mass and self.dm_mass is not None:
                return F.lit(self.dm_mass * self.factor("mass"))
            if name in elements and self.format.element_column in df.columns:
                return F.get(F.col(self.format.element_column), F.lit(elements[name])).cast("double")
            source = self.format.overrides.get((ptype, name), self.format.columns.get(name))
            if source is None or source not in df.columns:
                if name.startswith("fraction_"):
                    raise KeyError(f"{ptype} has no {name}; elements: {sorted(elements)}")
                raise KeyError(f"{ptype} has no column {name}")
            column = F.col(source)
            if name in self.format.places and df.schema[source].dataType.simpleString().startswith("array"):
                column = F.get(column, F.lit(self.format.places[name]))
            elif name == "metallicity" and df.schema[source].dataType.simpleString().startswith("array"):
                column = F.get(column, F.lit(0))
            if name == "halo_id":
                return self.format.decode_halo(column.cast("long"))
            if name == "particle_id":
                return column.cast("long")
            return column.cast("double") * self.factor(name) if name not in ("pos", "vel") else column

        out = []
        for name in columns:
            if name in ("pos", "vel"):
                vector = raw(name)
                out += [(F.get(vector, F.lit(i)).cast("double") * self.factor(name)).alias(("" if name == "pos" else "v") + axis) for i, axis in enumerate("xyz")]
            elif name in self.format.derived and (ptype == "gas" or name == "age"):
                out.append(self.format.derived[name](self.format, raw, self.header).alias(name))
            else:
                out.append(raw(name).alias(name))
        return df.select(*out)


def open_snapshot(spark: SparkSession, path: str, simulation: str) -> Snapshot:
    """The snapshot with its header. The ``Header`` table has boxsize, h, scale_factor, omega_matter and, where known,
    omega_lambda, w_0, w_a, t_cmb, n_star, n_gas, dm_mass and unit attributes ``units`` (map of column to cgs, a and h exponents)."""
    fmt = build_format(simulation)
    row = spark.read.parquet(f"{path}/Header.parquet").first().asDict()
    if isinstance(row["boxsize"], list):
        if len(set(row["boxsize"])) != 1:
            raise ValueError("the box is not cubic")
        row["boxsize"] = row["boxsize"][0]
    h, a = row["h"], row["scale_factor"]
    cosmology = P.Cosmology(h, row["omega_matter"], row.get("omega_lambda") if not fmt.swift else None, row.get("w_0") or -1.0, row.get("w_a") or 0.0, (row.get("t_cmb") or 0.0) if fmt.swift else 0.0)
    header = P.Header(row["boxsize"] / (1 if fmt.swift else h), h, a, 1 / a - 1, cosmology, row.get("n_star") or 0, row.get("n_gas") or 0)
    factors = {}
    for column, unit in (row.get("units") or {}).items():
        target, power = CODE_UNITS.get(column, (1.0, 0))
        factors[column] = P.swift_unit_factor(unit["cgs"], unit["a_exponent"], unit["h_exponent"], target, power, h, a)
    return Snapshot(spark, path, fmt, header, factors, row.get("dm_mass"))


# The engine's units as (cgs, power of a).
CODE_UNITS = {
    "pos": (P.KPC_CM, 1), "smoothing_length": (P.KPC_CM, 1), "vel": (1e5, 0), "mass": (P.M_SUN_G, 0), "bhmass": (P.M_SUN_G, 0), "mass_HI": (P.M_SUN_G, 0), "mass_H2": (P.M_SUN_G, 0),
    "dust_mass": (P.M_SUN_G, 0), "potential": (1e10, 0), "internal_energy": (1.0, 0), "rho": (1.0, 0), "sfr": (P.M_SUN_G / P.YEAR_S, 0), "bhmdot": (P.M_SUN_G / P.YEAR_S, 0), "temperature": (1.0, 0),
}


def elements(df: DataFrame, column: str, symbols: list[str | None]) -> DataFrame:
    """``df`` with ``fraction_<symbol>`` for each named place of an array column; places without a name are skipped.

    An array shorter than the names gives null.
    """
    return df.withColumns({f"fraction_{s}": F.get(F.col(column), F.lit(i)).cast("double") for i, s in enumerate(symbols) if s})


def read_subset(df: DataFrame, wanted: DataFrame, ident: str = "pidx") -> DataFrame:
    """Rows whose id is wanted, each once; the ids are a semi-join, so scans can use them as a runtime filter."""
    return df.join(wanted.select(ident).distinct(), ident, "left_semi")
