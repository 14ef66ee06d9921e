"""Queries of the engine's own operators over the shared tables, with their SQL counterparts.

``particles`` rows in haloes are the members, (run_id, haloid) the groups. Columns that the table lacks (density, HI and H2
mass, helium) are fixed expressions of those it has, the same in both dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astroloom.functions import dust as D
from astroloom.functions import physics as P
from astroloom.operators import groups as G
from astroloom.operators import lightcone as L
from astroloom.operators import membership as M
from astroloom.operators import photometry as PH
from astroloom.operators import spatial as S
from astroloom.operators.hierarchy import resolve_forest
from astroloom.sources import formats, halo_sources
from astroloom.tables import cut, in_halo, latest, table

BOX = 500.0
KEYS = ["run_id", "haloid"]
FULL = ("gas", "dm", "star", "bh")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid particles with mass and position that lie in a halo."""
    rows = latest(table(spark, sf_dir, "particles"), "particle_id", "ingested_at").where(in_halo() & F.col("mass").isNotNull() & F.col("pos").isNotNull())
    hidden = F.col("particle_id") % 97
    return rows.select(
        *KEYS, "ptype", F.col("particle_id").alias("pidx"), *[F.get("pos", F.lit(i)).alias(c) for i, c in enumerate("xyz")], *[F.get("vel", F.lit(i)).alias(f"v{c}") for i, c in enumerate("xyz")],
        "mass", "potential", "temperature", "metallicity", "age", "sfr", "smoothing_length", "bhmass", "bhmdot", "snap_id", "slab",
        (F.col("mass") * hidden / 128.0).alias("mass_HI"), (F.col("mass") * (96 - hidden) / 256.0).alias("mass_H2"), (hidden * 1e-26).alias("rho"),
    )


_BASE = """WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY particle_id ORDER BY ingested_at DESC) AS rk FROM particles WHERE particle_id IS NOT NULL) WHERE rk = 1
), m AS (
  SELECT run_id, haloid, ptype, particle_id AS pidx, pos[1] AS x, pos[2] AS y, pos[3] AS z, vel[1] AS vx, vel[2] AS vy, vel[3] AS vz, mass, potential, temperature, metallicity, age, sfr,
    smoothing_length AS h, bhmass, bhmdot, snap_id, slab, mass * (particle_id % 97) / 128.0 AS mass_HI, mass * (96 - particle_id % 97) / 256.0 AS mass_H2, (particle_id % 97) * 1e-26 AS rho,
    CASE ptype WHEN 'gas' THEN 0 WHEN 'dm' THEN 1 WHEN 'star' THEN 2 WHEN 'bh' THEN 3 ELSE 4 END AS trank
  FROM latest WHERE haloid IS NOT NULL AND haloid <> -1 AND mass IS NOT NULL AND pos IS NOT NULL
)"""


def _mi(e: str) -> str:
    return f"(({e}) - 500.0 * round_even(({e}) / 500.0, 0))"


def _rounded(df: DataFrame, digits: int, *keep: str) -> DataFrame:
    """Double columns rounded; -0 becomes 0."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _r(e: str, name: str, digits: int) -> str:
    return f"round({e}, {digits}) + 0.0 AS {name}"


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


# scans, filters, derived columns


@query("scan_columns", _BASE + " SELECT run_id, haloid, pidx, x, y, z FROM m")
def scan_columns(spark, sf_dir):
    return members(spark, sf_dir).select(*KEYS, "pidx", "x", "y", "z")


@query("scan_subset", _BASE + " SELECT pidx, mass FROM m WHERE pidx IN (SELECT DISTINCT central_galaxy_index FROM galaxies WHERE central_galaxy_index IS NOT NULL)")
def scan_subset(spark, sf_dir):
    wanted = table(spark, sf_dir, "galaxies", "central_galaxy_index").select(F.col("central_galaxy_index").alias("pidx"))
    return formats.read_subset(members(spark, sf_dir).select("pidx", "mass"), wanted)


@query("scan_elements", "SELECT vec_id, CAST(embedding[2] AS DOUBLE) AS \"fraction_He\", CAST(embedding[5] AS DOUBLE) AS \"fraction_O\", CAST(embedding[11] AS DOUBLE) AS \"fraction_Fe\" FROM embeddings")
def scan_elements(spark, sf_dir):
    return formats.elements(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "embedding", list(formats.SIMBA_ELEMENTS)).select("vec_id", "fraction_He", "fraction_O", "fraction_Fe")


@query("derive_halo_ids", "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN -1 ELSE user_id - 1 END AS decoded, user_id + 1 AS encoded FROM events")
def derive_halo_ids(spark, sf_dir):
    swift = formats.build_format("SWIFT-EAGLE")
    raw = F.when(F.col("user_id") % 7 == 0, F.lit(formats.SWIFT_NO_HALO)).otherwise(F.col("user_id"))
    return table(spark, sf_dir, "events", "event_id", "user_id").select("event_id", swift.decode_halo(raw).alias("decoded"), swift.encode_halo(F.col("user_id")).alias("encoded"))


@query("derive_units", "SELECT event_id, round(value * power(0.25, 0.5 - 1.0) * power(0.68, -1.0) * (3.0e24 / 3.0e21), 4) AS scaled, round(greatest(value - 50, 0.0), 6) AS sfr FROM events")
def derive_units(spark, sf_dir):
    factor = P.swift_unit_factor(3.0e24, 0.5, -1.0, 3.0e21, 1.0, 0.68, 0.25)
    return table(spark, sf_dir, "events", "event_id", "value").select("event_id", F.round(F.col("value") * factor, 4).alias("scaled"), F.round(F.greatest(F.col("value") - 50, F.lit(0.0)), 6).alias("sfr"))


_Y, _NE, _U = "(0.2e0 + (pidx % 11) / 1e2)", "((pidx % 13) / 13e0)", "(1e12 + (pidx % 1009) * 1e10)"


@query(
    "derive_temperature",
    _BASE + f""" SELECT pidx, round((1 + 4*({_Y}/(4*(1-{_Y})))) / (1 + {_Y}/(4*(1-{_Y})) + {_NE}) * {P.PROTON_MASS_G} * (2e0/3e0) * {_U} / {P.BOLTZMANN_CGS}, 2) AS temperature FROM m WHERE ptype = 'gas'""",
)
def derive_temperature(spark, sf_dir):
    gas = members(spark, sf_dir).where("ptype = 'gas'")
    return gas.select("pidx", F.round(P.gas_temperature(F.expr(_U), F.expr(_NE), F.expr(_Y)), 2).alias("temperature"))


@query(
    "derive_phases",
    _BASE + f""" SELECT pidx, {_r(f"least(1.0, greatest(0.0, (1 - {_Y} - metallicity) * {_NE})) * mass", "mass_HI", 9)}, {_r(f"least(1.0, greatest(0.0, (1 - {_Y} - metallicity) * 2.0 * {_NE})) * mass", "mass_H2", 9)} FROM m WHERE ptype = 'gas' AND metallicity IS NOT NULL""",
)
def derive_phases(spark, sf_dir):
    gas = members(spark, sf_dir).where("ptype = 'gas' and metallicity is not null")
    hydrogen = 1 - F.expr(_Y) - F.col("metallicity")
    return _rounded(gas.select("pidx", P.clipped_fraction(hydrogen, F.expr(_NE), F.col("mass")).alias("mass_HI"), P.clipped_fraction(hydrogen, 2.0 * F.expr(_NE), F.col("mass")).alias("mass_H2")), 9)


def _neutral_sql() -> str:
    x = f"(1 - {_Y} - metallicity)"
    per = f"({P.BOLTZMANN_CGS} / ((2e0/3e0) * (4 / (1 + 3 * {x})) * {P.PROTON_MASS_G}))"
    return _BASE + f""", a AS (SELECT pidx, mass, sfr, {x} AS hx, {_Y} AS y, {_NE} AS ne, {_U} AS u, (pidx % 17) / 17e0 AS neutral, (pidx % 97 + 1) * 1e-25 AS density, {per} AS per FROM m WHERE ptype = 'gas' AND metallicity IS NOT NULL AND sfr IS NOT NULL
), b AS (SELECT *, density * hx / {P.PROTON_MASS_G} AS nh, per * 1000.0 AS uc, per * 1000.0 + per * 5.73e7 / (1 + 573.0 * power(density * hx / {P.PROTON_MASS_G} / 0.1065, -0.8)) AS uh FROM a
), c AS (SELECT *, CASE WHEN sfr > 0 THEN least(1.0, greatest(0.0, (uh - u) / (uh - uc))) ELSE neutral END AS xn,
  power(nh * (1 + ne + y / (4 * hx)) * ((1 + 4*(y/(4*(1-y)))) / (1 + y/(4*(1-y)) + ne) * {P.PROTON_MASS_G} * (2e0/3e0) * u / {P.BOLTZMANN_CGS}) / 4.3e4, 0.92) AS rm FROM b)
SELECT pidx, round(hx * xn / (1 + rm) * mass, 9) + 0.0 AS mass_HI, round(hx * xn * rm / (1 + rm) * mass, 9) + 0.0 AS mass_H2 FROM c"""


@query("derive_pressure_phases", _neutral_sql())
def derive_pressure_phases(spark, sf_dir):
    gas = members(spark, sf_dir).where("ptype = 'gas' and metallicity is not null and sfr is not null")
    hi, h2 = P.neutral_and_molecular(F.expr(_U), F.col("sfr"), F.expr("(pidx % 17) / 17e0"), F.expr(_NE), F.expr("(pidx % 97 + 1) * 1e-25"), F.expr(_Y), F.col("metallicity"), F.col("mass"))
    return _rounded(gas.select("pidx", hi.alias("mass_HI"), h2.alias("mass_H2")), 9)


@query("filter_halo_size", _BASE + ", big AS (SELECT run_id, haloid FROM m GROUP BY ALL HAVING count(*) FILTER (ptype = 'dm') >= 24) SELECT pidx FROM m JOIN big USING (run_id, haloid)")
def filter_halo_size(spark, sf_dir):
    rows = members(spark, sf_dir).withColumn("group", F.col("run_id") * 1_000_000_000 + F.col("haloid"))
    return M.select_halos(rows, "group", 24).select("pidx")


_NH = f"(rho * 1e2 * (1 - metallicity - 0.24) / {P.PROTON_MASS_G})"


@query("filter_gas", _BASE + f" SELECT pidx FROM m WHERE ptype = 'gas' AND {_NH} > 0.13 AND (temperature < 1e5 OR sfr > 0)")
def filter_gas(spark, sf_dir):
    n_h = P.hydrogen_number_density(F.col("rho") * 1e2, F.col("metallicity"), F.lit(0.24))
    return members(spark, sf_dir).where("ptype = 'gas'").where(P.gas_criterion(n_h, F.col("temperature"), F.col("sfr"), "COLD_OR_STARFORMING", 0.13, 1e5)).select("pidx")


# aggregates


@query(
    "agg_summary",
    _BASE + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, haloid ORDER BY mass DESC, pidx) AS hi, row_number() OVER (PARTITION BY run_id, haloid ORDER BY mass, pidx) AS lo FROM m)
SELECT run_id, haloid, sum(mass) AS total, count(*) AS n, max(mass) AS largest, min(mass) AS smallest, max(CASE WHEN hi = 1 THEN pidx END) AS argmax, max(CASE WHEN lo = 1 THEN pidx END) AS argmin, min(pidx) AS first FROM ranked GROUP BY run_id, haloid""",
)
def agg_summary(spark, sf_dir):
    return G.summarise(members(spark, sf_dir), KEYS, "mass")


_KINDS_SQL = ", ".join(f"count(*) FILTER (ptype = '{p}') AS n_{p}, coalesce(sum(mass) FILTER (ptype = '{p}'), 0) AS mass_{p}" for p in FULL)


@query("agg_counts_masses", _BASE + f" SELECT run_id, haloid, {_KINDS_SQL}, count(*) FILTER (ptype IN ('gas','star','bh')) AS n_baryon, coalesce(sum(mass) FILTER (ptype IN ('gas','star','bh')), 0) AS mass_baryon, count(*) AS n_total, sum(mass) AS mass_total FROM m GROUP BY run_id, haloid")
def agg_counts_masses(spark, sf_dir):
    return G.counts_and_masses(members(spark, sf_dir), KEYS)


def _centre_sql(keys: str) -> str:
    first = ", ".join(f"first_value({c}) OVER (PARTITION BY {keys} ORDER BY pidx) AS a{c}" for c in "xyz")
    sums = ", ".join(f"sum(mass * {_mi(f'{c} - a{c}')}) AS s{c}, sum(mass * v{c}) AS sv{c}, min(a{c}) AS a{c}" for c in "xyz")
    wrapped = ", ".join(f"(((s{c}/mass + a{c}) % 500.0) + 500.0) % 500.0 AS c{c}, sv{c}/mass AS cv{c}" for c in "xyz")
    return f", anchored AS (SELECT *, {first} FROM m), csum AS (SELECT {keys}, count(*) AS n, sum(mass) AS mass, {sums} FROM anchored GROUP BY {keys}), centre AS (SELECT {keys}, n, mass, {wrapped} FROM csum)"


_CENTRE_OUT = ", ".join(_r(f"c{c}", f"c{c}", 6) for c in ("x", "y", "z", "vx", "vy", "vz"))


@query("centre_of_mass", _BASE + _centre_sql("run_id, haloid") + f" SELECT run_id, haloid, n, mass, {_CENTRE_OUT} FROM centre")
def centre_of_mass(spark, sf_dir):
    return _rounded(G.centre_of_mass(members(spark, sf_dir), KEYS, BOX), 6, "mass")


@query(
    "centre_combined",
    _BASE + _centre_sql("run_id, haloid, ptype") + f""", best AS (SELECT *, row_number() OVER (PARTITION BY run_id, haloid ORDER BY mass DESC, CASE ptype WHEN 'gas' THEN 0 WHEN 'dm' THEN 1 WHEN 'star' THEN 2 ELSE 3 END) AS k FROM centre WHERE mass > 0),
anchor AS (SELECT run_id, haloid, cx AS ax, cy AS ay, cz AS az FROM best WHERE k = 1),
total AS (SELECT run_id, haloid, sum(mass) AS mass, min(ax) AS ax, min(ay) AS ay, min(az) AS az, {", ".join(f"sum(mass * {_mi(f'c{c} - a{c}')}) AS s{c}, sum(mass * cv{c}) AS sv{c}" for c in "xyz")} FROM best JOIN anchor USING (run_id, haloid) GROUP BY run_id, haloid)
SELECT run_id, haloid, mass, {", ".join(_r(f"(((s{c}/mass + a{c}) % 500.0) + 500.0) % 500.0", f"c{c}", 6) for c in "xyz")}, {", ".join(_r(f"sv{c}/mass", f"cv{c}", 6) for c in "xyz")} FROM total""",
)
def centre_combined(spark, sf_dir):
    parts = G.centre_of_mass(members(spark, sf_dir), [*KEYS, "ptype"], BOX)
    return _rounded(G.combine_centres(cut(parts, "centres"), KEYS, BOX), 6, "mass")


_MINPOT = """, low AS (SELECT *, row_number() OVER (PARTITION BY run_id, haloid ORDER BY potential, trank, pidx) AS k FROM m WHERE potential IS NOT NULL),
ref AS (SELECT run_id, haloid, pidx AS minpot_pidx, x AS rx, y AS ry, z AS rz, vx AS rvx, vy AS rvy, vz AS rvz FROM low WHERE k = 1)"""


def _reference(rows: DataFrame) -> DataFrame:
    low = G.minimum_potential(rows, KEYS)
    return low.select(*KEYS, *[F.col(f"m{c}").alias(f"r{c}") for c in "xyz"], *[F.col(f"mv{c}").alias(f"rv{c}") for c in "xyz"])


@query("minimum_potential", _BASE + _MINPOT + " SELECT run_id, haloid, minpot_pidx, rx AS mx, ry AS my, rz AS mz, rvx AS mvx, rvy AS mvy, rvz AS mvz FROM ref")
def minimum_potential(spark, sf_dir):
    return G.minimum_potential(members(spark, sf_dir), KEYS)


_REL = f""", rel AS (SELECT m.*, {_mi("x - rx")} AS dx, {_mi("y - ry")} AS dy, {_mi("z - rz")} AS dz, vx - rvx AS ux, vy - rvy AS uy, vz - rvz AS uz FROM m JOIN ref USING (run_id, haloid))"""
_SUMS = """sum(mass*(dy*uz - dz*uy)) AS lx, sum(mass*(dz*ux - dx*uz)) AS ly, sum(mass*(dx*uy - dy*ux)) AS lz, sum(0.5*mass*(ux*ux+uy*uy+uz*uz)) AS ke,
 sum(mass*(dy*dy+dz*dz)) AS ixx, sum(mass*(dx*dx+dz*dz)) AS iyy, sum(mass*(dx*dx+dy*dy)) AS izz, sum(-mass*dx*dy) AS ixy, sum(-mass*dx*dz) AS ixz, sum(-mass*dy*dz) AS iyz,
 greatest(0.0, sum(mass*(ux*ux+uy*uy+uz*uz)) - (sum(mass*ux)*sum(mass*ux) + sum(mass*uy)*sum(mass*uy) + sum(mass*uz)*sum(mass*uz)) / sum(mass)) AS dispersion,
 sum(mass*ux)/sum(mass) AS bvx, sum(mass*uy)/sum(mass) AS bvy, sum(mass*uz)/sum(mass) AS bvz"""
_KIN = [*(f"l{c}" for c in "xyz"), "ke", "dispersion", *(f"i{a}" for a in ("xx", "yy", "zz", "xy", "xz", "yz"))]


@query("kinematics", _BASE + _MINPOT + _REL + f", k AS (SELECT run_id, haloid, ptype, count(*) AS n, sum(mass) AS mass, {_SUMS} FROM rel GROUP BY run_id, haloid, ptype) SELECT run_id, haloid, ptype, n, mass, {', '.join(_r(c, c, 4) for c in [*_KIN, 'bvx', 'bvy', 'bvz'])} FROM k")
def kinematics(spark, sf_dir):
    rows = cut(members(spark, sf_dir), "members")
    return _rounded(G.kinematics(rows, [*KEYS, "ptype"], _reference(rows), BOX).drop("cx"), 4, "mass")


_LN = "sqrt(lx*lx+ly*ly+lz*lz)"


def _few(e: str, name: str, digits: int) -> str:
    return _r(f"CASE WHEN n < 3 THEN 0.0 ELSE {e} END", name, digits)


@query(
    "kinematics_derived",
    _BASE + _MINPOT + _REL + f""", k AS (SELECT run_id, haloid, count(*) AS n, sum(mass) AS mass, {_SUMS} FROM rel GROUP BY run_id, haloid)
SELECT run_id, haloid, {_few(_LN, "l_size", 4)}, {_few("atan2(ly, lx)", "l_azimuth", 5)}, {_few(f"CASE WHEN {_LN} = 0 THEN 0.0 ELSE asin(greatest(-1.0, least(1.0, lz/{_LN}))) END", "l_elevation", 5)}, {_few("sqrt(dispersion/mass)", "sigma", 4)} FROM k""",
)
def kinematics_derived(spark, sf_dir):
    rows = cut(members(spark, sf_dir), "members")
    out = G.derive_kinematics(G.kinematics(rows, KEYS, _reference(rows), BOX))
    return out.select(*KEYS, *[(F.round(c, d) + 0.0).alias(c) for c, d in (("l_size", 4), ("l_azimuth", 5), ("l_elevation", 5), ("sigma", 4))])


_SHIFT = "((bvx-cvx)*(bvx-cvx)+(bvy-cvy)*(bvy-cvy)+(bvz-cvz)*(bvz-cvz))"


@query(
    "combine_types",
    _BASE + _MINPOT + _REL + f""", k AS (SELECT run_id, haloid, ptype, count(*) AS n, sum(mass) AS mass, {_SUMS} FROM rel WHERE ptype IN ('gas','star','bh') GROUP BY run_id, haloid, ptype),
cen AS (SELECT run_id, haloid, sum(mass*ux)/sum(mass) AS cvx, sum(mass*uy)/sum(mass) AS cvy, sum(mass*uz)/sum(mass) AS cvz FROM rel WHERE ptype IN ('gas','star','bh') GROUP BY run_id, haloid)
SELECT run_id, haloid, CAST(sum(n) AS BIGINT) AS n, sum(mass) AS mass, {", ".join(_r(f"sum(CASE WHEN n >= 3 THEN {c} ELSE 0.0 END)", c, 3) for c in ("lx", "ly", "lz", "ixx", "iyy", "izz", "ixy", "ixz", "iyz"))},
 {_r(f"sum(ke + 0.5*mass*{_SHIFT})", "ke", 3)}, {_r(f"sum(dispersion + mass*{_SHIFT})", "dispersion", 3)}, {_r(f"sqrt(sum(dispersion + mass*{_SHIFT})/sum(mass))", "sigma", 4)} FROM k JOIN cen USING (run_id, haloid) WHERE mass > 0 GROUP BY run_id, haloid""",
)
def combine_types(spark, sf_dir):
    rows = cut(members(spark, sf_dir), "members")
    sums = cut(G.kinematics(rows, [*KEYS, "ptype"], _reference(rows), BOX), "kinematics")
    baryons = sums.where(F.col("ptype").isin(*G.BARYONS))
    centres = baryons.groupBy(*KEYS).agg(*[(F.sum(F.col("mass") * F.col(f"bv{c}")) / F.sum("mass")).alias(f"cv{c}") for c in "xyz"])
    out = G.combine_types(sums, KEYS, centres, G.BARYONS)
    return out.select(*KEYS, "n", "mass", *[(F.round(c, 4 if c == "sigma" else 3) + 0.0).alias(c) for c in out.columns if c not in (*KEYS, "n", "mass")])


_MORPH = """, k AS (SELECT run_id, haloid, sum(mass*(dy*uz - dz*uy)) AS lx, sum(mass*(dz*ux - dx*uz)) AS ly, sum(mass*(dx*uy - dy*ux)) AS lz FROM rel GROUP BY run_id, haloid),
r AS (SELECT rel.*, lx, ly, lz, mass*((dy*uz - dz*uy)*lx + (dz*ux - dx*uz)*ly + (dx*uy - dy*ux)*lz) AS along,
 sqrt((dy*lz - dz*ly)*(dy*lz - dz*ly) + (dz*lx - dx*lz)*(dz*lx - dx*lz) + (dx*ly - dy*lx)*(dx*ly - dy*lx)) AS arm FROM rel JOIN k USING (run_id, haloid))"""


@query(
    "rotation",
    _BASE + _MINPOT + _REL + _MORPH + """, s AS (SELECT run_id, haloid, count(*) AS n, sum(mass) AS mass, coalesce(sum(CASE WHEN along < 0 THEN mass END), 0) AS mc,
 coalesce(sum(CASE WHEN arm * mass <> 0 THEN 0.5*mass*(along/(arm*mass))*(along/(arm*mass)) END), 0) AS kr, sum(0.5*mass*(ux*ux+uy*uy+uz*uz)) AS ke FROM r GROUP BY run_id, haloid)
SELECT run_id, haloid, round(CASE WHEN n < 3 THEN 0.0 ELSE 2*mc/mass END, 6) + 0.0 AS b_over_t, round(CASE WHEN n < 3 THEN 0.0 WHEN ke <> 0 THEN kr/ke END, 5) + 0.0 AS kappa_rot FROM s""",
)
def rotation(spark, sf_dir):
    rows = cut(members(spark, sf_dir), "members")
    place = cut(_reference(rows), "reference")
    axis = G.kinematics(rows, KEYS, place, BOX).select(*KEYS, "lx", "ly", "lz").join(place, KEYS)
    out = G.morphology(G.rotation(rows, KEYS, cut(axis, "axis"), BOX))
    return out.select(*KEYS, (F.round("b_over_t", 6) + 0.0).alias("b_over_t"), (F.round("kappa_rot", 5) + 0.0).alias("kappa_rot"))


_R200, _A = 20.0, 0.5


@query(
    "halo_scales",
    _BASE + _MINPOT + _REL + f""", k AS (SELECT run_id, haloid, count(*) AS n, sum(mass) AS mass, {_SUMS} FROM rel GROUP BY run_id, haloid), s AS (SELECT *, {_R200} * cbrt(mass) AS r, sqrt({P.G_VCIRC} * mass / ({_R200} * cbrt(mass) * {_A})) AS v FROM k WHERE mass > 0)
SELECT run_id, haloid, {_r("r", "r200m", 6)}, {_r("v * 1e6", "velocity_circular", 4)}, {_r(f"{P.virial_temperature_factor()} * v * v * 1e9", "temperature_virial", 4)}, {_r(f"{_LN} / (sqrt(2.0) * mass * v * r) * 1e-3", "spin_param", 2)} FROM s""",
)
def halo_scales(spark, sf_dir):
    rows = cut(members(spark, sf_dir), "members")
    out = G.halo_scales(G.kinematics(rows, KEYS, _reference(rows), BOX), _R200, _A)
    return out.select(*KEYS, (F.round("r200m", 6) + 0.0).alias("r200m"), (F.round(F.col("velocity_circular") * 1e6, 4) + 0.0).alias("velocity_circular"), (F.round(F.col("temperature_virial") * 1e9, 4) + 0.0).alias("temperature_virial"), (F.round(F.col("spin_param") * 1e-3, 2) + 0.0).alias("spin_param"))


def _wavg(value: str, weight: str, where: str = "true") -> str:
    bottom = f"sum(CASE WHEN {where} AND {value} IS NOT NULL THEN {weight} END)"
    return f"CASE WHEN {bottom} <> 0 THEN sum(CASE WHEN {where} THEN {value} * {weight} END) / {bottom} END"


@query(
    "gas_properties",
    _BASE + f""" SELECT run_id, haloid, {_r("coalesce(sum(mass_HI), 0)", "mass_HI", 8)}, {_r("coalesce(sum(mass_H2), 0)", "mass_H2", 8)}, {_r("coalesce(sum(sfr), 0)", "sfr", 5)}, {_r(_wavg("metallicity", "mass"), "metallicity_gas_mass_weighted", 8)},
 {_r(_wavg("metallicity", "sfr"), "metallicity_gas_sfr_weighted", 8)}, {_r(_wavg("temperature", "mass"), "temperature_gas_mass_weighted", 2)}, {_r("coalesce(sum(CASE WHEN temperature < 1e5 THEN mass END), 0)", "mass_gas_cold", 8)}, {_r("coalesce(sum(CASE WHEN temperature >= 1e5 THEN mass END), 0)", "mass_gas_hot", 8)}
 FROM m WHERE ptype = 'gas' GROUP BY run_id, haloid""",
)
def gas_properties(spark, sf_dir):
    out = G.gas_properties(members(spark, sf_dir).where("ptype = 'gas'"), KEYS)
    digits = {"sfr": 5, "temperature_gas_mass_weighted": 2}
    return out.select(*KEYS, *[(F.round(c, digits.get(c, 8)) + 0.0).alias(c) for c in out.columns if c not in KEYS])


@query(
    "cgm_properties",
    _BASE + f""", g AS (SELECT *, rho * (1 - metallicity - 0.24) / {P.PROTON_MASS_G} AS nh FROM m WHERE ptype = 'gas') SELECT run_id, haloid, {_r("coalesce(sum(CASE WHEN nh < 0.13 THEN mass END), 0)", "mass_cgm", 8)}, {_r(_wavg("temperature", "mass", "nh < 0.13"), "temperature_gas_mass_weighted_cgm", 2)},
 {_r(_wavg("temperature", "(mass*metallicity)", "nh < 0.13"), "temperature_gas_metal_weighted_cgm", 2)}, {_r(_wavg("metallicity", "mass", "nh < 0.13"), "metallicity_gas_mass_weighted_cgm", 8)}, {_r(_wavg("metallicity", "(mass*temperature)", "nh < 0.13"), "metallicity_gas_temperature_weighted_cgm", 8)} FROM g GROUP BY run_id, haloid""",
)
def cgm_properties(spark, sf_dir):
    gas = members(spark, sf_dir).where("ptype = 'gas'").withColumn("nH", P.hydrogen_number_density(F.col("rho"), F.col("metallicity"), F.lit(0.24)))
    out = G.cgm_properties(gas, KEYS, 0.13)
    return out.select(*KEYS, *[(F.round(c, 2 if c.startswith("temp") else 8) + 0.0).alias(c) for c in out.columns if c not in KEYS])


@query("star_properties", _BASE + f" SELECT run_id, haloid, {_r(_wavg('metallicity', 'mass'), 'metallicity_star_mass_weighted', 8)}, {_r(_wavg('age', 'mass'), 'age_star_mass_weighted', 6)}, {_r(_wavg('age', '(mass*metallicity)'), 'age_star_metal_weighted', 6)} FROM m WHERE ptype = 'star' GROUP BY run_id, haloid")
def star_properties(spark, sf_dir):
    out = G.star_properties(members(spark, sf_dir).where("ptype = 'star'"), KEYS)
    return out.select(*KEYS, *[(F.round(c, 6 if c.startswith("age") else 8) + 0.0).alias(c) for c in out.columns if c not in KEYS])


@query("black_hole_properties", _BASE + f", b AS (SELECT *, row_number() OVER (PARTITION BY run_id, haloid ORDER BY bhmass DESC, pidx) AS k FROM m WHERE ptype = 'bh' AND bhmass IS NOT NULL) SELECT run_id, haloid, bhmass AS smbh_mass, bhmdot AS smbh_mdot, round(CASE WHEN bhmass <> 0 THEN bhmdot / ({P.eddington_factor()} * bhmass) END, 4) + 0.0 AS smbh_fedd FROM b WHERE k = 1")
def black_hole_properties(spark, sf_dir):
    out = G.black_hole_properties(members(spark, sf_dir).where("ptype = 'bh'"), KEYS, P.eddington_factor())
    return out.withColumn("smbh_fedd", F.round("smbh_fedd", 4) + 0.0)


# profiles

_RADII = f", rad AS (SELECT m.run_id, m.haloid, m.pidx, m.ptype, m.mass, sqrt({_mi('x - rx')}*{_mi('x - rx')} + {_mi('y - ry')}*{_mi('y - ry')} + {_mi('z - rz')}*{_mi('z - rz')}) AS r FROM m JOIN ref USING (run_id, haloid))"


@query("radii", _BASE + _MINPOT + _RADII + " SELECT pidx, round(r, 8) + 0.0 AS r FROM rad")
def radii(spark, sf_dir):
    rows = cut(members(spark, sf_dir), "members")
    return G.radii(rows, KEYS, _reference(rows).select(*KEYS, "rx", "ry", "rz"), BOX).select("pidx", (F.round("r", 8) + 0.0).alias("r"))


_RHO = 1e-9


def _profile_sql(where: str) -> str:
    density = "enclosed / (4.0/3.0*pi()*r*r*r)"
    over = ", ".join(f"max(CASE WHEN r > 0 AND {density} >= {f} * {_RHO} THEN r END) AS r{f}c" for f in (200, 500, 2500))
    return f""", run AS (SELECT *, sum(mass) OVER (PARTITION BY run_id, haloid ORDER BY r, pidx ROWS UNBOUNDED PRECEDING) AS enclosed, sum(mass) OVER (PARTITION BY run_id, haloid) AS total FROM rad WHERE {where}),
 agg AS (SELECT run_id, haloid, max(r) AS radius_max, min(CASE WHEN enclosed >= 0.2*total THEN r END) AS radius_r20, min(CASE WHEN enclosed >= 0.5*total THEN r END) AS radius_half_mass, min(CASE WHEN enclosed >= 0.8*total THEN r END) AS radius_r80, {over} FROM run GROUP BY run_id, haloid),
 peak AS (SELECT *, row_number() OVER (PARTITION BY run_id, haloid ORDER BY sqrt({P.G_VCIRC} * enclosed / (r * {_A})) DESC, r) AS k FROM run WHERE r > 0),
 top AS (SELECT run_id, haloid, sqrt({P.G_VCIRC} * enclosed / (r * {_A})) AS vmax, r AS rmax FROM peak WHERE k = 1)"""


@query("mass_quantile_radii", _BASE + _MINPOT + _RADII + _profile_sql("ptype IN ('gas','star','bh')") + f" SELECT run_id, haloid, {', '.join(_r(c, c, 7) for c in ('radius_max', 'radius_r20', 'radius_half_mass', 'radius_r80'))} FROM agg")
def mass_quantile_radii(spark, sf_dir):
    rows = cut(members(spark, sf_dir), "members")
    placed = G.radii(rows, KEYS, _reference(rows).select(*KEYS, "rx", "ry", "rz"), BOX).where(F.col("ptype").isin(*G.BARYONS))
    out = G.profiles(placed, KEYS, {"r20": 0.2, "half_mass": 0.5, "r80": 0.8})
    return out.select(*KEYS, *[(F.round(c, 7) + 0.0).alias(c) for c in ("radius_max", "radius_r20", "radius_half_mass", "radius_r80")])


@query("virial_and_vmax", _BASE + _MINPOT + _RADII + _profile_sql("true") + f" SELECT run_id, haloid, {', '.join(_r(c, c, 7) for c in ('r200c', 'r500c', 'r2500c'))}, {_r('vmax * 1e6', 'vmax', 3)}, {_r('rmax', 'rmax', 7)} FROM agg LEFT JOIN top USING (run_id, haloid)")
def virial_and_vmax(spark, sf_dir):
    rows = cut(members(spark, sf_dir), "members")
    placed = G.radii(rows, KEYS, _reference(rows).select(*KEYS, "rx", "ry", "rz"), BOX)
    out = G.profiles(placed, KEYS, {}, {"200c": 200.0, "500c": 500.0, "2500c": 2500.0}, _RHO, _A)
    return out.select(*KEYS, *[(F.round(c, 7) + 0.0).alias(c) for c in ("r200c", "r500c", "r2500c")], (F.round(F.col("vmax") * 1e6, 3) + 0.0).alias("vmax"), (F.round("rmax", 7) + 0.0).alias("rmax"))


# joins, order, memberships


@query("lookup_join", "SELECT o_orderkey, coalesce(c.c_nationkey, -1) AS nation FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON o_custkey = c_custkey")
def lookup_join(spark, sf_dir):
    known = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").where("c_custkey % 3 <> 0")
    return M.lookup(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_custkey", known, "c_custkey", "c_nationkey", "nation").select("o_orderkey", "nation")


@query("rekey", "WITH k AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS number FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 5 <> 0)) SELECT o_orderkey, coalesce(number, -1) AS number FROM orders LEFT JOIN k USING (o_custkey)")
def rekey(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").withColumn("key", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")))
    return M.rekey(rows, "key", "number").select("o_orderkey", "number")


@query("run_expansion", "SELECT n_regionkey AS region, n_nationkey AS nation, generate_series AS position FROM (SELECT *, sum(len) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - len AS start FROM (SELECT *, n_nationkey % 4 AS len FROM nation)), generate_series(0, 30) WHERE generate_series >= start AND generate_series < start + len")
def run_expansion(spark, sf_dir):
    runs = table(spark, sf_dir, "nation", "n_regionkey", "n_nationkey").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), (F.col("n_nationkey") % 4).alias("length"))
    return M.expand_runs(runs, ["region"], "nation", "length").select("region", "nation", F.col("position").cast("long").alias("position"))


@query("interval_lookup", "WITH s AS (SELECT DISTINCT event_id AS start, user_id AS owner FROM events WHERE event_id % 37 = 5) SELECT e.event_id, s.owner FROM events e ASOF LEFT JOIN s ON e.event_id >= s.start")
def interval_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "event_id", "user_id").withColumn("k", F.lit(0))
    starts = rows.where("event_id % 37 = 5").select("k", F.col("event_id").alias("start"), F.col("user_id").alias("owner"))
    return M.interval_lookup(rows.select("k", "event_id"), ["k"], "event_id", starts, "start", "owner").select("event_id", "owner")


@query("deepest_membership", "WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host_field_id ORDER BY depth DESC, sub_id DESC) AS k FROM (SELECT DISTINCT host_field_id, depth, sub_id FROM subhaloes WHERE depth IS NOT NULL)) WHERE k = 1) SELECT host_field_id, sub_id FROM l")
def deepest_membership(spark, sf_dir):
    rows = table(spark, sf_dir, "subhaloes", "host_field_id", "depth", "sub_id").where("depth is not null")
    return M.deepest(rows, "host_field_id", "depth", "sub_id").select("host_field_id", "sub_id")


@query("size_labels", _BASE + ", g AS (SELECT run_id * 1000000 + haloid AS root, count(*) AS n, min(pidx) AS first FROM m GROUP BY 1) SELECT root, n, first, CASE WHEN n < 20 THEN -1 ELSE row_number() OVER (ORDER BY n < 20, n DESC, first) - 1 END AS label FROM g")
def size_labels(spark, sf_dir):
    rows = members(spark, sf_dir).select((F.col("run_id") * 1_000_000 + F.col("haloid")).alias("root"), "pidx")
    return M.size_labels(rows, "root", "pidx", 20).select("root", "n", "first", "label")


@query("csr_lists", _BASE + ", g AS (SELECT run_id * 1000000 + haloid AS grp, string_agg(pidx, ',' ORDER BY pidx) AS members, count(*) AS length FROM m WHERE ptype = 'star' GROUP BY 1) SELECT grp, members, length, CAST(sum(length) OVER (ORDER BY grp) - length AS BIGINT) AS \"offset\" FROM g")
def csr_lists(spark, sf_dir):
    rows = members(spark, sf_dir).where("ptype = 'star'").select((F.col("run_id") * 1_000_000 + F.col("haloid")).alias("grp"), "pidx")
    return M.csr(rows, "grp").select("grp", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "length", "offset")


@query("csr_slots", _BASE + " SELECT pidx, row_number() OVER (ORDER BY run_id * 1000000 + haloid, pidx) - 1 AS slot FROM m")
def csr_slots(spark, sf_dir):
    rows = members(spark, sf_dir).select((F.col("run_id") * 1_000_000 + F.col("haloid")).alias("grp"), "pidx")
    return M.csr_order(rows, "grp").select("pidx", "slot")


_GAL = "WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY galaxy_id ORDER BY written_at DESC) AS rk FROM galaxies WHERE galaxy_id IS NOT NULL) WHERE rk = 1), g AS (SELECT *, CASE WHEN isnan(mass_baryon) THEN NULL ELSE mass_baryon END AS mb FROM latest), o AS (SELECT *, row_number() OVER (ORDER BY mb DESC NULLS LAST, depth, galaxy_id) - 1 AS row FROM g)"


def _galaxies(spark, sf_dir):
    rows = latest(table(spark, sf_dir, "galaxies"), "galaxy_id", "written_at")
    return rows.withColumn("mb", F.when(~F.isnan("mass_baryon"), F.col("mass_baryon")))


@query("catalogue_order", _GAL + " SELECT galaxy_id, row FROM o")
def catalogue_order(spark, sf_dir):
    return M.order_groups(_galaxies(spark, sf_dir).select("galaxy_id", "mb", "depth"), "mb", "galaxy_id", "depth").select("galaxy_id", "row")


@query("pointer_remap", _GAL + " SELECT o.galaxy_id, coalesce(t.row, -1) AS central_row FROM o LEFT JOIN o t ON t.galaxy_id = o.central_galaxy_index")
def pointer_remap(spark, sf_dir):
    ordered = cut(M.order_groups(_galaxies(spark, sf_dir).select("galaxy_id", "mb", "depth", "central_galaxy_index"), "mb", "galaxy_id", "depth"), "ordered")
    return M.remap(ordered, "central_galaxy_index", "galaxy_id", "row", "central_row").select("galaxy_id", "central_row")


_VOTE = _BASE + """, v AS (SELECT run_id * 1000000 + haloid AS galaxy, CASE WHEN pidx % 4 = 0 THEN -1 ELSE snap_id * 10 + slab % 3 END AS vote, trank, pidx, ptype FROM m),
c AS (SELECT galaxy, vote, count(*) AS n, max(trank::BIGINT * 1000000000 + pidx) AS last FROM v WHERE vote >= 0 GROUP BY galaxy, vote),
w AS (SELECT *, row_number() OVER (PARTITION BY galaxy ORDER BY n DESC, last) AS k, sum(n) OVER (PARTITION BY galaxy) AS alln FROM c),
win AS (SELECT a.galaxy, coalesce(w.vote, -1) AS winner, coalesce(w.n / w.alln, 0) AS share FROM (SELECT DISTINCT galaxy FROM v) a LEFT JOIN w ON a.galaxy = w.galaxy AND w.k = 1)"""


def _votes(spark, sf_dir):
    rows = members(spark, sf_dir)
    return rows.select((F.col("run_id") * 1_000_000 + F.col("haloid")).alias("galaxy"), F.when(F.col("pidx") % 4 == 0, F.lit(-1)).otherwise(F.col("snap_id") * 10 + F.col("slab") % 3).alias("vote"), "ptype", "pidx", F.struct(G.ptype_rank().alias("t"), F.col("pidx").alias("p")).alias("order"))


@query("plurality_vote", _VOTE + " SELECT galaxy, CAST(winner AS BIGINT) AS winner, round(CAST(CAST(share AS FLOAT) AS DOUBLE), 5) AS fraction FROM win")
def plurality_vote(spark, sf_dir):
    out = M.plurality(_votes(spark, sf_dir), "galaxy", "vote", ["order"])
    return out.select("galaxy", F.col("winner").cast("long").alias("winner"), F.round(F.col("fraction").cast("double"), 5).alias("fraction"))


@query("trim_interlopers", _VOTE + ", kept AS (SELECT v.*, CASE WHEN winner >= 0 AND vote <> winner THEN -1 ELSE v.galaxy END AS gal FROM v JOIN win USING (galaxy)), ok AS (SELECT gal FROM kept WHERE gal >= 0 GROUP BY gal HAVING count(*) FILTER (ptype = 'star') >= 2) SELECT pidx, coalesce(ok.gal, -1) AS galaxy FROM kept LEFT JOIN ok ON kept.gal = ok.gal")
def trim_interlopers(spark, sf_dir):
    rows = cut(_votes(spark, sf_dir), "votes")
    winners = M.plurality(rows, "galaxy", "vote", ["order"])
    return M.trim_interlopers(rows, "galaxy", "vote", winners, 2).select("pidx", "galaxy")


# hierarchy

_FOREST = """WITH RECURSIVE f AS (
  SELECT r_regionkey AS id, CAST(NULL AS BIGINT) AS parent FROM region UNION ALL SELECT 1000 + n_nationkey, n_regionkey FROM nation UNION ALL SELECT 100000 + c_custkey, 1000 + c_nationkey FROM customer
), anc AS (SELECT id, id AS anc, 0 AS up FROM f UNION ALL SELECT anc.id, f.parent, anc.up + 1 FROM anc JOIN f ON f.id = anc.anc WHERE f.parent IS NOT NULL)"""


def _nations(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent"))
    customer = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 100000).cast("long").alias("id"), (F.col("c_nationkey") + 1000).cast("long").alias("parent"))
    return region.unionByName(nation).unionByName(customer)


@query("hierarchy_depth_root", _FOREST + " SELECT a.id, a.anc AS root, CAST(a.up + 1 AS BIGINT) AS depth, (SELECT count(*) FROM anc d WHERE d.anc = a.id) AS size FROM anc a JOIN f ON f.id = a.anc WHERE f.parent IS NULL")
def hierarchy_depth_root(spark, sf_dir):
    return resolve_forest(_nations(spark, sf_dir), "id", "parent", None).nodes.select("id", "root", "depth", "size")


@query("inclusive_mass", _FOREST + " SELECT anc AS grp, count(*) AS n, round(sum(o_totalprice), 2) AS mass FROM orders JOIN anc ON anc.id = 100000 + o_custkey GROUP BY anc")
def inclusive_mass(spark, sf_dir):
    forest = resolve_forest(_nations(spark, sf_dir), "id", "parent", None)
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 100000).cast("long").alias("grp"), F.col("o_orderkey").alias("pidx"), "o_totalprice")
    return M.inclusive(rows, "grp", forest).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("mass"))


@query("halo_galaxies", _FOREST + " SELECT anc AS halo, count(*) AS n_galaxies, min(o_orderkey) AS central FROM orders JOIN anc ON anc.id = 100000 + o_custkey GROUP BY anc")
def halo_galaxies(spark, sf_dir):
    forest = resolve_forest(_nations(spark, sf_dir), "id", "parent", None)
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 100000).cast("long").alias("halo"), F.col("o_orderkey").alias("galaxy"))
    return M.galaxy_parents(rows, "galaxy", "halo", forest).groupBy("halo").agg(F.count(F.lit(1)).alias("n_galaxies"), F.min("galaxy").alias("central"))


# spatial

_NEAR = f"{_mi('a.x - b.x')}*{_mi('a.x - b.x')} + {_mi('a.y - b.y')}*{_mi('a.y - b.y')} + {_mi('a.z - b.z')}*{_mi('a.z - b.z')}"


@query("periodic_pairs", _BASE + f", s AS (SELECT * FROM m WHERE ptype IN ('star', 'bh')) SELECT a.pidx AS apidx, b.pidx AS bpidx, round({_NEAR}, 7) + 0.0 AS d2 FROM s a JOIN s b ON a.pidx < b.pidx AND {_NEAR} <= 2.25")
def periodic_pairs(spark, sf_dir):
    rows = cut(members(spark, sf_dir).where("ptype in ('star', 'bh')").select("pidx", "x", "y", "z"), "points")
    return S.pairs(rows, 1.5, BOX).select("apidx", "bpidx", (F.round("d2", 7) + 0.0).alias("d2"))


@query("nearest_label", _BASE + f", h AS (SELECT * FROM m WHERE ptype = 'bh'), d AS (SELECT pidx, x, y, z, haloid AS label FROM m WHERE ptype = 'dm'), k AS (SELECT a.pidx, b.label, row_number() OVER (PARTITION BY a.pidx ORDER BY {_NEAR}, b.pidx) AS r FROM h a JOIN d b ON {_NEAR} <= 9.0) SELECT h.pidx, coalesce(k.label, -1) AS label FROM h LEFT JOIN k ON k.pidx = h.pidx AND k.r = 1")
def nearest_label(spark, sf_dir):
    rows = cut(members(spark, sf_dir), "members")
    return S.nearest_label(rows.where("ptype = 'bh'"), rows.where("ptype = 'dm'").withColumn("label", F.col("haloid")), 3.0, BOX)


@query("fof_haloes")
def fof_haloes(spark, sf_dir):
    """Friends-of-friends over all dark matter of every run: component sizes by run and label; checked by brute force in the tests."""
    rows = members(spark, sf_dir).where("ptype = 'dm'")
    return S.friends_of_friends(rows, 1.5, BOX, 20, ("run_id",)).groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("pidx").alias("first"))


@query("fof_attach")
def fof_attach(spark, sf_dir):
    """Baryons of every run take the halo of the nearest linked dark matter particle of their run."""
    rows = cut(members(spark, sf_dir), "members")
    labels = cut(S.friends_of_friends(rows.where("ptype = 'dm'"), 1.5, BOX, 20, ("run_id",)), "labels")
    dm = rows.where("ptype = 'dm'").join(labels.where("label >= 0").select("pidx", "label"), "pidx")
    return S.nearest_label(rows.where("ptype <> 'dm'"), dm, 1.5, BOX, by=("run_id",))


@query(
    "phase_dispersion",
    _BASE + """, s AS (SELECT * FROM m WHERE ptype IN ('star','bh')), p AS (SELECT a.pidx, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) * 2 / 1.5 AS q, (a.vx-b.vx)*(a.vx-b.vx)+(a.vy-b.vy)*(a.vy-b.vy)+(a.vz-b.vz)*(a.vz-b.vz) AS dv2
 FROM s a JOIN s b ON a.run_id = b.run_id AND a.haloid = b.haloid AND a.pidx <> b.pidx AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 2.25),
w AS (SELECT pidx, dv2, CASE WHEN q < 1 THEN 1 - 1.5*q*q + 0.75*q*q*q WHEN q < 2 THEN 0.25*power(2-q, 3) ELSE 0 END AS w FROM p), t AS (SELECT pidx, sum(w) AS w, sum(w*dv2) AS v FROM w GROUP BY pidx)
SELECT s.pidx, round(coalesce(CASE WHEN w > 0 THEN sqrt(v/w) END, 0.0), 5) + 0.0 AS sigma FROM s LEFT JOIN t USING (pidx)""",
)
def phase_dispersion(spark, sf_dir):
    rows = cut(members(spark, sf_dir).where("ptype in ('star', 'bh')"), "points")
    return S.local_dispersions(rows, 1.5, tuple(KEYS)).select("pidx", (F.round("sigma", 5) + 0.0).alias("sigma"))


@query("phase_galaxies")
def phase_galaxies(spark, sf_dir):
    """Galaxies by six-dimensional linking of the valid phase-space points of every halo; checked by brute force in the tests."""
    rows = latest(table(spark, sf_dir, "fof6d_points"), "write_key", "read_at").where((F.size("pos") == 3) & (F.size("vel") == 3))
    kinds = F.create_map(*[F.lit(x) for p, c in formats.PTYPE_CODES.items() for x in (c, p)])
    points = rows.select((F.col("run_id") * 1_000_000 + F.col("haloid")).alias("halo"), F.element_at(kinds, F.col("ptype_code").cast("int")).alias("ptype"), F.col("write_key").alias("pidx"), *[F.get("pos", F.lit(i)).alias(c) for i, c in enumerate("xyz")], *[F.get("vel", F.lit(i)).alias(f"v{c}") for i, c in enumerate("xyz")])
    for c in ("x", "y", "z", "vx", "vy", "vz"):
        points = points.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return S.find_galaxies(cut(points, "points"), "halo", 1.0, 1.0, 5).select("pidx", "galaxy")


_SITES = ", site AS (SELECT run_id, haloid, pidx AS galaxy, x, y, z, bhmass AS gm FROM m WHERE ptype = 'bh')"


@query(
    "aperture_masses",
    _BASE + _SITES + f""", n AS (SELECT a.run_id, a.haloid, a.galaxy, b.ptype, b.mass, {_NEAR} AS d2 FROM site a JOIN m b ON a.run_id = b.run_id AND a.haloid = b.haloid AND {_NEAR} <= 9.0)
SELECT site.run_id, site.haloid, site.galaxy, {", ".join(f"coalesce(sum(mass) FILTER (ptype = '{p}' AND d2 <= {r * r}), 0) AS mass_{p}_{r}kpc" for r in (1, 3) for p in FULL)}, {", ".join(f"coalesce(sum(mass) FILTER (d2 <= {r * r}), 0) AS mass_total_{r}kpc" for r in (1, 3))} FROM site LEFT JOIN n ON n.galaxy = site.galaxy GROUP BY site.run_id, site.haloid, site.galaxy""",
)
def aperture_masses(spark, sf_dir):
    rows = cut(members(spark, sf_dir), "members")
    sites = rows.where("ptype = 'bh'").select(*KEYS, F.col("pidx").alias("galaxy"), "x", "y", "z")
    return S.aperture_masses(sites, rows, tuple(KEYS), "galaxy", {"1kpc": 1.0, "3kpc": 3.0}, BOX)


@query(
    "diffuse_hydrogen",
    _BASE + _SITES + f""", w AS (SELECT b.pidx, a.galaxy, b.mass_HI, b.mass_H2, row_number() OVER (PARTITION BY b.pidx ORDER BY CASE WHEN {_NEAR} = 0 THEN 'infinity'::DOUBLE ELSE a.gm / ({_NEAR}) END DESC, a.galaxy) AS k FROM site a JOIN m b ON a.run_id = b.run_id AND a.haloid = b.haloid AND b.ptype = 'gas' WHERE a.gm IS NOT NULL)
SELECT site.run_id, site.haloid, site.galaxy, round(coalesce(sum(mass_HI), 0), 8) + 0.0 AS mass_HI_diffuse, round(coalesce(sum(mass_H2), 0), 8) + 0.0 AS mass_H2_diffuse FROM site LEFT JOIN w ON w.galaxy = site.galaxy AND k = 1 WHERE site.gm IS NOT NULL GROUP BY site.run_id, site.haloid, site.galaxy""",
)
def diffuse_hydrogen(spark, sf_dir):
    rows = cut(members(spark, sf_dir), "members")
    sites = rows.where("ptype = 'bh' and bhmass is not null").select(*KEYS, F.col("pidx").alias("galaxy"), F.col("bhmass").alias("mass"), "x", "y", "z")
    return _rounded(S.share_hydrogen(rows.where("ptype = 'gas'"), sites, tuple(KEYS), "galaxy", BOX), 8)


@query("local_densities", _BASE + f", s AS (SELECT * FROM m WHERE ptype = 'star') SELECT a.pidx, round(sum(b.mass) / (4.0/3.0*pi()*8.0), 8) + 0.0 AS mass_density_2kpc, round(count(*) / (4.0/3.0*pi()*8.0), 8) + 0.0 AS number_density_2kpc FROM s a JOIN s b ON a.run_id = b.run_id AND {_NEAR} <= 4.0 GROUP BY a.pidx")
def local_densities(spark, sf_dir):
    rows = cut(members(spark, sf_dir).where("ptype = 'star'"), "stars")
    return S.local_densities(rows, {"2kpc": 2.0}, BOX, ("run_id",)).select("pidx", (F.round("mass_density_2kpc", 8) + 0.0).alias("mass_density_2kpc"), (F.round("number_density_2kpc", 8) + 0.0).alias("number_density_2kpc"))


_APART = "(a.{0}-b.{0}) - 500.0*round((a.{0}-b.{0})/500.0)"
_KERNEL_SQL = """kz AS (SELECT i, j, sqrt(power(i/100.0, 2) + power(j/100.0, 2)) AS q FROM range(0, 101) t(i), range(0, 101) u(j)),
kw AS (SELECT i, j, 2/pi() * (power(greatest(2 - 2*q, 0), 3) - 4*power(greatest(1 - 2*q, 0), 3)) AS w FROM kz),
kt AS (SELECT a.i, 2*sum(CASE WHEN a.j/100.0 < sqrt(greatest(0, 1 - power(a.i/100.0, 2))) THEN 0.5/100*(a.w + b.w) ELSE 0 END) AS k FROM kw a JOIN kw b ON b.i = a.i AND b.j = a.j + 1 GROUP BY a.i)"""


@query(
    "metal_columns",
    _BASE + f""", {_KERNEL_SQL}, s AS (SELECT run_id, haloid, pidx, x, y, z FROM m WHERE ptype = 'star'), g AS (SELECT run_id, haloid, x, y, z, h, mass * metallicity AS zm FROM m WHERE ptype = 'gas' AND h > 0 AND metallicity IS NOT NULL),
d AS (SELECT a.pidx, b.zm, b.h, sqrt(power({_APART.format("x")}, 2) + power({_APART.format("y")}, 2)) AS r FROM s a JOIN g b ON a.run_id = b.run_id AND a.haloid = b.haloid AND {_APART.format("z")} >= 0),
p AS (SELECT d.pidx, zm/(h*h)*k AS c FROM d JOIN kt ON kt.i = CAST(floor(r/h*100) AS BIGINT) WHERE r < h)
SELECT s.pidx, round(coalesce(sum(c), 0) * 1e6, 3) + 0.0 AS column_density FROM s LEFT JOIN p USING (pidx) GROUP BY s.pidx""",
)
def metal_columns(spark, sf_dir):
    rows = cut(members(spark, sf_dir), "members")
    gas = rows.where("ptype = 'gas'").withColumnRenamed("smoothing_length", "h")
    out = S.metal_columns(rows.where("ptype = 'star'"), gas, tuple(KEYS), list(D.kernel_table(100)), BOX)
    return out.select("pidx", (F.round(F.col("column") * 1e6, 3) + 0.0).alias("column_density"))


# curves and photometry

_GRID = "SELECT 500.0 + 37.5 * i AS w FROM range(0, 800) t(i)"


def _grid(spark):
    return spark.range(800).select((500.0 + 37.5 * F.col("id")).alias("w"))


def _poly_sql(cs: tuple, x: str) -> str:
    return " + ".join(f"({c}) * power({x}, {i})" for i, c in enumerate(cs))


def _cardelli_sql() -> str:
    x = "(1e4/w)"
    a, b = f"(1.752 - 0.316*{x} - 0.104/(({x}-4.67)*({x}-4.67)+0.341))", f"(-3.09 + 1.825*{x} + 1.206/(({x}-4.62)*({x}-4.62)+0.263))"
    return f"""CASE WHEN {x} < 1.1 THEN (0.574 - 0.527/3.1) * power({x}, 1.61) WHEN {x} < 3.3 THEN ({_poly_sql(D.CARDELLI_A, f"({x}-1.82)")}) + ({_poly_sql(D.CARDELLI_B, f"({x}-1.82)")})/3.1
 WHEN {x} < 5.9 THEN {a} + {b}/3.1 WHEN {x} < 8.0 THEN {a} + ({_poly_sql(D.CARDELLI_FAR_A, f"({x}-5.9)")}) + ({b} + ({_poly_sql(D.CARDELLI_FAR_B, f"({x}-5.9)")}))/3.1
 ELSE ({_poly_sql(D.CARDELLI_XUV_A, f"({x}-8.0)")}) + ({_poly_sql(D.CARDELLI_XUV_B, f"({x}-8.0)")})/3.1 END"""


def _calzetti_sql() -> str:
    uv = lambda w: f"(2.659*({_poly_sql(D.CALZETTI_UV, f'(1e4/{w})')}) + 4.05)"
    ir = lambda w: f"(2.659*({_poly_sql(D.CALZETTI_IR, f'(1e4/{w})')}) + 4.05)"
    return f"greatest(0.0, CASE WHEN w < 1200 THEN {uv('1100.0')} + (w-1100.0)*({uv('1200.0')}-{uv('1100.0')})/100 WHEN w < 6300 THEN {uv('w')} WHEN w <= 22000 THEN {ir('w')} ELSE {ir('22000.0')} + (w-22000.0)*({ir('22000.0')}-{ir('21900.0')})/100 END) / {uv('5500.0')}"


def _pei_sql(terms: tuple) -> str:
    f = lambda w: "(" + " + ".join(f"{a}/(power({w}/{at}, {n}) + power({at}/{w}, {n}) + ({b}))" for a, at, b, n in terms) + ")"
    return f"{f('(w/1e4)')} / {f('0.55')}"


@query("dust_curves", f"WITH g AS ({_GRID}) SELECT w, {_r('power(w/5500.0, -1.0)', 'power_law', 8)}, {_r(_calzetti_sql(), 'calzetti', 8)}, {_r(_cardelli_sql(), 'cardelli', 8)}, {_r(_pei_sql(D.SMC), 'smc', 8)}, {_r(_pei_sql(D.LMC), 'lmc', 8)} FROM g")
def dust_curves(spark, sf_dir):
    w = F.col("w")
    return _rounded(_grid(spark).select("w", D.power_law(w).alias("power_law"), D.calzetti(w).alias("calzetti"), D.cardelli(w).alias("cardelli"), D.smc(w).alias("smc"), D.lmc(w).alias("lmc")), 8, "w")


def _madau_sql(z: float) -> str:
    xe, xc = 1 + z, "(w/912.0)"
    lines = " + ".join(f"CASE WHEN w <= {line * xe} THEN {s} * power(w/{line}, 3.46) ELSE 0 END" for line, s in D.MADAU_LINES)
    cont = f"0.25*power({xc},3)*(power({xe},0.46)-power({xc},0.46)) + 9.4*power({xc},1.5)*(power({xe},0.18)-power({xc},0.18)) - 0.7*power({xc},3)*(power({xc},-1.32)-power({xe},-1.32)) - 0.023*(power({xe},1.68)-power({xc},1.68))"
    return f"least(1.0, greatest(0.0, exp(-({lines} + CASE WHEN w < {912.0 * xe} THEN {cont} ELSE 0 END))))"


@query("igm_transmission", f"WITH g AS ({_GRID}) SELECT w, {_r(_madau_sql(3.0), 'z3', 8)}, {_r(_madau_sql(1.0), 'z1', 8)} FROM g")
def igm_transmission(spark, sf_dir):
    return _rounded(_grid(spark).select("w", D.madau(F.col("w"), 3.0).alias("z3"), D.madau(F.col("w"), 1.0).alias("z1")), 8, "w")


@query("uv_slope", "SELECT user_id, round(regr_slope(log10(value), log10(1500 + event_id % 1500)) - 2, 6) AS beta, round(CASE WHEN avg(value) > 0 THEN -2.5*log10(avg(value)*1e-3) - 48.6 END, 6) AS magnitude FROM events WHERE value > 0 GROUP BY user_id HAVING count(*) >= 2")
def uv_slope(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "user_id", "event_id", "value").where("value > 0").select("user_id", "value", F.log10("value").alias("l"), F.log10(1500 + F.col("event_id") % 1500).alias("w"))
    out = rows.groupBy("user_id").agg(PH.uv_slope("w", "l").alias("beta"), PH.ab_magnitude(F.avg("value"), 1e-3).alias("magnitude"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return out.select("user_id", F.round("beta", 6).alias("beta"), F.round("magnitude", 6).alias("magnitude"))


def _models():
    import numpy as np

    ages, metals, wave = np.linspace(6, 10.2, 15), np.linspace(-4, -1, 7), np.linspace(1000, 10000, 91)
    flux = (wave[None, None, :] / 5500.0) ** (-1.5 - 0.2 * (10.2 - ages)[None, :, None] + 0.1 * metals[:, None, None]) * 10 ** (-0.6 * (ages - 6))[None, :, None]
    left = np.clip(1 - 0.08 * (ages - 6), 0.5, 1)[None, :] * np.ones((7, 1))
    return PH.StellarModels(ages, metals, wave, flux * 1e20, left)


@query("photometry")
def photometry(spark, sf_dir):
    """Magnitudes of the stars of every halo with dust columns in front of each star; parts are checked in the tests."""
    import numpy as np

    models = _models()
    band = PH.Band("v", np.exp(-(((models.wavelengths - 5500) / 500) ** 2)), 5500.0)
    config = PH.PhotometryConfig("COMPOSITE", kernel_bins=100, redshift=0.5, luminosity_distance_mpc=2800.0, bands=(band,))
    rows = cut(members(spark, sf_dir).withColumn("galaxy", F.col("run_id") * 1_000_000 + F.col("haloid")), "members")
    stars = rows.where("ptype = 'star' and age > 0 and metallicity > 0").select("galaxy", "pidx", "x", "y", "z", F.log10(F.col("age") * 1e9).alias("log_age"), F.log10("metallicity").alias("log_z"), (F.col("mass") * 1e10).alias("mass"), F.col("vz").alias("v_los"))
    gas = rows.where("ptype = 'gas'").select("galaxy", "x", "y", "z", F.col("smoothing_length").alias("h"), (F.col("mass") * 1e10).alias("mass"), "metallicity")
    galaxies = PH.galaxy_quantities(rows.groupBy("galaxy").agg(F.sum("sfr").alias("sfr"), (F.sum(F.when(F.col("ptype") == "star", F.col("mass"))) * 1e10).alias("mass_star"), P.guarded_divide(F.sum(F.col("metallicity") * F.col("sfr")), F.sum("sfr")).alias("metallicity_gas_sfr_weighted")))
    out = PH.run_photometry(stars, gas, galaxies, "galaxy", models, config, BOX)
    return out.drop("spectrum", "spectrum_nodust")


# lightcone

_TURN = L.BoxTransform((2, 0, 1), (1, -1, 1), (120.0, 30.0, 410.0))
_HALF = 0.12


def _cone_sql() -> str:
    cells = L.replica_cells(BOX, 400.0, 1300.0, L.off_axis_angle(_HALF))
    values = ", ".join(f"({i * BOX}, {j * BOX}, {k * BOX})" for i, j, k in cells)
    moved = [f"(((({'xyz'[o]}) * {float(f)} + {s}) % 500.0) + 500.0) % 500.0" for o, f, s in zip(_TURN.order, _TURN.flips, _TURN.shift)]
    turned = [f"v{'xyz'[o]} * {float(f)}" for o, f in zip(_TURN.order, _TURN.flips)]
    return _BASE + f""", cell(i, j, k) AS (VALUES {values}), q AS (SELECT pidx, {moved[0]} + i AS qx, {moved[1]} + j AS qy, {moved[2]} + k AS qz, {turned[0]} AS ux, {turned[1]} AS uy, {turned[2]} AS uz FROM m, cell WHERE ptype = 'star'),
d AS (SELECT *, sqrt(qx*qx+qy*qy+qz*qz) AS d FROM q) SELECT pidx, {_r("atan2(qx, qz)", "ra", 8)}, {_r("asin(greatest(-1.0, least(1.0, qy/d)))", "dec", 8)}, {_r("d", "comoving_distance", 6)}, {_r(f"(1 + 0.5)*(1 + (qx*ux+qy*uy+qz*uz)/d/{P.C_KMS}) - 1", "redshift_observed", 8)}
FROM d WHERE d >= 400.0 AND d < 1300.0 AND abs(atan2(qx, qz)) <= {_HALF} AND abs(asin(greatest(-1.0, least(1.0, qy/d)))) <= {_HALF}"""


@query("lightcone_select", _cone_sql())
def lightcone_select(spark, sf_dir):
    rows = members(spark, sf_dir).where("ptype = 'star'").select("pidx", "x", "y", "z", "vx", "vy", "vz")
    out = L.select_in_shell(rows, L.Shell(0, 400.0, 1300.0), BOX, _TURN, _HALF)
    z = L.observed_redshift(F.lit(0.5), [F.col(f"q{c}") for c in "xyz"], [F.col(f"qv{c}") for c in "xyz"])
    return _rounded(out.select("pidx", "ra", "dec", "comoving_distance", z.alias("redshift_observed")), 8).withColumn("comoving_distance", F.round("comoving_distance", 6) + 0.0)


@query("lightcone_build")
def lightcone_build(spark, sf_dir):
    """A lightcone from three snapshots with random turns; invariants are checked in the tests."""
    cosmology = P.Cosmology(0.68, 0.3)
    rows = cut(members(spark, sf_dir).where("ptype = 'star'").select("pidx", "mass", "x", "y", "z", "vx", "vy", "vz"), "stars")
    shots = [L.Snapshot(rows, z, BOX, cosmology) for z in (0.1, 0.25, 0.5)]
    return L.build_lightcone(shots, 100.0, 0.05, 0.6, seed=7, redshift_space=True).drop("qx", "qy", "qz", "qvx", "qvy", "qvz")


# external catalogues


@query("subfind_parents", "SELECT n_nationkey AS sub, CASE WHEN n_nationkey % 5 = p OR p = 0 THEN -1 ELSE (n_nationkey - n_nationkey % 5) + p END AS parent FROM (SELECT n_nationkey, (n_nationkey % 5) // 2 AS p FROM nation)")
def subfind_parents(spark, sf_dir):
    subs = table(spark, sf_dir, "nation", "n_nationkey").select(F.col("n_nationkey").alias("sub"), F.expr("n_nationkey div 5").alias("group"), F.expr("(n_nationkey % 5) div 2").alias("local_parent"))
    groups = subs.groupBy("group").agg(F.min("sub").alias("first_sub"))
    return halo_sources.subfind_parents(subs, groups)


@query("nested_match")
def nested_match(spark, sf_dir):
    """Particles to their deepest halo and its field halo, from a membership list; checked by brute force in the tests."""
    rows = latest(table(spark, sf_dir, "subhaloes", "sub_id", "parent_index", "updated_at"), "sub_id", "updated_at")
    halos = rows.select(F.col("sub_id").alias("id"), F.coalesce(F.when(F.col("parent_index") >= 0, F.col("parent_index")), F.lit(0)).alias("host"))
    listed = rows.select((F.col("sub_id") % 500).alias("pid"), F.col("sub_id").alias("halo"))
    particles = table(spark, sf_dir, "events", "event_id").select(F.col("event_id").alias("pid"))
    return halo_sources.match_nested(particles, listed, halos)
