"""Group properties of particles: masses, centres, kinematics, profiles and phase quantities.

Members are rows of (keys, ptype, pidx, x, y, z, vx, vy, vz, mass, potential, ...), one row for each group that a particle counts in.
Aggregations take partial sums before any exchange, so groups of any size are safe; where members need a value of
their group, heavy groups get it by broadcast (see ``skew``). Undefined results are null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astroloom.functions.physics import G_VCIRC, guarded_asin, guarded_divide, min_image, norm, virial_temperature_factor, wrap
from astroloom.operators.skew import running_sums, skew_join

#: Order in which particle types decide ties.
PTYPE_ORDER = ("gas", "dm", "star", "bh")
BARYONS = ("gas", "star", "bh")
AXES = ("x", "y", "z")


def ptype_rank(ptype: str | Column = "ptype") -> Column:
    column = F.col(ptype) if isinstance(ptype, str) else ptype
    chain = F
    for i, name in enumerate(PTYPE_ORDER):
        chain = chain.when(column == name, F.lit(i))
    return chain.otherwise(F.lit(len(PTYPE_ORDER)))


def summarise(members: DataFrame, keys: list[str], value: str, order: str = "pidx") -> DataFrame:
    """Sum, count, extremes and the first members that reach them, per group.

    ``argmax`` and ``argmin`` name the first row in ``order`` on ties, ``first`` the first row at all. Null and NaN
    values count for ``n`` and ``first`` only.
    """
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return members.groupBy(*keys).agg(
        F.coalesce(F.sum(v), F.lit(0.0)).alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.max(v).alias("largest"),
        F.min(v).alias("smallest"),
        (-F.max(F.when(v.isNotNull(), F.struct(v.alias("v"), (-F.col(order)).alias("o"))))["o"]).alias("argmax"),
        F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), F.col(order).alias("o"))))["o"].alias("argmin"),
        F.min(order).alias("first"),
    )


def counts_and_masses(members: DataFrame, keys: list[str]) -> DataFrame:
    """``n_<type>`` and ``mass_<type>`` per particle type, baryons and all types, in one pass."""
    def of(kind):
        return F.col("ptype").isin(*kind) if isinstance(kind, tuple) else F.col("ptype") == kind

    kinds = {**{t: t for t in PTYPE_ORDER}, "baryon": BARYONS}
    columns = []
    for name, kind in kinds.items():
        columns += [F.count(F.when(of(kind), 1)).alias(f"n_{name}"), F.coalesce(F.sum(F.when(of(kind), F.col("mass"))), F.lit(0.0)).alias(f"mass_{name}")]
    return members.groupBy(*keys).agg(*columns, F.count(F.lit(1)).alias("n_total"), F.sum("mass").alias("mass_total"))


def centre_of_mass(members: DataFrame, keys: list[str], box: float) -> DataFrame:
    """Periodic centre ``cx, cy, cz`` and mean velocity ``cvx, cvy, cvz`` per group, with ``n`` and ``mass``.

    Offsets from the group's first member (smallest pidx) are taken to the nearest image, averaged by mass and
    added to it. A group without mass has no centre.
    """
    anchors = members.groupBy(*keys).agg(F.min(F.struct("pidx", *AXES)).alias("anchor")).select(*keys, *[F.col(f"anchor.{c}").alias(f"a{c}") for c in AXES])
    placed = skew_join(members, anchors, keys, "pidx")
    mass = F.sum("mass")
    sums = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), mass.alias("mass"), *[F.first(f"a{c}").alias(f"a{c}") for c in AXES],
        *[F.sum(F.col("mass") * min_image(F.col(c) - F.col(f"a{c}"), box)).alias(f"s{c}") for c in AXES],
        *[F.sum(F.col("mass") * F.col(f"v{c}")).alias(f"sv{c}") for c in AXES],
    )
    centre = [wrap(guarded_divide(F.col(f"s{c}"), F.col("mass")) + F.col(f"a{c}"), box).alias(f"c{c}") for c in AXES]
    return sums.select(*keys, "n", "mass", *centre, *[guarded_divide(F.col(f"sv{c}"), F.col("mass")).alias(f"cv{c}") for c in AXES])


def combine_centres(parts: DataFrame, keys: list[str], box: float) -> DataFrame:
    """One centre from centres per type (keys, ptype, mass, cx.., cvx..): anchored at the most massive type, ties by type order."""
    best = parts.where("mass > 0").groupBy(*keys).agg(F.max(F.struct("mass", (-ptype_rank()).alias("r"), *[f"c{c}" for c in AXES])).alias("b"))
    best = best.select(*keys, *[F.col(f"b.c{c}").alias(f"a{c}") for c in AXES])
    placed = parts.where("mass > 0").join(best, keys)
    sums = placed.groupBy(*keys).agg(
        F.sum("mass").alias("mass"), *[F.first(f"a{c}").alias(f"a{c}") for c in AXES],
        *[F.sum(F.col("mass") * min_image(F.col(f"c{c}") - F.col(f"a{c}"), box)).alias(f"s{c}") for c in AXES],
        *[F.sum(F.col("mass") * F.col(f"cv{c}")).alias(f"sv{c}") for c in AXES],
    )
    return sums.select(*keys, "mass", *[wrap(F.col(f"s{c}") / F.col("mass") + F.col(f"a{c}"), box).alias(f"c{c}") for c in AXES], *[(F.col(f"sv{c}") / F.col("mass")).alias(f"cv{c}") for c in AXES])


def minimum_potential(members: DataFrame, keys: list[str]) -> DataFrame:
    """Position ``mx..`` and velocity ``mvx..`` of the member with the least potential; ties by type order, then pidx."""
    lowest = members.where(F.col("potential").isNotNull()).groupBy(*keys).agg(F.min(F.struct("potential", ptype_rank().alias("rank"), "pidx", *AXES, *[f"v{c}" for c in AXES])).alias("m"))
    return lowest.select(*keys, F.col("m.pidx").alias("minpot_pidx"), *[F.col(f"m.{c}").alias(f"m{c}") for c in AXES], *[F.col(f"m.v{c}").alias(f"mv{c}") for c in AXES])


def _cross(a: tuple, b: tuple) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _relative(box: float) -> tuple[tuple, tuple]:
    """(offset, velocity) of a member from the reference columns rx.., rvx.. of its group."""
    return tuple(min_image(F.col(c) - F.col(f"r{c}"), box) for c in AXES), tuple(F.col(f"v{c}") - F.col(f"rv{c}") for c in AXES)


def kinematics(members: DataFrame, keys: list[str], reference: DataFrame, box: float) -> DataFrame:
    """Per group (and any further keys such as ptype) n, mass, lx ly lz, ke, dispersion sum and inertia tensor about the reference.

    ``reference``: the group keys with rx, ry, rz, rvx, rvy, rvz. ``dispersion`` is the mass-weighted sum of squared
    velocities about the mean velocity of the rows of the same full key, from sums of one pass.
    """
    groups = [k for k in keys if k in reference.columns]
    (dx, dy, dz), v = _relative(box)
    m = F.col("mass")
    momentum = _cross((dx, dy, dz), tuple(m * u for u in v))
    placed = skew_join(members, reference, groups, "pidx")
    sums = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(m).alias("mass"),
        *[F.sum(x).alias(f"l{c}") for x, c in zip(momentum, AXES)],
        F.sum(0.5 * m * (v[0] * v[0] + v[1] * v[1] + v[2] * v[2])).alias("ke"),
        *[F.sum(m * u).alias(f"p{c}") for u, c in zip(v, AXES)],
        F.sum(m * (dy * dy + dz * dz)).alias("ixx"), F.sum(m * (dx * dx + dz * dz)).alias("iyy"), F.sum(m * (dx * dx + dy * dy)).alias("izz"),
        F.sum(-m * dx * dy).alias("ixy"), F.sum(-m * dx * dz).alias("ixz"), F.sum(-m * dy * dz).alias("iyz"),
    )
    bulk = guarded_divide(F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz"), F.col("mass"))
    return sums.withColumn("dispersion", F.greatest(F.lit(0.0), 2 * F.col("ke") - bulk)).withColumns({f"bv{c}": guarded_divide(F.col(f"p{c}"), F.col("mass")) for c in AXES}).drop("px", "py", "pz")


def derive_kinematics(sums: DataFrame, least: int = 3) -> DataFrame:
    """Angles of the angular momentum and the velocity dispersion; with fewer than ``least`` members these and L are 0."""
    size = norm(F.col("lx"), F.col("ly"), F.col("lz"))
    few = F.col("n") < least
    zero = lambda c: F.when(F.col("n") == 0, F.lit(None)).when(few, F.lit(0.0)).otherwise(c)
    out = sums.withColumns({
        "l_size": zero(size), "l_azimuth": zero(F.atan2("ly", "lx")), "l_elevation": zero(guarded_asin(guarded_divide(F.col("lz"), size))),
        "sigma": zero(F.sqrt(guarded_divide(F.col("dispersion"), F.col("mass")))),
    })
    return out.withColumns({f"l{c}": zero(F.col(f"l{c}")) for c in AXES})


def combine_types(parts: DataFrame, keys: list[str], centres: DataFrame, kinds: tuple[str, ...], least: int = 3) -> DataFrame:
    """Sums of several types from sums per type: n, mass, L, KE, dispersion and inertia.

    ``parts``: keys, ptype and the columns of :func:`kinematics`; ``centres``: keys with the combined mean velocity
    cvx, cvy, cvz relative to the same reference. A type with fewer than ``least`` members adds nothing to L and the
    inertia tensor. The bulk motion of each type is added to dispersion and kinetic energy.
    """
    shift = sum(((F.col(f"bv{c}") - F.col(f"cv{c}")) * (F.col(f"bv{c}") - F.col(f"cv{c}")) for c in AXES), F.lit(0.0))
    counts = F.col("n") >= least
    rows = parts.where(F.col("ptype").isin(*kinds) & (F.col("mass") > 0)).join(centres.select(*keys, *[f"cv{c}" for c in AXES]), keys)
    out = rows.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("mass").alias("mass"),
        *[F.sum(F.when(counts, F.col(f"l{c}")).otherwise(0.0)).alias(f"l{c}") for c in AXES],
        F.sum(F.col("ke") + 0.5 * F.col("mass") * shift).alias("ke"), F.sum(F.col("dispersion") + F.col("mass") * shift).alias("dispersion"),
        *[F.sum(F.when(counts, F.col(f"i{a}")).otherwise(0.0)).alias(f"i{a}") for a in ("xx", "yy", "zz", "xy", "xz", "yz")],
    )
    return out.withColumn("sigma", F.sqrt(guarded_divide(F.col("dispersion"), F.col("mass"))))


def rotation(members: DataFrame, keys: list[str], reference: DataFrame, box: float) -> DataFrame:
    """Counter-rotating mass and rotational energy about each group's angular momentum.

    ``reference``: the group keys with rx.., rvx.. and the angular momentum lx, ly, lz.
    """
    groups = [k for k in keys if k in reference.columns]
    d, v = _relative(box)
    m = F.col("mass")
    own = _cross(d, tuple(m * u for u in v))
    l = tuple(F.col(f"l{c}") for c in AXES)  # noqa: E741
    along = own[0] * l[0] + own[1] * l[1] + own[2] * l[2]
    arm = norm(*_cross(d, l))
    turn = guarded_divide(along, arm * m)
    placed = skew_join(members, reference, groups, "pidx")
    return placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(m).alias("mass"), F.coalesce(F.sum(F.when(along < 0, m)), F.lit(0.0)).alias("mass_counter"),
        F.coalesce(F.sum(0.5 * m * turn * turn), F.lit(0.0)).alias("k_rot"), F.sum(0.5 * m * (v[0] * v[0] + v[1] * v[1] + v[2] * v[2])).alias("ke"),
    )


def morphology(sums: DataFrame, least: int = 3) -> DataFrame:
    """Bulge share 2 m_counter / m (not clipped) and rotational share of the kinetic energy; 0 with fewer than ``least`` members."""
    few = lambda c: F.when(F.col("n") == 0, F.lit(None)).when(F.col("n") < least, F.lit(0.0)).otherwise(c)
    return sums.withColumns({"b_over_t": few(guarded_divide(2 * F.col("mass_counter"), F.col("mass"))), "kappa_rot": few(guarded_divide(F.col("k_rot"), F.col("ke")))})


def halo_scales(groups: DataFrame, r200_factor: float, scale_factor: float, mu: float = 0.6) -> DataFrame:
    """r200m, circular velocity, virial temperature and spin from total mass and total angular momentum."""
    mass = F.when(F.col("mass") > 0, F.col("mass"))
    r = F.lit(r200_factor) * F.cbrt(mass)
    v = F.sqrt(G_VCIRC * mass / (r * scale_factor))
    return groups.withColumns({
        "r200m": r, "velocity_circular": v, "temperature_virial": F.lit(virial_temperature_factor(mu)) * v * v,
        "spin_param": norm(F.col("lx"), F.col("ly"), F.col("lz")) / (math.sqrt(2) * mass * v * r),
    })


def radii(members: DataFrame, keys: list[str], reference: DataFrame, box: float) -> DataFrame:
    """Members with ``r``, their periodic distance from the reference point rx, ry, rz of their group."""
    d = [min_image(F.col(c) - F.col(f"r{c}"), box) for c in AXES]
    return skew_join(members, reference, keys, "pidx").withColumn("r", norm(*d)).drop(*[c for c in reference.columns if c not in keys])


def profiles(placed: DataFrame, keys: list[str], quantiles: dict[str, float], overdensities: dict[str, float] | None = None, rhocrit: float = 1.0, scale_factor: float = 1.0) -> DataFrame:
    """Enclosed-mass radii, largest radius, overdensity radii and masses, and peak circular velocity per group.

    ``placed`` has keys, pidx, r and mass. Radius ``radius_<name>``: the first r whose enclosed mass reaches the
    quantile. ``r<name>`` and ``m<name>``: the outermost r > 0 whose mean density is at least the given multiple of
    ``rhocrit``, and the mass there. ``vmax`` and ``rmax``: the largest circular velocity and where, the inner one
    on ties. All come from one running mass, ordered by (r, pidx); no group is sorted in one task if it is heavy.
    """
    rows = placed.select(*keys, "pidx", "r", "mass")
    run = running_sums(rows, keys, ["r", "pidx"], {"enclosed": F.col("mass")})
    totals = rows.groupBy(*keys).agg(F.sum("mass").alias("total"))
    run = skew_join(run, totals, keys, "pidx")
    outside = F.when(F.col("r") > 0, F.col("r"))
    speed = F.sqrt(G_VCIRC * F.col("enclosed") / (outside * scale_factor))
    columns = [F.max("r").alias("radius_max")]
    for name, q in quantiles.items():
        columns.append(F.min(F.when((F.col("total") > 0) & (F.col("enclosed") >= F.lit(q) * F.col("total")), F.col("r"))).alias(f"radius_{name}"))
    density = F.col("enclosed") / (4 / 3 * math.pi * outside * outside * outside)
    for name, factor in (overdensities or {}).items():
        columns.append(F.max(F.when((F.col("r") > 0) & (density >= factor * rhocrit), F.struct("r", "enclosed"))).alias(f"__{name}"))
    columns.append(F.max(F.when(F.col("r") > 0, F.struct(speed.alias("v"), (-F.col("r")).alias("r")))).alias("__peak"))
    out = run.groupBy(*keys).agg(*columns)
    for name in overdensities or {}:
        out = out.withColumns({f"r{name}": F.col(f"__{name}.r"), f"m{name}": F.col(f"__{name}.enclosed")}).drop(f"__{name}")
    return out.withColumns({"vmax": F.col("__peak.v"), "rmax": -F.col("__peak.r")}).drop("__peak")


def _weighted(value: str, weight: Column, where: Column | None = None) -> Column:
    top, bottom = F.col(value) * weight, F.when(F.col(value).isNotNull(), weight)
    if where is not None:
        top, bottom = F.when(where, top), F.when(where, bottom)
    return guarded_divide(F.sum(top), F.sum(bottom))


def gas_properties(gas: DataFrame, keys: list[str], temperature_limit: float = 1e5) -> DataFrame:
    """HI and H2 mass, star formation, weighted metallicity and temperature, cold and hot mass of the gas of each group."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return gas.groupBy(*keys).agg(
        zero(F.sum("mass_HI")).alias("mass_HI"), zero(F.sum("mass_H2")).alias("mass_H2"), zero(F.sum("sfr")).alias("sfr"),
        _weighted("metallicity", F.col("mass")).alias("metallicity_gas_mass_weighted"), _weighted("metallicity", F.col("sfr")).alias("metallicity_gas_sfr_weighted"),
        _weighted("temperature", F.col("mass")).alias("temperature_gas_mass_weighted"),
        zero(F.sum(F.when(F.col("temperature") < temperature_limit, F.col("mass")))).alias("mass_gas_cold"),
        zero(F.sum(F.when(F.col("temperature") >= temperature_limit, F.col("mass")))).alias("mass_gas_hot"),
    )


def cgm_properties(gas: DataFrame, keys: list[str], density_limit: float) -> DataFrame:
    """Mass, temperature and metallicity of the thin gas (``nH`` below the limit) of each group."""
    thin = F.col("nH") < density_limit
    metal = F.col("mass") * F.col("metallicity")
    return gas.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(thin, F.col("mass"))), F.lit(0.0)).alias("mass_cgm"),
        _weighted("temperature", F.col("mass"), thin).alias("temperature_gas_mass_weighted_cgm"), _weighted("temperature", metal, thin).alias("temperature_gas_metal_weighted_cgm"),
        _weighted("metallicity", F.col("mass"), thin).alias("metallicity_gas_mass_weighted_cgm"),
        _weighted("metallicity", F.col("mass") * F.col("temperature"), thin).alias("metallicity_gas_temperature_weighted_cgm"),
    )


def star_properties(stars: DataFrame, keys: list[str]) -> DataFrame:
    """Mass- and metal-weighted age and mass-weighted metallicity of the stars of each group."""
    return stars.groupBy(*keys).agg(
        _weighted("metallicity", F.col("mass")).alias("metallicity_star_mass_weighted"), _weighted("age", F.col("mass")).alias("age_star_mass_weighted"),
        _weighted("age", F.col("mass") * F.col("metallicity")).alias("age_star_metal_weighted"),
    )


def black_hole_properties(holes: DataFrame, keys: list[str], eddington: float) -> DataFrame:
    """Mass, accretion rate and Eddington ratio of the most massive black hole, the first in pidx on ties."""
    best = holes.where(F.col("bhmass").isNotNull()).groupBy(*keys).agg(F.max(F.struct("bhmass", (-F.col("pidx")).alias("o"), "bhmdot")).alias("b"))
    mass, rate = F.col("b.bhmass"), F.col("b.bhmdot")
    return best.select(*keys, mass.alias("smbh_mass"), rate.alias("smbh_mdot"), guarded_divide(rate, F.lit(eddington) * mass).alias("smbh_fedd"))
