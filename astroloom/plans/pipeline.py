"""From particles with halo ids to a catalogue."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astroloom.functions.physics import Header, eddington_factor, gas_criterion, hydrogen_number_density, unwrap
from astroloom.operators import groups as G
from astroloom.operators import membership as M
from astroloom.operators import photometry as PH
from astroloom.operators import spatial as S
from astroloom.operators.hierarchy import resolve_forest
from astroloom.plans import catalogue
from astroloom.plans.config import RunConfig
from astroloom.plans.stages import STAGES, fill_lists, resolve, runnable
from astroloom.sources.photometry_tables import read_table
from astroloom.tables import cut

logger = logging.getLogger("astroloom")


@dataclass
class Run:
    """Inputs of a run. ``particles``: ptype, pidx (unique over types), x.., vx.., mass, potential, halo_id, sub_id and the gas,
    star and black hole columns, null where a type lacks them. ``subhaloes``: id, parent (-1: field halo), host."""

    particles: DataFrame
    header: Header
    config: RunConfig
    subhaloes: DataFrame | None = None


_TENSOR = (("xx", "xy", "xz"), ("xy", "yy", "yz"), ("xz", "yz", "zz"))


def _vector(columns: list[str]) -> Column:
    return F.when(F.col(columns[0]).isNotNull(), F.array(*columns))


def _dynamics(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Angular momentum, its angles, dispersion and inertia tensor under the names of the catalogue."""
    tensor = F.when(F.col("ixx").isNotNull(), F.array(*[F.array(*[f"i{a}" for a in row]) for row in _TENSOR]))
    return df.select(
        *keys, _vector(["lx", "ly", "lz"]).alias(f"L_{kind}"), F.col("l_azimuth").alias(f"L_azimuth_{kind}"), F.col("l_elevation").alias(f"L_elevation_{kind}"),
        F.col("sigma").alias(f"velocity_dispersion_{kind}"), tensor.alias(f"inertia_tensor_{kind}"),
    )


def core_properties(members: DataFrame, keys: list[str], header: Header, config: RunConfig, kind: str = "haloes") -> DataFrame:
    """Counts, masses, centres, kinematics and radii per type and combined; for haloes overdensities and scales, for galaxies morphology.

    Columns have the declared names. A type that a group lacks has null kinematics and radii; one with fewer than
    three members has zeros.
    """
    box = header.boxsize
    types = G.PTYPE_ORDER if kind == "haloes" else G.BARYONS
    members = cut(members.where(F.col("ptype").isin(*types)).select(*keys, "ptype", "pidx", *G.AXES, *[f"v{c}" for c in G.AXES], "mass", "potential"), "members")
    out = G.counts_and_masses(members, keys).drop("n_baryon", "n_total")
    parts = cut(G.centre_of_mass(members, [*keys, "ptype"], box), "centres")
    kinds = {"baryon": G.BARYONS, **({"total": G.PTYPE_ORDER} if kind == "haloes" else {})}
    centres = {}
    for name, chosen in kinds.items():
        centres[name] = cut(G.combine_centres(parts.where(F.col("ptype").isin(*chosen)), keys, box), "centre")
        out = out.join(centres[name].select(*keys, _vector([f"c{c}" for c in G.AXES]).alias(f"com_pos_{name}"), _vector([f"cv{c}" for c in G.AXES]).alias(f"com_vel_{name}")), keys, "left")
    if kind == "haloes":
        lowest = cut(G.minimum_potential(members, keys), "lowest")
        out = out.join(lowest.select(*keys, _vector([f"m{c}" for c in G.AXES]).alias("minpot_pos"), _vector([f"mv{c}" for c in G.AXES]).alias("minpot_vel")), keys, "left")
    if kind == "haloes" and config.halo_centre == "MIN_POT":
        place = lowest.select(*keys, *[F.col(f"m{c}").alias(f"r{c}") for c in G.AXES], *[F.col(f"mv{c}").alias(f"rv{c}") for c in G.AXES])
    else:
        main = centres["total" if kind == "haloes" else "baryon"]
        place = main.select(*keys, *[F.col(f"c{c}").alias(f"r{c}") for c in G.AXES], *[F.col(f"cv{c}").alias(f"rv{c}") for c in G.AXES])
    sums = cut(G.kinematics(members, [*keys, "ptype"], place, box), "kinematics")
    derived = cut(G.derive_kinematics(sums), "kinematics")
    for ptype in types:
        few = [F.when(F.col("n") < 3, F.lit(0.0)).otherwise(F.col(f"i{a}")).alias(f"i{a}") for a in ("xx", "yy", "zz", "xy", "xz", "yz")]
        own = derived.where(F.col("ptype") == ptype).select(*keys, "lx", "ly", "lz", "l_azimuth", "l_elevation", "sigma", *few)
        out = out.join(_dynamics(own, keys, ptype), keys, "left")
    whole = {}
    for name, chosen in kinds.items():
        relative = centres[name].join(place.select(*keys, *[f"rv{c}" for c in G.AXES]), keys).select(*keys, *[(F.col(f"cv{c}") - F.col(f"rv{c}")).alias(f"cv{c}") for c in G.AXES])
        whole[name] = cut(G.combine_types(sums, keys, relative, chosen), "combined")
        angles = G.derive_kinematics(whole[name], 0).drop("sigma").join(whole[name].select(*keys, "sigma"), keys)  # the combined dispersion stands for any count
        out = out.join(_dynamics(angles, keys, name), keys, "left")
        if kind == "haloes" and name == "total":
            scaled = G.halo_scales(whole[name], header.r200_factor, header.scale_factor, config.MU)
            out = out.join(scaled.select(*keys, "r200m", "velocity_circular", "temperature_virial", "spin_param"), keys, "left")
    if kind == "galaxies":
        axes = {"baryon": whole["baryon"].select(*keys, "lx", "ly", "lz"), **{p: derived.where(F.col("ptype") == p).select(*keys, "lx", "ly", "lz") for p in types}}
        for name, axis in axes.items():
            rows = members if name == "baryon" else members.where(F.col("ptype") == name)
            turned = G.rotation(rows, keys, axis.join(place, keys), box)
            if name == "baryon":
                turned = turned.drop("ke").join(whole["baryon"].select(*keys, "ke"), keys)
            turned = G.morphology(turned)
            out = out.join(turned.select(*keys, F.col("b_over_t").alias(f"BoverT_{name}"), F.col("kappa_rot").alias(f"kappa_rot_{name}")), keys, "left")
    placed = cut(G.radii(members, keys, place.select(*keys, *[f"r{c}" for c in G.AXES]), box), "radii")
    per_type = cut(G.profiles(placed, [*keys, "ptype"], config.radial_quantiles), "profiles")
    names = [c for c in per_type.columns if c.startswith("radius_")]
    wide = [F.max(F.when(F.col("ptype") == p, F.col(c))).alias(f"{c}_{p}") for p in types for c in names]
    out = out.join(per_type.groupBy(*keys).agg(*wide), keys, "left")
    factors = {f"{f}c": float(f) for f in config.virial_factors}
    for name, chosen in kinds.items():
        full = name == "total"
        shape = G.profiles(placed.where(F.col("ptype").isin(*chosen)), keys, config.radial_quantiles, factors if full else {}, header.rhocrit_comoving, header.scale_factor)
        shape = shape if full else shape.drop("vmax", "rmax")
        out = out.join(shape.withColumnsRenamed({c: f"{c}_{name}" for c in names}), keys, "left")
    return cut(out, "core")


def type_properties(members: DataFrame, keys: list[str], config: RunConfig, kind: str = "haloes") -> DataFrame:
    """Gas, star, black hole and, for haloes, thin gas quantities."""
    gas, star, bh = (members.where(F.col("ptype") == p) for p in ("gas", "star", "bh"))
    parts = [G.gas_properties(gas, keys, config.T_lim), G.star_properties(star, keys), G.black_hole_properties(bh, keys, eddington_factor(config.FRAD))]
    if kind == "haloes":
        n_h = hydrogen_number_density(F.col("rho"), F.col("metallicity"), F.coalesce(F.col("helium_fraction"), F.lit(0.24)))
        parts.append(G.cgm_properties(gas.withColumn("nH", n_h), keys, config.nH_lim))
    return reduce(lambda a, b: a.join(b, keys, "full"), parts)


def galaxies_in(particles: DataFrame, header: Header, config: RunConfig) -> DataFrame:
    """(pidx, galaxy) for all baryons, by phase-space friends-of-friends in each halo; -1 outside galaxies."""
    baryons = particles.where(F.col("ptype").isin(*G.BARYONS) & (F.col("halo_id") >= 0))
    n_h = hydrogen_number_density(F.col("rho"), F.col("metallicity"), F.coalesce(F.col("helium_fraction"), F.lit(0.24)))
    dense = gas_criterion(n_h, F.col("temperature"), F.col("sfr"), config.gas_criterion, config.nH_lim, config.T_lim)
    used = baryons.where((F.col("ptype") != "gas") | F.coalesce(dense, F.lit(False)))
    first = used.groupBy("halo_id").agg(F.min(F.struct("pidx", *G.AXES)).alias("f"))
    placed = used.join(first, "halo_id").withColumns({c: unwrap(F.col(c), F.col(f"f.{c}"), header.boxsize) for c in G.AXES}).drop("f")
    found = S.find_galaxies(placed.select("halo_id", "ptype", "pidx", *G.AXES, "vx", "vy", "vz"), "halo_id", config.b * header.mean_separation, config.velocity_factor, config.min_stars_per_galaxy, config.min_gas_per_galaxy)
    return found.select("pidx", "galaxy")


def photometry(inside: DataFrame, galaxies: DataFrame, header: Header, config: RunConfig, key: str = "galaxy", orientation: str | None = None, keep_spectra: bool = False) -> DataFrame:
    """Magnitudes, infrared luminosity and UV slopes of galaxies from their members and properties, keyed by ``key``.

    ``galaxies`` has the declared columns sfr, mass_star, metallicity_gas_sfr_weighted, com_pos_baryon and, for an
    ``orientation`` ('face-on' or 'side-on'), L_baryon. Galaxies without stars have no row.
    """
    models, bands = read_table(inside.sparkSession, config.photometry_table_path, config.bands)
    place = {f"c{c}": F.get("com_pos_baryon", F.lit(i)) for i, c in enumerate(G.AXES)}
    turn = {f"l{c}": F.get("L_baryon", F.lit(i)) for i, c in enumerate(G.AXES)}
    known = PH.galaxy_quantities(galaxies).select(key, "log_ssfr", "log_z", *[v.alias(k) for k, v in {**place, **turn}.items()])
    stars = PH.star_quantities(inside.where("ptype = 'star'")).select(key, "pidx", *G.AXES, *[f"v{c}" for c in G.AXES], "log_age", "log_z", "mass")
    gas = inside.where("ptype = 'gas'")
    own = ["dust_mass"] if "dust_mass" in gas.columns else []
    gas = gas.select(key, *G.AXES, F.col("smoothing_length").alias("h"), "mass", "metallicity", *own)
    distance = float(header.cosmology.luminosity_distance(header.redshift)[0]) if header.redshift >= 1e-10 else 0.0
    setup = PH.PhotometryConfig(
        config.extinction_law, config.kernel_type, config.interpolation_bins, config.viewing_axis.lower(), header.redshift, distance,
        config.use_dust, config.use_cosmic_extinction, config.power_law_alpha, orientation, bands,
    )
    out = PH.run_photometry(stars, gas, known, key, models, setup, header.boxsize)
    return out.withColumnRenamed("spectrum", "spectra").withColumnRenamed("spectrum_nodust", "spectra_nodust") if keep_spectra else out.drop("spectrum", "spectrum_nodust")


def planned(run: Run) -> set[str]:
    """Names of the stages that run: those switched on and, of these, the ones whose columns are there and whose needs run.

    Photometry needs a table besides. A stage that is on but cannot run is named in the log.
    """
    config = run.config
    have = set(run.particles.columns)
    vectors = {"pos": set(G.AXES), "vel": {f"v{c}" for c in G.AXES}}
    have |= {name for name, parts in vectors.items() if parts <= have}
    available = {p: have for p, on in config.process_ptypes.items() if on}
    wanted = [s for s in STAGES if config.stages.get(s, True) and (s != "photometry" or config.photometry_table_path is not None)]
    wanted = [s for s in wanted if all(config.stages.get(n.name, True) for n in resolve([s]))]
    names = {s.name for s in runnable(wanted, available)} & set(wanted)
    for lost in sorted(set(wanted) - names):
        logger.warning("stage %s is on, but the columns it needs are not there", lost)
    return names


def analyse(run: Run) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(haloes, galaxies, members) in catalogue order, with the columns of the stages that :func:`planned` names."""
    config, header = run.config, run.header
    stages = planned(run)
    types = tuple(p for p, on in config.process_ptypes.items() if on)
    particles = cut(M.select_halos(run.particles, "halo_id", config.min_dm_per_halo, types), "particles")
    fields = particles.select("halo_id").distinct().select(F.col("halo_id").alias("id"), F.lit(-1).cast("long").alias("parent"))
    offset = 1 << 40  # subhaloes get numbers of their own behind the field haloes
    own = F.col("halo_id")
    if run.subhaloes is not None:
        subs = run.subhaloes.join(fields.select(F.col("id").alias("host")), "host", "left_semi")
        subs = subs.select((F.col("id") + offset).alias("id"), F.when(F.col("parent") < 0, F.col("host")).otherwise(F.col("parent") + offset).alias("parent"))
        fields = fields.unionByName(subs)
        own = F.when(F.coalesce("sub_id", F.lit(-1)) >= 0, F.col("sub_id") + offset).otherwise(F.col("halo_id"))
    forest = resolve_forest(fields, "id", "parent", -1)
    forest.nodes = cut(forest.nodes, "forest")
    exclusive = particles.withColumn("group", own)
    members = cut(M.inclusive(exclusive, "group", forest).withColumnRenamed("group", "id"), "inclusive")
    haloes = core_properties(members, ["id"], header, config)
    if "properties_ptype_specific" in stages:
        haloes = haloes.join(type_properties(members, ["id"], config), "id", "left")
    tree = forest.nodes.select("id", F.coalesce("parent", F.lit(-1)).alias("parent_halo_index"), F.col("root").alias("field_halo_index"), (F.col("depth") - 1).alias("depth"))
    haloes = cut(catalogue.finish(haloes.join(tree, "id"), "mass_total", "depth", ("parent_halo_index", "field_halo_index")), "haloes")
    rows = haloes.select("id", "row")
    edges = members.select("id", "ptype", "pidx").join(rows, "id").select(F.lit("haloes").alias("kind"), "row", "ptype", "pidx")
    if "find_galaxies" not in stages:
        return haloes, haloes.limit(0), edges
    inside = particles.withColumn("group", own).join(galaxies_in(particles, header, config), "pidx").where("galaxy >= 0")
    inside = cut(inside.withColumn("order", F.struct(G.ptype_rank().alias("t"), F.col("pidx").alias("p"))), "galaxies")
    votes = M.plurality(inside.withColumn("vote", F.when(F.col("group") >= offset, F.col("group")).otherwise(F.lit(-1))), "galaxy", "vote", ["order"])
    if config.subhalo_override:
        inside = cut(M.trim_interlopers(inside.withColumn("vote", F.when(F.col("group") >= offset, F.col("group")).otherwise(F.lit(-1))), "galaxy", "vote", votes, config.min_stars_per_galaxy, config.min_gas_per_galaxy).where("galaxy >= 0"), "galaxies")
    galaxies = core_properties(inside, ["galaxy"], header, config, "galaxies")
    if "properties_ptype_specific" in stages:
        galaxies = galaxies.join(type_properties(inside, ["galaxy"], config, "galaxies"), "galaxy", "left")
    parents = inside.groupBy("galaxy").agg(F.min(F.struct("order", "halo_id"))["halo_id"].alias("field")).join(votes, "galaxy", "left")
    parents = parents.select("galaxy", "field", F.when(F.col("winner") >= 0, F.col("winner")).otherwise(F.col("field")).alias("parent"), F.when(F.col("winner") >= 0, F.col("fraction")).otherwise(F.lit(1).cast("float")).alias("parent_membership_fraction"))
    galaxies = galaxies.join(parents, "galaxy")
    if "properties_local_environment" in stages:
        sites = galaxies.select(F.col("field").alias("halo_id"), "galaxy", *[F.get("com_pos_baryon", F.lit(i)).alias(c) for i, c in enumerate(G.AXES)], F.col("mass_baryon").alias("mass"))
        phases = tuple(p for p in ("HI", "H2") if f"mass_{p}" in particles.columns)
        around = S.aperture_masses(sites, particles, ("halo_id",), "galaxy", {f"{r}kpc": float(r) for r in config.aperture_size}, header.boxsize, phases)
        galaxies = galaxies.join(around.drop("halo_id"), "galaxy", "left")
        if config.distribute_halo_hydrogen:
            free = particles.where(F.col("ptype") == "gas").join(inside.select("pidx"), "pidx", "left_anti")
            galaxies = galaxies.join(S.share_hydrogen(free, sites, ("halo_id",), "galaxy", header.boxsize).drop("halo_id"), "galaxy", "left")
    if "photometry" in stages:
        galaxies = cut(galaxies, "galaxies")
        galaxies = galaxies.join(photometry(inside, galaxies, header, config), "galaxy", "left")
    for pointer, source in (("field_halo_index", "field"), ("parent_halo_index", "parent")):
        galaxies = galaxies.join(rows.select(F.col("id").alias(source), F.col("row").alias(pointer)), source, "left").drop(source)
    galaxies = cut(catalogue.finish(galaxies.withColumnRenamed("galaxy", "id"), "mass_baryon"), "galaxies")
    central = M.galaxy_parents(galaxies.select(F.col("row").alias("galaxy"), F.col("parent_halo_index").alias("halo")), "galaxy", "halo", resolve_forest(haloes.select("row", "parent_halo_index"), "row", "parent_halo_index", -1))
    haloes = haloes.join(central.groupBy(F.col("halo").alias("row")).agg(F.min("galaxy").alias("central_galaxy_index")), "row", "left").withColumn("central_galaxy_index", F.coalesce("central_galaxy_index", F.lit(-1)))
    linked = inside.select(F.col("galaxy").alias("id"), "ptype", "pidx").join(galaxies.select("id", "row"), "id").select(F.lit("galaxies").alias("kind"), "row", "ptype", "pidx")
    return haloes, galaxies, edges.unionByName(linked)


def analyse_to(run: Run, path: str, overwrite: bool = False) -> None:
    """Runs the analysis and writes the catalogue."""
    haloes, galaxies, members = analyse(run)
    bands = tuple(c.removeprefix("mag_abs_nodust_") for c in galaxies.columns if c.startswith("mag_abs_nodust_"))
    lists = fill_lists(tuple(run.config.radial_quantiles), run.config.virial_factors, run.config.aperture_size, bands)
    catalogue.write(path, haloes, galaxies, members, run.header.row(), run.config.to_json(), overwrite, lists, "zstd" if run.config.compress_catalogue else "none")
