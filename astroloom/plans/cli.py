"""Command line: ``python -m astroloom.plans.cli init|analyse|lightcone``."""

from __future__ import annotations

import argparse
import logging
import os
from functools import reduce

from pyspark.sql import functions as F

from astroloom.operators.lightcone import Snapshot, build_lightcone, write_lightcone
from astroloom.operators.spatial import friends_of_friends, linking_length, nearest_label
from astroloom.plans.catalogue import Catalogue
from astroloom.plans.config import RunConfig
from astroloom.plans.pipeline import Run, analyse_to
from astroloom.plans.runlog import RunLog, warn_if_dominant
from astroloom.session import build_session
from astroloom.sources import halo_sources as H
from astroloom.sources.formats import PTYPE_CODES, open_snapshot
from astroloom.sources.halo_sources import choose_source
from astroloom.tables import cut

logger = logging.getLogger("astroloom")
TEMPLATE = """# settings; sections may be nested freely
input:
  snapshot_path: snapshot
  output_dir: catalogue
  simulation_type: SWIFT-EAGLE
  halo_id_source: SNAP_OR_FOF
haloes:
  min_dm_per_halo: 24
  halo_b: 0.2
galaxies:
  min_stars_per_galaxy: 16
  b: 0.02
"""
_GAS = ["rho", "temperature", "sfr", "metallicity", "helium_fraction", "mass_HI", "mass_H2", "smoothing_length", "dust_mass"]
_OWN = {"gas": _GAS, "star": ["metallicity", "age"], "bh": ["bhmass", "bhmdot"], "dm": []}


def generate_config(folder: str) -> str:
    path = os.path.join(folder, "config.yaml")
    with open(path, "x") as file:  # an existing file is an error
        file.write(TEMPLATE)
    return path


def load_particles(snapshot, config: RunConfig):
    """All wanted particle types as one table; ``pidx`` numbers particles by id within the run."""
    parts = []
    for ptype in (p for p, on in config.process_ptypes.items() if on):
        have = snapshot.available(ptype)
        columns = ["particle_id", "pos", "vel", "mass", *[c for c in ("potential", "halo_id", *_OWN[ptype]) if c in have]]
        df = snapshot.read(ptype, columns).withColumnRenamed("particle_id", "pidx").withColumn("ptype", F.lit(ptype))
        parts.append(df)
    names = list(dict.fromkeys(c for p in parts for c in p.columns))
    wanted = list(dict.fromkeys([*names, "potential", "halo_id", *[c for own in _OWN.values() for c in own if c != "dust_mass" or c in names]]))
    full = [p.select(*[F.col(c) if c in p.columns else F.lit(None).cast("long" if c == "halo_id" else "double").alias(c) for c in wanted]) for p in parts]
    out = full[0]
    for p in full[1:]:
        out = out.unionByName(p)
    return out


def _from_catalogue(source: str, particles, snapshot, config: RunConfig):
    """(particles with halo_id and sub_id, subhaloes) from an external catalogue."""
    spark, path = snapshot.spark, config.halo_catalogue_path
    pids = particles.select(F.col("pidx").alias("pid"))
    if source == "AHF":
        stem = path.removesuffix("_halos").removesuffix("_particles")
        memberships, halos = H.ahf_source(spark, f"{stem}_halos", f"{stem}_particles")
        halos = cut(halos, "halos")
        matched = H.match_nested(pids, memberships, halos)
        subhaloes = H.nested_subhaloes(halos)
    elif source == "HBT-HERONS":
        listed, subs = H.herons_source(spark, path)
        matched = cut(H.match_offsets(pids, listed, subs), "matched")
        subhaloes = H.track_subhaloes(subs, matched)
    else:
        types = [p for p, on in config.process_ptypes.items() if on]
        placed, parents = H.subfind_source(spark, path, {p: PTYPE_CODES[p] for p in types})
        where = reduce(lambda a, b: a.unionByName(b), [snapshot.positions(p).withColumn("ptype", F.lit(p)) for p in types])
        matched = pids.join(where.join(placed, ["ptype", "position"]).select(F.col("particle_id").alias("pid"), F.col("group").alias("field_halo"), F.col("sub").alias("sub_halo")), "pid", "left")
        matched = matched.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("field_halo", "sub_halo")})
        subhaloes = parents.select(F.col("sub").alias("id"), "parent", F.col("group").alias("host"))
    out = particles.drop("halo_id", "sub_id").join(matched.withColumnsRenamed({"pid": "pidx", "field_halo": "halo_id", "sub_halo": "sub_id"}), "pidx")
    return out, cut(subhaloes, "subhaloes")


def _found(particles, snapshot, config: RunConfig):
    """Particles with the halo numbers of the built-in finder, which are stored beside the snapshot on request."""
    box = snapshot.header.boxsize
    dm = particles.where("ptype = 'dm'")
    length = linking_length(dm.count(), box, config.halo_b)
    least = config.min_dm_per_halo if config.min_dm_per_halo_to_store is None else max(1, config.min_dm_per_halo_to_store)
    labels = cut(friends_of_friends(dm, length, box, least), "labels")
    largest = labels.where("label = 0").count()  # labels count down from the largest halo
    warn_if_dominant(largest, labels.count())
    linked = dm.select("pidx", "x", "y", "z").join(labels.where("label >= 0").select("pidx", "label"), "pidx")
    attach = config.halo_attach_ptypes or ("gas", "star", "bh")
    near = nearest_label(particles.where(F.col("ptype").isin(*attach)), linked, length, box)
    ids = cut(labels.select("pidx", "label").unionByName(near), "ids")
    out = particles.drop("halo_id").join(ids.withColumnRenamed("label", "halo_id"), "pidx", "left").withColumn("halo_id", F.coalesce("halo_id", F.lit(-1)))
    if config.write_halo_ids:
        origin = {"finder": "friends-of-friends", "linking_length": length, "halo_b": config.halo_b, "least": least, "attached": ",".join(attach)}
        if not H.write_halo_ids(out.select("ptype", "pidx", "halo_id"), f"{config.snapshot_path}/HaloIds", origin, snapshot.format.encode_halo):
            logger.warning("%s can't be written; the halo ids are not stored", config.snapshot_path)
    return out


def with_haloes(particles, snapshot, config: RunConfig):
    """(particles with halo numbers, subhaloes or None): stored numbers, an external catalogue, or friends-of-friends over dark matter with baryons attached."""
    source = choose_source(config.halo_id_source, {p: "halo_id" in snapshot.available(p) for p, on in config.process_ptypes.items() if on})
    external = source in ("AHF", "HBT-HERONS", "SUBFIND")
    if external and config.halo_catalogue_path is None:
        raise ValueError(f"halo_id_source {source} needs halo_catalogue_path")
    if not external and config.halo_catalogue_path is not None:
        raise ValueError(f"halo_catalogue_path is given, but halo_id_source {source} reads none")
    if external:
        return _from_catalogue(source, particles, snapshot, config)
    return (_found(particles, snapshot, config) if source == "FOF" else particles), None


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="astroloom")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("init").add_argument("folder", nargs="?", default=".")
    run = commands.add_parser("analyse")
    run.add_argument("config")
    run.add_argument("--overwrite", action="store_true")
    cone = commands.add_parser("lightcone")
    cone.add_argument("catalogues", nargs="+")
    cone.add_argument("--output", required=True)
    cone.add_argument("--area", type=float, required=True)
    cone.add_argument("--z-min", type=float, default=0.0)
    cone.add_argument("--z-max", type=float, required=True)
    cone.add_argument("--shape", choices=("square", "circle"), default="square")
    cone.add_argument("--seed", type=int)
    cone.add_argument("--redshift-space", action="store_true")
    cone.add_argument("--overwrite", action="store_true")
    args = parser.parse_args(arguments)
    if args.command == "init":
        print(generate_config(args.folder))
        return
    spark = build_session()
    if args.command == "analyse":
        config = RunConfig.from_yaml(args.config)
        log = RunLog()
        with log.timer("read"):
            snapshot = open_snapshot(spark, config.snapshot_path, config.simulation_type)
            particles = cut(load_particles(snapshot, config), "particles")
        with log.timer("haloes"):
            particles, subhaloes = with_haloes(particles, snapshot, config)
            particles = cut(particles, "particles")
        with log.timer("analysis"):
            analyse_to(Run(particles, snapshot.header, config, subhaloes), config.output_dir, args.overwrite)
        print(log.summary())
        return
    from astroloom.functions.physics import Cosmology

    shots = []
    for path in args.catalogues:
        c = Catalogue(spark, path)
        h = c.header
        scale = 1e-3  # kpc to Mpc
        objects = c.galaxies.df.select("row", "mass_baryon", *[(F.get("com_pos_baryon", F.lit(i)) * scale).alias(a) for i, a in enumerate("xyz")], *[F.get("com_vel_baryon", F.lit(i)).alias(f"v{a}") for i, a in enumerate("xyz")])
        shots.append(Snapshot(objects, h["redshift"], h["boxsize"] * scale, Cosmology(h["h"], h["omega_matter"], h["omega_lambda"], h["w_0"], h["w_a"])))
    out = build_lightcone(shots, args.area, args.z_min, args.z_max, args.shape, seed=args.seed, redshift_space=args.redshift_space)
    write_lightcone(out, args.output, args.overwrite)


if __name__ == "__main__":
    main()
