import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from astroloom.functions.physics import Cosmology, Header
from astroloom.plans import catalogue, cli, pipeline, stages
from astroloom.plans.config import RunConfig
from astroloom.plans.pipeline import Run, analyse_to, type_properties
from astroloom.sources import formats, halo_sources, synthetic


def test_stage_order_and_columns():
    assert [s.name for s in stages.resolve(["photometry"])] == ["find_galaxies", "properties_core", "properties_ptype_specific", "photometry"]
    with pytest.raises(KeyError):
        stages.resolve(["nothing"])
    declared = stages.declared_columns(stages.fill_lists())
    for name in ("n_gas", "mass_total", "radius_half_mass_baryon", "r200c", "mass_HI_30kpc", "metallicity_gas_sfr_weighted", "age_star_metal_weighted"):
        assert name in declared
    with pytest.raises(KeyError):
        stages.expand(stages.Output("x_{nothing}"), stages.fill_lists())
    have = {"gas": {"pos", "vel", "mass"}, "star": {"pos", "vel", "mass", "potential"}}
    assert [s.name for s in stages.runnable(["properties_core"], have)] == []
    with pytest.raises(KeyError):
        stages.columns_for(stages.resolve(["properties_core"]), have)


def config(tmp_path, **more):
    return RunConfig(str(tmp_path), str(tmp_path / "out"), "SWIFT-EAGLE", "SNAPSHOT", **more)


def test_config(tmp_path):
    c = config(tmp_path)
    assert RunConfig.from_json(c.to_json()) == c
    flat = RunConfig.from_mapping({"paths": {"snapshot_path": "s", "output_dir": "o"}, "kind": {"simulation_type": "tng", "halo_id_source": "fof"}})
    assert flat.simulation_type == "TNG"
    for bad in ({"T_lim": -1}, {"gas_criterion": "warm"}, {"write_halo_ids": True}, {"min_dm_per_halo_to_store": 99}, {"halo_attach_ptypes": ("dm",)}, {"stages": {"x": True}}):
        with pytest.raises(ValueError):
            config(tmp_path, **bad)
    with pytest.raises(ValueError):
        RunConfig.from_mapping({"one": {"T_lim": 1}, "two": {"T_lim": 2}})
    with pytest.raises(ValueError):
        RunConfig("s", "o", "TNG", "SNAPSHOT")
    path = cli.generate_config(str(tmp_path))
    with pytest.raises(FileExistsError):
        cli.generate_config(str(tmp_path))
    assert RunConfig.from_yaml(path).halo_b == 0.2


@pytest.mark.parametrize("simulation", list(formats.FORMATS))
def test_formats(spark, tmp_path, simulation):
    synthetic.write_snapshot(spark, str(tmp_path), simulation)
    shot = formats.open_snapshot(spark, str(tmp_path), simulation)
    assert shot.header.boxsize == pytest.approx(500.0)
    columns = ["pos", "mass", "rho", "sfr", "metallicity", "helium_fraction", "temperature", "mass_HI", "mass_H2"]
    gas = shot.read("gas", columns).collect()
    assert len(gas) == 240 and all(0 <= r["x"] < 500.001 for r in gas)
    assert all(0 <= r["mass_HI"] <= r["mass"] * 1.0001 for r in gas) if simulation not in ("SWIFT-KIARA", "SWIFT-EAGLE") else True
    assert all(r["temperature"] > 0 for r in gas) and (all(r["sfr"] >= 0 for r in gas) if "SWIFT" in simulation else True)
    ages = [r["age"] for r in shot.read("star", ["age"]).collect()]
    assert all(0 <= a < float(shot.header.cosmology.age(3.0)[0]) for a in ages)
    dm = shot.read("dm", ["mass", "particle_id"]).collect()
    assert len(dm) == 250 and all(r["mass"] > 0 for r in dm)
    if simulation != "TNG":
        halo = {r["halo_id"] for r in shot.read("dm", ["halo_id"]).collect()}
        assert halo <= {-1, 0, 1, 2} and -1 in halo
    else:
        assert "halo_id" not in shot.available("dm")
    with pytest.raises(KeyError):
        shot.read("gas", ["nothing"])
    if shot.format.elements:
        assert shot.read("gas", ["fraction_He"]).first()[0] is not None
        with pytest.raises(KeyError, match="fraction_He"):
            shot.read("gas", ["fraction_Xx"])
    with pytest.raises(ValueError):
        formats.build_format("GADGET-1")


def test_halo_sources(spark, tmp_path):
    assert halo_sources.choose_source("SNAP_OR_FOF", {"gas": True, "dm": False}) == "FOF" and halo_sources.choose_source("SNAP_OR_FOF", {"gas": True}) == "SNAPSHOT"
    (tmp_path / "halos").write_text("#ID\thost\ta\tb\tn\n11\t0\tx\ty\t5\n12\t11\tx\ty\t3\n13\t0\tx\ty\t2\n")
    halos = halo_sources.ahf_halos(spark, str(tmp_path / "halos"))
    assert sorted(tuple(r) for r in halos.collect()) == [(11, 0, 5), (12, 11, 3), (13, 0, 2)]
    lines = [(0, 5, 111), (1, 100, 1), (2, 101, 0), (3, 102, 4), (4, 2, 112), (5, 101, 0), (6, 1, 113), (7, 200, 5)]
    runs = halo_sources.ahf_runs(spark.createDataFrame(lines, "line long, c0 long, c1 long"))
    assert sorted(tuple(r) for r in runs.collect()) == [(100, 0), (101, 0), (101, 1), (102, 0), (200, 2)]
    ids = {0: 11, 1: 12, 2: 13}
    memberships = spark.createDataFrame([(r["pid"], ids[r["halo_row"]]) for r in runs.collect()], "pid long, halo long")
    particles = spark.createDataFrame([(p,) for p in (100, 101, 102, 200, 300)], "pid long")
    got = {r["pid"]: (r["field_halo"], r["sub_halo"]) for r in halo_sources.match_nested(particles, memberships, halos.select("id", "host")).collect()}
    assert got == {100: (11, -1), 101: (11, 12), 102: (11, -1), 200: (13, -1), 300: (-1, -1)}

    subs = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 1, 0), (5, 2, 0)], "sub long, group long, local_parent long")
    groups = spark.createDataFrame([(0, 0), (1, 3), (2, 5), (3, -1)], "group long, first_sub long")
    assert {r["sub"]: r["parent"] for r in halo_sources.subfind_parents(subs, groups).collect()} == {0: -1, 1: -1, 2: 1, 3: -1, 4: -1, 5: -1}
    lengths = spark.createDataFrame([("dm", 0, 5), ("dm", 1, 2)], "ptype string, group long, length long")
    inner = spark.createDataFrame([("dm", 0, 0, 2), ("dm", 0, 1, 1), ("dm", 1, 2, 2)], "ptype string, group long, sub long, length long")
    got = [(r["group"], r["sub"]) for r in halo_sources.subfind_membership(lengths, inner).orderBy("position").collect()]
    assert got == [(0, 0), (0, 0), (0, 1), (0, -1), (0, -1), (1, 2), (1, 2)]

    tracks = spark.createDataFrame([(7, 3, -1, 0, 2, 0), (8, 3, 7, 1, 1, 2), (9, -1, -1, 1, 2, 3)], "track_id long, host_halo long, parent_track long, depth int, n_bound long, offset long")
    listed = spark.createDataFrame([(i, 500 + i) for i in range(5)], "place long, pid long")
    got = {r["pid"]: (r["field_halo"], r["sub_halo"]) for r in halo_sources.match_offsets(spark.createDataFrame([(500 + i,) for i in range(6)], "pid long"), listed, tracks).collect()}
    assert got == {500: (0, -1), 501: (0, -1), 502: (0, 8), 503: (1, -1), 504: (1, -1), 505: (-1, -1)}

    path = f"file://{tmp_path}/ids"
    frame = spark.createDataFrame([("dm", 1, 5)], "ptype string, pidx long, halo_id long")
    assert halo_sources.write_halo_ids(frame, path, {"finder": "fof"}) and halo_sources.write_halo_ids(frame, path, {"finder": "fof"})
    (tmp_path / "foreign").mkdir()
    with pytest.raises(FileExistsError):
        halo_sources.write_halo_ids(frame, f"file://{tmp_path}/foreign", {})


def test_analysis_and_catalogue(spark, tmp_path):
    rows = synthetic.particles(spark, {"gas": 300, "dm": 300, "star": 120, "bh": 6})
    from astroloom.tables import cut

    rows = cut(rows, "particles")
    head = Header(500.0, 0.68, 0.25, 3.0, Cosmology(0.68, 0.3), 120, 300)
    setup = config(tmp_path, min_dm_per_halo=10, min_stars_per_galaxy=5, b=0.02, velocity_factor=3.0, gas_criterion="DENSE_ONLY", nH_lim=1e-6, distribute_halo_hydrogen=True)
    path = f"file://{tmp_path}/cat"
    subs = spark.createDataFrame([(0, -1, 0), (1, 0, 0)], "id long, parent long, host long")
    rows = rows.withColumn("sub_id", F.when((F.col("halo_id") == 0) & (F.col("pidx") % 5 == 0), F.lit(1)).when((F.col("halo_id") == 0) & (F.col("pidx") % 5 == 1), F.lit(0)).otherwise(F.lit(-1)))
    analyse_to(Run(rows, head, setup, subs), path)
    cat = catalogue.Catalogue(spark, path)
    haloes = cat.haloes.get("n_dm", "mass_total", "mass_baryon", "parent_halo_index", "depth", "central_galaxy_index").collect()
    assert [r["row"] for r in haloes] == list(range(5))
    masses = [r["mass_total"] for r in haloes]
    assert masses == sorted(masses, reverse=True)
    direct = {r["halo_id"]: r for r in rows.where("halo_id >= 0").groupBy("halo_id").agg(F.sum("mass").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    fields = [r for r in haloes if r["depth"] == 0]
    assert sorted(round(r["mass_total"]) for r in fields) == sorted(round(d["m"]) for d in direct.values())
    chain = {r["row"]: r["parent_halo_index"] for r in haloes}
    top = next(r["row"] for r in haloes if r["depth"] == 2)
    assert cat.subhaloes(chain[chain[top]]).count() == 2 and cat.subhaloes(top).count() == 0
    with pytest.raises(IndexError):
        cat.subhaloes(99)
    declared = stages.declared_columns(stages.fill_lists())
    known = {c for c in cat.haloes.keys() if c in declared}
    core = {c for c, (stage, o) in declared.items() if stage == "properties_core" and "haloes" in o.groups}
    assert core <= known, core - known
    lacking = {c for c, (stage, o) in declared.items() if stage == "properties_core" and "galaxies" in o.groups and "dm" not in c and "total" not in c} - set(cat.galaxies.keys())
    assert not lacking
    assert cat.haloes.units("mass_total") == "Msun" and not cat.haloes.is_comoving("mass_total") and cat.haloes.is_comoving("r200c")
    raw, physical = (cat.haloes.get("r200m", physical=p).first()["r200m"] for p in (False, True))
    assert physical == pytest.approx(raw * 0.25)
    with pytest.raises(ValueError):
        cat.haloes.get("n_dm", "n_gas", factors=[1.0])
    galaxies = cat.galaxies.df.collect()
    assert galaxies and all(0 <= g["field_halo_index"] < 5 and 0 < g["parent_membership_fraction"] <= 1 for g in galaxies)
    found = [g["row"] for h in fields for g in cat.galaxies_of(h["row"]).collect()]
    assert sorted(found) == [g["row"] for g in sorted(galaxies, key=lambda g: g["row"])]
    members = cat.particles("haloes", fields[0]["row"], "star").collect()
    assert [r["pidx"] for r in members] == sorted(r["pidx"] for r in members)
    data = cat.member_data(rows, "haloes", [top, top], "dm", "mass").collect()
    assert {r["place"] for r in data} == {0, 1}
    analyser = catalogue.Analyser(cat, rows)
    again = analyser.run(type_properties, "haloes", [0, 2], config=setup)
    assert analyser.difference(again, "haloes", ["mass_HI", "mass_gas_cold", "metallicity_star_mass_weighted"]).count() == 0 and again.count() == 2
    assert all(math.isfinite(r["mass_baryon"]) for r in haloes)


def test_stream(spark, tmp_path):
    from astroloom.streaming.increments import arriving, running_masses

    rows = spark.createDataFrame([(1, 1, 2.0), (1, 1, 2.0), (2, 1, 3.0), (3, 2, 1.0), (4, None, 1.0)], "pid long, halo long, mass double").withColumn("at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    rows.write.parquet(f"{tmp_path}/in")
    stream = running_masses(arriving(spark, f"{tmp_path}/in", rows), ["halo"], "pid", "at")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["halo"], r["n"], r["mass"]) for r in spark.table("sums").collect()} == {(1, 2, 5.0), (2, 1, 1.0)}


def test_command_line_with_built_in_finder(spark, tmp_path, monkeypatch):
    from astroloom.operators.lightcone import Lightcone
    from astroloom.plans.runlog import warn_if_dominant

    synthetic.write_snapshot(spark, f"{tmp_path}/snap", "TNG")
    (tmp_path / "run.yaml").write_text(
        f"input:\n  snapshot_path: {tmp_path}/snap\n  output_dir: {tmp_path}/cat\n  simulation_type: TNG\n  halo_id_source: FOF\n  write_halo_ids: true\n  min_dm_per_halo_to_store: 5\nset:\n  min_dm_per_halo: 10\n  halo_b: 0.02\n  min_stars_per_galaxy: 2\n  velocity_factor: 5.0\n  gas_criterion: DENSE_ONLY\n  nH_lim: 1.0e-9\n"
    )
    cli.main(["analyse", str(tmp_path / "run.yaml")])
    cat = catalogue.Catalogue(spark, f"{tmp_path}/cat")
    assert spark.read.parquet(f"{tmp_path}/snap/HaloIds/ids.parquet").where("halo_id > 0").select("ptype").distinct().count() > 1
    assert cat.haloes.df.count() == 3 and cat.header["redshift"] == pytest.approx(3.0)
    cli.main(["lightcone", f"{tmp_path}/cat", "--output", f"{tmp_path}/cone", "--area", "1", "--z-max", "0.01", "--seed", "1"])
    assert Lightcone(spark, f"{tmp_path}/cone").get("ra", "comoving_distance", a_exponents={"comoving_distance": 1}).columns == ["ra", "comoving_distance"]
    assert warn_if_dominant(6, 10) and not warn_if_dominant(5, 10) and not warn_if_dominant(0, 0)
    catalogue.recompress(spark, f"{tmp_path}/cat", f"{tmp_path}/small")
    assert catalogue.Catalogue(spark, f"{tmp_path}/small").haloes.df.count() == 3


def test_analysis_gives_hydrogen_apertures_and_magnitudes(spark, tmp_path):
    from astroloom.functions import dust
    from astroloom.operators.photometry import Band, StellarModels
    from astroloom.sources import photometry_tables

    wave = np.linspace(1000.0, 9000.0, 41)
    models = StellarModels(np.array([6.0, 8, 10.2]), np.array([-4.0, -2]), wave, np.ones((2, 3, 41)) * np.array([3.0, 2, 1])[None, :, None], np.ones((2, 3)))
    bands = [Band("v", np.exp(-(((wave - 5500) / 500) ** 2)), 5500.0), Band("sdss_r", np.exp(-(((wave - 6200) / 500) ** 2)), 6200.0)]
    table = f"{tmp_path}/table"
    photometry_tables.write_table(spark, table, models, bands)
    read, found = photometry_tables.read_table(spark, table, ("sdss_",))
    assert np.array_equal(read.spectra, models.spectra) and [b.name for b in found] == ["v", "sdss_r"]
    assert [r["name"] for r in photometry_tables.filters(spark, table).orderBy("effective").collect()] == ["v", "sdss_r"]
    with pytest.raises(ValueError):
        photometry_tables.read_table(spark, table, ("zz",))
    rows = synthetic.particles(spark, {"gas": 150, "dm": 150, "star": 60, "bh": 3}).withColumn("sub_id", F.lit(-1))
    head = Header(500.0, 0.68, 0.25, 3.0, Cosmology(0.68, 0.3), 120, 300)
    more = dict(min_dm_per_halo=10, min_stars_per_galaxy=5, b=0.02, velocity_factor=3.0, gas_criterion="DENSE_ONLY", nH_lim=1e-6)
    setup = config(tmp_path, photometry_table_path=table, bands=("sdss_",), extinction_law="CALZETTI", interpolation_bins=100, **more)
    analyse_to(Run(rows, head, setup), f"file://{tmp_path}/cat")
    cat = catalogue.Catalogue(spark, f"file://{tmp_path}/cat")
    galaxies = cat.galaxies.df.collect()
    assert galaxies and cat.galaxies.units("mag_abs_v") == "mag"
    for g in galaxies:
        assert 0 <= g["mass_HI_30kpc"] <= g["mass_gas_30kpc"] * 1.0001 and g["mag_abs_v"] >= g["mag_abs_nodust_v"] and g["luminosity_fir"] >= 0
        assert g["mag_app_sdss_r"] > g["mag_abs_sdss_r"] and g["beta_nodust"] == pytest.approx(-2.0, abs=1e-6)
    members = cat.membership.where("kind = 'galaxies' and ptype = 'star' and row = 0").join(rows, ["ptype", "pidx"]).select("age", "metallicity", "mass").collect()
    light = sum(r["mass"] * np.interp(math.log10(max(r["age"], 1e-9)) + 9, [6, 8, 10.2], [3, 2, 1]) for r in members)
    assert galaxies[0]["mag_abs_nodust_v"] == pytest.approx(-2.5 * math.log10(light * 3.828e33 / (4 * math.pi * (3.08567758e19) ** 2)) - 48.6, abs=1e-4)
    assert dust.mixed_law("POWER_LAW", 11000.0, alpha=2.0) == pytest.approx(0.25)
    plain = config(tmp_path, stages={"properties_ptype_specific": False}, **more)
    assert "photometry" not in pipeline.planned(Run(rows, head, plain)) and "properties_local_environment" in pipeline.planned(Run(rows, head, plain))
    assert "properties_local_environment" not in pipeline.planned(Run(rows, head, config(tmp_path, stages={"find_galaxies": False}, **more)))


class Stored:
    """A snapshot of given ids, for the sources of halo numbers."""

    def __init__(self, spark, order):
        self.spark, self.order = spark, order

    def available(self, ptype):
        return {"halo_id"}

    def positions(self, ptype):
        return self.spark.createDataFrame([(p, i) for i, p in enumerate(self.order)] if ptype == "dm" else [], "particle_id long, position long")


def assigned(spark, tmp_path, source, ids, order=()):
    settings = {"snapshot_path": "s", "output_dir": str(tmp_path), "simulation_type": "SWIFT-EAGLE", "halo_catalogue_path": f"{tmp_path}/halos"}
    particles = spark.createDataFrame([(p, "dm", 7) for p in ids], "pidx long, ptype string, halo_id long")
    out, subs = cli.with_haloes(particles, Stored(spark, order), RunConfig(halo_id_source=source, **settings))
    return {r["pidx"]: (r["halo_id"], r["sub_id"]) for r in out.collect()}, {tuple(r) for r in subs.select("id", "parent", "host").collect()}


def test_run_takes_ahf_halos(spark, tmp_path):
    big = 6_000_000_000_000_000_000
    (tmp_path / "halos_halos").write_text(f"#ID\thost\ta\tb\tn\n{big}\t0\tx\ty\t5\n{big + 1}\t{big}\tx\ty\t3\n{big + 2}\t{big + 1}\tx\ty\t2\n{big + 3}\t0\tx\ty\t2\n")
    (tmp_path / "halos_particles").write_text(f"4\n5\t{big}\n100\t1\n101\t0\n102\t4\n103\t1\n2\t{big + 1}\n101\t0\n103\t1\n1\t{big + 2}\n103\t1\n1\t{big + 3}\n200\t5\n")
    got, subs = assigned(spark, tmp_path, "AHF", (100, 101, 102, 103, 200, 300))
    assert got == {100: (1, -1), 101: (1, 2), 102: (1, -1), 103: (1, 3), 200: (4, -1), 300: (-1, -1)}
    assert subs == {(2, -1, 1), (3, 2, 1)}


def test_run_takes_herons_tracks(spark, tmp_path):
    tracks = [(7, 3, -1, 0, 2, 0), (8, 3, 7, 1, 1, 2), (9, 3, 8, 2, 1, 3), (10, -1, -1, 1, 2, 4)]
    spark.createDataFrame(tracks, "TrackId long, HostHaloId long, NestedParentTrackId long, Depth int, Nbound long, ParticleOffset long").write.parquet(f"{tmp_path}/halos/Subhalos.parquet")
    with pytest.raises(FileNotFoundError):
        assigned(spark, tmp_path, "HBT-HERONS", (500,))
    spark.createDataFrame([(500 + i,) for i in range(6)], "ParticleIDs long").coalesce(1).write.parquet(f"{tmp_path}/halos/Particles.parquet")
    got, subs = assigned(spark, tmp_path, "HBT-HERONS", tuple(range(500, 507)))
    assert got == {500: (0, -1), 501: (0, -1), 502: (0, 8), 503: (0, 9), 504: (1, -1), 505: (1, -1), 506: (-1, -1)}
    assert subs == {(8, -1, 0), (9, 8, 0)}


def test_run_takes_subfind_groups(spark, tmp_path):
    groups = [([0, n, 0, 0, 0, 0], first, subs) for n, first, subs in ((10, 0, 3), (6, 3, 2), (3, 5, 1), (1, -1, 0))]
    spark.createDataFrame(groups, "GroupLenType array<int>, GroupFirstSub int, GroupNsubs int").coalesce(1).write.parquet(f"{tmp_path}/halos/Group.parquet")
    subs = [([0, n, 0, 0, 0, 0], g, p) for n, g, p in ((4, 0, 0), (2, 0, 0), (2, 0, 1), (3, 1, 0), (1, 1, 0), (2, 2, 0))]
    spark.createDataFrame(subs, "SubhaloLenType array<int>, SubhaloGrNr int, SubhaloParent int").coalesce(1).write.parquet(f"{tmp_path}/halos/Subhalo.parquet")
    ids = tuple(1000 - i for i in range(22))
    got, parents = assigned(spark, tmp_path, "SUBFIND", ids, ids)
    want = [(0, s) for s in (0, 0, 0, 0, 1, 1, 2, 2, -1, -1)] + [(1, s) for s in (3, 3, 3, 4, -1, -1)] + [(2, 5), (2, 5), (2, -1), (3, -1), (-1, -1), (-1, -1)]
    assert [got[i] for i in ids] == want
    assert parents == {(0, -1, 0), (1, -1, 0), (2, 1, 0), (3, -1, 1), (4, -1, 1), (5, -1, 2)}


def test_sources_and_paths_must_fit(tmp_path):
    snapshot = Stored(None, ())
    settings = {"snapshot_path": "s", "output_dir": str(tmp_path), "simulation_type": "SWIFT-EAGLE"}
    with pytest.raises(ValueError):
        cli.with_haloes("particles", snapshot, RunConfig(halo_id_source="AHF", **settings))
    with pytest.raises(ValueError):
        cli.with_haloes("particles", snapshot, RunConfig(halo_id_source="SNAPSHOT", halo_catalogue_path="c", **settings))
    assert cli.with_haloes("particles", snapshot, RunConfig(halo_id_source="SNAPSHOT", **settings)) == ("particles", None)
