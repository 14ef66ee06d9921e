import numpy as np
import pytest
from pyspark.sql import functions as F

from astroloom.operators import spatial as S

BOX = 100.0


def near(d):
    return d - BOX * np.rint(d / BOX)


def components(linked):
    n = len(linked)
    root = np.arange(n)
    for _ in range(n):
        new = np.array([root[np.flatnonzero(linked[i])].min() for i in range(n)])
        if (new == root).all():
            break
        root = new
    return root


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    pos = np.concatenate([rng.uniform(0, BOX, (120, 3)), rng.normal(0, 1.0, (80, 3)) % BOX, rng.normal(50, 1.0, (40, 3)), np.repeat([[20.0, 20.0, 20.0]], 30, 0)])
    vel = rng.normal(0, 5, pos.shape)
    rows = [(i, "star" if i % 3 else "gas", *map(float, p), *map(float, v), float(i % 5 + 1)) for i, (p, v) in enumerate(zip(pos, vel))]
    df = spark.createDataFrame(rows, "pidx long, ptype string, x double, y double, z double, vx double, vy double, vz double, mass double").repartition(3)
    return df, pos, vel


def test_pairs(points):
    df, pos, _ = points
    d2 = (near(pos[:, None] - pos[None]) ** 2).sum(-1)
    got = {(r["apidx"], r["bpidx"]) for r in S.pairs(df, 2.0, BOX).select("apidx", "bpidx").collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(d2 <= 4.0)) if i < j}
    free = ((pos[:, None] - pos[None]) ** 2).sum(-1)
    got = {(r["apidx"], r["bpidx"]) for r in S.pairs(df, 2.0).select("apidx", "bpidx").collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(free <= 4.0)) if i < j}


@pytest.mark.parametrize("blocks", [S.CELL_BLOCK, 4])
def test_friends_of_friends(points, monkeypatch, blocks):
    df, pos, _ = points
    monkeypatch.setattr(S, "CELL_BLOCK", blocks)
    monkeypatch.setattr(S, "SMALL_PAIRS", 4096 if blocks > 4 else 1)
    d2 = (near(pos[:, None] - pos[None]) ** 2).sum(-1)
    want = components(d2 <= 2.25)
    got = {r["pidx"]: r for r in S.friends_of_friends(df, 1.5, BOX, 20).collect()}
    assert [got[i]["root"] for i in range(len(pos))] == list(want)
    sizes = np.bincount(want, minlength=len(pos))
    order = sorted((r for r in set(want) if sizes[r] >= 20), key=lambda r: (-sizes[r], r))
    assert all(got[i]["label"] == (order.index(want[i]) if want[i] in order else -1) for i in range(len(pos)))
    with pytest.raises(ValueError):
        S.friends_of_friends(df, 60.0, BOX)
    assert S.friends_of_friends(df.limit(0), 1.5, BOX).count() == 0


@pytest.mark.parametrize("blocks", [S.CELL_BLOCK, 4])
def test_friends_of_friends_keep_runs_apart(points, monkeypatch, blocks):
    df, pos, _ = points
    monkeypatch.setattr(S, "CELL_BLOCK", blocks)
    monkeypatch.setattr(S, "SMALL_PAIRS", 4096 if blocks > 4 else 1)
    run = np.arange(len(pos)) % 2
    d2 = (near(pos[:, None] - pos[None]) ** 2).sum(-1)
    want = components((d2 <= 2.25) & (run[:, None] == run[None]))
    rows = df.withColumn("run_id", F.col("pidx") % 2)
    got = {r["pidx"]: r for r in S.friends_of_friends(rows, 1.5, BOX, 10, ("run_id",)).collect()}
    assert [got[i]["root"] for i in range(len(pos))] == list(want) and all(got[i]["run_id"] == run[i] for i in got)
    sizes = np.bincount(want, minlength=len(pos))
    for k in (0, 1):
        order = sorted((r for r in set(want) if sizes[r] >= 10 and r % 2 == k), key=lambda r: (-sizes[r], r))
        assert order and all(got[i]["label"] == (order.index(want[i]) if want[i] in order else -1) for i in range(k, len(pos), 2))
    labelled = rows.where("pidx % 7 = 0").withColumn("label", F.col("pidx"))
    found = {r["pidx"]: r["label"] for r in S.nearest_label(rows, labelled, 3.0, BOX, by=("run_id",)).collect()}
    chosen = np.arange(0, len(pos), 7)
    for i in range(len(pos)):
        best = min(((d2[i, j], j) for j in chosen if d2[i, j] <= 9.0 and run[j] == run[i]), default=None)
        assert found[i] == (best[1] if best else -1)


def test_fof_queries_cover_every_run(spark):
    from astroloom.queries import reference

    folder = "/root/testdata/sf0.001"
    rows = reference.members(spark, folder)
    runs = {r["run_id"]: r["n"] for r in rows.where("ptype = 'dm'").groupBy("run_id").agg(F.count("*").alias("n")).collect()}
    got = reference.fof_haloes(spark, folder).groupBy("run_id").agg(F.sum("n").alias("n")).collect()
    assert len(runs) > 1 and {r["run_id"]: r["n"] for r in got} == runs
    assert reference.fof_attach(spark, folder).count() == rows.where("ptype <> 'dm'").count()


@pytest.mark.parametrize("small", [0, 10_000])
def test_components_of_a_graph(spark, monkeypatch, small):
    monkeypatch.setattr(S, "SMALL_EDGES", small)
    edges = [(7, 3), (3, 12), (40, 41), (12, 5), (41, 41), (5, 7)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 201 + i) for i in range(50)]
    nodes = sorted({x for e in edges for x in e} | {999})
    got = {r["id"]: r["root"] for r in S.connected_components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [got[k] for k in (3, 5, 7, 12, 40, 41, 999)] == [3, 3, 3, 3, 40, 40, 999]
    assert all(got[100 + i] == 100 for i in range(41)) and all(got[200 + i] == 200 for i in range(51))


def test_nearest_label(points, spark):
    df, pos, _ = points
    labelled = df.where("pidx % 7 = 0").withColumn("label", F.col("pidx") * 10)
    got = {r["pidx"]: r["label"] for r in S.nearest_label(df, labelled, 3.0, BOX).collect()}
    chosen = np.arange(0, len(pos), 7)
    for i in range(len(pos)):
        d2 = (near(pos[chosen] - pos[i]) ** 2).sum(1)
        best = min(((d, j) for d, j in zip(d2, chosen) if d <= 9.0), default=None)
        assert got[i] == (best[1] * 10 if best else -1)


def test_phase_space_galaxies(points):
    df, pos, vel = points
    length = 1.5
    d2, v2 = ((pos[:, None] - pos[None]) ** 2).sum(-1), ((vel[:, None] - vel[None]) ** 2).sum(-1)
    q = 2 * np.sqrt(d2) / length
    w = np.where(q < 1, 1 - 1.5 * q**2 + 0.75 * q**3, np.where(q < 2, 0.25 * (2 - q) ** 3, 0.0)) * (d2 <= length**2)
    np.fill_diagonal(w, 0)
    total = w.sum(1)
    sigma = np.sqrt(np.divide((w * v2).sum(1), total, out=np.zeros_like(total), where=total > 0))
    got = {r["pidx"]: r["sigma"] for r in S.local_dispersions(df, length).collect()}
    assert np.allclose([got[i] for i in range(len(pos))], sigma)
    linked = (d2 <= length**2) & (v2 <= np.maximum(sigma[:, None], sigma[None]) ** 2)
    np.fill_diagonal(linked, True)
    want = components(linked)
    found = {r["pidx"]: r for r in S.find_galaxies(df.withColumn("halo", F.lit(1).cast("long")), "halo", length, 1.0, 5).collect()}
    assert [found[i]["root"] for i in range(len(pos))] == list(want)
    stars = {r: sum(1 for i in np.flatnonzero(want == r) if i % 3) for r in set(want)}
    assert {r for r in stars if stars[r] >= 5} == {want[i] for i in range(len(pos)) if found[i]["galaxy"] >= 0}


def test_apertures_densities_and_hydrogen(points, spark):
    df, pos, _ = points
    mass = np.arange(len(pos)) % 5 + 1.0
    rows = df.withColumn("halo", F.lit(1).cast("long"))
    sites = rows.where("pidx < 5").select("halo", F.col("pidx").alias("galaxy"), "x", "y", "z")
    got = {r["galaxy"]: r for r in S.aperture_masses(sites, rows, ("halo",), "galaxy", {"5": 5.0, "20": 20.0}, BOX).collect()}
    for g in range(5):
        d = np.sqrt((near(pos - pos[g]) ** 2).sum(1))
        assert got[g]["mass_total_20"] == mass[d <= 20].sum() and got[g]["mass_gas_5"] == mass[(d <= 5) & (np.arange(len(pos)) % 3 == 0)].sum()
    dense = {r["pidx"]: r for r in S.local_densities(df, {"9": 9.0}, BOX).collect()}
    d2 = (near(pos[:, None] - pos[None]) ** 2).sum(-1)
    assert all(dense[i]["number_density_9"] == pytest.approx((d2[i] <= 81).sum() / (4 / 3 * np.pi * 729)) for i in range(len(pos)))
    gas = spark.createDataFrame([(1, i, float(p[0]), float(p[1]), float(p[2]), hi, 0.5) for i, (p, hi) in enumerate([((1, 0, 0), 1.0), ((0, 2, 0), 2.0), ((0, 0, 3), 3.0)])], "halo long, pidx long, x double, y double, z double, mass_HI double, mass_H2 double")
    one = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0, 0.0), (2, 1, 1.0, 0.0, 0.0, 0.0)], "halo long, galaxy long, mass double, x double, y double, z double")
    got = {r["galaxy"]: r for r in S.share_hydrogen(gas, one, ("halo",), "galaxy", BOX).collect()}
    assert got[0]["mass_HI_diffuse"] == 6 and got[0]["mass_H2_diffuse"] == 1.5 and got[1]["mass_HI_diffuse"] == 0


def test_metal_columns(spark):
    from astroloom.functions.dust import kernel_table

    table = [float(v) for v in kernel_table(100)]
    stars = spark.createDataFrame([(1, 1, 500.0, 500.0, 500.0), (2, 1, 0.0, 0.0, 0.0)], "g long, pidx long, x double, y double, z double")
    cases = [(495.0, 500.0, 10.0, table[0] * 0.02 / 100), (505.0, 500.0, 10.0, 0.0), (495.0, 510.0, 10.0, 0.0), (495.0, 505.0, 10.0, table[50] * 0.02 / 100)]
    for z, x, h, want in cases:
        gas = spark.createDataFrame([(1, x, 500.0, z, h, 1.0, 0.02)], "g long, x double, y double, z double, h double, mass double, metallicity double")
        got = {r["g"]: r["column"] for r in S.metal_columns(stars, gas, ("g",), table, 1000.0).collect()}
        assert got[1] == pytest.approx(want) and got[2] == 0


def test_hydrogen_apertures(points, spark):
    df, pos, _ = points
    rows = df.withColumns({"halo": F.lit(1).cast("long"), "mass_HI": F.when(F.col("ptype") == "gas", F.col("mass") / 4), "mass_H2": F.when(F.col("ptype") == "gas", F.col("mass") / 8)})
    sites = rows.where("pidx < 5").select("halo", F.col("pidx").alias("galaxy"), "x", "y", "z")
    got = {r["galaxy"]: r for r in S.aperture_masses(sites, rows, ("halo",), "galaxy", {"20kpc": 20.0}, BOX, ("HI", "H2")).collect()}
    gas = np.arange(len(pos)) % 3 == 0
    for g in range(5):
        mass = (np.arange(len(pos)) % 5 + 1.0)[gas & (np.sqrt((near(pos - pos[g]) ** 2).sum(1)) <= 20)].sum()
        assert got[g]["mass_HI_20kpc"] == mass / 4 and got[g]["mass_H2_20kpc"] == mass / 8 and got[g]["mass_gas_20kpc"] == mass
