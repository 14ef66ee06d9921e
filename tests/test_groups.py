import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from astroloom.functions.physics import min_image, wrap
from astroloom.operators import groups as G

BOX = 100.0


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    n = 60
    group = np.repeat([0, 1, 2, 3], [20, 25, 14, 1])
    pos = rng.normal(np.array([[0, 0, 50], [50, 99, 1], [20, 20, 20], [5, 5, 5]])[group], 3.0) % BOX
    vel, mass, pot = rng.normal(0, 50, (n, 3)), rng.integers(1, 64, n) / 16.0, -rng.integers(1, 30, n).astype(float)
    ptype = np.array(["gas", "star", "dm", "bh"])[rng.integers(0, 4, n)]
    rows = [(int(g), str(t), i, *map(float, p), *map(float, v), float(m), float(u)) for i, (g, t, p, v, m, u) in enumerate(zip(group, ptype, pos, vel, mass, pot))]
    df = spark.createDataFrame(rows, "g long, ptype string, pidx long, x double, y double, z double, vx double, vy double, vz double, mass double, potential double").repartition(3)
    return df, group, ptype, pos, vel, mass, pot


def near(d):
    return d - BOX * np.rint(d / BOX)


def rows_by(df, key="g"):
    return {r[key]: r for r in df.collect()}


def test_summaries_and_types(cloud):
    df, group, ptype, _, _, mass, _ = cloud
    got = rows_by(G.summarise(df, ["g"], "mass"))
    kinds = rows_by(G.counts_and_masses(df, ["g"]))
    for g in range(4):
        own = np.flatnonzero(group == g)
        assert got[g]["total"] == mass[own].sum() and got[g]["n"] == len(own)
        assert got[g]["argmax"] == own[np.argmax(mass[own])] and got[g]["argmin"] == own[np.argmin(mass[own])] and got[g]["first"] == own[0]
        for t in ("gas", "dm", "star", "bh"):
            assert kinds[g][f"n_{t}"] == (ptype[own] == t).sum() and kinds[g][f"mass_{t}"] == mass[own][ptype[own] == t].sum()


def test_periodic_centre(cloud):
    df, group, _, pos, vel, mass, _ = cloud
    got = rows_by(G.centre_of_mass(df, ["g"], BOX))
    for g in range(4):
        own = group == g
        anchor = pos[own][0]
        want = ((mass[own, None] * near(pos[own] - anchor)).sum(0) / mass[own].sum() + anchor) % BOX
        assert np.allclose([got[g][f"c{c}"] for c in "xyz"], want)
        assert np.allclose([got[g][f"cv{c}"] for c in "xyz"], (mass[own, None] * vel[own]).sum(0) / mass[own].sum())


def test_combined_centre_golden(spark):
    side = 100.0
    at = {"gas": (0.45, 0.02, 0.0), "star": (0.55, 0.98, 0.49), "bh": (0.0, 0.0, 0.51)}
    masses = {"gas": (1, 1, 0), "star": (3, 3, 1), "bh": (1, 0, 3)}
    speed = {"gas": 1.0, "star": 2.0, "bh": 3.0}
    rows = [(g, t, float(masses[t][g]), *[side * c for c in ((at[t][g],) * 3)], speed[t], speed[t], speed[t]) for t in at for g in range(3)]
    parts = spark.createDataFrame(rows, "g long, ptype string, mass double, cx double, cy double, cz double, cvx double, cvy double, cvz double")
    got = rows_by(G.combine_centres(parts, ["g"], side))
    assert [got[g]["cvx"] for g in range(3)] == [2.0, 1.75, 2.75]
    x = [got[g]["cx"] / side for g in range(3)]
    assert x[1] == pytest.approx(0.99) and x[2] == pytest.approx(0.505)


def test_kinematics_and_rotation(cloud):
    df, group, ptype, pos, vel, mass, pot = cloud
    low = G.minimum_potential(df, ["g"])
    place = low.select("g", *[F.col(f"m{c}").alias(f"r{c}") for c in "xyz"], *[F.col(f"mv{c}").alias(f"rv{c}") for c in "xyz"])
    sums = G.kinematics(df, ["g"], place, BOX)
    got, first = rows_by(G.derive_kinematics(sums)), rows_by(low)
    axis = sums.select("g", "lx", "ly", "lz").join(place, "g")
    turn = rows_by(G.morphology(G.rotation(df, ["g"], axis, BOX)))
    rank = {"gas": 0, "dm": 1, "star": 2, "bh": 3}
    for g in range(4):
        own = np.flatnonzero(group == g)
        best = min(own, key=lambda i: (pot[i], rank[ptype[i]], i))
        assert first[g]["minpot_pidx"] == best
        d, u, m = near(pos[own] - pos[best]), vel[own] - vel[best], mass[own]
        l = (m[:, None] * np.cross(d, u)).sum(0)  # noqa: E741
        if len(own) < 3:
            assert got[g]["l_size"] == 0 and turn[g]["kappa_rot"] == 0
            continue
        assert np.allclose([got[g][f"l{c}"] for c in "xyz"], l) and got[g]["ke"] == pytest.approx(0.5 * (m * (u**2).sum(1)).sum())
        mean = (m[:, None] * u).sum(0) / m.sum()
        assert got[g]["sigma"] == pytest.approx(math.sqrt((m * ((u - mean) ** 2).sum(1)).sum() / m.sum()))
        assert got[g]["ixy"] == pytest.approx(-(m * d[:, 0] * d[:, 1]).sum())
        along = np.cross(d, u) @ l * m
        arm = np.linalg.norm(np.cross(d, l), axis=1) * m
        k = 0.5 * m * np.divide(along, arm, out=np.zeros_like(along), where=arm > 0) ** 2
        assert turn[g]["b_over_t"] == pytest.approx(2 * m[along < 0].sum() / m.sum()) and turn[g]["kappa_rot"] == pytest.approx(k.sum() / got[g]["ke"])


def test_combined_types_equal_direct_sums(cloud):
    df, *_ = cloud
    place = G.minimum_potential(df, ["g"]).select("g", *[F.col(f"m{c}").alias(f"r{c}") for c in "xyz"], *[F.col(f"mv{c}").alias(f"rv{c}") for c in "xyz"])
    parts = G.kinematics(df, ["g", "ptype"], place, BOX)
    direct = rows_by(G.kinematics(df, ["g"], place, BOX))
    centres = parts.groupBy("g").agg(*[(F.sum(F.col("mass") * F.col(f"bv{c}")) / F.sum("mass")).alias(f"cv{c}") for c in "xyz"])
    got = rows_by(G.combine_types(parts, ["g"], centres, G.PTYPE_ORDER, least=0))
    for g in range(4):
        assert got[g]["dispersion"] == pytest.approx(direct[g]["dispersion"], abs=1e-6) and got[g]["lx"] == pytest.approx(direct[g]["lx"], abs=1e-6) and got[g]["ixx"] == pytest.approx(direct[g]["ixx"])


def test_profiles(cloud):
    df, group, _, pos, _, mass, pot = cloud
    centre = G.centre_of_mass(df, ["g"], BOX).select("g", *[F.col(f"c{c}").alias(f"r{c}") for c in "xyz"])
    c = rows_by(centre)
    placed = G.radii(df, ["g"], centre, BOX)
    rho = 1e-3
    got = rows_by(G.profiles(placed, ["g"], {"half": 0.5, "all": 1.0}, {"200c": 200.0, "1c": 1.0}, rho, 1.0))
    for g in range(4):
        own = group == g
        r = np.linalg.norm(near(pos[own] - np.array([c[g][f"r{a}"] for a in "xyz"])), axis=1)
        o = np.argsort(r)
        r, run = r[o], np.cumsum(mass[own][o])
        assert got[g]["radius_max"] == pytest.approx(r[-1]) and got[g]["radius_half"] == pytest.approx(r[np.searchsorted(run, run[-1] / 2)])
        ok = np.flatnonzero((r > 0) & (run >= rho * 4 / 3 * np.pi * r**3))
        if len(ok):
            assert got[g]["r1c"] == pytest.approx(r[ok[-1]]) and got[g]["m1c"] == pytest.approx(run[ok[-1]])
        if (r > 1e-9).any():
            v = np.where(r > 0, np.sqrt(run / np.where(r > 0, r, 1)), 0)
            assert got[g]["rmax"] == pytest.approx(r[np.argmax(v)])


def test_type_properties_and_nulls(spark):
    gas = spark.createDataFrame([(1, 2.0, 1.0, 0.5, 0.1, 0.02, 1e4, 0.05), (1, 1.0, None, 0.5, 0.0, None, 1e6, 0.5), (2, 1.0, 0.0, 0.0, 0.0, 0.01, None, None)], "g long, mass double, mass_HI double, mass_H2 double, sfr double, metallicity double, temperature double, nH double")
    got = rows_by(G.gas_properties(gas, ["g"]))
    assert got[1]["mass_HI"] == 1 and got[1]["mass_gas_cold"] == 2 and got[1]["mass_gas_hot"] == 1 and got[1]["metallicity_gas_mass_weighted"] == pytest.approx(0.02)
    assert got[2]["metallicity_gas_sfr_weighted"] is None and got[2]["temperature_gas_mass_weighted"] is None and got[2]["mass_gas_cold"] == 0
    thin = rows_by(G.cgm_properties(gas, ["g"], 0.13))
    assert thin[1]["mass_cgm"] == 2 and thin[2]["mass_cgm"] == 0
    holes = spark.createDataFrame([(1, 5, 3.0, 0.1), (1, 4, 3.0, 0.2), (1, 3, 1.0, 0.9), (2, 1, None, 1.0)], "g long, pidx long, bhmass double, bhmdot double")
    best = rows_by(G.black_hole_properties(holes, ["g"], 2.0))
    assert best[1]["smbh_mdot"] == 0.2 and best[1]["smbh_fedd"] == pytest.approx(0.2 / 6) and 2 not in best
    assert G.gas_properties(gas.limit(0), ["g"]).count() == 0


def test_scalars(spark):
    row = spark.range(1).select(min_image(F.lit(50.0), 100.0).alias("half"), min_image(F.lit(-70.0), 100.0).alias("low"), wrap(F.lit(-1.0), 100.0).alias("wrapped")).first()
    assert row["half"] == 50.0 and row["low"] == 30.0 and row["wrapped"] == 99.0
