import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from astroloom.functions import dust as D
from astroloom.functions.physics import Cosmology, Header
from astroloom.operators import lightcone as L
from astroloom.operators import photometry as PH

# Transmission at redshift 3 for 30 wavelengths from 500 to 7000 angstrom, as published tools give it.
MADAU_Z3 = [0.34793921, 0.1935625, 0.11392457, 0.07147155, 0.04805771, 0.03485828, 0.02750745, 0.02387668, 0.02311123, 0.02535915, 0.03215376, 0.04815082, 0.08727324, 0.19670177, 0.56782333, 0.60376266, 0.64316617, 0.75053057, 0.71035254, 0.66755994, *[1.0] * 10]


def test_transmission():
    assert np.allclose(D.madau(np.linspace(500, 7000, 30), 3.0), MADAU_Z3, rtol=1e-6)
    assert (D.madau(np.linspace(500, 7000, 30), 0.0) == 1).all()


@pytest.mark.parametrize("law", list(D.LAWS))
def test_curves(spark, law):
    wave = np.linspace(920, 30000, 60)
    curve = D.LAWS[law](wave)
    assert np.isfinite(curve).all() and (curve >= -0.05).all() and abs(D.LAWS[law](np.array([5500.0]))[0] - 1) < 2e-3
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate(wave)], "i int, w double")
    got = [r["k"] for r in df.select("i", D.LAWS[law](F.col("w")).alias("k")).orderBy("i").collect()]
    assert np.allclose(got, curve)


def test_mixes():
    w = np.array([1500.0, 5500.0])
    assert np.allclose(D.mixed_law("MIX_CALZ_MW", w, 1.0, 0.0), D.calzetti(w)) and np.allclose(D.mixed_law("MIX_CALZ_MW", w, -2.0, 0.0), D.cardelli(w))
    assert np.allclose(D.mixed_law("COMPOSITE", w, 1.0, -3.0), D.smc(w))
    with pytest.raises(ValueError):
        D.mixed_law("NONE", w)


@pytest.mark.parametrize("kind", ["CUBIC", "QUINTIC"])
def test_kernels_integrate_to_one(kind):
    q = np.linspace(0, 1, 20001)
    assert np.trapezoid(4 * np.pi * q**2 * D.kernel(q, kind), q) == pytest.approx(1, abs=1e-4 if kind == "CUBIC" else 3e-3)  # the usual quintic norm is rounded
    table = D.kernel_table(400, kind)
    b = np.arange(401) / 400
    assert np.trapezoid(2 * np.pi * b * table, b) == pytest.approx(1, abs=5e-3) and table[-1] == pytest.approx(0, abs=1e-6)


def test_models_are_exact_on_the_grid(spark):
    models = PH.StellarModels(np.array([6.0, 7, 8, 9]), np.array([-4.0, -3, -2]), np.linspace(1000, 5000, 5), np.arange(60, dtype=float).reshape(3, 4, 5), np.full((3, 4), 0.5))
    stars = spark.createDataFrame([(1, 7.0, -3.0, 1.0), (1, 7.0, -3.0, 2.0), (2, 99.0, 0.0, 1.0), (3, 6.5, -4.0, 1.0), (4, None, -3.0, 1.0)], "g long, log_age double, log_z double, mass double")
    got = {r["g"]: np.array(r["spectrum"]) for r in PH.spectra(stars, "g", models).collect()}
    flat = models.spectra
    assert np.allclose(got[1], flat[1, 1] * 6) and np.allclose(got[2], flat[2, 3] * 2) and np.allclose(got[3], (flat[0, 0] + flat[0, 1]) / 2 * 2) and 4 not in got
    with pytest.raises(ValueError):
        PH.StellarModels(models.log_ages, models.log_metals, models.wavelengths, flat, np.ones((2, 2)))


def test_magnitudes_and_slopes(spark):
    wave = np.linspace(1000, 9000, 161)
    models = PH.StellarModels(np.array([6.0, 7]), np.array([-3.0, -2]), wave, np.ones((2, 2, 161)), np.ones((2, 2)))
    light = (wave / 2000.0) ** 1.3
    df = spark.createDataFrame([(1, [float(v) for v in light], [float(v) for v in light * 2]), (2, [0.0] * 161, [0.0] * 161)], "g long, spectrum array<double>, spectrum_nodust array<double>")
    band = PH.Band("flat", np.ones(161))
    got = {r["g"]: r for r in PH.magnitudes(df, models, PH.PhotometryConfig(bands=(band,))).collect()}
    assert got[1]["beta"] == pytest.approx(1.3 - 2) and got[1]["beta_nodust"] == pytest.approx(1.3 - 2)
    assert got[1]["mag_abs_flat"] - got[1]["mag_abs_nodust_flat"] == pytest.approx(2.5 * math.log10(2)) and got[1]["luminosity_fir"] > 0
    assert got[2]["mag_abs_flat"] is None and got[2]["beta"] is None


def test_bands_and_grids():
    known = {"v": 5500.0, "sdss_r": 6200.0, "sdss_i": 7600.0, "alma_1": 1e7}
    assert PH.resolve_bands(["sdss_"], known) == ["v", "sdss_r", "sdss_i"] and PH.resolve_bands(["uvoir"], known) == ["v", "sdss_r", "sdss_i"] and len(PH.resolve_bands(["all", "v"], known)) == 4
    with pytest.raises(ValueError):
        PH.resolve_bands(["zz"], known)
    assert np.allclose(PH.oversample(np.array([0.0, 1, 3]), 2), [0, 0.5, 1, 2, 3])


def test_rotation_matrix(spark):
    df = spark.createDataFrame([(1.0, 2.0, -0.5), (0.0, 0.0, 3.0), (None, 0.0, 0.0)], "a double, b double, c double")
    for view, axis in (("face-on", 2), ("side-on", 1)):
        m = PH.rotation_to((F.col("a"), F.col("b"), F.col("c")), view)
        for r in df.select("a", "b", "c", *[F.array(*row).alias(f"m{i}") for i, row in enumerate(m)]).collect():
            matrix = np.array([r["m0"], r["m1"], r["m2"]])
            assert np.allclose(matrix @ matrix.T, np.eye(3))
            if r["a"] is not None:
                turned = matrix @ np.array([r["a"], r["b"], r["c"]])
                assert turned[axis] == pytest.approx(np.linalg.norm([r["a"], r["b"], r["c"]]))


def test_cosmology_limits():
    flat = Cosmology(0.7, 1.0, 0.0)
    assert flat.age(0.0)[0] == pytest.approx(2 / 3 * flat.hubble_time, rel=1e-5) and flat.comoving_distance(3.0)[0] == pytest.approx(2 * flat.hubble_distance * (1 - 0.5), rel=1e-6)
    usual = Cosmology(0.7, 0.3)
    assert usual.age(0.0)[0] == pytest.approx(13.467, abs=2e-3) and usual.luminosity_distance(1.0)[0] == pytest.approx(2 * 3303.8, rel=1e-4)
    head = Header(500.0, 0.68, 0.25, 3.0, Cosmology(0.68, 0.3), 50, 240)
    assert head.row()["mis"] == pytest.approx(500 / 290 ** (1 / 3)) and head.r200_factor > 0


def test_shells_fields_and_tables():
    shells = L.snapshot_shells([100, 300, 400, 1000], 50, 800)
    assert [(s.snapshot, s.d_min, s.d_max) for s in shells] == [(0, 50, 200), (1, 200, 350), (2, 350, 700), (3, 700, 800)]
    h = L.field_half_angle(100.0)
    assert 4 * h * math.sin(h) == pytest.approx(100 * (math.pi / 180) ** 2)
    assert L.field_half_angle(100.0, "circle") == pytest.approx(math.acos(1 - 100 * (math.pi / 180) ** 2 / (2 * math.pi)))
    for bad in (0, 20627):
        with pytest.raises(ValueError):
            L.field_half_angle(bad, "circle")
    table = L.DistanceTable(Cosmology(0.7, 0.3), 2.0)
    assert table.distance(1.0) == pytest.approx(3303.8, rel=1e-4) and table.redshift(table.distance(0.7)) == pytest.approx(0.7)
    with pytest.raises(ValueError):
        table.distance(3.0)


def test_observed_redshift(spark):
    row = spark.range(1).select(
        L.observed_redshift(F.lit(0.5), [F.lit(0.0), F.lit(0.0), F.lit(1000.0)], [F.lit(0.0), F.lit(0.0), F.lit(300.0)]).alias("a"),
        L.observed_redshift(F.lit(0.5), [F.lit(0.0), F.lit(1000.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(300.0)]).alias("b"),
    ).first()
    assert row["a"] == pytest.approx(1.5 * (1 + 300 / 299792.458) - 1) and row["b"] == pytest.approx(0.5)


def test_lightcone_counts_and_seeds(spark):
    n, box = 4000, 100.0
    rng = np.random.default_rng(2)
    pos = rng.uniform(0, box, (n, 3))
    objects = spark.createDataFrame([(i, *map(float, p), 0.0, 0.0, 0.0) for i, p in enumerate(pos)], "id long, x double, y double, z double, vx double, vy double, vz double")
    c = Cosmology(0.7, 0.3)
    shots = [L.Snapshot(objects, z, box, c) for z in (0.02, 0.05)]
    first = L.build_lightcone(shots, 400.0, 0.0, 0.06, seed=3, redshift_space=True)
    rows = first.orderBy("comoving_distance", "id").collect()
    again = L.build_lightcone(shots, 400.0, 0.0, 0.06, seed=3).orderBy("comoving_distance", "id").collect()
    assert [r["id"] for r in rows] == [r["id"] for r in again]
    want = n * L.cone_volume(400.0, 0.0, float(c.comoving_distance(0.06)[0]), box)
    assert abs(len(rows) - want) < 5 * math.sqrt(want) and all(abs(r["redshift_observed"] - r["redshift_cosmological"]) < 1e-12 for r in rows)
    with pytest.raises(ValueError):
        L.build_lightcone([shots[0], shots[0]], 10.0, 0.0, 0.05)
    with pytest.raises(KeyError):
        L.build_lightcone(shots, 10.0, 0.0, 0.05, properties=["nothing"])
