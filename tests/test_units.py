import itertools
import math

import pandas as pd
import pytest

from astroloom.functions import units as U
from astroloom.functions.units import parse_unit, split_raw
from astroloom.operators.units import conflicting_pairs, to_code_units


@pytest.mark.parametrize(
    ("text", "quantity", "expected"),
    [
        ("ckpc/h", "pos", (21.489350545012236, 1, -1)),
        ("kpc h^-1, proper", "pos", (21.489350545012236, 0, -1)),
        ("cm s**-1", "vel", (0, 0, 0)),
        ("sqrt(a) km/s", "vel", (5, 0.5, 0)),
        ("[10**10 M_sun h^-1]", "mass", (43.29850593860189, 0, -1)),
        ("solar masses per Gyr", "sfr", (16.799401971516666, 0, 0)),
        ("10^10 Msun h^2/kpc^3, comoving", "rho", (-21.169545696434824, -3, 2)),
        ("(km/s)^2 a^-2", "internal_energy", (10, -2, 0)),
        ("m2/s2", "potential", (4, 0, 0)),
        ("10^6 K", "temperature", (6, 0, 0)),
        ("keV (k_B T)", "temperature", (7.0646, 0, 0)),
    ],
)
def test_unit_texts(text, quantity, expected):
    assert U.parse_unit(text, quantity) == pytest.approx(expected, abs=1e-4)


@pytest.mark.parametrize("text", [None, "", "?", "n/a", "kg", "((", "km/s^", "Msun )", "flurbs"])
def test_unusable_texts(text):
    assert U.parse_unit(text, "pos") is None


def test_field_prior_settles_ambiguous_words():
    assert any(r.frame == "comoving" for r in U.segment("cm")) and any(not r.frame for r in U.segment("cm"))
    assert U.parse_unit("cm", "pos")[1] == 0  # a centimetre rather than a comoving metre
    assert U.parse_unit("keV", "temperature") is not None and U.parse_unit("keV", "mass") is None


@pytest.mark.parametrize(
    ("raw", "number", "unit"),
    [
        ("value=9.49E+40; units=g", 9.49e40, "g"),
        ("approx. 3.857931d-03 cMpc/h", 3.857931e-3, "cMpc/h"),
        ("units: cm s**-1 | -1.28E7", -1.28e7, "cm s**-1"),
        ("10**10 M_sun h^-1: 1.3d-03", 1.3e-3, "10**10 M_sun h^-1"),
        ("2.5 x 10^6 solar masses, taken from the log", 2.5e6, "solar masses"),
        ("m/s: -32,726.6425", -32726.6425, "m/s"),
        ("-130.55  (km/s)", -130.55, "(km/s)"),
        ("86.672", 86.672, ""),
    ],
)
def test_free_texts(raw, number, unit):
    got = U.split_raw(raw)
    assert got[0] == pytest.approx(number) and got[1] == unit


VALUES = "rec_id long, run_id long, snap_id int, object_id long, quantity string, num_value double, cgs_factor double, a_scale_exponent double, h_scale_exponent double, unit_text string, raw_text string, extra string"


def _tables(spark):
    snaps = spark.createDataFrame([(1, 0.5, 0.7)], "snap_id int, scale_factor double, h double")
    units = spark.createDataFrame([("pos", 3.08567758e21, 1), ("mass", 1.98841e33, 0)], "quantity string, unit_cgs double, a_exponent int")
    return snaps, units


def test_conversion_cases(spark):
    rows = [
        (1, 1, 1, 1, "pos", 10.0, 3.08567758e21, 1.0, -1.0, "Mpc", None, "e"),  # attributes decide
        (2, 1, 1, 1, "pos", 10.0, None, None, None, "proper kpc", None, "e"),
        (3, 1, 1, 1, "pos", None, None, None, None, None, "10 ckpc", "e"),
        (4, 1, 1, 1, "pos", 10.0, -1.0, None, None, "kpc", None, "e"),
        (5, 1, 1, 1, "pos", float("nan"), 1.0, None, None, None, None, "e"),
        (6, 1, 9, 1, "mass", 3.0, None, None, None, "Msun", None, "e"),  # unknown snapshot, not needed
        (7, 1, 9, 1, "pos", 3.0, None, None, None, "proper kpc", None, "e"),
        (8, 1, 1, 1, None, 3.0, None, None, None, "kpc", None, "e"),
        (9, 1, 1, 1, "pos", 10.0, 3.08567758e21, None, None, None, None, "e"),  # absent exponents are 0
    ]
    out = to_code_units(spark.createDataFrame(rows, VALUES), *_tables(spark)).toPandas().set_index("rec_id").code_value
    assert len(out) == 9
    assert out[1] == pytest.approx(10 / 0.7) and out[2] == pytest.approx(20) and out[3] == pytest.approx(10) and out[6] == pytest.approx(3) and out[9] == pytest.approx(20)
    assert out[[4, 5, 7, 8]].isna().all()


def test_conflicts_match_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.randrange(4), rng.choice([0.0, 1.0, 1.04, 1.06, -1.0, -1.2, 1e-9, 100.0, 101.0, 120.0, None, float("nan")])) for i in range(120)]
    rows += [(200, None, 1.0), (201, None, 5.0), (300, 9, 7.0)]
    got = conflicting_pairs(spark.createDataFrame(rows, "id long, k long, x double"), ["k"], "id", "x").toPandas()
    good = [r for r in rows if r[1] is not None and r[2] is not None and r[2] == r[2]]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a, b in itertools.combinations(good, 2) if a[1] == b[1] and abs(a[2] - b[2]) > 0.05 * max(abs(a[2]), abs(b[2]))}
    assert len(got) == len(want) and set(map(tuple, got.to_numpy())) == want
    assert conflicting_pairs(spark.createDataFrame([], "id long, k long, x double"), ["k"], "id", "x").count() == 0
    assert isinstance(got, pd.DataFrame)


def test_remarks_roots_of_two_words_and_further_units():
    assert split_raw("12.5 kpc, read off the plot") == (12.5, "kpc")
    assert split_raw("12.5 kpc, comoving") == (12.5, "kpc, comoving") and split_raw("3 km, s") == (3.0, "km, s")
    assert parse_unit("1e10 solar masses", "mass")[0] == pytest.approx(math.log10(1.98841e43))
    assert parse_unit("keV k_B T", "temperature") == parse_unit("keV (k_B*T)", "temperature") == parse_unit("keV", "temperature")
    assert parse_unit("kly", "pos")[0] == pytest.approx(math.log10(9.4607e20), abs=1e-4) and parse_unit("Å", "pos")[0] == -8
    assert parse_unit("Msun/day", "sfr")[0] == pytest.approx(math.log10(1.98841e33 / 86400)) and parse_unit("lb", "mass")[0] == pytest.approx(math.log10(453.59237))
    assert parse_unit("km per hour", "vel")[0] == pytest.approx(math.log10(1e5 / 3600)) and parse_unit("furlong", "pos") is None
