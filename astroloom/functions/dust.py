"""Attenuation and extinction curves, intergalactic transmission and kernel tables.

Curves take wavelengths in angstrom as a column or a numpy array and give the optical depth relative to the V band.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

V_BAND = 5500.0

# Calzetti et al. (2000), coefficients of powers of 1/um, and the edges of the law in angstrom.
CALZETTI_RV = 4.05
CALZETTI_UV = (-2.156, 1.509, -0.198, 0.011)
CALZETTI_IR = (-1.857, 1.040)
CALZETTI_SCALE, CALZETTI_EDGES = 2.659, (1200.0, 6300.0, 22000.0)

# Cardelli, Clayton and Mathis (1989) and its variant by Conroy et al. (2010); x in 1/um, y = x - 1.82.
RV = 3.1
CARDELLI_A = (1.0, 0.17699, -0.50447, -0.02427, 0.72085, 0.01979, -0.77530, 0.32999)
CARDELLI_B = (0.0, 1.41338, 2.28305, 1.07233, -5.38434, -0.62251, 5.30260, -2.09002)
CARDELLI_FAR_A, CARDELLI_FAR_B = (0.0, 0.0, -0.04473, -0.009779), (0.0, 0.0, 0.2130, 0.1207)
CARDELLI_XUV_A, CARDELLI_XUV_B = (-1.073, -0.628, 0.137, -0.070), (13.670, 4.257, -0.420, 0.374)
CONROY_A = (1.0, 0.177, -0.504, -0.0243, 0.721, 0.0198, -0.775, 0.330)
CONROY_B = (0.0, 1.413, 2.283, 1.072, -5.384, -0.622, 5.303, -2.090)
CONROY_FAR_A, CONROY_FAR_B = (0.0, 0.0, -0.0447, -0.00978), (0.0, 0.0, 0.213, 0.121)
INFRARED_A, INFRARED_B, INFRARED_POWER = 0.574, -0.527, 1.61
BUMP = 0.6

# Pei (1992), terms (a, lambda in um, b, n).
SMC = ((185.0, 0.042, 90.0, 2.0), (27.0, 0.08, 5.50, 4.0), (0.005, 0.22, -1.95, 2.0), (0.010, 9.7, -1.95, 2.0), (0.012, 18.0, -1.80, 2.0), (0.030, 25.0, 0.0, 2.0))
LMC = ((175.0, 0.046, 90.0, 2.0), (19.0, 0.08, 5.50, 4.5), (0.023, 0.22, -1.95, 2.0), (0.005, 9.7, -1.95, 2.0), (0.006, 18.0, -1.80, 2.0), (0.020, 25.0, 0.0, 2.0))

# Madau (1995), line wavelengths and coefficients, and the terms of the continuum (factor, power, x_e power, x_c power).
MADAU_LINES = ((1216.0, 3.6e-3), (1026.0, 1.7e-3), (973.0, 1.2e-3), (950.0, 9.3e-4))
LYMAN_LIMIT, MADAU_LINE_POWER = 912.0, 3.46


def _pick(cases: list[tuple], default):
    """The value of the first case that holds, on columns or arrays."""
    if isinstance(cases[0][0], Column):
        out = F.when(cases[0][0], cases[0][1])
        for test, value in cases[1:]:
            out = out.when(test, value)
        return out.otherwise(default)
    return np.select([c for c, _ in cases], [v for _, v in cases], default)


def _poly(coefficients: tuple, x):
    """Horner's rule."""
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = x * out + c
    return out


def power_law(wavelength, alpha: float = 1.0):
    return (wavelength / V_BAND) ** (-alpha)


def calzetti(wavelength):
    def uv(w):
        return CALZETTI_SCALE * _poly(CALZETTI_UV, 1e4 / w) + CALZETTI_RV

    def ir(w):
        return CALZETTI_SCALE * _poly(CALZETTI_IR, 1e4 / w) + CALZETTI_RV

    low, middle, high = CALZETTI_EDGES
    # beyond its edges the law goes on in a straight line with the slope of the last 100 angstrom
    below = uv(low - 100) + (wavelength - (low - 100)) * ((uv(low) - uv(low - 100)) / 100)
    above = ir(high) + (wavelength - high) * ((ir(high) - ir(high - 100)) / 100)
    k = _pick([(wavelength < low, below), (wavelength < middle, uv(wavelength)), (wavelength <= high, ir(wavelength))], above)
    return _pick([(k < 0, k * 0.0 + 0.0)], k) / uv(V_BAND)


def _drude(x, f_bump: float = 1.0):
    """The near-UV parts a(x), b(x) with the 2175 angstrom bump."""
    a = 1.752 - 0.316 * x - 0.104 * f_bump / ((x - 4.67) * (x - 4.67) + 0.341)
    b = -3.09 + 1.825 * x + 1.206 * f_bump / ((x - 4.62) * (x - 4.62) + 0.263)
    return a, b


def _infrared(x):
    return (INFRARED_A + INFRARED_B / RV) * x**INFRARED_POWER


def cardelli(wavelength):
    x = 1e4 / wavelength
    y, far, xuv = x - 1.82, x - 5.9, x - 8.0
    a, b = _drude(x)
    return _pick(
        [
            (x < 1.1, _infrared(x)),
            (x < 3.3, _poly(CARDELLI_A, y) + _poly(CARDELLI_B, y) / RV),
            (x < 5.9, a + b / RV),
            (x < 8.0, a + _poly(CARDELLI_FAR_A, far) + (b + _poly(CARDELLI_FAR_B, far)) / RV),
        ],
        _poly(CARDELLI_XUV_A, xuv) + _poly(CARDELLI_XUV_B, xuv) / RV,
    )


def conroy(wavelength, f_bump: float = BUMP):
    x = 1e4 / wavelength

    def far_uv(x):
        a, b = _drude(x, f_bump)
        return a + _poly(CONROY_FAR_A, x - 5.9) + (b + _poly(CONROY_FAR_B, x - 5.9)) / RV

    y = x - 1.82
    a, b = _drude(x, f_bump)
    join = (3.3 / x) ** 6 * (-0.0370 + 0.0469 * f_bump - 0.601 * f_bump / RV + 0.542 / RV)
    return _pick(
        [(x > 8.0, (8.0 / x) ** -1.3 * far_uv(8.0)), (x > 5.9, far_uv(x)), (x > 3.3, a + join + b / RV), (x > 1.1, _poly(CONROY_A, y) + _poly(CONROY_B, y) / RV)],
        _infrared(x),
    )


def _pei(terms: tuple, wavelength):
    def curve(w):
        return sum(a / ((w / at) ** n + (at / w) ** n + b) for a, at, b, n in terms)

    return curve(wavelength / 1e4) / curve(0.55)


def smc(wavelength):
    return _pei(SMC, wavelength)


def lmc(wavelength):
    return _pei(LMC, wavelength)


LAWS = {"POWER_LAW": power_law, "CALZETTI": calzetti, "CONROY": conroy, "CARDELLI": cardelli, "SMC": smc, "LMC": lmc}
MIXES = ("MIX_CALZ_MW", "COMPOSITE")


def _clamp(x):
    if isinstance(x, Column):
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return np.clip(x, 0.0, 1.0)


def mixed_law(name: str, wavelength, log_ssfr=None, log_z=None, alpha: float = 1.0):
    """A single law (the power law with slope ``alpha``), or a mix by the galaxy: active galaxies towards Calzetti, metal-poor ones towards SMC."""
    if name == "POWER_LAW":
        return power_law(wavelength, alpha)
    if name in LAWS:
        return LAWS[name](wavelength)
    if name not in MIXES:
        raise ValueError(f"unknown dust law {name!r}")
    active = _clamp(log_ssfr + 1.0)
    mix = active * calzetti(wavelength) + (1 - active) * cardelli(wavelength)
    if name == "MIX_CALZ_MW":
        return mix
    rich = _clamp(log_z + 2.0)
    return rich * mix + (1 - rich) * smc(wavelength)


def madau(wavelength, redshift: float):
    """Transmission of the intergalactic medium at an observed wavelength; 1 at redshift 0."""
    if redshift < 1e-10:
        return wavelength * 0.0 + 1.0
    x_e = 1 + redshift
    x_c = wavelength / LYMAN_LIMIT
    tau = wavelength * 0.0
    for line, strength in MADAU_LINES:
        tau = tau + _pick([(wavelength <= line * x_e, strength * (wavelength / line) ** MADAU_LINE_POWER)], wavelength * 0.0)
    continuum = (
        0.25 * x_c**3 * (x_e**0.46 - x_c**0.46) + 9.4 * x_c**1.5 * (x_e**0.18 - x_c**0.18)
        - 0.7 * x_c**3 * (x_c**-1.32 - x_e**-1.32) - 0.023 * (x_e**1.68 - x_c**1.68)
    )
    tau = tau + _pick([(wavelength < LYMAN_LIMIT * x_e, continuum)], wavelength * 0.0)
    return _clamp(F.exp(-tau) if isinstance(tau, Column) else np.exp(-tau))


def kernel(q: np.ndarray, kind: str = "CUBIC") -> np.ndarray:
    """The 3D smoothing kernel with support [0, 1]: sums of powers of (c - u) with u = c q."""
    # Fixed values: (support in smoothing units, power, norm, factors of the terms).
    c, power, scale, factors = {"CUBIC": (2, 3, 2 / math.pi, (1, -4)), "QUINTIC": (3, 5, 81 / (359 * math.pi), (1, -6, 15))}[kind]
    u = c * np.asarray(q, dtype=float)
    return scale * sum(f * np.where(u < c - i, (c - i - u), 0.0) ** power for i, f in enumerate(factors))


def kernel_table(bins: int, kind: str = "CUBIC") -> np.ndarray:
    """Projected kernel at b/h = 0, 1/bins, ..., 1: twice the trapezoid sum along the line of sight."""
    grid = np.arange(bins + 1) / bins
    b2, z = grid[:, None] ** 2, grid[None, :]
    w = kernel(np.sqrt(b2 + z**2), kind)
    steps = 0.5 / bins * (w[:, :-1] + w[:, 1:])
    return 2 * np.where(z[:, :-1] < np.sqrt(np.maximum(0, 1 - b2)), steps, 0.0).sum(1)
