"""Physical constants and scalar column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# CODATA 2022 and IAU 2015, cgs unless the name says otherwise.
G_CGS = 6.6743e-8
C_CGS = 2.99792458e10
C_KMS = 299792.458
PROTON_MASS_G = 1.67262192595e-24
BOLTZMANN_CGS = 1.380649e-16
SIGMA_T_CGS = 6.6524587051e-25
M_SUN_G = 1.988409870698051e33
L_SUN_CGS = 3.828e33
KPC_CM = 3.0856775814913674e21
PC_CM = 3.0856775814913674e18
YEAR_S = 3.15576e7
GYR_S = 3.15576e16
X_H = 0.76
MW_DUST_TO_METAL = 0.4 / 0.6
Z_SUN_WATSON = 0.0189
Z_SUN_ASPLUND = 0.0134
AV_TO_NH = 2.2e21
G_VCIRC = G_CGS * M_SUN_G / KPC_CM / 1e10  # km^2 kpc Msun^-1 s^-2 in kpc: (km/s)^2 kpc / Msun

# Neutral and molecular gas in star-forming gas without stored fractions.
BLITZ_ALPHA, BLITZ_P0 = 0.92, 4.3e4
TNG_A0, TNG_A_EXP, TNG_T_SN, TNG_T_COLD, TNG_NH_THRESH = 573.0, -0.8, 5.73e7, 1.0e3, 0.1065

# Element symbols by full name, up to germanium.
ELEMENT_SYMBOLS = {
    "Hydrogen": "H", "Helium": "He", "Lithium": "Li", "Beryllium": "Be", "Boron": "B", "Carbon": "C", "Nitrogen": "N", "Oxygen": "O",
    "Fluorine": "F", "Neon": "Ne", "Sodium": "Na", "Magnesium": "Mg", "Aluminium": "Al", "Aluminum": "Al", "Silicon": "Si", "Phosphorus": "P",
    "Sulfur": "S", "Sulphur": "S", "Chlorine": "Cl", "Argon": "Ar", "Potassium": "K", "Calcium": "Ca", "Scandium": "Sc", "Titanium": "Ti",
    "Vanadium": "V", "Chromium": "Cr", "Manganese": "Mn", "Iron": "Fe", "Cobalt": "Co", "Nickel": "Ni", "Copper": "Cu", "Zinc": "Zn",
    "Gallium": "Ga", "Germanium": "Ge",
}


def virial_temperature_factor(mu: float = 0.6) -> float:
    """Kelvin per (km/s)^2."""
    return mu * PROTON_MASS_G * 1e10 / (2 * BOLTZMANN_CGS)


def eddington_factor(frad: float = 0.1) -> float:
    """Eddington accretion rate per black hole mass, per year."""
    return 4 * math.pi * G_CGS * PROTON_MASS_G / (frad * C_CGS * SIGMA_T_CGS) * YEAR_S


def min_image(delta: Column, box: float) -> Column:
    """The nearest periodic image of a separation; halves go to the even multiple."""
    return delta - F.lit(float(box)) * F.rint(delta / F.lit(float(box)))


def wrap(x: Column, box: float) -> Column:
    """A coordinate inside [0, box)."""
    return F.pmod(x, F.lit(float(box)))


def unwrap(x: Column, centre: Column, box: float) -> Column:
    """The image of ``x`` within half a box of ``centre``."""
    half = box / 2
    return F.when(x - centre > half, x - box).when(x - centre < -half, x + box).otherwise(x)


def guarded_divide(top: Column, bottom: Column) -> Column:
    """Null where the denominator is 0 or null."""
    return F.when(bottom != 0, top / bottom)


def guarded_asin(x: Column) -> Column:
    """asin of the value clipped to [-1, 1]; 0 where it is null or NaN."""
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.asin(clipped))


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def cubic_spline_weight(q: Column) -> Column:
    """Neighbour weight for q = 2 r / l: the cubic spline without its norm."""
    near = 1 - 1.5 * q * q + 0.75 * q * q * q
    far = 0.25 * F.pow(2 - q, F.lit(3.0))
    return F.when(q < 1, near).when(q < 2, far).otherwise(F.lit(0.0))


def hydrogen_number_density(rho: Column, metallicity: Column, helium: Column) -> Column:
    """Hydrogen nuclei per cm^3 of gas with density in g/cm^3."""
    return rho * (1 - metallicity - helium) / PROTON_MASS_G


GAS_CRITERIA = ("COLD", "STARFORMING", "COLD_OR_STARFORMING", "DENSE_ONLY")


def gas_criterion(density: Column, temperature: Column, sfr: Column, criterion: str, density_limit: float, temperature_limit: float) -> Column:
    """Which gas takes part in galaxy finding: dense, and cold or star-forming as asked for."""
    cold, forming = temperature < temperature_limit, sfr > 0
    extra = {"COLD": cold, "STARFORMING": forming, "COLD_OR_STARFORMING": cold | forming, "DENSE_ONLY": F.lit(True)}
    if criterion not in extra:
        raise ValueError(f"gas criterion {criterion!r} is none of {GAS_CRITERIA}")
    return (density > density_limit) & extra[criterion]


def gas_temperature(energy: Column, electrons: Column, helium: Column, gamma: float = 5 / 3) -> Column:
    """Kelvin from specific internal energy in cm^2/s^2."""
    y = helium / (4 * (1 - helium))
    mu = (1 + 4 * y) / (1 + y + electrons)
    return mu * PROTON_MASS_G * (gamma - 1) * energy / BOLTZMANN_CGS


def clipped_fraction(hydrogen: Column, part: Column, mass: Column) -> Column:
    """Mass of a phase that makes up ``part`` of the hydrogen, kept within [0, mass]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), hydrogen * part)) * mass


def neutral_and_molecular(energy: Column, sfr: Column, neutral: Column, electrons: Column, rho: Column, helium: Column, metallicity: Column, mass: Column) -> tuple[Column, Column]:
    """(HI mass, H2 mass) by a two-phase model for star-forming gas and a pressure law for the molecular part."""
    hydrogen = 1 - helium - metallicity
    mu_cold = 4 / (1 + 3 * hydrogen)
    per_kelvin = BOLTZMANN_CGS / ((5 / 3 - 1) * mu_cold * PROTON_MASS_G)
    u_cold, u_sn = per_kelvin * TNG_T_COLD, per_kelvin * TNG_T_SN
    n_h = rho * hydrogen / PROTON_MASS_G
    u_hot = u_cold + u_sn / (1 + TNG_A0 * F.pow(n_h / TNG_NH_THRESH, F.lit(TNG_A_EXP)))
    cold = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (u_hot - energy) / (u_hot - u_cold)))
    x = F.when(sfr > 0, cold).otherwise(neutral)
    pressure = n_h * (1 + electrons + helium / (4 * hydrogen)) * gas_temperature(energy, electrons, helium)
    ratio = F.pow(pressure / BLITZ_P0, F.lit(BLITZ_ALPHA))
    return hydrogen * x / (1 + ratio) * mass, hydrogen * x * ratio / (1 + ratio) * mass


@dataclass(frozen=True)
class Cosmology:
    """A w0-wa universe with optional curvature and radiation; distances in Mpc, times in Gyr."""

    h: float
    omega_matter: float
    omega_lambda: float | None = None
    w0: float = -1.0
    wa: float = 0.0
    t_cmb: float = 0.0
    steps: int = 20001
    omega_radiation: float = field(init=False, default=0.0)
    omega_dark: float = field(init=False, default=0.0)

    def __post_init__(self):
        # photons and three massless neutrino species
        photons = 2.4728e-5 / self.h**2 * (self.t_cmb / 2.7255) ** 4
        radiation = photons * (1 + 0.2271073 * 3.04)
        object.__setattr__(self, "omega_radiation", radiation)
        object.__setattr__(self, "omega_dark", 1 - self.omega_matter - radiation if self.omega_lambda is None else self.omega_lambda)

    @property
    def omega_curvature(self) -> float:
        return 1 - self.omega_matter - self.omega_dark - self.omega_radiation

    @property
    def hubble_time(self) -> float:
        return 1 / (self.h * 100 / (KPC_CM / 1e5 * 1e3)) / GYR_S

    @property
    def hubble_distance(self) -> float:
        return C_KMS / (100 * self.h)

    def e(self, z):
        a = 1 / (1 + np.asarray(z, dtype=float))
        dark = self.omega_dark * a ** (-3 * (1 + self.w0 + self.wa)) * np.exp(-3 * self.wa * (1 - a))
        return np.sqrt(self.omega_matter * a**-3 + self.omega_radiation * a**-4 + self.omega_curvature * a**-2 + dark)

    def hubble(self, z):
        """1/s."""
        return self.h * 100 / (KPC_CM / 1e5 * 1e3) * self.e(z)

    def age(self, z) -> np.ndarray:
        """Gyr since a = 0, by quadrature in sqrt(a), which is smooth at 0."""
        out = []
        for one in np.atleast_1d(np.asarray(z, dtype=float)):
            s = np.linspace(0, math.sqrt(1 / (1 + one)), self.steps)
            a = np.maximum(s**2, 1e-30)
            f = np.where(s > 0, 2 * s / (a * self.e(1 / a - 1)), 0.0)
            out.append(simpson(f, s[1] - s[0]) * self.hubble_time)
        return np.array(out)

    def critical_density(self, z):
        """Msun / kpc^3, physical."""
        return 3 * self.hubble(z) ** 2 / (8 * math.pi * G_CGS) * KPC_CM**3 / M_SUN_G

    def omega_matter_at(self, z):
        return self.omega_matter * (1 + np.asarray(z, dtype=float)) ** 3 / self.e(z) ** 2

    def comoving_distance(self, z) -> np.ndarray:
        out = []
        for one in np.atleast_1d(np.asarray(z, dtype=float)):
            grid = np.linspace(0, one, self.steps)
            out.append(simpson(1 / self.e(grid), grid[1] - grid[0]) * self.hubble_distance if one > 0 else 0.0)
        return np.array(out)

    def luminosity_distance(self, z) -> np.ndarray:
        d, k = self.comoving_distance(z), self.omega_curvature
        if abs(k) > 1e-12:
            root = math.sqrt(abs(k)) / self.hubble_distance
            d = (np.sinh(root * d) if k > 0 else np.sin(root * d)) / root
        return d * (1 + np.atleast_1d(np.asarray(z, dtype=float)))


def simpson(values: np.ndarray, step: float) -> float:
    """Integral over an odd number of equally spaced values."""
    return float(step / 3 * (values[0] + values[-1] + 4 * values[1:-1:2].sum() + 2 * values[2:-1:2].sum()))


@dataclass(frozen=True)
class Header:
    """Derived scalars of a snapshot."""

    boxsize: float
    h: float
    scale_factor: float
    redshift: float
    cosmology: Cosmology
    n_star: int = 0
    n_gas: int = 0

    @property
    def mean_separation(self) -> float:
        return self.boxsize / max(1, self.n_star + self.n_gas) ** (1 / 3)

    @property
    def rhocrit(self) -> float:
        return float(self.cosmology.critical_density(self.redshift))

    @property
    def rhocrit_comoving(self) -> float:
        return self.rhocrit * self.scale_factor**3

    @property
    def r200_factor(self) -> float:
        return float((200 * 4 / 3 * math.pi * self.cosmology.omega_matter_at(self.redshift) * self.rhocrit_comoving) ** (-1 / 3))

    def row(self) -> dict:
        c, z = self.cosmology, self.redshift
        return {
            "boxsize": self.boxsize, "h": self.h, "scale_factor": self.scale_factor, "redshift": z, "omega_matter": c.omega_matter, "omega_lambda": c.omega_dark,
            "w_0": c.w0, "w_a": c.wa, "mis": self.mean_separation, "time_gyr": float(c.age(z)[0]), "Hz": float(c.hubble(z)), "E_z": float(c.e(z)),
            "rhocrit": self.rhocrit, "rhocrit_comoving": self.rhocrit_comoving, "omega_matter_z": float(c.omega_matter_at(z)), "r200_factor": self.r200_factor,
        }


def stellar_age(formation: Column, cosmology: Cosmology, time_now: float, knots: int = 512) -> Column:
    """Age in Gyr of a star formed at scale factor ``formation``: linear between tabulated ages, whose table is a literal."""
    a = np.linspace(0, 1, knots + 1)
    ages = [0.0, *(float(x) for x in cosmology.age(1 / a[1:] - 1))]
    place = F.least(F.lit(knots - 1), F.greatest(F.lit(0), F.floor(formation * knots).cast("int")))
    table = F.array(*[F.lit(x) for x in ages])
    low, high = F.element_at(table, place + 1), F.element_at(table, place + 2)
    return F.lit(float(time_now)) - (low + (high - low) * (formation * knots - place))


def gadget_unit_factor(column: str, h: float, a: float) -> float:
    """Factor from the usual code units of that family (1e10 Msun/h, kpc/h comoving, km/s sqrt(a)) to the engine's."""
    mass, time = 1e10 / h, KPC_CM / 1e5 / YEAR_S  # Msun; years in kpc / (km/s)
    density = 1e10 * h**2 * M_SUN_G / KPC_CM**3 / a**3
    return {
        "pos": 1 / h, "smoothing_length": 1 / h, "vel": math.sqrt(a), "potential": 1.0, "mass": mass, "bhmass": mass, "dust_mass": mass,
        "rho": density, "internal_energy": 1e10, "bhmdot": 1e10 / h / time, "age": 1.0,
    }.get(column, 1.0)


def swift_unit_factor(cgs: float, a_exponent: float, h_exponent: float, target_cgs: float, target_a_exponent: float, h: float, a: float) -> float:
    """Factor from a dataset with unit attributes to a code unit."""
    return cgs / target_cgs * a ** (a_exponent - target_a_exponent) * h**h_exponent
