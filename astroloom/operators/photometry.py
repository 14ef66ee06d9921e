"""Galaxy photometry: dust, spectra, magnitudes."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astroloom.functions.dust import kernel_table, madau, mixed_law
from astroloom.functions.physics import AV_TO_NH, C_KMS, KPC_CM, L_SUN_CGS, M_SUN_G, PROTON_MASS_G, X_H, Z_SUN_ASPLUND, Z_SUN_WATSON, guarded_divide, unwrap
from astroloom.operators.spatial import metal_columns
from astroloom.tables import cut

#: Stars per task in the spectrum synthesis; a galaxy of any size is cut into so many and its partial spectra are added.
STARS = 20_000
ANGSTROM_PER_S = C_KMS * 1e13
# Fixed value: the dust-to-metal ratio of the Milky Way.
MW_DUST_TO_METAL = 0.4 / 0.6


@dataclass(frozen=True)
class StellarModels:
    """Spectra of single populations on a grid of log metallicity and log age (years), with remaining mass fractions."""

    log_ages: np.ndarray
    log_metals: np.ndarray
    wavelengths: np.ndarray
    spectra: np.ndarray  # (metal, age, wavelength)
    remaining: np.ndarray  # (metal, age)
    version: int = 1

    def __post_init__(self):
        shape = (len(self.log_metals), len(self.log_ages))
        if self.spectra.shape != (*shape, len(self.wavelengths)) or self.remaining.shape != shape:
            raise ValueError("spectra and remaining masses do not fit the grids")

    def corners(self, grid: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower grid place and fraction, clamped to the grid."""
        at = np.clip(np.searchsorted(grid, value, side="right") - 1, 0, len(grid) - 2)
        return at, np.clip((value - grid[at]) / (grid[at + 1] - grid[at]), 0.0, 1.0)

    def weights(self, log_age: np.ndarray, log_metal: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """(stars, metal * age) weights: bilinear shares times the initial mass."""
        i, f = self.corners(self.log_ages, log_age)
        j, g = self.corners(self.log_metals, log_metal)
        left = np.zeros(len(mass))
        out = np.zeros((len(mass), self.remaining.size))
        rows = np.arange(len(mass))
        for dj, wj in ((0, 1 - g), (1, g)):
            for di, wi in ((0, 1 - f), (1, f)):
                left += wj * wi * self.remaining[j + dj, i + di]
                out[rows, (j + dj) * len(self.log_ages) + i + di] += wj * wi
        return out * np.where(left > 0, mass / np.where(left > 0, left, 1), 0.0)[:, None]


@dataclass(frozen=True)
class Band:
    """A filter as transmission at the wavelengths of the models."""

    name: str
    transmission: np.ndarray
    effective: float = 0.0


@dataclass(frozen=True)
class PhotometryConfig:
    dust_law: str = "COMPOSITE"
    kernel: str = "CUBIC"
    kernel_bins: int = 1000
    axis: str = "z"
    redshift: float = 0.0
    luminosity_distance_mpc: float = 0.0
    use_dust: bool = True
    use_igm: bool = True
    alpha: float = 1.0
    orientation: str | None = None
    bands: tuple[Band, ...] = field(default_factory=tuple)

    @property
    def av_per_column(self) -> float:
        """V-band extinction per metal column in Msun per comoving kpc^2."""
        return X_H * M_SUN_G * (1 + self.redshift) ** 2 / PROTON_MASS_G / KPC_CM**2 / AV_TO_NH / Z_SUN_WATSON


def resolve_bands(names: list[str], known: dict[str, float]) -> list[str]:
    """Band names for ``all``, ``uvoir`` (effective wavelength below 5e4 angstrom), exact names and prefixes that end in '_'.

    Repeated names count once; 'v' is put first where it is known and not asked for. Unknown names are an error.
    """
    out: list[str] = []
    for name in names:
        if name == "all":
            found = list(known)
        elif name == "uvoir":
            found = [b for b, w in known.items() if w < 5e4]
        elif name in known:
            found = [name]
        else:
            found = [b for b in known if name and b.startswith(f"{name.rstrip('_')}_")]
        if not found:
            raise ValueError(f"no band is called {name!r}")
        out += [b for b in found if b not in out]
    return out if "v" in out or "v" not in known else ["v", *out]


def oversample(grid: np.ndarray, parts: int) -> np.ndarray:
    """A grid with every interval divided evenly."""
    steps = np.linspace(0, 1, parts + 1)[:-1]
    return np.append((grid[:-1, None] + np.diff(grid)[:, None] * steps).ravel(), grid[-1])


def rotation_to(momentum: tuple[Column, Column, Column], view: str = "face-on") -> list[list[Column]]:
    """Rotation matrix that turns the angular momentum to the line of sight z (face-on) or to y (side-on); identity if it is null or 0."""
    lx, ly, lz = momentum
    size = F.sqrt(lx * lx + ly * ly + lz * lz)
    good = (size > 0) & ~F.isnan(size)
    nx, ny, nz = (F.coalesce(F.when(good, c / size), F.lit(d)) for c, d in ((lx, 0.0), (ly, 0.0), (lz, 1.0)))
    flat = F.sqrt(nx * nx + ny * ny)
    ux, uy = F.when(flat > 0, ny / flat).otherwise(F.lit(1.0)), F.when(flat > 0, -nx / flat).otherwise(F.lit(0.0))
    first = [ux, uy, F.lit(0.0)]
    second = [-nz * uy, nz * ux, nx * uy - ny * ux]
    third = [nx, ny, nz]
    turned = [first, second, third] if view == "face-on" else [first, third, [-c for c in second]]
    same = [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    return [[F.when(good, turned[i][j]).otherwise(same[i][j]) for j in range(3)] for i in range(3)]


def rotate(matrix: list[list[Column]], x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    return tuple(row[0] * x + row[1] * y + row[2] * z for row in matrix)


def ab_magnitude(luminosity: Column, factor: float) -> Column:
    """Magnitude of a mean band luminosity; null where it is not positive."""
    return F.when(luminosity > 0, -2.5 * F.log10(luminosity * factor) - 48.6)


def uv_slope(log_wavelength: str, log_luminosity: str) -> Column:
    """Slope of log luminosity per log wavelength, less 2 (frequency to wavelength units); null with fewer than two points."""
    return F.regr_slope(log_luminosity, log_wavelength) - 2


def spectra(stars: DataFrame, galaxy: str, models: StellarModels, law: str = "CALZETTI", alpha: float = 1.0) -> DataFrame:
    """(galaxy, spectrum, spectrum_nodust): summed spectra of the stars of every galaxy at the model wavelengths.

    ``stars``: galaxy, log_age, log_z, mass, and optionally a_v, v_los, log_ssfr, galaxy_log_z. Stars are dealt
    to chunks of a galaxy by a hash, chunks are synthesised with matrix products, and partial spectra are added, so the
    size of a galaxy is no limit. Stars with null values add nothing; a galaxy without stars has no row.
    """
    wave = models.wavelengths
    flat = models.spectra.reshape(-1, len(wave))
    shared = stars.sparkSession.sparkContext.broadcast((models, flat))
    extra = [c for c in ("a_v", "v_los", "log_ssfr", "galaxy_log_z") if c in stars.columns]
    rows = stars.select(galaxy, "log_age", "log_z", "mass", *extra).dropna(subset=[galaxy, "log_age", "log_z", "mass"])
    rows = rows.withColumn("__chunk", F.pmod(F.xxhash64("log_age", "log_z", "mass"), F.lit(64)).cast("int"))

    def synthesise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        models, flat = shared.value
        total, bare = np.zeros(len(wave)), np.zeros(len(wave))
        for at in range(0, len(pdf), 2048):
            part = pdf.iloc[at : at + 2048]
            weights = models.weights(part["log_age"].to_numpy(), part["log_z"].to_numpy(), part["mass"].to_numpy())
            if "v_los" in part or "a_v" in part:
                light = weights @ flat
                if "v_los" in part:
                    shift = 1 + part["v_los"].fillna(0.0).to_numpy() / C_KMS
                    source = np.clip(np.searchsorted(wave, wave[None, :] / shift[:, None]), 0, len(wave) - 1)
                    light = np.take_along_axis(light, source, 1)
                bare += light.sum(0)
                if "a_v" in part:
                    curve = mixed_law(law, wave, float(part["log_ssfr"].iloc[0]) if "log_ssfr" in part else 0.0, float(part["galaxy_log_z"].iloc[0]) if "galaxy_log_z" in part else 0.0, alpha)
                    light = light * np.exp(-part["a_v"].fillna(0.0).to_numpy()[:, None] * curve[None, :])
                total += light.sum(0)
            else:
                whole = weights.sum(0) @ flat
                total += whole
                bare += whole
        return pd.DataFrame({galaxy: [key[0]], "spectrum": [total], "bare": [bare]})

    kind = stars.schema[galaxy].dataType.simpleString()
    parts = rows.groupBy(galaxy, "__chunk").applyInPandas(synthesise, f"{galaxy} {kind}, spectrum array<double>, bare array<double>")
    add = lambda c: F.aggregate(F.collect_list(c), F.array_repeat(F.lit(0.0), len(wave)), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
    return parts.groupBy(galaxy).agg(add("spectrum").alias("spectrum"), add("bare").alias("spectrum_nodust"))  # at most 64 partial spectra


def _weighted_sum(spectrum: str, weights: np.ndarray) -> Column:
    table = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(F.zip_with(F.col(spectrum), table, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def magnitudes(light: DataFrame, models: StellarModels, config: PhotometryConfig) -> DataFrame:
    """Absolute and apparent magnitudes with and without dust, infrared luminosity and UV slopes from spectra per galaxy."""
    wave = models.wavelengths
    dnu = ANGSTROM_PER_S / wave**2 * np.gradient(wave)
    ten_pc = 4 * math.pi * (10 * KPC_CM / 1e3) ** 2 / L_SUN_CGS
    out = light
    for band in config.bands:
        weight = band.transmission * dnu
        scale = weight.sum() or 1.0
        for suffix, source in (("", "spectrum"), ("_nodust", "spectrum_nodust")):
            out = out.withColumn(f"mag_abs{suffix}_{band.name}", ab_magnitude(_weighted_sum(source, weight / scale), 1 / ten_pc))
            # at redshift 0 there is no luminosity distance, and apparent magnitudes are the absolute ones
            far = config.redshift >= 1e-10
            shifted = np.interp(wave * (1 + config.redshift), wave, band.transmission, left=0.0, right=0.0) * dnu
            through = shifted * (madau(wave * (1 + config.redshift), config.redshift) if config.use_igm else 1.0)
            area = 4 * math.pi * (config.luminosity_distance_mpc * 1e3 * KPC_CM) ** 2 / (1 + config.redshift) / L_SUN_CGS if far else ten_pc
            out = out.withColumn(f"mag_app{suffix}_{band.name}", ab_magnitude(_weighted_sum(source, through / (shifted.sum() or 1.0)), 1 / area))
    out = out.withColumn("luminosity_fir", _weighted_sum("spectrum_nodust", dnu) - _weighted_sum("spectrum", dnu))
    inside = (wave >= 1500) & (wave < 3000)
    x = np.log10(wave[inside])
    for name, source in (("beta", "spectrum"), ("beta_nodust", "spectrum_nodust")):
        points = F.arrays_zip(F.array(*[F.lit(float(v)) for v in x]).alias("x"), F.slice(F.col(source), F.lit(int(np.argmax(inside)) + 1), F.lit(int(inside.sum()))).alias("l")) if inside.any() else None
        if points is None:
            out = out.withColumn(name, F.lit(None).cast("double"))
            continue
        used = F.filter(points, lambda p: p["l"] > 0)
        total = lambda f: F.aggregate(used, F.lit(0.0), lambda s, p: s + f(p))  # noqa: E731,B023
        n = F.size(used)
        sx, sy = total(lambda p: p["x"]), total(lambda p: F.log10(p["l"]))
        sxx, sxy = total(lambda p: p["x"] * p["x"]), total(lambda p: p["x"] * F.log10(p["l"]))
        out = out.withColumn(name, F.when(n >= 2, guarded_divide(n * sxy - sx * sy, n * sxx - sx * sx) - 2))
    return out


def dust_extinction(column: Column, config: PhotometryConfig, from_metals: bool) -> Column:
    """V-band extinction of a column. A column of metals instead of dust is lowered by the dust-to-metal ratio of Li et al.
    (2019) at its metallicity and redshift, where that lies below the Milky Way's."""
    a_v = column * config.av_per_column
    if not from_metals:
        return a_v
    slope, start = -0.104 * config.redshift + 0.97, -0.059 * config.redshift + 0.005
    ratio = F.pow(F.lit(10.0), slope * F.log10(column / Z_SUN_ASPLUND) + start)
    return F.when((column > 0) & (ratio < MW_DUST_TO_METAL), a_v * ratio / MW_DUST_TO_METAL).otherwise(a_v)


def _turned(points: DataFrame, frame: DataFrame, galaxy: str, box: float, view: str, velocities: bool) -> DataFrame:
    """``points`` with places about their galaxy's centre (cx, cy, cz), turned by its angular momentum (lx, ly, lz)."""
    matrix = rotation_to((F.col("lx"), F.col("ly"), F.col("lz")), view)
    near = points.join(frame, galaxy)
    places = rotate(matrix, *[unwrap(F.col(c), F.col(f"c{c}"), box) - F.col(f"c{c}") for c in "xyz"])
    moved = dict(zip("xyz", places))
    if velocities:
        moved |= dict(zip(("vx", "vy", "vz"), rotate(matrix, *[F.col(f"v{c}") for c in "xyz"])))
    return near.withColumns(moved).drop("cx", "cy", "cz", "lx", "ly", "lz")


def run_photometry(stars: DataFrame, gas: DataFrame, galaxies: DataFrame, galaxy: str, models: StellarModels, config: PhotometryConfig, box: float) -> DataFrame:
    """Dust columns, spectra and magnitudes of every galaxy that has stars.

    ``stars`` (galaxy, pidx, places, log_age, log_z, mass, and v_los or velocities), ``gas`` (galaxy, places, h, mass, metallicity and,
    where the snapshot has it, dust_mass), ``galaxies`` (galaxy, log_ssfr, log_z and, for an orientation, the centre
    cx, cy, cz and angular momentum lx, ly, lz). With ``use_dust`` the snapshot's dust masses make the columns; without
    them, or with ``use_dust`` off, metals do, at a dust-to-metal ratio. Stars without gas in front have no extinction.
    """
    from_metals = not (config.use_dust and "dust_mass" in gas.columns)
    if not from_metals:
        gas = gas.drop("mass", "metallicity").withColumns({"mass": F.col("dust_mass"), "metallicity": F.lit(1.0)})
    axis, edge = config.axis.lower(), box
    if config.orientation is not None:
        frame = galaxies.select(galaxy, "cx", "cy", "cz", "lx", "ly", "lz")
        stars = _turned(stars, frame, galaxy, box, config.orientation, "vz" in stars.columns)
        gas = _turned(gas, frame, galaxy, box, config.orientation, False)
        axis, edge = "z", None
    if "v_los" not in stars.columns and f"v{axis}" in stars.columns:
        stars = stars.withColumn("v_los", F.col(f"v{axis}"))
    table = kernel_table(config.kernel_bins, config.kernel)
    seen = metal_columns(stars, gas, (galaxy,), list(table), edge, axis)
    stars = stars.join(seen.withColumn("a_v", dust_extinction(F.col("column"), config, from_metals)).select(galaxy, "pidx", "a_v"), [galaxy, "pidx"])
    stars = stars.join(galaxies.select(galaxy, "log_ssfr", F.col("log_z").alias("galaxy_log_z")), galaxy)
    light = cut(spectra(stars, galaxy, models, law=config.dust_law, alpha=config.alpha), "spectra")
    return magnitudes(light, models, config)


def galaxy_quantities(galaxies: DataFrame, floor: float = 1e-30) -> DataFrame:
    """log10 of the specific star formation rate per Gyr and of the metallicity, weighted by star formation, in solar units; floored."""
    ssfr = F.coalesce(guarded_divide(F.col("sfr"), F.col("mass_star")), F.lit(0.0)) * 1e9
    metals = F.coalesce("metallicity_gas_sfr_weighted", F.lit(0.0)) / Z_SUN_ASPLUND
    return galaxies.withColumns({"log_ssfr": F.log10(F.when(ssfr > 0, ssfr).otherwise(floor)), "log_z": F.log10(F.when(metals > 0, metals).otherwise(floor))})


def star_quantities(stars: DataFrame) -> DataFrame:
    """``stars`` with log_age (years, at least one) and log_z from age (Gyr) and metallicity; both null where not positive metals."""
    return stars.withColumns({"log_age": F.log10(F.greatest(F.col("age"), F.lit(1e-9))) + 9, "log_z": F.when(F.col("metallicity") > 0, F.log10("metallicity"))})
