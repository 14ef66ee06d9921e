"""Run configuration: one frozen record, from Python or from a YAML file with nested sections."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from astroloom.functions.dust import LAWS, MIXES
from astroloom.functions.physics import GAS_CRITERIA
from astroloom.sources.formats import FORMATS
from astroloom.sources.halo_sources import SOURCES

STAGES = ("find_galaxies", "properties_core", "properties_ptype_specific", "properties_local_environment", "photometry")
_ALLOWED = {
    "simulation_type": tuple(FORMATS), "halo_id_source": SOURCES, "halo_centre": ("MIN_POT", "COM"), "gas_criterion": GAS_CRITERIA,
    "extinction_law": (*LAWS, *MIXES), "viewing_axis": ("X", "Y", "Z"), "kernel_type": ("CUBIC", "QUINTIC"),
}
_POSITIVE = ("min_stars_per_galaxy", "min_dm_per_halo", "nH_lim", "T_lim", "FRAD", "MU", "b", "velocity_factor", "halo_b", "interpolation_bins")
#: Sources of halo ids that a simulation type cannot have.
_IMPOSSIBLE = {("TNG", "SNAPSHOT")}


@dataclass(frozen=True)
class RunConfig:
    snapshot_path: str
    output_dir: str
    simulation_type: str
    halo_id_source: str
    stages: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(STAGES, True))
    process_ptypes: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(("gas", "star", "dm", "bh"), True))
    min_stars_per_galaxy: int = 16
    min_gas_per_galaxy: int = 0
    min_dm_per_halo: int = 24
    nH_lim: float = 0.13
    T_lim: float = 1e5
    FRAD: float = 0.1
    MU: float = 0.6
    radial_quantiles: dict[str, float] = field(default_factory=lambda: {"r20": 0.2, "half_mass": 0.5, "r80": 0.8})
    aperture_size: tuple[int, ...] = (30,)
    virial_factors: tuple[int, ...] = (200, 500, 2500)
    halo_centre: str = "MIN_POT"
    distribute_halo_hydrogen: bool = False
    b: float = 0.02
    velocity_factor: float = 1.0
    subhalo_override: bool = False
    gas_criterion: str = "COLD_OR_STARFORMING"
    halo_b: float = 0.2
    halo_attach_ptypes: tuple[str, ...] | None = None
    write_halo_ids: bool = False
    min_dm_per_halo_to_store: int | None = None
    bands: tuple[str, ...] = ("all",)
    extinction_law: str = "COMPOSITE"
    viewing_axis: str = "Z"
    use_dust: bool = True
    use_cosmic_extinction: bool = True
    interpolation_bins: int = 5000
    kernel_type: str = "CUBIC"
    power_law_alpha: float = 1.0
    split_age: float = 0.01
    compress_catalogue: bool = True
    halo_catalogue_path: str | None = None
    photometry_table_path: str | None = None

    def __post_init__(self):
        for name, allowed in _ALLOWED.items():
            value = str(getattr(self, name)).upper()
            object.__setattr__(self, name, value)
            if value not in allowed:
                raise ValueError(f"{name}: {value!r} is none of {allowed}")
        for name in _POSITIVE:
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if (self.simulation_type, self.halo_id_source) in _IMPOSSIBLE:
            raise ValueError(f"{self.simulation_type} has no {self.halo_id_source} halo ids")
        if unknown := set(self.stages) - set(STAGES):
            raise ValueError(f"unknown stages {sorted(unknown)}")
        attach = self.halo_attach_ptypes
        if attach is not None and set(attach) - {"gas", "star", "bh"}:
            raise ValueError("halo_attach_ptypes names types that are not baryonic")
        if self.write_halo_ids and self.halo_id_source not in ("FOF", "SNAP_OR_FOF"):
            raise ValueError("write_halo_ids needs the built-in halo finder")
        stored = self.min_dm_per_halo_to_store
        if stored is not None and not 0 <= stored <= self.min_dm_per_halo:
            raise ValueError("min_dm_per_halo_to_store must lie between 0 and min_dm_per_halo")
        for name in ("aperture_size", "virial_factors", "bands"):
            object.__setattr__(self, name, tuple(getattr(self, name)))

    @classmethod
    def from_mapping(cls, sections: dict) -> RunConfig:
        """From a mapping whose sections may be nested; a key that occurs twice or is unknown is an error."""
        known = {f.name: f for f in dataclasses.fields(cls)}
        flat: dict = {}

        def walk(node: dict) -> None:
            for key, value in node.items():
                if key in known:
                    if key in flat:
                        raise ValueError(f"{key} is given twice")
                    flat[key] = value
                elif isinstance(value, dict):
                    walk(value)
                else:
                    raise ValueError(f"unknown setting {key}")

        walk(sections)
        return cls(**flat)

    @classmethod
    def from_yaml(cls, path: str) -> RunConfig:
        import yaml

        with open(path) as file:
            return cls.from_mapping(yaml.safe_load(file))

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @classmethod
    def from_json(cls, text: str) -> RunConfig:
        return cls(**json.loads(text))
