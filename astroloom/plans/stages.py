"""Stages with what they need and give: column templates, dependencies and their order."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

PTYPES = ("gas", "star", "dm", "bh")


@dataclass(frozen=True)
class Output:
    """A family of output columns: ``{key}`` places are filled from lists by name."""

    template: str
    unit: str = ""
    a_exponent: int = 0
    description: str = ""
    groups: tuple[str, ...] = ("haloes", "galaxies")


@dataclass(frozen=True)
class Stage:
    name: str
    needs: tuple[str, ...] = ()
    required: dict[str, tuple[str, ...]] | None = None
    optional: dict[str, tuple[str, ...]] | None = None
    outputs: tuple[Output, ...] = ()


H, G = ("haloes",), ("galaxies",)
CORE = ("pos", "vel", "mass")
STAGES = {
    s.name: s
    for s in (
        Stage("find_galaxies", (), {"gas": (*CORE, "rho", "metallicity", "helium_fraction", "temperature", "sfr"), "star": CORE, "bh": CORE}),
        Stage("properties_core", (), {p: (*CORE, "potential") for p in PTYPES}, None, (
            Output("n_{ptype}"), Output("mass_{kind}", "Msun"), Output("com_pos_{combined}", "kpc", 1), Output("com_vel_{combined}", "km/s"),
            Output("minpot_pos", "kpc", 1, "", H), Output("minpot_vel", "km/s", 0, "", H), Output("L_{kind}", "Msun kpc km/s", 1), Output("L_azimuth_{kind}", "rad"),
            Output("L_elevation_{kind}", "rad"), Output("velocity_dispersion_{kind}", "km/s"), Output("inertia_tensor_{kind}", "Msun kpc^2", 2),
            Output("radius_{quantile}_{kind}", "kpc", 1), Output("radius_max_{kind}", "kpc", 1), Output("BoverT_{baryonic}", "", 0, "", G), Output("kappa_rot_{baryonic}", "", 0, "", G),
            Output("r{factor}c", "kpc", 1, "", H), Output("m{factor}c", "Msun", 0, "", H), Output("vmax", "km/s", 0, "", H), Output("rmax", "kpc", 1, "", H), Output("r200m", "kpc", 1, "", H),
            Output("velocity_circular", "km/s", 0, "", H), Output("spin_param", "", 0, "", H), Output("temperature_virial", "K", 0, "", H),
        )),
        Stage("properties_ptype_specific", ("properties_core",), {"gas": ("mass", "sfr", "metallicity", "temperature", "rho"), "star": ("mass", "metallicity", "age"), "bh": ("bhmass", "bhmdot")}, {"gas": ("mass_HI", "mass_H2", "helium_fraction")}, (
            Output("mass_HI", "Msun"), Output("mass_H2", "Msun"), Output("sfr", "Msun/yr"), Output("metallicity_gas_{gasweight}_weighted"), Output("temperature_gas_mass_weighted", "K"), Output("mass_gas_{phase}", "Msun"),
            Output("mass_cgm", "Msun", 0, "", H), Output("metallicity_gas_{metalweight}_weighted_cgm", "", 0, "", H), Output("temperature_gas_{tempweight}_weighted_cgm", "K", 0, "", H),
            Output("metallicity_star_mass_weighted"), Output("age_star_{tempweight}_weighted", "Gyr"), Output("smbh_mass", "Msun"), Output("smbh_mdot", "Msun/yr"), Output("smbh_fedd"),
        )),
        Stage("properties_local_environment", ("find_galaxies", "properties_core"), {p: ("pos", "mass") for p in PTYPES}, {"gas": ("mass_HI", "mass_H2")}, (
            Output("mass_{apertured}_{aperture}kpc", "Msun", 0, "", G), Output("mass_HI_diffuse", "Msun", 0, "", G), Output("mass_H2_diffuse", "Msun", 0, "", G),
        )),
        Stage("photometry", ("find_galaxies", "properties_core", "properties_ptype_specific"), {"star": (*CORE, "metallicity", "age"), "gas": ("pos", "mass", "metallicity", "smoothing_length")}, {"gas": ("dust_mass",)}, (
            Output("mag_{frame}_{band}", "mag", 0, "", G), Output("mag_{frame}_nodust_{band}", "mag", 0, "", G), Output("luminosity_fir", "erg/s", 0, "", G), Output("beta", "", 0, "", G), Output("beta_nodust", "", 0, "", G),
        )),
    )
}


def fill_lists(quantiles=("r20", "half_mass", "r80"), factors=(200, 500, 2500), apertures=(30,), bands=()) -> dict[str, tuple]:
    return {
        "ptype": PTYPES, "kind": (*PTYPES, "baryon", "total"), "combined": ("total", "baryon"), "baryonic": ("gas", "star", "bh", "baryon"), "quantile": tuple(quantiles), "factor": tuple(factors),
        "gasweight": ("mass", "sfr"), "phase": ("cold", "hot"), "metalweight": ("mass", "temperature"), "tempweight": ("mass", "metal"), "apertured": (*PTYPES, "HI", "H2", "total"),
        "aperture": tuple(apertures), "frame": ("abs", "app"), "band": tuple(bands),
    }


def expand(output: Output, lists: dict[str, tuple]) -> list[str]:
    """All column names of a template; a place without a list is an error."""
    keys = re.findall(r"\{(\w+)\}", output.template)
    if missing := [k for k in keys if k not in lists]:
        raise KeyError(f"{output.template}: nothing fills {missing}")
    return [output.template.format(**dict(zip(keys, values))) for values in itertools.product(*(lists[k] for k in keys))]


def declared_columns(lists: dict[str, tuple]) -> dict[str, tuple[str, Output]]:
    """Column to (stage, output); two outputs that give one column are an error."""
    out: dict[str, tuple[str, Output]] = {}
    for stage in STAGES.values():
        for output in stage.outputs:
            for column in expand(output, lists):
                if column in out:
                    raise ValueError(f"{column} is declared twice")
                out[column] = (stage.name, output)
    return out


def resolve(wanted: list[str]) -> list[Stage]:
    """The wanted stages and all that they need, in an order that runs each after its needs; ties by name."""
    todo, seen = list(wanted), set()
    while todo:
        name = todo.pop()
        if name not in STAGES:
            raise KeyError(f"unknown stage {name}")
        if name not in seen:
            seen.add(name)
            todo += STAGES[name].needs
    order: list[Stage] = []
    waiting = {n: {d for d in STAGES[n].needs} for n in seen}
    while waiting:
        ready = sorted(n for n, d in waiting.items() if not d)
        if not ready:
            raise ValueError(f"stages depend on each other: {sorted(waiting)}")
        order.append(STAGES[ready[0]])
        del waiting[ready[0]]
        for needs in waiting.values():
            needs.discard(ready[0])
    return order


def columns_for(stages: list[Stage], available: dict[str, set[str]]) -> dict[str, list[str]]:
    """Per particle type the columns that the stages read: required ones must be there, optional ones if they are."""
    out: dict[str, list[str]] = {}
    for stage in stages:
        for ptype, names in (stage.required or {}).items():
            if ptype not in available:
                continue
            if lacking := [n for n in names if n not in available[ptype]]:
                raise KeyError(f"{stage.name} needs {lacking} of {ptype}")
            out.setdefault(ptype, [])
            out[ptype] += [n for n in (*names, *[o for o in (stage.optional or {}).get(ptype, ()) if o in available[ptype]]) if n not in out[ptype]]
    return out


def runnable(wanted: list[str], available: dict[str, set[str]]) -> list[Stage]:
    """The resolved stages without those whose required columns are absent, and without those that depend on such."""
    kept: list[Stage] = []
    for stage in resolve(wanted):
        whole = all(n in available.get(p, set()) for p, names in (stage.required or {}).items() if p in available for n in names)
        if whole and all(any(k.name == d for k in kept) for d in stage.needs):
            kept.append(stage)
    return kept
