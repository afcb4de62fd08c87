"""A run's settings: one frozen dataclass, from keywords or XML, checked once on the driver."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from .catalog import ALGORITHMS, BANDS, COLUMNS, FAMILIES, GRIDS, NEDT, VARIABLES

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
ANTENNA = ("gaussian", "instrument", "gaussian_projected")


@dataclass(frozen=True)
class Config:
    """Lengths in metres (search_radius in XML is in kilometres). See check() for what is allowed."""

    type: str = "CIMR"
    path: str = ""
    antenna_patterns_path: str = ""
    source_band: tuple[str, ...] = ("L",)
    target_band: tuple[str, ...] = ("L",)
    quality_control: bool = False
    split_fore_aft: bool = True
    grid_type: str = "L1C"
    grid_definition: str = "EASE2_G9km"
    projection_definition: str = "G"
    reduced_grid_inds: tuple[int, int, int, int] | None = None
    regridding_algorithm: str = "IDS"
    search_radius: float | None = None
    max_neighbours: int = 1000
    exact_distance: float | None = 1e-6  # IDS: samples so near stand for themselves; None: inverse squares alone, NaN right at a target
    variables_to_regrid: tuple[str, ...] = ()
    source_antenna_method: str = "gaussian"
    target_antenna_method: str = "gaussian"
    source_antenna_threshold: float = 0.001
    target_antenna_threshold: float = 9.0
    max_theta_antenna_patterns: float | None = None
    polarisation_method: str = "scalar"
    boresight_shift: bool = False
    source_gaussian_params: tuple[float, float] = (20000.0, 20000.0)
    target_gaussian_params: tuple[float, float] = (20000.0, 20000.0)
    rsir_iteration: int = 15
    max_iterations: int = 1000
    relative_tolerance: float = 1e-5
    regularisation_parameter: float = 1e-4
    MRF_grid_definition: str = "EASE2_G9km"
    MRF_projection_definition: str = ""  # that of the grid
    bg_smoothing: float = 0.0
    antenna_pattern_uncertainty: float = 0.0
    nedt: dict[str, float] = field(default_factory=lambda: dict(NEDT))
    max_chunk_size: int = 32
    chunk_buffer: float = 1.3
    save_to_disk: bool = True
    output_path: str = ""
    creator_email: str = ""
    creator_name: str = ""
    creator_institution: str = ""
    version: str = ""
    suffix: str = ""

    def __post_init__(self) -> None:
        for name, value in {
            "type": self.type.upper(), "grid_type": self.grid_type.upper(), "regridding_algorithm": self.regridding_algorithm.upper(),
        }.items():
            object.__setattr__(self, name, value)
        if self.type == "AMSR2":
            object.__setattr__(self, "split_fore_aft", False)
        if self.type != "SMAP":
            object.__setattr__(self, "quality_control", False)
            object.__setattr__(self, "boresight_shift", False)
        if self.regridding_algorithm == "NN":
            object.__setattr__(self, "max_neighbours", 1)
        if self.search_radius is None and self.grid_type == "L1R":
            object.__setattr__(self, "search_radius", 31000.0 if self.type == "AMSR2" else 36500.0)
        if not self.MRF_projection_definition and self.MRF_grid_definition in GRIDS:
            object.__setattr__(self, "MRF_projection_definition", GRIDS[self.MRF_grid_definition].projection)
        if not self.variables_to_regrid:
            object.__setattr__(self, "variables_to_regrid", VARIABLES.get(self.type, ()))
        self.check()

    def check(self) -> None:
        """ValueError with what is wrong."""

        def must(good: bool, what: str) -> None:
            if not good:
                raise ValueError(what)

        def one_of(name: str, allowed) -> None:
            must(getattr(self, name) in allowed, f"{name} must be one of {', '.join(map(str, allowed))}, not {getattr(self, name)}")

        one_of("type", tuple(COLUMNS))
        one_of("grid_type", ("L1C",) if self.type == "SMAP" else ("L1C", "L1R"))
        one_of("regridding_algorithm", ALGORITHMS)
        one_of("grid_definition", tuple(GRIDS))
        one_of("projection_definition", FAMILIES[GRIDS[self.grid_definition].family])
        one_of("MRF_grid_definition", tuple(GRIDS))
        own = GRIDS[self.MRF_grid_definition].projection
        must(self.MRF_projection_definition == own, f"the integration grid {self.MRF_grid_definition} is laid out in {own}: MRF_projection_definition must be that")
        one_of("source_antenna_method", ANTENNA)
        one_of("target_antenna_method", ANTENNA)
        one_of("polarisation_method", ("scalar", "mueller"))
        # what has no effect in a run is refused, not passed over
        must(self.polarisation_method == "scalar", "patterns are weighed by their scalar gain: polarisation_method must be scalar")
        must(self.source_antenna_method != "gaussian_projected" and self.target_antenna_method != "gaussian_projected", "patterns that are Gaussian in director cosines can't be used in a run")
        must(not self.boresight_shift, "boresights are not shifted: boresight_shift must be false")
        bands = BANDS[self.type]
        for name in ("source_band", "target_band"):
            must(bool(getattr(self, name)) and all(b in bands for b in getattr(self, name)), f"{name} must be of {', '.join(bands)}")
        if self.grid_type == "L1C":
            must(self.source_band == self.target_band, "L1C needs the same source and target bands")
        else:
            must(len(self.target_band) == 1, "L1R takes one target band a run")
            must(not set(self.source_band) & set(self.target_band), "L1R needs source bands that aren't target bands")
        must(self.search_radius is None or self.search_radius >= 0, "search_radius must not be negative")
        must(self.max_neighbours >= 1, "max_neighbours must be positive")
        for name in ("rsir_iteration", "max_iterations"):
            must(getattr(self, name) >= 0, f"{name} must not be negative")
        must(self.relative_tolerance >= 0, "relative_tolerance must not be negative")
        must(self.max_chunk_size > 0 and self.chunk_buffer >= 0, "max_chunk_size must be positive and chunk_buffer not negative")
        must(all(x >= 0 for x in self.nedt.values()), "noise must not be negative")
        r = self.reduced_grid_inds
        must(r is None or (len(r) == 4 and min(r) >= 0 and r[0] <= r[1] and r[2] <= r[3]), "reduced_grid_inds must be row and column bounds, first not above last")
        for name in ("source_gaussian_params", "target_gaussian_params"):
            must(len(getattr(self, name)) == 2, f"{name} must be two numbers")
        must(not self.creator_email or bool(_EMAIL.fullmatch(self.creator_email)), "creator_email isn't a mail address")
        must(all(v in VARIABLES[self.type] for v in self.variables_to_regrid), f"variables_to_regrid must be of {', '.join(VARIABLES[self.type])}")

    @property
    def rows(self) -> tuple[int, int] | None:
        return self.reduced_grid_inds and self.reduced_grid_inds[:2]

    @property
    def cols(self) -> tuple[int, int] | None:
        return self.reduced_grid_inds and self.reduced_grid_inds[2:]

    def with_overrides(self, **values) -> Config:
        return replace(self, **values)


def as_bool(text: str, name: str) -> bool:
    low = text.strip().lower()
    if low not in ("true", "false", "1", "0", "yes", "no"):
        raise ValueError(f"{name} must be true or false, not {text}")
    return low in ("true", "1", "yes")


_SECTIONS = ("InputData", "GridParams", "ReGridderParams", "OutputData")


def from_xml(text: str, **overrides) -> Config:
    """Settings of an XML document; overrides win. Empty elements keep the defaults."""
    root = ET.fromstring(text)
    known = {f.name: f for f in fields(Config)}
    values: dict = {}
    nedt = dict(NEDT)
    for section in _SECTIONS:
        for element in root.find(section) if root.find(section) is not None else ():
            name, value = element.tag, (element.text or "").strip()
            if not value or not isinstance(name, str):
                continue
            if m := re.fullmatch(r"cimr_(\w+)_nedt", name):
                nedt[m[1]] = float(value)
            elif name == "search_radius":
                values[name] = float(value) * 1000
            elif name in ("source_band", "target_band", "variables_to_regrid"):
                values[name] = tuple(value.split())
            elif name == "reduced_grid_inds":
                values[name] = tuple(int(x) for x in value.split())
            elif name.endswith("_gaussian_params"):
                values[name] = tuple(float(x) for x in value.split())
            elif name in known:
                kind = str(known[name].type).split(" |")[0]
                values[name] = as_bool(value, name) if kind == "bool" else {"int": int, "float": float}.get(kind, str)(value)
    kind = values.get("type", "CIMR").upper()
    for name in ("source_band", "target_band"):
        if tuple(x.lower() for x in values.get(name, ())) == ("all",):
            values[name] = BANDS[kind]
    return Config(**values | {"nedt": nedt} | overrides)


def read_xml(path: str, **overrides) -> Config:
    return from_xml(Path(path).expanduser().read_text(encoding="utf-8"), **overrides)


def parse_job_order(text: str) -> dict[str, str | None]:
    """Paths that a job order names: config, l1b, antenna, output, version. ValueError if one of the first four is missing."""
    root = ET.fromstring(text)
    get = lambda e, at: (e.findtext(at) or "").strip() or None
    inputs = {get(e, "File_Type"): get(e, "List_of_File_Names/File_Name") for e in root.iterfind("List_of_Ipf_Procs/Ipf_Proc/List_of_Inputs/Input")}
    outputs = [get(e, "File_Name") for e in root.iterfind("List_of_Ipf_Procs/Ipf_Proc/List_of_Outputs/Output") if get(e, "File_Type") in ("OUT_L1C", "OUT_L1R")]
    out = {"config": inputs.get("CFG_RGB_"), "l1b": inputs.get("L1B_"), "antenna": inputs.get("AntennaPattern"), "output": next(filter(None, outputs), None)}
    if missing := [k for k, v in out.items() if v is None]:
        raise ValueError(f"the job order lacks {', '.join(missing)}")
    return out | {"version": get(root, "Ipf_Conf/Version")}


def job_config(job_order: str, config_xml: str) -> Config:
    """The config of a job order: its paths go over those of the XML."""
    job = parse_job_order(job_order)
    return from_xml(config_xml, path=job["l1b"], antenna_patterns_path=job["antenna"], output_path=job["output"])
