"""From samples to product: targets, neighbours, one of seven reductions, counts and unused samples."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import GRIDS
from ..config import Config
from ..functions.patterns import THRESHOLD, footprint_radius, nadir_angle
from ..operators import inversion, neighbours, reconstruct, simple
from ..sources import beam, swath

NOT_AVERAGED = ("regridding_n_samples", "regridding_l1b_orphans")


@dataclass(frozen=True)
class Task:
    """What an algorithm gets: all tables of one run."""

    config: Config
    samples: DataFrame
    targets: DataFrame
    neighbours: DataFrame | None
    variables: list[str]
    noise: list[str]
    band: str = ""


def _simple(reduce: Callable) -> Callable[[Task], DataFrame]:
    def run(t: Task) -> DataFrame:
        keys = ["scan_direction", "target_id"]
        rows = neighbours.with_values(t.neighbours, t.samples, [*t.variables, *t.noise], ("scan_direction",))
        if reduce is simple.nn and t.config.max_neighbours == 1:  # the search has left one row for each target
            out = rows.select(*keys, *t.variables, *t.noise, F.lit(1).cast("long").alias("regridding_n_samples"))
        elif reduce is simple.ids:
            out = simple.ids(rows, keys, t.variables, t.noise, t.config.exact_distance, count=True)
        else:
            out = reduce(rows, keys, [*t.variables, *t.noise], count=True)
        return _placed(out, t)

    return run


def _placed(out: DataFrame, t: Task) -> DataFrame:
    """out with cell_row and cell_col: by arithmetic on a grid, else from the targets."""
    if t.config.grid_type == "L1C":
        n = GRIDS[t.config.grid_definition].n_cols
        return out.withColumns({"cell_row": F.expr(f"target_id div {n}"), "cell_col": F.col("target_id") % n})
    return out.join(t.targets.select("target_id", "cell_row", "cell_col"), "target_id")


#: Angle (degrees) between the antenna's axis and straight down, and a satellite's height (m), where nothing else is known.
TILT = {"CIMR": 46.886, "SMAP": 180 - 144.54}
HEIGHT = {"CIMR": 830000.0, "SMAP": 685000.0}


def _footprints(t: Task, target: float) -> reconstruct.Footprints:
    """Gaussian footprints, or an instrument's patterns from config.antenna_patterns_path projected to the ground.

    A target of another band (L1R) has that band's own footprint, a cell a Gaussian one of its size.
    """
    spark, c, band = t.samples.sparkSession, t.config, t.band
    attitude, target_attitude = (set(reconstruct.ATTITUDE) <= set(df.columns) for df in (t.samples, t.targets))
    source, own, aim, least = None, None, target, THRESHOLD
    if c.grid_type == "L1R":
        # a threshold over 1 can't be a share of the largest gain: it is in decibels below it
        aim, least = c.target_gaussian_params, c.target_antenna_threshold if c.target_antenna_threshold < 1 else 10 ** (-c.target_antenna_threshold / 10)

    def projected(of: str, threshold: float, attitude: bool) -> reconstruct.Projected:
        held = beam.load_patterns(spark, c.antenna_patterns_path, of, threshold, c.max_theta_antenna_patterns)
        tilt = math.radians(TILT[c.type])
        reach = max(footprint_radius(tilt, HEIGHT[c.type], p.widest()) for p in held.values())
        return reconstruct.Projected({k: p.scalar for k, p in held.items()}, tilt, reach, body_scan=c.type != "SMAP", attitude=attitude)

    if c.source_antenna_method == "instrument":
        source = projected(band, c.source_antenna_threshold, attitude)
    if c.grid_type == "L1R" and c.target_antenna_method == "instrument":
        own = projected(c.target_band[0], least, target_attitude)
    return reconstruct.Footprints(c.MRF_grid_definition, *c.source_gaussian_params, aim, threshold=c.source_antenna_threshold, target_threshold=least, turned=is_turned(c), target_turned=is_target_turned(c), source=source, aim=own)


def is_turned(c: Config) -> bool:
    """Whether the samples' footprints are ellipses, whose angle counts."""
    return c.source_antenna_method == "gaussian" and c.source_gaussian_params[0] != c.source_gaussian_params[1]


def is_target_turned(c: Config) -> bool:
    """Whether a target band's footprints are."""
    return c.grid_type == "L1R" and c.target_antenna_method == "gaussian" and c.target_gaussian_params[0] != c.target_gaussian_params[1]


def with_angle(df: DataFrame) -> DataFrame:
    """df with the angle by which each row's footprint is turned, from its nadir point."""
    if missing := {"sub_satellite_lon", "sub_satellite_lat"} - set(df.columns):
        raise ValueError(f"elliptical footprints are turned towards the nadir point: {', '.join(sorted(missing))} is missing")
    angle = nadir_angle(F.col("longitude"), F.col("latitude"), F.col("sub_satellite_lon"), F.col("sub_satellite_lat"))
    return df.withColumn(reconstruct.ANGLE, angle)


def with_attitude(df: DataFrame) -> DataFrame:
    """df with the nine elements of the satellite's frame as columns, where there is an array of them."""
    return df.withColumns({n: F.get("attitude", F.lit(i)) for i, n in enumerate(reconstruct.ATTITUDE)}) if "attitude" in df.columns else df


def _bg(t: Task) -> DataFrame:
    c = t.config
    f = _footprints(t, GRIDS[c.grid_definition].res)
    return reconstruct.backus_gilbert(t.neighbours, t.samples, t.targets, t.variables, f, c.bg_smoothing, t.noise, c.antenna_pattern_uncertainty, ("scan_direction",))


def _rsir(t: Task) -> DataFrame:
    """Brightness temperatures are reconstructed; all else, and the noise, follows inverse-square weights."""
    c = t.config
    f = _footprints(t, GRIDS[c.grid_definition].res / 10)
    main = [v for v in t.variables if v.startswith("bt_")]
    out = reconstruct.reconstruct_rsir(t.neighbours, t.samples, t.targets, main, f, c.rsir_iteration, ("scan_direction",))
    rest = [v for v in t.variables if v not in main]
    if rest or t.noise:
        rows = neighbours.with_values(t.neighbours, t.samples, [*rest, *t.noise], ("scan_direction",))
        more = simple.ids(rows, ["scan_direction", "target_id"], rest, t.noise)
        more = more.withColumns({n: F.sqrt(F.col(n) ** 2 + c.antenna_pattern_uncertainty**2) for n in t.noise})
        out = out.join(more, ["scan_direction", "target_id"])
    return out


def _inverted(method: str) -> Callable[[Task], DataFrame]:
    def run(t: Task) -> DataFrame:
        c = t.config
        if c.grid_type != "L1C":
            raise ValueError("inversion works on a grid")
        f = _footprints(t, GRIDS[c.grid_definition].res)
        same = c.MRF_grid_definition == c.grid_definition
        image = inversion.invert(t.samples, t.variables, f, method, c.max_chunk_size, c.chunk_buffer, c.regularisation_parameter, c.max_iterations, c.relative_tolerance, c.rows if same else None, c.cols if same else None, ("scan_direction",))
        if same:
            return image.withColumn("target_id", F.col("cell_row") * GRIDS[c.grid_definition].n_cols + F.col("cell_col"))
        return _placed(inversion.bilinear(image, t.targets, c.MRF_grid_definition, t.variables, ("scan_direction",)), t)

    return run


#: Algorithms by name; register() adds others.
REGISTRY: dict[str, Callable[[Task], DataFrame]] = {
    "NN": _simple(simple.nn), "DIB": _simple(simple.dib), "IDS": _simple(simple.ids), "BG": _bg, "RSIR": _rsir, "LW": _inverted("LW"), "CG": _inverted("CG"),
}


def register(name: str, run: Callable[[Task], DataFrame]) -> None:
    """Add an algorithm: Task -> (scan_direction, target_id, cell_row, cell_col, variables)."""
    REGISTRY[name] = run


def regrid(spark: SparkSession, samples: DataFrame, config: Config, targets: DataFrame | None = None) -> DataFrame:
    """The product in long form: (band, scan_direction, cell_row, cell_col, variables, regridding_n_samples).

    samples: canonical, clean, of the source bands. targets: for L1R, another band's positions; for L1C they
    are the grid's cells. Without a search radius a sample counts for the cell it falls into, and no search
    is made. Each band is searched by itself.
    """
    c = config
    wanted = [v for v in c.variables_to_regrid if v in samples.columns and v not in NOT_AVERAGED]
    noise = [v for v in wanted if v.startswith("nedt")]
    variables = [v for v in wanted if v not in noise]
    if "scan_direction" not in samples.columns:
        samples = samples.withColumn("scan_direction", F.lit("all"))
    if c.grid_type == "L1R" and targets is None:
        raise ValueError("L1R needs another band's positions as targets")
    if c.search_radius is None and c.grid_type == "L1C" and c.regridding_algorithm in ("NN", "DIB", "IDS"):
        return _without_search(samples, c, variables, noise)
    weighed = c.regridding_algorithm in ("BG", "RSIR")
    turned = is_turned(c) and c.regridding_algorithm in ("BG", "RSIR", "LW", "CG")
    if turned:
        samples = with_angle(samples)
    if weighed and is_target_turned(c):
        targets = with_angle(targets)
    instrument = c.source_antenna_method == "instrument" and c.regridding_algorithm in ("BG", "RSIR", "LW", "CG")
    if instrument:
        samples = with_attitude(samples)
    if targets is not None and weighed and c.target_antenna_method == "instrument":
        targets = with_attitude(targets)
    geometry = [*reconstruct.GEOMETRY, *(x for x in reconstruct.ATTITUDE if x in samples.columns)] if weighed and instrument else []
    out = None
    for band in c.source_band:
        own = samples.where(F.col("band") == band) if "band" in samples.columns else samples
        aims = targets if targets is not None else neighbours.grid_targets(spark, c.grid_definition, c.projection_definition, c.rows, c.cols)
        near = None
        if c.regridding_algorithm not in ("LW", "CG"):
            # what the algorithm needs of a sample goes along with the search
            carried = dict.fromkeys([*variables, *noise, *(("longitude", "latitude") if weighed else ()), *((reconstruct.ANGLE,) if weighed and turned else ()), *geometry])
            near = neighbours.nearest_any(own, aims, c.search_radius, c.max_neighbours, ("scan_direction",), tuple(carried))
        got = REGISTRY[c.regridding_algorithm](Task(c, own, aims, near, variables, noise, band))
        got = got.withColumn("band", F.lit(band))
        out = got if out is None else out.unionByName(got)
    return out


def _without_search(samples: DataFrame, c: Config, variables: list[str], noise: list[str]) -> DataFrame:
    placed = neighbours.assign_cells(samples, c.grid_definition, c.projection_definition)
    if c.rows:
        placed = placed.where(F.col("cell_row").between(*c.rows) & F.col("cell_col").between(*c.cols))
    keys = [k for k in ("band", "scan_direction", "cell_row", "cell_col") if k in placed.columns]
    reduce = {"NN": simple.nn, "DIB": simple.dib}.get(c.regridding_algorithm)
    if reduce:
        return reduce(placed, keys, [*variables, *noise], count=True)
    return simple.ids(placed, keys, variables, noise, c.exact_distance, count=True)


def unused(spark: SparkSession, samples: DataFrame, config: Config, targets: DataFrame | None = None) -> DataFrame:
    """samples with used: 1 if a target took the sample. Without a radius a cell takes what falls into it, for NN the nearest.

    Each band is searched by itself. Inversions use every sample.
    """
    if config.regridding_algorithm in ("LW", "CG"):
        return samples.withColumn("used", F.lit(1))
    if config.search_radius is None and targets is None:
        cells = neighbours.assign_cells(samples, config.grid_definition, config.projection_definition).where("cell_row is not null and cell_col is not null")
        if config.rows:
            cells = cells.where(F.col("cell_row").between(*config.rows) & F.col("cell_col").between(*config.cols))
        keys = [k for k in ("band", "scan_direction") if k in samples.columns]
        if config.regridding_algorithm == "NN":
            cells = simple.nn(cells.withColumn("_sample", F.col("sample_id")), [*keys, "cell_row", "cell_col"], ["_sample"]).select(*keys, F.col("_sample").alias("sample_id"))
        return neighbours.used_samples(samples, cells, tuple(keys))
    aims = targets if targets is not None else neighbours.grid_targets(spark, config.grid_definition, config.projection_definition, config.rows, config.cols)
    out = None
    for band in config.source_band:
        own = samples.where(F.col("band") == band) if "band" in samples.columns else samples
        near = neighbours.nearest_any(own, aims, config.search_radius, config.max_neighbours, ("scan_direction",))
        used = neighbours.used_samples(own, near, ("scan_direction",))
        if "band" not in samples.columns:
            return used
        out = used if out is None else out.unionByName(used)
    return out


def orphan_flags(spark: SparkSession, samples: DataFrame, config: Config, targets: DataFrame | None = None) -> DataFrame:
    """(band, scan_direction, scan_number, sample_number, feed_horn_number, regridding_l1b_orphans): 1 for each sample that a run used, else 0."""
    place = [c for c in ("band", "scan_direction", "scan_number", "sample_number", "feed_horn_number") if c in samples.columns]
    return unused(spark, samples, config, targets).select(*place, F.col("used").alias("regridding_l1b_orphans"))


def as_samples(product: DataFrame, variables: list[str], keep: bool = False) -> DataFrame:
    """An L1R product as samples of a new run (L1R to L1C): new ids, rows without a position or value dropped."""
    more = [c for c in ("regridding_n_samples",) if keep and c in product.columns]
    rows = product.select(
        F.xxhash64("band", "scan_direction", "cell_row", "cell_col").alias("sample_id"), "band", "scan_direction", F.col("cell_row").alias("scan_number"), F.col("cell_col").alias("sample_number"), *variables, *more
    )
    return swath.listwise(rows, ["longitude", "latitude", *variables])
