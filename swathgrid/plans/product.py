"""The product on disk: Parquet by band, with a JSON sidecar of the attributes that describe it."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import GRIDS, HORNS
from ..config import Config
from ..sources import beam
from .watch import Watch, missing

#: What each variable is, by the product's four groups. {way} and {band} are filled in.
ATTRIBUTES = {
    "Measurement": {
        "bt_h": ("{band} band {way} H-polarised brightness temperatures", "K"), "bt_v": ("{band} band {way} V-polarised brightness temperatures", "K"),
        "bt_3": ("{band} band {way} third Stokes parameter", "K"), "bt_4": ("{band} band {way} fourth Stokes parameter", "K"),
        "nedt_h": ("noise of {way} H-polarised brightness temperatures", "K"), "nedt_v": ("noise of {way} V-polarised brightness temperatures", "K"),
        "nedt_3": ("noise of the {way} third Stokes parameter", "K"), "nedt_4": ("noise of the {way} fourth Stokes parameter", "K"),
        "regridding_n_samples": ("number of samples used for a cell, {way} scan", "1"), "regridding_l1b_orphans": ("samples used by any cell, {way} scan", "1"),
    },
    "Navigation": {
        "longitude": ("longitude of the {way} samples", "degrees_east"), "latitude": ("latitude of the {way} samples", "degrees_north"),
        "processing_scan_angle": ("scan angle of the {way} scan", "degree"), "azimuth": ("azimuth of the {way} scan", "degree"), "oza": ("observation zenith angle of the {way} scan", "degree"),
        "acq_time_utc": ("time of the {way} scan", "seconds since 1970-01-01T00:00:00Z"), "altitude": ("altitude of the satellite", "m"),
    },
    "Processing_flags": {"processing_flag": ("processing flags", "1")},
    "Quality_information": {"instrument_status": ("status of the instrument", "1")},
}

#: netCDF type letters of Spark's types.
TYPE_CODES = {"tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8", "string": "str", "boolean": "i1", "timestamp": "f8"}


def variable_attributes(name: str, band: str, res_km: str) -> dict[str, str] | None:
    """Attributes of a variable, whose name may end in _fore or _aft; None for unknown ones."""
    m = re.fullmatch(r"(.+?)(?:_(fore|aft))?", name)
    way = m[2] or "entire"
    for group, held in ATTRIBUTES.items():
        if m[1] in held:
            text, units = held[m[1]]
            return {"group": group, "long_name": text.format(way=way, band=band), "units": units, "grid_spacing": f"{res_km} km"}
    return None


def resolution_km(grid: str) -> str:
    return re.search(r"([\d.]+)km$", grid)[1]


def file_name(config: Config, now: datetime | None = None) -> str:
    """<type>_<grid or target band>_<algorithm>[_<res>km]_<suffix or time>."""
    place = config.projection_definition if config.grid_type == "L1C" else "_".join(config.target_band)
    parts = [config.grid_type, place, config.regridding_algorithm]
    if config.grid_type == "L1C":
        parts.append(f"{resolution_km(config.grid_definition)}km")
    parts.append(config.suffix or (now or datetime.now(UTC)).strftime("%Y-%m-%d_%H-%M-%S"))
    return f"{config.type}_{'_'.join(parts)}"


def covered(counts: dict) -> dict:
    """Times, box and sizes that a product covers, from what a run counted of it (see described_by)."""
    told = {k: v for k, v in counts.items() if v is not None}
    out = {name: told[k] for name, k in (("geospatial_lon_min", "lon_min"), ("geospatial_lon_max", "lon_max"), ("geospatial_lat_min", "lat_min"), ("geospatial_lat_max", "lat_max")) if k in told}
    if "time_min" in told:
        start, end = (datetime.fromtimestamp(told[k], UTC) for k in ("time_min", "time_max"))
        out |= {"time_coverage_start": start.isoformat(), "time_coverage_end": end.isoformat(), "time_coverage_duration": f"PT{(end - start).total_seconds():.3f}S"}
    return out


def described_by(product: DataFrame) -> list[Column]:
    """The aggregates that covered() and the sizes of dimensions need, for the columns that are there."""
    there = set(product.columns)
    out = [F.max(c).alias(f"last_{c}") for c in ("cell_row", "cell_col") if c in there]
    for c, name in (("longitude", "lon"), ("latitude", "lat"), ("acq_time_utc", "time")):
        if c in there:
            value = F.col(c).cast("double")
            out += [F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max")]
    return out


def antenna_files(spark: SparkSession, config: Config) -> list[str]:
    """Names of the beam files that the patterns of the run's bands were made of, if it uses an instrument's patterns."""
    if "instrument" not in (config.source_antenna_method, config.target_antenna_method) or not config.antenna_patterns_path:
        return []
    try:
        made = spark.read.parquet(f"{config.antenna_patterns_path}/{beam.MANIFEST}")
    except AnalysisException:  # patterns that came without a manifest
        return []
    bands = [*config.source_band, *config.target_band]
    own = made.where(beam.name_parts(F.col("path"))["band"].isin(bands))
    return sorted(r[0] for r in own.select(F.element_at(F.split("path", "/"), -1)).distinct().collect())  # tens of files


def global_attributes(config: Config, product: DataFrame, now: datetime | None = None, counts: dict | None = None) -> dict:
    counts = counts or {}
    sizes = {"scan": counts.get("last_cell_row"), "sample": counts.get("last_cell_col")}
    g = GRIDS[config.grid_definition]
    return {
        "title": f"{config.type} {config.grid_type} product", "instrument": config.type, "processing_level": config.grid_type, "algorithm": config.regridding_algorithm,
        "grid": config.grid_definition, "projection": config.projection_definition, "epsg": g.epsg, "spatial_resolution": f"{resolution_km(config.grid_definition)} km",
        "input": config.path, "antenna_patterns": config.antenna_patterns_path, "creator_name": config.creator_name, "creator_email": config.creator_email,
        "creator_institution": config.creator_institution, "version": config.version, "date_created": (now or datetime.now(UTC)).isoformat(timespec="seconds"),
        "dimensions": {"y": g.n_rows, "x": g.n_cols} if config.grid_type == "L1C" else {k: None if v is None else v + 1 for k, v in sizes.items()} | {"feed": HORNS.get(config.target_band[0], 1)},
        **covered(counts),
        "variables": {
            f.name: (variable_attributes(f.name, " ".join(config.target_band), resolution_km(config.grid_definition)) or {}) | {"type": TYPE_CODES.get(f.dataType.simpleString(), "str")}
            for f in product.schema
        },
    }


def write_product(product: DataFrame, path: str, config: Config, mode: str = "errorifexists", orphans: DataFrame | None = None, watch: Watch | None = None) -> None:
    """product under path/data, partitioned by band, its attributes under path/attributes, and the samples' flags under path/orphans.

    watch: its counts, and the product's own rows and missing values, go to the attributes.
    """
    spark = product.sparkSession
    described = product.select(*(F.col(f.name).alias(f.name, metadata=variable_attributes(f.name, " ".join(config.target_band), resolution_km(config.grid_definition)) or {}) for f in product.schema))
    if watch:
        used = [F.sum("regridding_n_samples").alias("samples_used")] if "regridding_n_samples" in product.columns else []
        described = watch.values(described, "product", *missing(product), *used, *described_by(product))
    described.write.mode(mode).partitionBy("band").parquet(f"{path}/data")
    if orphans is not None:
        told = variable_attributes("regridding_l1b_orphans", " ".join(config.source_band), resolution_km(config.grid_definition))
        orphans.select(*(F.col(c).alias(c, metadata=told) if c == "regridding_l1b_orphans" else c for c in orphans.columns)).write.mode(mode).partitionBy("band").parquet(f"{path}/orphans")
    counts = watch.told() if watch else {}
    attributes = global_attributes(config, product, counts=counts.get("product")) | {"antenna_files": antenna_files(spark, config)} | ({"counts": counts} if watch else {})
    text = json.dumps(attributes, indent=1)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode(mode).text(f"{path}/attributes", lineSep="\n\n")


def read_product(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    text = "\n".join(r[0] for r in spark.read.text(f"{path}/attributes", wholetext=True).collect())
    return spark.read.parquet(f"{path}/data"), json.loads(text)


def append_scores(scores: DataFrame, path: str, **settings) -> None:
    """Add rows of scores with the settings they belong to; new settings and scores widen the table."""
    scores.withColumns({k: F.lit(v) for k, v in settings.items()}).write.mode("append").option("mergeSchema", "true").parquet(path)


def extent(product: DataFrame) -> DataFrame:
    """(lon_min, lon_max, lat_min, lat_max, wkt): the box of all positions, NULLs skipped."""
    a = product.agg(*(f(c).alias(f"{c[:3]}_{n}") for c in ("longitude", "latitude") for n, f in (("min", F.min), ("max", F.max))))
    corners = [("lon_min", "lat_min"), ("lon_max", "lat_min"), ("lon_max", "lat_max"), ("lon_min", "lat_max"), ("lon_min", "lat_min")]

    def number(c: str) -> Column:
        return F.format_string("%.2f", F.col(c))

    points = F.concat_ws(", ", *(F.concat_ws(" ", number(x), number(y)) for x, y in corners))
    return a.select("lon_min", "lon_max", "lat_min", "lat_max", F.concat(F.lit("POLYGON (("), points, F.lit("))")).alias("wkt"))


def row_bounds(product: DataFrame, value: str = "longitude") -> DataFrame:
    """(cell_row, first_col, first, last_col, last): the outermost values of each row."""
    known = product.where(F.col(value).isNotNull())
    return known.groupBy("cell_row").agg(
        F.min("cell_col").alias("first_col"), F.min_by(value, "cell_col").alias("first"), F.max("cell_col").alias("last_col"), F.max_by(value, "cell_col").alias("last")
    )

