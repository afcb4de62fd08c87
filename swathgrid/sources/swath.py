"""From instruments' files to the canonical samples table: one row for each sample, typed and clean.

Files are read as Parquet in their own column names. Missing values become NULL once, here, so that
aggregates skip them; nothing later sees NaN.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import AFT, BANDS, COLUMNS, FILL, GRIDS, HORNS, NEDT, PARTS, POSITION, QUALITY_FLAGS, VECTORS, Grid
from ..functions import geo

KEYS = ("sample_id", "scan_number", "sample_number", "feed_horn_number", "band", "scan_direction")


def read_l1b(spark: SparkSession, path: str, instrument: str, columns: list[str] | None = None) -> DataFrame:
    """A granule's Parquet files with canonical column names; only what is asked for is read."""
    if instrument not in COLUMNS:
        raise ValueError(f"instrument {instrument} isn't one of {', '.join(COLUMNS)}")
    df = spark.read.parquet(path)
    df = df.withColumnsRenamed({k: v for k, v in COLUMNS[instrument].items() if k in df.columns})
    wanted = {*(columns or df.columns), *(part for c in columns or () for part in PARTS.get(c, ()))}
    return df.select(*(c for c in df.columns if c in wanted)) if columns else df


def numeric(df: DataFrame, skip: tuple[str, ...] = KEYS) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in skip]


def fill_to_null(df: DataFrame, fill: float = FILL) -> DataFrame:
    """The fill value and NaN become NULL in every floating column."""
    return df.withColumns({c: F.when(~F.isnan(c) & (F.col(c) != fill), F.col(c)) for c in numeric(df)})


def listwise(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN in any of the columns; arrays need all their elements."""
    arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and (columns is None or f.name in columns)]
    plain = [c for c in columns or df.columns if c not in arrays]
    out = df.dropna("any", subset=plain) if plain else df
    for a in arrays:
        out = out.where(F.col(a).isNotNull() & ~F.exists(a, lambda x: x.isNull() | F.isnan(x)))
    return out


def quality_filter(df: DataFrame, flags: tuple[str, ...] = QUALITY_FLAGS) -> DataFrame:
    """Rows whose flags are all 0; the flags go. A flag that is missing counts as 0."""
    there = [f for f in flags if f in df.columns]
    for f in there:
        df = df.where(F.coalesce(F.col(f), F.lit(0)) == 0)
    return df.drop(*there)


def in_bounds(df: DataFrame, grid: str | Grid, projection: str) -> DataFrame:
    """Rows whose latitude and projected y lie on the grid."""
    g = GRIDS[grid] if isinstance(grid, str) else grid
    lat = F.col("latitude")
    south = projection.endswith("S")
    if projection in ("G", "MERC_G"):
        keep = lat.between(g.lat_min, g.lat_max)
    elif south:
        keep = lat <= (g.lat_min if g.lat_min <= 0 else -g.lat_min)
    else:
        keep = lat >= g.lat_min
    _, y = geo.lonlat_to_xy(projection, F.col("longitude"), lat)
    return df.where(keep & lat.between(-90, 90)).where(y.between(g.y_max - g.n_rows * g.res, g.y_max))


def scan_direction(angle: Column, instrument: str) -> Column:
    low, high = AFT[instrument]
    return F.when(angle.between(low, high), "aft").otherwise("fore")


def split_fore_aft(df: DataFrame, instrument: str, angle: str = "processing_scan_angle") -> DataFrame:
    """scan_direction: aft if the angle lies in the instrument's range, else fore. Instruments without one: all."""
    way = scan_direction(F.col(angle), instrument) if instrument in AFT else F.lit("all")
    return df.withColumn("scan_direction", way)


def trim_overlap(df: DataFrame, overlap: int, scans: int, scan: str = "scan_number") -> DataFrame:
    """Without the first and last `overlap` scans. ValueError for a negative overlap or one that leaves nothing."""
    if overlap < 0 or 2 * overlap > scans:
        raise ValueError("the overlap must be from 0 to half the scans")
    return df.where((F.col(scan) >= overlap) & (F.col(scan) < scans - overlap))


def per_scan(samples: DataFrame, scans: DataFrame, scan: str = "scan_number") -> DataFrame:
    """Values given once for each scan, on all its samples."""
    return samples.join(scans, scan, "left")


def twice(df: DataFrame, sample: str = "sample_number") -> DataFrame:
    """Each sample of a low-frequency band on the two samples of a high-frequency band that it covers."""
    return df.withColumn(sample, F.explode(F.array(F.col(sample) * 2, F.col(sample) * 2 + 1)))


def explode_feeds(df: DataFrame, arrays: list[str], feeds: int) -> DataFrame:
    """One row for each feed horn: array columns give their element, other columns repeat."""
    horn = F.explode(F.sequence(F.lit(0), F.lit(feeds - 1)))
    out = df.withColumn("feed_horn_number", horn)
    return out.withColumns({a: F.get(a, F.col("feed_horn_number")) for a in arrays})


def components(df: DataFrame, array: str, names: list[str]) -> DataFrame:
    """An array column as columns of their own."""
    return df.withColumns({n: F.get(array, F.lit(k)) for k, n in enumerate(names)}).drop(array)


def scaled(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) * f for c, f in factors.items()})


def with_nedt(df: DataFrame, values: dict[str, float] | None = None, names: tuple[str, ...] = ("nedt_h", "nedt_v")) -> DataFrame:
    """Constant noise by band, for files without it."""
    pairs = [F.lit(x) for kv in (values or NEDT).items() for x in kv]
    held = F.create_map(*pairs)
    return df.withColumns({n: F.element_at(held, F.col("band")) for n in names})


def with_processing_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("processing_flag", F.lit(0).cast("short"))


def altitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z) - geo.R_ALTITUDE


def max_altitude(df: DataFrame) -> DataFrame:
    return df.agg(F.max(altitude(F.col("x_position"), F.col("y_position"), F.col("z_position"))).alias("max_altitude"))


# ---- times: all become seconds since 1970 in UTC


def tai93_to_posix(seconds: Column, leap: int = 37) -> Column:
    """Seconds of atomic time since 1993-01-01; 725 846 400 s lie between that and 1970."""
    return seconds + (725846400.0 - leap)


def iso_to_posix(text: Column) -> Column:
    return F.unix_micros(F.to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))) / 1e6


def days_to_posix(days: Column, seconds: Column, micros: Column) -> Column:
    """Days, seconds and microseconds since 2000-01-01; 946 684 800 s lie between that and 1970."""
    return days * 86400.0 + seconds + micros / 1e6 + 946684800.0


# ---- low-frequency positions from pairs of high-frequency ones


def coregistration(text: Column) -> Column:
    """The numbers of a parameter line such as "10G-0.12345,18G--0.0098": a doubled sign is a minus, a single one only divides."""
    found = F.regexp_extract_all(text, F.lit(r"(--\d+\.\d+|-\d+\.\d+|\d+\.\d+)"), F.lit(1))
    return F.transform(found, lambda x: F.when(x.startswith("--"), -F.substring(x, 3, 40).cast("double")).otherwise(F.regexp_replace(x, "^.", "").cast("double")))


def low_frequency(df: DataFrame, a: float, b: float, scan: str = "scan_number", sample: str = "sample_number") -> DataFrame:
    """(scan, sample, longitude, latitude): the point beside each pair (2s, 2s + 1) of high-frequency samples.

    The pair spans a frame: along it the point lies `a` of the pair's angle on, across it `b` of the angle
    off. Pairs with a position out of range give the fill value.
    """
    # the pair's two rows meet in an aggregation by (scan, pair), which is combined before the shuffle
    pair = F.floor(F.col(sample) / 2).cast("int")
    own = lambda c, k: F.max(F.when(F.col(sample) % 2 == k, F.col(c))).alias(f"_{c}{k}")
    rows = df.groupBy(F.col(scan), pair.alias("_pair")).agg(*(own(c, k) for c in ("longitude", "latitude") for k in (0, 1)))
    rows = rows.where(F.col("_longitude0").isNotNull() & F.col("_longitude1").isNotNull())
    p, q = (geo.to_sphere(F.col(f"_longitude{k}"), F.col(f"_latitude{k}"), radius=1.0) for k in (0, 1))
    theta = F.acos(F.least(F.greatest(p[0] * q[0] + p[1] * q[1] + p[2] * q[2], F.lit(-1.0)), F.lit(1.0)))
    rows = rows.withColumn("_theta", theta)
    ez = [F.try_divide(c, F.sin("_theta")) for c in geo.cross(p, q)]
    ey = geo.cross(ez, p)
    along, across = F.col("_theta") * a, F.col("_theta") * b
    at = [F.cos(across) * (F.cos(along) * p[i] + F.sin(along) * ey[i]) + F.sin(across) * ez[i] for i in range(3)]
    good = F.lit(True)
    for k in (0, 1):
        good = good & F.col(f"_longitude{k}").between(-180, 180) & F.col(f"_latitude{k}").between(-90, 90)
    lon, lat = F.degrees(F.atan2(at[1], at[0])), F.degrees(F.atan2(at[2], F.sqrt(at[0] * at[0] + at[1] * at[1])))
    return rows.select(scan, F.col("_pair").alias(sample), F.when(good, lon).otherwise(FILL).alias("longitude"), F.when(good, lat).otherwise(FILL).alias("latitude"))


# ---- whole chains


def unfold(df: DataFrame, band: str) -> DataFrame:
    """Raw rows of one scan and sample as samples: vectors to columns, a row for each feed horn, times to seconds, ids.

    Arrays beside the vectors and the attitude (nine numbers, kept) hold a value for each feed. Columns that aren't there
    are left out; what is canonical already stays.
    """
    vectors = [c for c in VECTORS if c in df.columns]
    for c in vectors:
        df = components(df, c, [n for n in VECTORS[c] if n not in df.columns])
    feeds = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and f.name != "attitude"]
    if feeds:
        df = explode_feeds(df, feeds, HORNS.get(band, 1))
    elif "feed_horn_number" not in df.columns:
        df = df.withColumn("feed_horn_number", F.lit(0))
    if "acq_time_utc" not in df.columns and {"days", "seconds", "microseconds"} <= set(df.columns):
        df = df.withColumn("acq_time_utc", days_to_posix(F.col("days"), F.col("seconds"), F.col("microseconds"))).drop("days", "seconds", "microseconds")
    if "acq_time_utc" not in df.columns and "scan_time" in df.columns:
        df = df.withColumn("acq_time_utc", tai93_to_posix(F.col("scan_time"))).drop("scan_time")
    if "altitude" not in df.columns and set(POSITION) <= set(df.columns):
        df = df.withColumn("altitude", altitude(*(F.col(c) for c in POSITION)))
    if "sample_id" not in df.columns and {"scan_number", "sample_number"} <= set(df.columns):
        # scan, 16 bits for the sample, 4 for the feed: distinct in a granule, whatever its size
        scan, sample = F.col("scan_number").cast("long"), F.col("sample_number").cast("long")
        df = df.withColumn("sample_id", F.shiftleft(scan, 20) + F.shiftleft(sample, 4) + F.col("feed_horn_number").cast("long"))
    return df


def amsr2(raw: DataFrame, scans: DataFrame, positions: DataFrame, band: str, overlap: int, scan_count: int, coregistration_a: str, coregistration_b: str, scale: float = 0.01) -> DataFrame:
    """A low- or high-frequency band of a granule as samples, before normalise(): overlap, positions, values of each scan.

    raw: (scan_number, sample_number, bt_h, bt_v) as stored, to be scaled. scans: what is given once a scan (scan_time,
    navigation, azimuths). positions: (scan_number, sample_number, longitude, latitude) of the high-frequency band; a lower one has
    half as many samples, each beside a pair of these as the granule's two parameter lines say.
    """
    if band not in BANDS["AMSR2"]:
        raise ValueError(f"band {band} isn't one of {', '.join(BANDS['AMSR2'])}")
    raw, scans, positions = (trim_overlap(x, overlap, scan_count) for x in (raw, scans, positions))
    if not band.startswith("89"):
        k = BANDS["AMSR2"].index(band)
        lines = raw.sparkSession.range(1).select(*(F.get(coregistration(F.lit(x)), F.lit(k)).alias(n) for n, x in (("a", coregistration_a), ("b", coregistration_b)))).first()
        if lines.a is None or lines.b is None:
            raise ValueError(f"the parameter lines have no number for band {band}")
        positions = low_frequency(positions, lines.a, lines.b)
    held = scaled(raw, {c: scale for c in ("bt_h", "bt_v") if c in raw.columns}).join(positions, ["scan_number", "sample_number"])
    return unfold(per_scan(held, scans), band)


def normalise(df: DataFrame, instrument: str, band: str, grid: str | None = None, projection: str | None = None, split: bool = True, quality: bool = True, nedt: dict[str, float] | None = None, needed: list[str] | None = None, watch: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """The whole chain: vectors, feeds, times and ids, fills, noise, quality, bounds (for a grid), direction, listwise deletion.

    df: a granule's rows with canonical names, one for each sample, or with arrays over the feeds; for AMSR2 from amsr2().

    needed: the columns in which a NULL drops the row; those that nobody asked for don't count. All, if not given.
    watch: is given the rows after each rule that drops some, such as Watch.values.
    """
    out = watch(fill_to_null(unfold(df, band).withColumn("band", F.lit(band))), f"{band} read")
    if quality and instrument == "SMAP":
        out = watch(quality_filter(out), f"{band} good")
    if instrument == "CIMR" and "nedt_h" not in out.columns:
        out = with_nedt(out, nedt)
    if instrument == "CIMR" and "processing_flag" not in out.columns:
        out = with_processing_flag(out)
    if grid:
        out = watch(in_bounds(out, grid, projection or GRIDS[grid].projection), f"{band} in bounds")
    out = split_fore_aft(out, instrument) if split else out.withColumn("scan_direction", F.lit("all"))
    return watch(listwise(out, None if needed is None else [c for c in out.columns if c in needed]), f"{band} samples")


# ---- a swath made from the events table, for queries and tests


def events_swath(events: DataFrame) -> DataFrame:
    """A deterministic swath: position, values and geometry by arithmetic on the event's numbers."""
    e, u = F.col("event_id"), F.col("user_id")
    return events.select(
        e.alias("sample_id"), F.expr("event_id div 50").alias("scan_number"), (e % 50).alias("sample_number"), (u % 4).alias("feed_horn_number"),
        (((e * 7919 + u * 104729) % 36000) / F.lit(100.0) - 180.0).alias("longitude"), (((e * 3571 + u * 37) % 17000) / F.lit(100.0) - 85.0).alias("latitude"),
        ((e * 17) % 360).cast("double").alias("processing_scan_angle"), (F.col("value") + 150.0).alias("bt_h"), ((F.col("value") + 150.0) * 1.1).alias("bt_v"),
        F.lit(0.3).alias("nedt_h"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("scan_quality_flag"), F.col("ts").alias("acq_time_utc"),
    ).withColumn("scan_direction", scan_direction(F.col("processing_scan_angle"), "SMAP"))
