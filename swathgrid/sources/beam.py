"""Antenna beams from `.grd` text files: lattice rows, recentring, and gains on a (theta, phi) lattice.

Files come through Spark's text reader, one row a file; a beam's points then are plain rows and everything
after parsing is DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..functions.patterns import Tabulated

POINTS = "set int, i int, j int, u double, v double, xcen double, ycen double, du double, dv double, nx int, ny int, xs double, ys double, co_re double, co_im double, cross_re double, cross_im double"
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def name_parts(path: Column) -> dict[str, Column]:
    """Band, horn and half-space of a file name such as `S-12345-E-FR` or `F1-12345-E-BK`."""
    stem = F.regexp_extract(path, r"([A-Za-z]+\d*-\d+-[A-Z]+-[A-Z]+)[^/]*$", 1)
    horn = F.regexp_extract(stem, r"^[A-Za-z]+(\d+)-", 1)
    return {
        "band": F.regexp_extract(stem, r"^([A-Za-z]+)", 1), "horn": F.when(horn == "", "1").otherwise(horn).cast("int"),
        "half_space": F.regexp_extract(stem, r"-([A-Z]+)$", 1),
    }


def parse(text: str) -> Iterator[tuple]:
    """The points of a file: POINTS. NotImplementedError for lattices other than (u, v)."""
    lines = iter(text.split("++++", 1)[1].lstrip("\r\n").splitlines())

    def numbers() -> list[float]:
        return [float(x) for x in _NUMBER.findall(next(lines))]

    numbers()  # KTYPE
    sets, _, _, kind = (int(x) for x in numbers()[:4])
    if kind != 1:
        raise NotImplementedError("only beams on a (u, v) lattice can be read")
    centres = [numbers()[:2] for _ in range(sets)]
    for n in range(sets):
        xs, ys, xe, ye = numbers()[:4]
        nx, ny, limited = (int(x) for x in numbers()[:3])
        dx, dy = (xe - xs) / (nx - 1), (ye - ys) / (ny - 1)
        xcen, ycen = dx * centres[n][0], dy * centres[n][1]
        for j in range(ny):
            first, count = (int(x) for x in numbers()[:2]) if limited else (1, nx)
            for i in range(first - 1, first - 1 + count):
                f = numbers()
                yield (n, i, j, xcen + xs + dx * i, ycen + ys + dy * j, xcen, ycen, dx, dy, nx, ny, xs, ys, f[2], f[3], f[0], f[1])


def read_beams(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(band, horn, half_space, POINTS) of all files under path. Points that a file leaves out have gain 0."""
    texts = spark.read.text(path, wholetext=True).withColumn("_path", F.input_file_name())
    return beam_points(texts)


def beam_points(texts: DataFrame) -> DataFrame:
    """The same from rows (value, _path)."""
    parts = name_parts(F.col("_path"))
    named = texts.select("value", *(parts[k].alias(k) for k in ("band", "horn", "half_space")))
    names = [p.split()[0] for p in POINTS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for band, horn, half, value in zip(frame["band"], frame["horn"], frame["half_space"], frame["value"], strict=True):
                out = pd.DataFrame(parse(value), columns=names)
                out.insert(0, "band", band)
                out.insert(1, "horn", horn)
                out.insert(2, "half_space", half)
                yield out

    return named.mapInPandas(run, f"band string, horn int, half_space string, {POINTS}")


BEAM = ("band", "horn", "half_space", "set")


def recentre(points: DataFrame) -> DataFrame:
    """u and v shifted so that the largest co-polar gain lies at the beam's centre.

    The place of the largest gain comes from one aggregation for each beam; ties go to the smaller (j, i).
    """
    size = F.col("co_re") ** 2 + F.col("co_im") ** 2
    top = points.groupBy(*BEAM).agg(F.max(F.struct(size.alias("g"), (-F.col("j")).alias("j"), (-F.col("i")).alias("i"), "u", "v", "xcen", "ycen")).alias("_top"))
    top = top.select(*BEAM, (F.col("_top.u") - F.col("_top.xcen")).alias("_du"), (F.col("_top.v") - F.col("_top.ycen")).alias("_dv"))
    met = points.join(top, list(BEAM))
    return met.withColumns({"u": F.col("u") - F.col("_du"), "v": F.col("v") - F.col("_dv")}).drop("_du", "_dv")


def to_polar(points: DataFrame, max_theta: float = 90.0, res_theta: float = 0.1, res_phi: float = 0.1) -> DataFrame:
    """(band, horn, half_space, set, i_theta, i_phi, theta, phi, co_re, co_im, cross_re, cross_im) on a regular lattice in degrees.

    The source is a regular (u, v) lattice, so a place is read from the four points around it by an equi-join
    on the lattice numbers. Places outside the lattice get 0.
    """
    n_theta, n_phi = int(max_theta / res_theta) + 1, int(360 / res_phi) + 1
    spark = points.sparkSession
    lattice = spark.range(n_theta * n_phi).select((F.col("id") % n_theta).cast("int").alias("i_theta"), F.expr(f"int(id div {n_theta})").alias("i_phi"))
    lattice = lattice.withColumns({"theta": F.col("i_theta") * (max_theta / (n_theta - 1)), "phi": F.col("i_phi") * (360.0 / (n_phi - 1))})
    u, v = geo.polar_to_uv(F.radians("theta"), F.radians("phi"))
    first = points.groupBy(*BEAM).agg(F.min(F.col("u") - F.col("i") * F.col("du")).alias("_u0"), F.min(F.col("v") - F.col("j") * F.col("dv")).alias("_v0"), F.first("du").alias("_du"), F.first("dv").alias("_dv"))
    # one row a beam: a beam's lattice is made once, where the beam's few numbers are broadcast
    at = lattice.withColumns({"_u": u, "_v": v}).join(F.broadcast(first)).withColumns({"_x": (F.col("_u") - F.col("_u0")) / F.col("_du"), "_y": (F.col("_v") - F.col("_v0")) / F.col("_dv")})
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))).alias("_k")
    at = at.select(*BEAM, "i_theta", "i_phi", "theta", "phi", "_x", "_y", corner)
    dx, dy = F.col("_x") - F.floor("_x"), F.col("_y") - F.floor("_y")
    w = F.when(F.col("_k.a") == 1, dx).otherwise(1 - dx) * F.when(F.col("_k.b") == 1, dy).otherwise(1 - dy)
    at = at.select(*BEAM, "i_theta", "i_phi", "theta", "phi", (F.floor("_x") + F.col("_k.a")).cast("int").alias("i"), (F.floor("_y") + F.col("_k.b")).cast("int").alias("j"), w.alias("_w"))
    gains = ("co_re", "co_im", "cross_re", "cross_im")
    met = at.join(points.select(*BEAM, "i", "j", *gains), [*BEAM, "i", "j"], "left")
    return met.groupBy(*BEAM, "i_theta", "i_phi", "theta", "phi").agg(*(F.sum(F.coalesce(F.col(g), F.lit(0.0)) * F.col("_w")).alias(g) for g in gains))


def pattern_table(polar: DataFrame) -> DataFrame:
    """The eight gain columns of the pattern file; the vertical ones are copies of the horizontal ones."""
    pairs = {"co_re": 1, "co_im": 2, "cross_re": 3, "cross_im": 4}
    return polar.select("band", "horn", "i_theta", "i_phi", "theta", "phi", *(F.col(c).alias(f"g{k}{p}") for p in "hv" for c, k in pairs.items()))


def share_of_total(points: DataFrame) -> DataFrame:
    """|co| of each point as a share of its beam's sum."""
    size = F.sqrt(F.col("co_re") ** 2 + F.col("co_im") ** 2)
    return points.withColumn("share", size / F.sum(size).over(Window.partitionBy(*BEAM)))


MANIFEST = "_finished"


def _files(spark: SparkSession, path: str, settings: str) -> DataFrame:
    """(path, length, modificationTime, settings) of the files under path, their content unread."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime", F.lit(settings).alias("settings"))


def preprocess(spark: SparkSession, path: str, out: str, max_theta: float = 90.0, res_theta: float = 0.1, res_phi: float = 0.1, centred: bool = True, back: bool = False) -> list[str]:
    """Files under path to Parquet patterns under out, by band and horn; the paths that were worked on. Backward half-spaces only if asked for.

    A second run does what is new or changed only: finished files stand in a manifest beside the patterns, with size, time
    and settings. The patterns of a horn are replaced whole, and noted when they are written, so a run that broke off is
    taken up again. ValueError if a horn has two files for one half-space.
    """
    files = _files(spark, path, f"{max_theta} {res_theta} {res_phi} {centred} {back}")
    parts = name_parts(F.col("path"))
    named = files.select("*", *(parts[k].alias(k) for k in ("band", "horn", "half_space")))
    named = named if back else named.where(F.col("half_space") == "FR")
    if twice := named.groupBy("band", "horn", "half_space").count().where("count > 1").first():
        raise ValueError(f"band {twice.band} has {twice['count']} files for horn {twice.horn}, half-space {twice.half_space}")
    try:
        finished = spark.read.parquet(f"{out}/{MANIFEST}")
        left = named.join(finished, ["path", "length", "modificationTime", "settings"], "left_anti")
    except AnalysisException:  # the first run
        left = named
    # beams are counted in tens: their names may go to the driver
    todo = [r[0] for r in named.join(left.select("band", "horn").distinct(), ["band", "horn"], "left_semi").select("path").collect()]
    if todo:
        points = read_beams(spark, todo)
        polar = to_polar(recentre(points) if centred else points, max_theta, res_theta, res_phi)
        pattern_table(polar).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("band", "horn").parquet(out)
        files.where(F.col("path").isin(todo)).write.mode("append").parquet(f"{out}/{MANIFEST}")
    return sorted(todo)


#: Lattice points of a band's patterns that go to the driver and from there into the tasks.
MOST = 4_000_000


def load_patterns(spark: SparkSession, path: str, band: str, threshold: float | None = None, max_theta: float | None = None) -> dict[int, Tabulated]:
    """The patterns of a band's horns that preprocess() wrote.

    Only the part of the lattice that the threshold leaves goes to the driver (sums and maxima are made by Spark), and
    not more than MOST points of it: ValueError says so.
    """
    rows = spark.read.parquet(path).where(F.col("band") == band)
    size = lambda p: F.sqrt(sum(F.col(f"g{k}{p}") ** 2 for k in range(1, 5)))
    norm = 0.5 * (size("h") + size("v"))
    whole = rows.groupBy("horn").agg(F.sum(norm).alias("_total"), F.max(norm).alias("_most"))
    held = rows.join(F.broadcast(whole), "horn")  # a row for each horn
    kept = held.where(norm >= (threshold or 0.0) * F.col("_most"))
    widest = kept.groupBy("horn").agg(F.max("i_theta").alias("_last"))
    near = held.join(F.broadcast(widest), "horn").where((F.col("i_theta") <= F.col("_last") + 1) & (F.lit(max_theta is None) | (F.col("theta") <= F.lit(max_theta or 0.0) + 1.0)))
    if (n := near.count()) > MOST:
        raise ValueError(f"{n} lattice points of band {band} are too many: raise source_antenna_threshold, or write the patterns on a coarser lattice")
    out = {}
    for horn, own in near.toPandas().groupby("horn"):
        own = own.sort_values(["i_phi", "i_theta"])
        n_phi, n_theta = own["i_phi"].nunique(), own["i_theta"].nunique()
        tables = {f"G{k}{p}": own[f"g{k}{p}"].to_numpy().reshape(n_phi, n_theta) for k in range(1, 5) for p in "hv"}
        phi, theta = np.radians(np.sort(own["phi"].unique())), np.radians(np.sort(own["theta"].unique()))
        out[int(horn)] = Tabulated.of(phi, theta, tables, threshold, max_theta, float(own["_total"].iloc[0]), float(own["_most"].iloc[0]))
    return out
