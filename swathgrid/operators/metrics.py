"""Scores of an image against a reference, each over the cells of both, in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE_DB = -3.0


def pair(image: DataFrame, reference: DataFrame, value: str, keys: tuple[str, ...] = ("cell_row", "cell_col")) -> DataFrame:
    """(keys, x, r) over all cells of either; what is missing is NULL."""
    a = image.select(*keys, F.col(value).alias("x"))
    b = reference.select(*keys, F.col(value).alias("r"))
    return a.join(b, list(keys), "full")


def _db(v: str, top: str) -> Column:
    return F.when(F.col(v) > 0, 10 * F.log10(F.col(v) / F.col(top)))


def scores(cells: DataFrame) -> DataFrame:
    """One row with all scores of cells (x, r). ValueError-like NULLs where a score has no cells.

    Scores without a mask of their own (relative_global_error, total_relative_absolute_error) leave out cells
    with x = 0, where they aren't defined.
    """
    both = F.col("x").isNotNull() & F.col("r").isNotNull()
    d = F.when(both, F.col("x") - F.col("r"))
    x, r = F.when(both, F.col("x")), F.when(both, F.col("r"))
    ratio = F.when(both & (F.col("x") != 0), (F.col("x") - F.col("r")) / F.col("x"))
    percent = F.when(both & (F.col("r") != 0), F.abs((F.col("x") - F.col("r")) / F.col("r")) * 100)
    tops = cells.where(both).agg(F.max("x").alias("_tx"), F.max("r").alias("_tr"))
    met = cells.join(F.broadcast(tops))  # one row
    loud_x, loud_r = _db("x", "_tx") >= EDGE_DB, _db("r", "_tr") >= EDGE_DB
    return met.agg(
        F.try_divide(F.sqrt(F.sum(d * d)), F.sqrt(F.sum(r * r))).alias("normalised_difference"),
        F.sqrt(F.avg(d * d)).alias("rmse"), F.stddev_pop(d).alias("standard_deviation_error"), F.corr(x, r).alias("correlation"),
        F.sqrt(F.sum(ratio * ratio)).alias("relative_global_error"), F.sum(F.abs(ratio)).alias("total_relative_absolute_error"),
        F.avg(F.abs(d)).alias("mae"), F.avg(percent).alias("mape"), (F.max(x) - F.max(r)).alias("peak_error"),
        F.sqrt(F.try_divide(F.count(F.when(both & loud_x, 1)), F.count(F.when(both & loud_r, 1)))).alias("improvement_factor"),
        F.avg(F.when(both & loud_r, d)).alias("average_peak_error"),
        F.try_divide(F.count(F.when(both, 1)), F.count(F.when(F.col("r").isNotNull(), 1))).alias("valid_pixel_overlap"),
    )


def gradient_sum(image: DataFrame, value: str) -> DataFrame:
    """(gradient): the sum of 3 x 3 Sobel magnitudes over the cells whose neighbours all have values.

    Each cell is listed under its nine neighbours and one aggregation gathers them: no self-join.
    """
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("_k")
    near = image.where(F.col(value).isNotNull()).select("cell_row", "cell_col", F.col(value).alias("_v"), steps)
    near = near.select((F.col("cell_row") - F.col("_k.i")).alias("_r"), (F.col("cell_col") - F.col("_k.j")).alias("_c"), "_v", F.col("_k.i").alias("_i"), F.col("_k.j").alias("_j"))
    across = F.sum(F.col("_v") * F.col("_j") * (2 - F.abs("_i"))).alias("_gx")
    down = F.sum(F.col("_v") * F.col("_i") * (2 - F.abs("_j"))).alias("_gy")
    got = near.groupBy("_r", "_c").agg(across, down, F.count("*").alias("_n")).where(F.col("_n") == 9)
    return got.agg(F.sum(F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2)).alias("gradient"))


def sharpening_factor(image: DataFrame, reference: DataFrame, value: str) -> DataFrame:
    a, b = gradient_sum(image, value), gradient_sum(reference, value).withColumnRenamed("gradient", "other")
    return a.join(F.broadcast(b)).select(F.try_divide("gradient", "other").alias("sharpening_factor"))
