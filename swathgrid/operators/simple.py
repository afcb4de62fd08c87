"""Reductions of a target's neighbours that are plain aggregates: NN, DIB, IDS, their noise and counts.

Each takes rows (keys, sample_id, distance, variables) and reduces all variables in one aggregation, with
the number of samples in the same pass if `count` asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(count: bool) -> list[Column]:
    return [F.count("*").alias("regridding_n_samples")] if count else []


def nn(rows: DataFrame, keys: list[str], variables: list[str], count: bool = False) -> DataFrame:
    """The nearest sample's values; equal distances (to the millimetre) go by sample_id."""
    by = F.struct(F.round("distance", 3), "sample_id")
    return rows.groupBy(*keys).agg(*(F.min_by(v, by).alias(v) for v in variables), *_counted(count))


def dib(rows: DataFrame, keys: list[str], variables: list[str], count: bool = False) -> DataFrame:
    """The mean of the samples in the bucket."""
    return rows.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in variables), *_counted(count))


def _weighted(v: str, near: Column) -> Column:
    """Inverse squares of the distance; samples right at the target (near) stand for themselves alone."""
    w = F.when(~near & F.col(v).isNotNull(), 1 / (F.col("distance") * F.col("distance")))
    exact = F.avg(F.when(near, F.col(v)))
    return F.coalesce(exact, F.try_divide(F.sum(F.col(v) * w), F.sum(w)))


def ids(rows: DataFrame, keys: list[str], variables: list[str], noise: list[str] = (), exact: float | None = 1e-6, count: bool = False) -> DataFrame:
    """Inverse-distance-squared means. noise: columns that follow the weights' squares instead.

    Samples within `exact` metres of the target would weigh infinitely much: then their mean is the value. With None
    they do weigh so, as in the published formula, and the value is NaN.
    """
    if exact is None:
        d = F.col("distance") * F.col("distance")
        weight = F.when(d == 0, float("inf")).otherwise(F.try_divide(F.lit(1.0), d))
        held = {v: F.when(F.col(v).isNotNull(), weight) for v in (*variables, *noise)}
        out = [F.try_divide(F.sum(F.col(v) * held[v]), F.sum(held[v])).alias(v) for v in variables]
        out += [F.try_divide(F.sum(held[n] * held[n] * F.col(n)), F.sum(held[n]) * F.sum(held[n])).alias(n) for n in noise]
        return rows.groupBy(*keys).agg(*out, *_counted(count))
    near = F.col("distance") <= exact
    w = F.when(near, 1.0).otherwise(1 / F.greatest(F.col("distance") * F.col("distance"), F.lit(exact * exact)))
    hit = F.max(near.cast("int"))
    out = [_weighted(v, near).alias(v) for v in variables]
    for n in noise:
        told = F.col(n).isNotNull()
        one, two = F.sum(F.when(told & ~near, w)), F.sum(F.when(told & ~near, w * w * F.col(n)))
        own, hits = F.sum(F.when(near, F.col(n))), F.sum((near & told).cast("int"))
        out.append(F.when(hit == 1, F.try_divide(own, hits * hits)).otherwise(F.try_divide(two, one * one)).alias(n))
    return rows.groupBy(*keys).agg(*out, *_counted(count))


def n_samples(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("regridding_n_samples"))


def pivot_directions(product: DataFrame, keys: list[str], variables: list[str], directions: tuple[str, ...] = ("fore", "aft")) -> DataFrame:
    """One row for each target, variables with the direction as their suffix."""
    picked = [F.max(F.when(F.col("scan_direction") == d, F.col(v))).alias(f"{v}_{d}") for d in directions for v in variables]
    return product.groupBy(*keys).agg(*picked)


def unpivot_directions(wide: DataFrame, keys: list[str], variables: list[str], directions: tuple[str, ...] = ("fore", "aft")) -> DataFrame:
    """The long form again: a row for each direction that has a value."""
    parts = [wide.select(*keys, F.lit(d).alias("scan_direction"), *(F.col(f"{v}_{d}").alias(v) for v in variables)) for d in directions]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropna("all", subset=variables)


def scatter(product: DataFrame, cells: DataFrame) -> DataFrame:
    """Values on the full grid; cells without a value are NULL."""
    return cells.join(product, ["cell_row", "cell_col"], "left")
