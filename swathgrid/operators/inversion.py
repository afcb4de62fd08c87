"""Regularised linear inversion of whole regions: Landweber and conjugate gradients.

The image on the inversion grid is cut into square tiles. A tile's samples, with those of a rim around it
so wide as a footprint, give the rows of a matrix (footprints on the tile's cells and the rim's), held by the
entries that aren't zero and solved in a task by steps of A'(A x), without A'A; the rim's cells are dropped afterwards. The samples are dealt to the tiles by an
equi-join-free explode: each sample names the few tiles whose rim it lies in.

A tile's samples grow with the data, its cells don't. They are gathered as rows while these are smaller than A'A, and
beyond that as the normal equations A'A x = A'y, which add up. A tile of up to SHARE samples is solved in the task
that gathers it; a larger one is dealt to pieces by the samples' hash, which are put together FOLD at a time. So no task
holds more than some FOLD times (tile + 2 * rim) ** 4 numbers, and far less where samples are few.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import GRIDS, Grid
from ..functions import geo
from ..functions.geo import NUMPY
from ..functions.patterns import gaussian_radius, gaussian_raw, normalised
from .reconstruct import ANGLE, Footprints, needed_columns
from .sparse import STRETCH, Rows, square_of

#: Samples of a tile that are put into one matrix, and those that one task takes.
PIECE, SHARE = 4096, 2**18
#: Cells along a side of the blocks by which samples are put in order, so that neighbouring rows share their cells.
NEAR = 4
#: Shares of a tile's normal equations that are summed at once, and the rounds of sums: up to FOLD ** ROUNDS pieces.
FOLD, ROUNDS = 4, 4


def landweber(a: np.ndarray | Rows, y: np.ndarray, damping: float = 1e-4, step: float | None = None, iterations: int = 1000, tolerance: float = 1e-5) -> tuple[np.ndarray, int]:
    """Gradient steps on |Ax - y|^2 + damping |x|^2 until the relative residual is below tolerance; (x, steps taken)."""
    times, norm = square_of(a)
    return _gradient(times, a.T @ y, float((y * y).sum()), damping, step if step is not None else 1 / max(norm, 1e-300), iterations, tolerance)


def landweber_normal(square: np.ndarray, right: np.ndarray, size: float, damping: float = 1e-4, step: float | None = None, iterations: int = 1000, tolerance: float = 1e-5) -> tuple[np.ndarray, int]:
    """The same from A'A, A'y and y'y."""
    return _gradient(lambda x: square @ x, right, size, damping, step if step is not None else 1 / max(np.linalg.norm(square), 1e-300), iterations, tolerance)


def _gradient(times, right: np.ndarray, size: float, damping: float, step: float, iterations: int, tolerance: float) -> tuple[np.ndarray, int]:
    """|Ax - y|^2 is y'y - 2 x'A'y + x'A'Ax."""
    x = np.full(right.shape, 1e-20)
    for k in range(iterations):
        seen = times(x)
        if max(size - 2 * float((x * right).sum()) + float((x * seen).sum()), 0.0) < tolerance**2 * max(size, 1e-300):
            return x, k
        x = x + step * (right - seen - damping * x)
    return x, iterations


def conjugate_gradient(a: np.ndarray | Rows, y: np.ndarray, damping: float = 1e-4, iterations: int = 1000, tolerance: float = 1e-5) -> tuple[np.ndarray, int]:
    """(A'A + damping I) x = A'y by conjugate gradients; (x, steps taken)."""
    return _conjugate(lambda p: a.T @ (a @ p), a.T @ y, damping, iterations, tolerance)


def conjugate_normal(square: np.ndarray, right: np.ndarray, size: float, damping: float = 1e-4, iterations: int = 1000, tolerance: float = 1e-5) -> tuple[np.ndarray, int]:
    """The same from A'A and A'y."""
    return _conjugate(lambda p: square @ p, right, damping, iterations, tolerance)


def _conjugate(times, right: np.ndarray, damping: float, iterations: int, tolerance: float) -> tuple[np.ndarray, int]:
    x, r = np.zeros_like(right), right.copy()
    p, rr, size = r.copy(), float((r * r).sum()), max(np.linalg.norm(right), 1e-300)
    for k in range(iterations):
        if math.sqrt(rr) / size < tolerance:
            return x, k
        q = times(p) + damping * p
        alpha = rr / float((p * q).sum())
        x, r = x + alpha * p, r - alpha * q
        new = float((r * r).sum())
        p, rr = r + new / rr * p, new
    return x, iterations


#: By method: from a matrix, and from the normal equations.
METHODS = {"LW": (landweber, landweber_normal), "CG": (conjugate_gradient, conjugate_normal)}


def normal_equations(a: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """A'A over the rows without a missing value, what else each column of y (rows x variables) adds to it, A'y and y'y."""
    there = ~np.isnan(y)
    whole = there.all(1)
    held = np.where(there, y, 0.0)
    out = {"square": a[whole].T @ a[whole], "right": a.T @ held, "size": (held * held).sum(0)}
    for v in range(y.shape[1]):
        if (own := there[:, v] & ~whole).any():
            out[f"square{v}"] = a[own].T @ a[own]
    return out


def _summed(parts) -> dict[str, np.ndarray]:
    total: dict[str, np.ndarray] = {}
    for part in parts:
        for k, x in part.items():
            total[k] = total[k] + x if k in total else x
    return total


def together(parts: list[dict[str, np.ndarray]], width: int) -> dict[str, np.ndarray]:
    """Pieces of a tile as one: rows (count, cell, share, y) while these are smaller than A'A, else normal equations."""
    rows, rest = [p for p in parts if "count" in p], [p for p in parts if "count" not in p]
    if not rest and sum(p[k].nbytes for p in rows for k in ("count", "cell", "share")) <= 8 * width**2:
        return {k: np.concatenate([p[k] for p in rows]) for k in ("count", "cell", "share", "y")}
    return _summed(rest + [_normal_of(p, width) for p in rows])


def _normal_of(held: dict[str, np.ndarray], width: int) -> dict[str, np.ndarray]:
    """Normal equations of rows: those of a stretch on the cells that it reaches, added up."""
    y = held["y"]
    total = {"square": np.zeros((width, width)), "right": np.zeros((width, y.shape[1])), "size": np.zeros(y.shape[1])}
    done = 0
    for cells, a in Rows(held["count"], held["cell"], held["share"], width).reached():
        for k, x in normal_equations(a, y[done : done + len(a)]).items():
            if k == "size":
                total[k] += x
            elif k == "right":
                total[k][cells] += x
            else:
                total.setdefault(k, np.zeros((width, width)))[np.ix_(cells, cells)] += x
        done += len(a)
    return total


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    held = io.BytesIO()
    np.savez(held, **arrays)
    return held.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as held:
        return {k: held[k] for k in held.files}


def invert(samples: DataFrame, variables: list[str], f: Footprints, method: str = "CG", tile: int = 32, buffer: float = 1.3, damping: float = 1e-4, iterations: int = 1000, tolerance: float = 1e-5, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, keys: tuple[str, ...] = (), piece: int = SHARE) -> DataFrame:
    """(keys, cell_row, cell_col, variables) on the grid f.grid, for the tiles that have samples.

    buffer: the rim's width in footprint radii. Cells that no footprint reaches are NULL. rows, cols: an
    inclusive block that is asked for. Samples with a NULL variable are left out for that variable. piece: the
    samples of a tile that a task takes at once; it changes the image by rounding only, which conjugate gradients
    that are stopped long before they converge can magnify. The footprints' entries are held, not a matrix.
    """
    g, (solve, solve_normal) = GRIDS[f.grid], METHODS[method]
    reach = f.source.radius if f.source else gaussian_radius(f.sigma_x, f.sigma_y, f.threshold)
    rim = max(1, math.ceil(buffer * reach / g.res))
    row, col = geo.nearest_cell(g, *geo.lonlat_to_xy(g.projection, F.col("longitude"), F.col("latitude")))
    own = samples.select("sample_id", *keys, "longitude", "latitude", *variables, *needed_columns(f), row.cast("int").alias("_r"), col.cast("int").alias("_c")).where("_r is not null")
    last_r, last_c = (g.n_rows - 1) // tile, (g.n_cols - 1) // tile

    def named(at: str, last: int):
        return F.sequence(F.greatest(F.floor((F.col(at) - rim) / tile), F.lit(0)).cast("int"), F.least(F.floor((F.col(at) + rim) / tile), F.lit(last)).cast("int"))

    dealt = own.withColumn("_tr", F.explode(named("_r", last_r))).withColumn("_tc", F.explode(named("_c", last_c)))
    if rows:
        dealt = dealt.where(F.col("_tr").between(rows[0] // tile, rows[1] // tile))
    if cols:
        dealt = dealt.where(F.col("_tc").between(cols[0] // tile, cols[1] // tile))
    place = [*keys, "_tr", "_tc"]
    # the few tiles with more samples than one matrix takes; no hint, since Spark sees their size
    full = dealt.groupBy(*place).agg(F.least(F.ceil(F.count("*") / piece), F.lit(FOLD**ROUNDS)).cast("int").alias("_pieces")).where("_pieces > 1")
    full = full.select(*(F.col(k).alias(f"_f{k}") for k in place), "_pieces")
    met = dealt.join(full, [F.col(k).eqNullSafe(F.col(f"_f{k}")) for k in place], "left").drop(*(f"_f{k}" for k in place))
    pieces = F.coalesce("_pieces", F.lit(1))
    met = met.withColumns({"_pieces": pieces, "_piece": F.pmod(F.xxhash64("sample_id", "longitude", "latitude", *variables), pieces).cast("int")})

    def cells(tr: int, tc: int) -> tuple[np.ndarray, np.ndarray]:
        r0, r1 = max(0, tr * tile - rim), min(g.n_rows - 1, tr * tile + tile - 1 + rim)
        c0, c1 = max(0, tc * tile - rim), min(g.n_cols - 1, tc * tile + tile - 1 + rim)
        rr, cc = np.meshgrid(np.arange(r0, r1 + 1), np.arange(c0, c1 + 1), indexing="ij")
        return rr.ravel(), cc.ravel()

    def matrix(pdf: pd.DataFrame, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """Footprints of some samples on the given cells, in full."""
        if f.source:  # an instrument's pattern: every sample on all cells of the tile
            wide = (len(pdf), len(lon))
            held = {c: pdf[c].to_numpy(float)[:, None] for c in f.source.columns}
            return f.source.on(np.broadcast_to(lon, wide), np.broadcast_to(lat, wide), np.broadcast_to(True, wide), held)[:, 0]
        s_lon, s_lat = (pdf[c].to_numpy(float)[:, None] for c in ("longitude", "latitude"))
        alpha = pdf[ANGLE].to_numpy(float)[:, None] if f.turned else f.alpha
        return normalised(gaussian_raw(lon[None, :], lat[None, :], s_lon, s_lat, f.sigma_x, f.sigma_y, alpha, NUMPY), f.threshold)

    def within(pdf: pd.DataFrame, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """Numbers of the cells that a footprint of these samples may reach; all others are surely below its threshold."""
        if f.source:
            return np.arange(len(lon))
        s_lon, s_lat = pdf["longitude"].to_numpy(float), pdf["latitude"].to_numpy(float)
        o_lon, o_lat = geo.xy_to_lonlat(g.projection, *geo.cell_centre(g, pdf["_r"].to_numpy(), pdf["_c"].to_numpy()), NUMPY)
        alpha = pdf[ANGLE].to_numpy(float) if f.turned else f.alpha
        own = gaussian_raw(o_lon, o_lat, s_lon, s_lat, f.sigma_x, f.sigma_y, alpha, NUMPY)  # the largest share is this or more
        with np.errstate(divide="ignore"):
            square = 2 * max(f.sigma_x, f.sigma_y) ** 2 * (-math.log(f.threshold) - np.log(own).min())
        turn = lambda x: (x - s_lon[0] + 180) % 360 - 180
        low, high, at = turn(s_lon).min(), turn(s_lon).max(), turn(lon)
        aside = np.min([np.maximum(np.maximum(low - x, x - high), 0.0) for x in (at - 360, at, at + 360)], axis=0)
        x = np.arcsin(np.cos(np.radians(s_lat)).min() * np.sin(np.radians(np.minimum(aside, 180.0)) / 2)) * 2 * geo.R_VINCENTY
        y = np.radians(np.maximum(np.maximum(s_lat.min() - lat, lat - s_lat.max()), 0.0)) * geo.R_VINCENTY
        return np.flatnonzero(~(x * x + y * y > square * 1.0001 + 1))

    def gathered(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        """Samples of a tile as rows, or as normal equations where these are smaller."""
        rr, cc = cells(int(pdf["_tr"].iloc[0]), int(pdf["_tc"].iloc[0]))
        lon, lat = geo.xy_to_lonlat(g.projection, *geo.cell_centre(g, rr, cc), NUMPY)
        pdf = pdf.assign(_p=pdf["_r"] // NEAR, _q=pdf["_c"] // NEAR).sort_values(["_p", "_q", "sample_id"])
        parts = []
        for i in range(0, len(pdf), PIECE):
            cut = pdf.iloc[i : i + PIECE]
            rows = []
            for _, own in cut.groupby(["_p", "_q"]):
                reached = within(own, lon, lat)
                a = Rows.of((matrix(own.iloc[j : j + STRETCH], lon[reached], lat[reached]) for j in range(0, len(own), STRETCH)), len(reached))
                rows.append(Rows(a.count, reached[a.cell].astype(np.int32), a.share, len(lon)))
            a = Rows.joined(rows)
            parts = [together([*parts, {"count": a.count, "cell": a.cell, "share": a.share, "y": cut[list(variables)].to_numpy(float)}], len(lon))]
        return parts[0]

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        """A piece of a tile that has several."""
        return pdf.iloc[:1].assign(_data=[_packed(gathered(pdf))])[shares.names]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        """A tile of one piece is solved where it is put together."""
        return solved_tile(pdf.iloc[0], gathered(pdf))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[:1]
        if len(pdf) == 1:
            return first.assign(_piece=first["_piece"] // FOLD)[shares.names]
        width = len(cells(int(first["_tr"].iloc[0]), int(first["_tc"].iloc[0]))[0])
        data = _packed(together([_unpacked(d) for d in pdf.sort_values("_piece")["_data"]], width))
        return first.assign(_piece=first["_piece"] // FOLD, _data=[data])[shares.names]

    def end(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        width = len(cells(int(first["_tr"]), int(first["_tc"]))[0])
        return solved_tile(first, together([_unpacked(d) for d in pdf.sort_values("_piece")["_data"]], width))

    def solved_tile(first: pd.Series, held: dict[str, np.ndarray]) -> pd.DataFrame:
        tr, tc = int(first["_tr"]), int(first["_tc"])
        rr, cc = cells(tr, tc)
        solved, seen = [], []
        for v in range(len(variables)):
            if "count" in held:
                there = ~np.isnan(held["y"][:, v])
                a = Rows(held["count"], held["cell"], held["share"], len(rr)).chosen(there)
                solved.append(solve(a, held["y"][there, v], damping, iterations=iterations, tolerance=tolerance)[0])
                seen.append(a.column_sums())
            else:
                square = held["square"] + held.get(f"square{v}", 0.0)
                solved.append(solve_normal(square, held["right"][:, v], float(held["size"][v]), damping, iterations=iterations, tolerance=tolerance)[0])
                seen.append(square.diagonal())  # shares aren't negative: a cell that none reaches has no square
        image = [np.where(s > 0, x, np.nan) for x, s in zip(solved, seen, strict=True)]
        keep = (rr // tile == tr) & (cc // tile == tc)
        out = {k: first[k] for k in keys} | {"cell_row": rr[keep], "cell_col": cc[keep]}
        return pd.DataFrame(out | {v: image[i][keep] for i, v in enumerate(variables)})[schema.names]

    named_keys = [samples.schema[k] for k in keys]
    shares = T.StructType([*named_keys, *(T.StructField(c, T.IntegerType()) for c in ("_tr", "_tc", "_piece", "_pieces")), T.StructField("_data", T.BinaryType())])
    schema = T.StructType([*named_keys, T.StructField("cell_row", T.LongType()), T.StructField("cell_col", T.LongType()), *(T.StructField(v, T.DoubleType()) for v in variables)])
    part = met.where("_pieces > 1").groupBy(*place, "_piece").applyInPandas(begin, shares)
    for _ in range(ROUNDS - 1):
        part = part.groupBy(*place, F.floor(F.col("_piece") / FOLD).alias("_group")).applyInPandas(fold, shares)
    image = met.where("_pieces = 1").groupBy(*place).applyInPandas(whole, schema).unionByName(part.groupBy(*place).applyInPandas(end, schema))
    return _block(image, rows, cols)


def _block(df: DataFrame, rows: tuple[int, int] | None, cols: tuple[int, int] | None) -> DataFrame:
    if rows:
        df = df.where(F.col("cell_row").between(*rows))
    if cols:
        df = df.where(F.col("cell_col").between(*cols))
    return df


def bilinear(image: DataFrame, targets: DataFrame, grid: str | Grid, variables: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """image (keys, cell_row, cell_col, variables) on `grid`, read at the targets' positions from the four cells around.

    Cells without a value count as 0, as does everything outside the grid; targets without any cell don't appear.
    """
    g = GRIDS[grid] if isinstance(grid, str) else grid
    x, y = geo.lonlat_to_xy(g.projection, F.col("longitude"), F.col("latitude"))
    at = targets.select("target_id", ((x - g.first("x")) / g.step("x")).alias("_x"), ((y - g.first("y")) / -g.step("y")).alias("_y"))
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))).alias("_k")
    at = at.select("target_id", "_x", "_y", corner)
    dx, dy = F.col("_x") - F.floor("_x"), F.col("_y") - F.floor("_y")
    weight = F.when(F.col("_k.i") == 1, dy).otherwise(1 - dy) * F.when(F.col("_k.j") == 1, dx).otherwise(1 - dx)
    at = at.select("target_id", (F.floor("_y") + F.col("_k.i")).alias("cell_row"), (F.floor("_x") + F.col("_k.j")).alias("cell_col"), weight.alias("_w"))
    met = at.join(image, ["cell_row", "cell_col"])
    return met.groupBy(*keys, "target_id").agg(*(F.sum(F.col(v) * F.col("_w")).alias(v) for v in variables))
