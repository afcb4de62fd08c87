"""Reconstructions that weigh a target's samples by their footprints: Backus-Gilbert and iterative (RSIR).

Both need small dense algebra for each target: k samples by the cells of a local window. Spark brings each
block of 1024 targets together with their neighbours; in the task the block's targets are stacked and
solved at once. A block holds at most 1024 * k rows, whatever the size of the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import GRIDS
from ..functions import geo
from ..functions.geo import NUMPY
from ..functions.patterns import THRESHOLD, antenna_axes, attitude_from_motion, gaussian_radius, gaussian_raw, normalised, to_earth

BLOCK = 1024
#: Numbers in a stack of patterns (targets * samples * cells) that are worked on at once: what a core's cache holds.
STACK = 60_000


@dataclass(frozen=True)
class Footprints:
    """Gaussian footprints and the grid they are summed on.

    sigma_x/y: of a sample, metres. target: of a target, metres, or both its sigmas. turned: samples have their
    ellipse's angle in the column ANGLE; target_turned: targets too. Without it all ellipses have `alpha`.
    """

    grid: str = "EASE2_G9km"
    sigma_x: float = 20000.0
    sigma_y: float = 20000.0
    target: float | tuple[float, float] = 18000.0
    alpha: float = 0.0
    threshold: float = THRESHOLD
    target_threshold: float = THRESHOLD
    turned: bool = False
    target_turned: bool = False
    source: Projected | None = None  # an instrument's patterns instead of Gaussian ones for the samples
    aim: Projected | None = None  # and for targets of another band


#: The column of a footprint's angle, in radians (patterns.nadir_angle).
ANGLE = "footprint_angle"
#: Columns of a sample that a projected antenna pattern needs.
ATTITUDE = tuple(f"attitude_{i}" for i in range(9))
GEOMETRY = ("x_position", "y_position", "z_position", "x_velocity", "y_velocity", "z_velocity", "processing_scan_angle", "feed_horn_number")


@dataclass(frozen=True)
class Projected:
    """Antenna patterns of an instrument, projected from the satellite: gain(phi, theta) by horn.

    tilt and offsets (phi, theta of each horn) are in radians. radius: metres beyond which a footprint is
    nothing. body_scan: scan angles count from the flight direction; otherwise from a quarter turn off it.
    attitude: samples have the satellite's frame in ATTITUDE; where an element is missing, and without it, the frame follows from the motion.
    """

    gains: dict[int, Callable[[np.ndarray, np.ndarray], np.ndarray]]
    tilt: float
    radius: float
    offsets: dict[int, tuple[float, float]] | None = None
    body_scan: bool = True
    attitude: bool = False

    @property
    def columns(self) -> tuple[str, ...]:
        """What it needs of a sample."""
        return GEOMETRY + ATTITUDE if self.attitude else GEOMETRY

    def on(self, lon: np.ndarray, lat: np.ndarray, inside: np.ndarray, sample: dict[str, np.ndarray]) -> np.ndarray:
        """Shares (targets x samples x cells) on windows; samples that don't exist have NaN in their columns."""
        shape = sample["x_position"].shape
        out = np.zeros((*shape, lon.shape[1]))
        t, k = np.nonzero(~np.isnan(sample["x_position"]))
        at = {c: sample[c][t, k] for c in self.columns}
        position, velocity = (np.stack([at[f"{a}_{w}"] for a in "xyz"], -1) for w in ("position", "velocity"))
        frame, scan, horn = attitude_from_motion(position, velocity), np.radians(at["processing_scan_angle"]), at["feed_horn_number"].astype(int)
        if self.attitude:
            given = np.stack([at[c] for c in ATTITUDE], -1).reshape(-1, 3, 3)
            whole = ~np.isnan(given).any((1, 2))
            frame[whole] = given[whole]
        for h in np.unique(horn).tolist():
            own = np.flatnonzero(horn == h)
            axes = antenna_axes(self.tilt, scan[own] if self.body_scan else math.pi / 2 - scan[own], *(self.offsets or {}).get(h, (0.0, 0.0)))
            step = max(1, 4 * STACK // lon.shape[1])
            for i in range(0, len(own), step):  # all samples of a stack at once, as far as a core's cache goes
                some = own[i : i + step]
                share = to_earth(self.gains[h], lon[t[some]], lat[t[some]], position[some], frame[some], axes[i : i + step]) * inside[t[some]]
                total = share.sum(-1, keepdims=True)
                out[t[some], k[some]] = np.divide(share, total, out=np.zeros_like(share), where=total > 0)
        return out


def _window(lon: np.ndarray, lat: np.ndarray, f: Footprints, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lon, lat, inside) of the cells around each target, as many rows and columns to each side as `halves` says: targets x cells."""
    g, half = GRIDS[f.grid], halves.max(0)
    row, col = geo.nearest_cell(g, *geo.lonlat_to_xy(g.projection, lon, lat, NUMPY), NUMPY)
    down, step = np.arange(-half[0], half[0] + 1), np.arange(-half[1], half[1] + 1)
    rows = row[:, None, None] + down[None, :, None] + 0 * step[None, None, :]
    cols = col[:, None, None] + 0 * down[None, :, None] + step[None, None, :]
    inside = (rows >= 0) & (rows < g.n_rows) & (np.abs(down)[None, :, None] <= halves[:, 0, None, None]) & (np.abs(step)[None, None, :] <= halves[:, 1, None, None])
    if g.projection == "G":
        cols = cols % g.n_cols
    else:
        inside &= (cols >= 0) & (cols < g.n_cols)
    rows, cols = np.clip(rows, 0, g.n_rows - 1), np.clip(cols, 0, g.n_cols - 1)
    x, y = geo.cell_centre(g, rows, cols)
    cell_lon, cell_lat = geo.xy_to_lonlat(g.projection, x, y, NUMPY)
    n = len(lon)
    return cell_lon.reshape(n, -1), cell_lat.reshape(n, -1), inside.reshape(n, -1)


def _gaussians(cell_lon, cell_lat, inside, lon, lat, sx, sy, alpha, threshold) -> np.ndarray:
    """Patterns of points (targets x samples) on windows (targets x cells)."""
    near = cell_lon[:, None, :]
    if (np.abs(lon) > 150).any() or (np.abs(cell_lat) > 80).any():  # the way that doesn't go round
        near = (near - lon[:, :, None] + 180) % 360 - 180 + lon[:, :, None]
    raw = gaussian_raw(near, cell_lat[:, None, :], lon[:, :, None], lat[:, :, None], sx, sy, alpha, NUMPY)
    return normalised(np.where(inside[:, None, :], raw, 0.0), threshold)


def bg_weights(patterns: np.ndarray, target: np.ndarray, there: np.ndarray, smoothing: float = 0.0) -> np.ndarray:
    """Weights (targets x samples) whose weighted patterns are nearest to the target's under unit sum.

    patterns: targets x samples x cells; there: which samples exist. Targets without a usable pattern or with a
    singular system get NaN; samples that don't exist get 0.
    """
    u = np.where(there, patterns.sum(-1), 0.0)
    v = np.where(there, np.einsum("tkc,tc->tk", patterns, target), 0.0)
    g = np.einsum("tkc,tlc->tkl", patterns, patterns)
    both = there[:, :, None] & there[:, None, :]
    scale = np.maximum(np.einsum("tkk->tk", np.where(both, g, 0.0)).max(-1), 1e-300)
    g = np.where(both, g, 0.0)
    k = g.shape[1]
    at = np.arange(k)
    g[:, at, at] += np.where(there, smoothing, scale[:, None])
    out = np.full(u.shape, np.nan)
    values = np.linalg.eigvalsh(g)  # g is symmetric, and singular if its least eigenvalue is next to nothing
    good = (u.sum(-1) > 0) & (values[:, 0] > 1e-13 * values[:, -1])
    if good.any():
        solved = np.linalg.solve(g[good], np.stack([u[good], v[good]], -1))
        gu, gv = solved[..., 0], solved[..., 1]
        one = (u[good] * gu).sum(-1)
        ok = np.abs(one) > 0
        add = np.divide(1 - (u[good] * gv).sum(-1), one, out=np.full(len(one), np.nan), where=ok)
        out[good] = np.where(there[good], gv + add[:, None] * gu, np.where(np.isnan(add)[:, None], np.nan, 0.0))
    return out


def rsir(patterns: np.ndarray, target: np.ndarray, values: np.ndarray, iterations: int) -> np.ndarray:
    """The multiplicative reconstruction of values (targets x samples, NaN: no sample), read through the target's pattern."""
    there = ~np.isnan(values)
    h = np.where(there[:, :, None], patterns, 0.0)
    z = np.where(there, values, 0.0)
    over = h.sum(1)

    def mean(x: np.ndarray) -> np.ndarray:
        return np.divide(x, over, out=np.zeros_like(x), where=over > 0)

    a = mean(np.einsum("tkc,tk->tc", h, z))
    weight = h.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(iterations):
            f = np.where(weight > 0, np.einsum("tkc,tc->tk", h, a) / weight, np.nan)
            d = np.sqrt(z / f)
            rising = d >= 1
            # upwards 1 / (p + q / a), downwards r + d * a: for each sample one of the two, over the cells
            p, q, r = (1 - 1 / d) / (2 * f), 1 / d, 0.5 * f * (1 - d)
            u = np.where(rising[:, :, None], 1 / (p[:, :, None] + q[:, :, None] / a[:, None, :]), r[:, :, None] + d[:, :, None] * a[:, None, :])
            u *= h
            a = mean(np.where(h > 0, u, 0.0).sum(1))
    seen = over > 0
    share = np.where(seen, target, 0.0)
    total = share.sum(-1)
    return np.divide((share * a).sum(-1), total, out=np.full(len(total), np.nan), where=total > 0)


def _by_block(rows: DataFrame, keys: tuple[str, ...], variables: list[str], solve: Callable, extra: list[str]) -> DataFrame:
    """Group neighbour rows by block of targets and solve each stack of a block."""
    out = T.StructType(
        [*(rows.schema[k] for k in keys), T.StructField("target_id", T.LongType()), T.StructField("cell_row", T.LongType()), T.StructField("cell_col", T.LongType()), *(T.StructField(v, T.DoubleType()) for v in [*variables, *extra]), T.StructField("regridding_n_samples", T.LongType())]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_n=pdf.groupby("target_id")["rank"].transform("size")).sort_values(["_n", "target_id", "rank"])
        code, ids = pd.factorize(pdf["target_id"])
        place = pdf.groupby("target_id", sort=False).cumcount().to_numpy()
        first = pdf.drop_duplicates("target_id")
        k = int(place.max()) + 1

        def stacked(c: str) -> np.ndarray:
            held = np.full((len(ids), k), np.nan)
            held[code, place] = pdf[c].to_numpy(float)
            return held

        res = first[[*keys, "target_id", "cell_row", "cell_col"]].copy()
        res["regridding_n_samples"] = np.bincount(code)
        for c, column in solve(first["t_lon"].to_numpy(float), first["t_lat"].to_numpy(float), stacked).items():
            res[c] = column
        return res[out.names]

    # by the target's own number, which no two granules share: never more than BLOCK targets meet
    return rows.groupBy(*keys, F.expr(f"target_id div {BLOCK}").alias("_block")).applyInPandas(run, out)


def _prepared(neighbours: DataFrame, samples: DataFrame, targets: DataFrame, columns: list[str], keys: tuple[str, ...]) -> DataFrame:
    if all(c in neighbours.columns for c in ("longitude", "latitude", *columns)):  # the search carried them along
        rows = neighbours.withColumnsRenamed({"longitude": "s_lon", "latitude": "s_lat"})
    else:
        s = samples.select("sample_id", *keys, F.col("longitude").alias("s_lon"), F.col("latitude").alias("s_lat"), *columns)
        rows = neighbours.select(*keys, "target_id", "sample_id", "distance", "rank").join(s, ["sample_id", *keys])
    own = (*GEOMETRY, *ATTITUDE, ANGLE)
    t = targets.select("target_id", F.col("cell_row").cast("long").alias("cell_row"), F.col("cell_col").cast("long").alias("cell_col"), F.col("longitude").alias("t_lon"), F.col("latitude").alias("t_lat"), *(F.col(c).alias(f"t_{c}") for c in own if c in targets.columns))
    return rows.join(t, "target_id")


def _halves(f: Footprints, t_lon: np.ndarray, t_lat: np.ndarray, s_lon: np.ndarray, s_lat: np.ndarray) -> np.ndarray:
    """(rows, columns) to each side of each target's cell: to its farthest neighbours and a footprint's radius beyond.

    However wide the search was, a window is as wide as the neighbours that were found. The radius is laid out in cells of the
    map, at all latitudes alike.
    """
    g = GRIDS[f.grid]
    row, col = geo.nearest_cell(g, *geo.lonlat_to_xy(g.projection, t_lon, t_lat, NUMPY), NUMPY)
    none = np.isnan(s_lon) | np.isnan(s_lat)
    s_row, s_col = geo.nearest_cell(g, *geo.lonlat_to_xy(g.projection, np.where(none, t_lon[:, None], s_lon), np.where(none, t_lat[:, None], s_lat), NUMPY), NUMPY)
    off = [np.abs(s_row - row[:, None]), np.abs(s_col - col[:, None])]
    if g.projection == "G":
        off[1] = np.minimum(off[1], g.n_cols - off[1])
    source = f.source.radius if f.source else gaussian_radius(f.sigma_x, f.sigma_y, f.threshold)
    target = f.aim.radius if f.aim else gaussian_radius(*(f.target if isinstance(f.target, tuple) else (f.target, f.target)), f.target_threshold)
    around, own = (math.ceil(x / g.res) + 1 for x in (source, target))
    halves = np.stack([np.maximum(x.max(1) + around, own) for x in off], axis=1)
    return np.minimum(halves, [g.n_rows, (g.n_cols - 1) // 2 if g.projection == "G" else g.n_cols]).astype(int)


def _stacks(lon: np.ndarray, halves: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(targets, number of samples) of each stack: targets with equally many samples and windows of about one size."""
    counts = (~np.isnan(lon)).sum(1)
    # sizes in steps of a quarter, so that few sizes come up and no window is much larger than it must be
    step = np.ceil(np.log(halves) / math.log(1.25)).astype(int)
    kinds, code = np.unique(np.stack([counts, *step.T], axis=1), axis=0, return_inverse=True)
    for kind, (k, *_) in enumerate(kinds.tolist()):
        own = np.flatnonzero(code.ravel() == kind)
        size = max(1, STACK // max(1, k * int((2 * halves[own].max(0) + 1).prod())))
        for i in range(0, len(own), size):
            yield own[i : i + size], k


def _sources(window: tuple, f: Footprints, stacked: Callable, at: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """The samples' patterns on the windows of a stack."""
    if f.source:
        return f.source.on(*window, {c: stacked(c)[at][:, : lon.shape[1]] for c in f.source.columns})
    alpha = stacked(ANGLE)[at][:, : lon.shape[1], None] if f.turned else f.alpha
    return np.nan_to_num(_gaussians(*window, lon, lat, f.sigma_x, f.sigma_y, alpha, f.threshold))


def _aims(window: tuple, f: Footprints, stacked: Callable, at: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """The targets' own patterns on the windows of a stack: targets x cells."""
    if f.aim:
        return f.aim.on(*window, {c: stacked(f"t_{c}")[at][:, :1] for c in f.aim.columns})[:, 0]
    sx, sy = f.target if isinstance(f.target, tuple) else (f.target, f.target)
    alpha = stacked(f"t_{ANGLE}")[at][:, :1, None] if f.target_turned else 0.0
    return _gaussians(*window, lon[:, None], lat[:, None], sx, sy, alpha, f.target_threshold)[:, 0]


def needed_columns(f: Footprints) -> list[str]:
    """What a footprint needs of its sample, beside the position."""
    return list(f.source.columns) if f.source else [ANGLE] if f.turned else []


def backus_gilbert(neighbours: DataFrame, samples: DataFrame, targets: DataFrame, variables: list[str], f: Footprints, smoothing: float = 0.0, noise: list[str] = (), uncertainty: float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, target_id, cell_row, cell_col, variables, noise). Targets without weights give NULL."""
    rows = _prepared(neighbours, samples, targets, [*variables, *noise, *needed_columns(f)], keys)

    def solve(t_lon: np.ndarray, t_lat: np.ndarray, stacked: Callable) -> dict[str, np.ndarray]:
        lon, lat = stacked("s_lon"), stacked("s_lat")
        held = {c: stacked(c) for c in [*variables, *noise]}
        out = {c: np.full(len(t_lon), np.nan) for c in held}
        halves = _halves(f, t_lon, t_lat, lon, lat)
        for at, k in _stacks(lon, halves):
            window = _window(t_lon[at], t_lat[at], f, halves[at])
            there = np.ones((len(at), k), bool)
            p = _sources(window, f, stacked, at, lon[at][:, :k], lat[at][:, :k])
            t = _aims(window, f, stacked, at, t_lon[at], t_lat[at])
            a = bg_weights(p, t, there, smoothing)
            none = np.isnan(a).any(-1)
            for c in variables:
                out[c][at] = np.where(none, np.nan, np.nansum(a * held[c][at][:, :k], -1))
            for c in noise:
                out[c][at] = np.where(none, np.nan, np.sqrt(np.nansum(a * a * held[c][at][:, :k], -1) ** 2 + uncertainty**2))
        return out

    return _by_block(rows, keys, variables, solve, list(noise))


def reconstruct_rsir(neighbours: DataFrame, samples: DataFrame, targets: DataFrame, variables: list[str], f: Footprints, iterations: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, target_id, cell_row, cell_col, variables). With 0 iterations the start value is read through the target's pattern."""
    if iterations < 0:
        raise ValueError("the number of iterations must not be negative")
    rows = _prepared(neighbours, samples, targets, [*variables, *needed_columns(f)], keys)

    def solve(t_lon: np.ndarray, t_lat: np.ndarray, stacked: Callable) -> dict[str, np.ndarray]:
        lon, lat = stacked("s_lon"), stacked("s_lat")
        held = {c: stacked(c) for c in variables}
        out = {c: np.full(len(t_lon), np.nan) for c in variables}
        halves = _halves(f, t_lon, t_lat, lon, lat)
        for at, k in _stacks(lon, halves):
            window = _window(t_lon[at], t_lat[at], f, halves[at])
            p = _sources(window, f, stacked, at, lon[at][:, :k], lat[at][:, :k])
            t = _aims(window, f, stacked, at, t_lon[at], t_lat[at])
            for c in variables:
                out[c][at] = rsir(p, t, held[c][at][:, :k], iterations)
        return out

    return _by_block(rows, keys, variables, solve, [])
