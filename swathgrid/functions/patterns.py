"""Antenna patterns on the ground.

Gaussian patterns are formulas and work on columns and arrays. Tabulated patterns are complex gains on a
(phi, theta) lattice; they are small, are held as numpy arrays and go to the tasks with the function.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import geo
from .geo import NUMPY, SPARK

#: Gains below this share of the largest one count as none, if nothing else is said.
THRESHOLD = 0.001


def nadir_angle(lon, lat, lon_nadir, lat_nadir, m=SPARK):
    """The angle (radians) by which a footprint is turned: from the azimuth of the sample seen from the nadir point."""
    d = m.rad(lon - lon_nadir)
    p, q = m.rad(lat), m.rad(lat_nadir)
    return -m.atan2(m.cos(p) * m.sin(d), m.cos(q) * m.sin(p) - m.sin(q) * m.cos(p) * m.cos(d)) + math.pi / 2


def gaussian_raw(lon, lat, lon0, lat0, sigma_x, sigma_y, alpha, m=SPARK):
    """The Gaussian of metres along the parallel and the meridian, turned by alpha; not normalised."""
    # along a parallel and a meridian the sphere's distance has these closed forms, with the sign of the step
    x = m.asin(m.cos(m.rad(lat0)) * m.sin(m.rad(lon - lon0) / 2)) * (2 * geo.R_VINCENTY)
    y = m.rad(lat - lat0) * geo.R_VINCENTY
    c, s = m.cos(alpha), m.sin(alpha)
    a, b = x * c + y * s, y * c - x * s
    return m.exp(-(a * a / (2.0 * sigma_x * sigma_x) + b * b / (2.0 * sigma_y * sigma_y)))


def normalised(gain: np.ndarray, threshold: float | None = THRESHOLD) -> np.ndarray:
    """Shares over the last axis, those below threshold * largest set to zero and the rest scaled to one again."""
    top = gain.max(-1, keepdims=True)
    kept = gain if threshold is None else np.where(gain < threshold * top, 0.0, gain)
    total = kept.sum(-1, keepdims=True)
    return np.divide(kept, total, out=np.zeros_like(kept), where=total > 0)


def normalised_gain(gain: Column, keys: list[str], threshold: float = THRESHOLD) -> Column:
    """The same as a column, over the rows of the keys."""
    w = Window.partitionBy(*keys)
    kept = F.when(gain < F.max(gain).over(w) * threshold, 0.0).otherwise(gain)
    return kept


def gaussian_shares(cells: DataFrame, keys: list[str], sigma_x: float, sigma_y: float, alpha: Column, threshold: float = THRESHOLD) -> DataFrame:
    """cells (keys, lon, lat, lon0, lat0) with gain: each cell's share of its key's pattern."""
    raw = gaussian_raw(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"), F.lit(sigma_x), F.lit(sigma_y), alpha)
    w = Window.partitionBy(*keys)
    out = cells.withColumn("_raw", raw).withColumn("_kept", normalised_gain(F.col("_raw"), keys, threshold))
    return out.withColumn("gain", F.col("_kept") / F.sum("_kept").over(w)).drop("_raw", "_kept")


def gaussian_radius(sigma_x: float, sigma_y: float, threshold: float = THRESHOLD) -> float:
    """Metres beyond which a Gaussian footprint is below the threshold."""
    return math.sqrt(-2 * max(sigma_x, sigma_y) ** 2 * math.log(threshold))


def projected_gaussian(phi: np.ndarray, theta: np.ndarray, sigma_u: float, sigma_v: float, max_theta: float | None = None, threshold: float = THRESHOLD) -> np.ndarray:
    """Gain of a pattern that is Gaussian in director cosines."""
    u, v = geo.polar_to_uv(theta, phi, NUMPY)
    gain = normalised(np.exp(-0.5 * ((u / sigma_u) ** 2 + (v / sigma_v) ** 2)).ravel(), threshold).reshape(np.shape(u))
    return gain if max_theta is None else np.where(theta > math.radians(max_theta), 0.0, gain)


def footprint_radius(tilt: float, altitude: float, max_theta: float) -> float:
    """Metres from the boresight's ground point to that of a ray max_theta (radians) further out, and a tenth more."""
    r = geo.R_VINCENTY
    edge = min(tilt + max_theta, math.asin(r / (r + altitude)))
    arcs = [r * math.atan2(*geo.sphere_hit(a, r, altitude)) for a in (edge, tilt)]
    return 1.1 * (arcs[0] - arcs[1])


@dataclass
class Tabulated:
    """One horn's gains: co- and cross-polar, for horizontal and vertical, on a regular (phi, theta) lattice in radians."""

    phi: np.ndarray
    theta: np.ndarray
    hco: np.ndarray
    hcx: np.ndarray
    vco: np.ndarray
    vcx: np.ndarray
    below: float = field(default=0.0)  # share of the gain that the threshold took

    @classmethod
    def of(cls, phi, theta, g, threshold: float | None = None, max_theta: float | None = None, total: float | None = None, most: float | None = None) -> Tabulated:
        """g: the eight tables G1h..G4h, G1v..G4v (real and imaginary part of co-, then of cross-polar gain).

        total, most: sum and maximum of the whole pattern's gain, where g is the part of it that matters.
        """
        h, v = [g[f"G{k}h"] for k in range(1, 5)], [g[f"G{k}v"] for k in range(1, 5)]
        parts = [h[0] + 1j * h[1], h[2] + 1j * h[3], v[0] + 1j * v[1], v[2] + 1j * v[3]]
        norm = cls._norm(*parts)
        total = norm.sum() if total is None else total
        off = np.zeros(norm.shape, bool)
        if threshold is not None:
            off |= norm < threshold * (norm.max() if most is None else most)
        if max_theta is not None:
            off |= (np.asarray(theta) > math.radians(max_theta))[None, :]
        out = cls(np.asarray(phi), np.asarray(theta), *(np.where(off, 0, p / total) for p in parts))
        out.below = float(1 - norm[~off].sum() / total)
        return out

    @staticmethod
    def _norm(hco, hcx, vco, vcx) -> np.ndarray:
        return 0.5 * (np.hypot(np.abs(hco), np.abs(hcx)) + np.hypot(np.abs(vco), np.abs(vcx)))

    def _at(self, table: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Bilinear in the lattice, 0 outside."""
        i = (phi - self.phi[0]) / (self.phi[1] - self.phi[0])
        j = (theta - self.theta[0]) / (self.theta[1] - self.theta[0])
        good = (i >= 0) & (j >= 0) & (i <= len(self.phi) - 1) & (j <= len(self.theta) - 1)
        i0, j0 = (np.clip(np.floor(np.where(good, x, 0)).astype(int), 0, n - 2) for x, n in ((i, len(self.phi)), (j, len(self.theta))))
        a, b = np.where(good, i, 0) - i0, np.where(good, j, 0) - j0
        value = (1 - a) * ((1 - b) * table[i0, j0] + b * table[i0, j0 + 1]) + a * ((1 - b) * table[i0 + 1, j0] + b * table[i0 + 1, j0 + 1])
        return np.where(good, value, 0)

    def scalar(self, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
        return self._norm(*(self._at(t, phi, theta) for t in (self.hco, self.hcx, self.vco, self.vcx)))

    def mueller(self, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """4 x 4 matrices (last axes) that take the Stokes vector (v, h, 3, 4) to what the antenna measures.

        The third and fourth are twice the real and the imaginary part of E_v E_h*.
        """
        hh, hv, vv, vh = (self._at(t, phi, theta) for t in (self.hco, self.hcx, self.vco, self.vcx))
        sq, re, im = (lambda x: np.abs(x) ** 2), np.real, np.imag
        rows = [
            [sq(vv), sq(vh), re(vh * vv.conj()), im(vh * vv.conj())],
            [sq(hv), sq(hh), re(hh * hv.conj()), im(hh * hv.conj())],
            [2 * re(vv * hv.conj()), 2 * re(vh * hh.conj()), re(vv * hh.conj() + vh * hv.conj()), -im(vv * hh.conj() - vh * hv.conj())],
            [2 * im(vv * hv.conj()), 2 * im(vh * hh.conj()), im(vv * hh.conj() + vh * hv.conj()), re(vv * hh.conj() - vh * hv.conj())],
        ]
        return np.stack([np.stack(r, -1) for r in rows], -2)

    def widest(self) -> float:
        """The first theta from which on the gain is zero on average, or the last one."""
        none = self._norm(self.hco, self.hcx, self.vco, self.vcx).mean(0) <= 0
        return float(self.theta[int(none.argmax())] if none.any() and none.argmax() else self.theta[-1])


def antenna_axes(tilt, scan, offset_phi=0.0, offset_theta=0.0) -> np.ndarray:
    """Rows: x, y and z axis of the antenna (z: boresight) in the satellite's frame, for one antenna or an array of them. Radians."""
    t, s = np.broadcast_arrays(np.asarray(tilt + offset_theta, float), np.asarray(scan + offset_phi, float))
    z = np.stack([-np.sin(t) * np.cos(s), np.sin(t) * np.sin(s), -np.cos(t)], -1)
    y = np.stack([-np.cos(t) * np.cos(s), np.cos(t) * np.sin(s), np.sin(t)], -1)
    return np.stack([np.cross(y, z), y, z], -2)


def attitude_from_motion(position: np.ndarray, velocity: np.ndarray) -> np.ndarray:
    """The satellite's frame (rows: axes in Earth-fixed coordinates) for flight along the velocity, z upwards; for one place or an array."""
    y, z = velocity / np.linalg.norm(velocity, axis=-1, keepdims=True), position / np.linalg.norm(position, axis=-1, keepdims=True)
    axes = np.stack([np.cross(y, z), y, z], -2)
    if (np.abs(np.linalg.det(axes)) < 1e-12).any():
        raise ValueError("a velocity points straight up or down")
    return np.linalg.inv(np.swapaxes(axes, -1, -2))


def boresight_to_earth(position: np.ndarray, attitude: np.ndarray, axes: np.ndarray) -> tuple[float, float]:
    """(lon, lat) where the boresight first meets the ellipsoid; NaN if it doesn't."""
    ray = axes[2] @ attitude
    scale = np.array([1 / 6378137.0, 1 / 6378137.0, 1 / 6356752.314245])
    p, d = position * scale, ray * scale
    a, b, c = d @ d, 2 * p @ d, p @ p - 1
    inside = b * b - 4 * a * c
    if inside < 0:
        return math.nan, math.nan
    t = min(((-b + s * math.sqrt(inside)) / (2 * a) for s in (1, -1)), key=abs)
    lon, lat = geo.from_ecef(*(position + t * ray), NUMPY)
    return float(lon), float(lat)


def to_earth(gain, lon: np.ndarray, lat: np.ndarray, position: np.ndarray, attitude: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Shares of a pattern over places on the ground, for one sample or many (first axis of all). gain(phi, theta): as Tabulated.scalar."""
    ground = np.stack(geo.to_ecef(lon, lat, NUMPY), -1)
    normal = -ground / np.array([6378137.0, 6378137.0, 6356752.0]) ** 2
    normal /= np.linalg.norm(normal, axis=-1, keepdims=True)
    ray = ground - position[..., None, :]
    ray /= np.linalg.norm(ray, axis=-1, keepdims=True)
    facing = (normal * ray).sum(-1)
    x, y, z = np.moveaxis(np.clip(ray @ np.swapaxes(axes @ attitude, -1, -2), -1, 1), -1, 0)
    flat = np.hypot(x, y)
    phi = np.sign(y) * np.arccos(np.clip(np.divide(x, flat, out=np.ones_like(x), where=flat > 0), -1, 1))
    out = gain(np.where(phi < 0, phi + 2 * math.pi, phi), np.arccos(z)) * np.maximum(facing, 0)
    total = out.sum(-1, keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 0)


# ---- local windows of an integration grid


def window_bounds(points: DataFrame, keys: list[str], grid: str, radius: Column | float) -> DataFrame:
    """(keys, i_first, i_last, j_first, j_last): the smallest block of cells around the keys' points, each +- radius.

    i counts columns and j rows from the top; both are kept inside the grid. On the global grid a block that
    is narrower across the date line has i_first > i_last and goes on at column 0.
    """
    from ..catalog import GRIDS

    g = GRIDS[grid]
    angle = F.degrees((radius if isinstance(radius, Column) else F.lit(radius)) / geo.R_VINCENTY)
    lon, lat = F.col("longitude"), F.col("latitude")
    four = F.array(*(F.struct((lon + angle * a).alias("lon"), (lat + angle * b).alias("lat")) for a, b in ((1, 0), (0, 1), (-1, 0), (0, -1))))
    p = points.select(*keys, F.explode(four).alias("_p")).select(*keys, F.col("_p.lon").alias("_lon"), F.col("_p.lat").alias("_lat"))
    over = F.abs("_lat") > 90  # over the pole: the other side's meridian
    p = p.select(*keys, F.when(over, F.col("_lon") + 180).otherwise(F.col("_lon")).alias("_lon"), F.when(over, F.signum("_lat") * 180 - F.col("_lat")).otherwise(F.col("_lat")).alias("_lat"))
    p = p.withColumn("_lon", F.when(F.col("_lon") > 180, F.col("_lon") - 360).when(F.col("_lon") < -180, F.col("_lon") + 360).otherwise(F.col("_lon")))

    def low(x: Column, n: int) -> Column:
        return F.least(F.greatest(F.ceil(x) - 1, F.lit(0)), F.lit(n - 1)).cast("int")

    def high(x: Column, n: int) -> Column:
        return F.least(F.greatest(F.ceil(x), F.lit(0)), F.lit(n - 1)).cast("int")

    if g.projection == "G":
        east, west = F.col("_lon") > 0, F.col("_lon") < 0
        b = p.groupBy(*keys).agg(
            F.min("_lon").alias("_w"), F.max("_lon").alias("_e"), F.min(F.when(east, F.col("_lon"))).alias("_we"), F.max(F.when(west, F.col("_lon"))).alias("_ew"), F.min("_lat").alias("_s"), F.max("_lat").alias("_n"),
        )
        wraps = F.col("_e") - F.col("_w") > F.coalesce(180 - F.col("_we"), F.lit(0.0)) + F.coalesce(F.col("_ew") + 180, F.lit(0.0))
        left, right = F.when(wraps, F.col("_we")).otherwise(F.col("_w")), F.when(wraps, F.col("_ew")).otherwise(F.col("_e"))
        (x0, y0), (x1, y1) = geo.lonlat_to_xy("G", left, F.col("_s")), geo.lonlat_to_xy("G", right, F.col("_n"))
    else:
        x, y = geo.lonlat_to_xy(g.projection, F.col("_lon"), F.col("_lat"))
        b = p.groupBy(*keys).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
        x0, x1, y0, y1 = (F.col(c) for c in ("_x0", "_x1", "_y0", "_y1"))
    col = lambda x: (x - g.first("x")) / g.step("x")
    up = lambda y: (y - (g.first("y") - (g.n_rows - 1) * g.step("y"))) / g.step("y")  # noqa: E731  rows from the bottom
    return b.select(*keys, low(col(x0), g.n_cols).alias("i_first"), high(col(x1), g.n_cols).alias("i_last"), (g.n_rows - 1 - high(up(y1), g.n_rows)).alias("j_first"), (g.n_rows - 1 - low(up(y0), g.n_rows)).alias("j_last"))


def window_cells(bounds: DataFrame, keys: list[str], grid: str) -> DataFrame:
    """(keys, cell_row, cell_col, lon, lat): each cell of the blocks."""
    from ..catalog import GRIDS

    g = GRIDS[grid]
    last = F.when(F.col("i_last") < F.col("i_first"), F.col("i_last") + g.n_cols).otherwise(F.col("i_last"))
    cells = bounds.select(*keys, F.explode(F.sequence("j_first", "j_last")).alias("cell_row"), "i_first", last.alias("_last"))
    cells = cells.select(*keys, "cell_row", F.explode(F.sequence("i_first", "_last")).alias("_i")).select(*keys, "cell_row", (F.col("_i") % g.n_cols).alias("cell_col"))
    lon, lat = geo.xy_to_lonlat(g.projection, *geo.cell_centre(g, F.col("cell_row"), F.col("cell_col")))
    return cells.withColumns({"lon": lon, "lat": lat})
