"""Map projections, distances and frames.

Every function works on Spark columns (m=SPARK, the default) and on numpy arrays (m=NUMPY): the formulas
are written once. Angles are degrees, lengths metres. Formulas: Snyder, Map Projections - A Working
Manual (1987); Brodzik et al., EASE-Grid 2.0 (2012).
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import GRIDS, Grid

SPARK = SimpleNamespace(
    sin=F.sin, cos=F.cos, tan=F.tan, asin=F.asin, acos=F.acos, atan=F.atan, atan2=F.atan2, exp=F.exp, ln=F.ln, sqrt=F.sqrt, abs=F.abs, floor=F.floor,
    rad=F.radians, deg=F.degrees, least=lambda x, c: F.least(x, F.lit(c)), greatest=lambda x, c: F.greatest(x, F.lit(c)), where=lambda c, x, y: F.when(c, x).otherwise(y), lit=F.lit,
)
NUMPY = SimpleNamespace(
    sin=np.sin, cos=np.cos, tan=np.tan, asin=np.arcsin, acos=np.arccos, atan=np.arctan, atan2=np.arctan2, exp=np.exp, ln=np.log, sqrt=np.sqrt, abs=np.abs, floor=np.floor,
    rad=np.radians, deg=np.degrees, least=np.minimum, greatest=np.maximum, where=np.where, lit=lambda x: x,
)

#: The ellipsoid of the equal-area grids.
A, E = 6378137.0, 0.081819190843
E2 = E * E
#: Spheres, each of one operator: neighbour search (the mean radius of common resampling libraries), cells without a search radius, Vincenty distances, altitude.
R_SEARCH, R_CELL, R_VINCENTY, R_ALTITUDE = 6370997.0, 6378000.0, (6378137.0 + 6356752.0) / 2, 6371000.0

_QP = 1 - (1 - E2) / (2 * E) * math.log((1 - E) / (1 + E))
_K0 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)
_AUTHALIC = (E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040, 23 * E2**2 / 360 + 251 * E2**3 / 3780, 761 * E2**3 / 45360)
#: WGS84, for the conformal projections.
_F = 1 / 298.257223563
_C2 = _F * (2 - _F)
_C = math.sqrt(_C2)
_CONFORMAL = (
    _C2 / 2 + 5 * _C2**2 / 24 + _C2**3 / 12 + 13 * _C2**4 / 360,
    7 * _C2**2 / 48 + 29 * _C2**3 / 240 + 811 * _C2**4 / 11520,
    7 * _C2**3 / 120 + 81 * _C2**4 / 1120,
    4279 * _C2**4 / 161280,
)


def _q(m, lat):
    s = m.sin(m.rad(lat))
    return (s / (1 - s * s * E2) - m.ln((1 - s * E) / (1 + s * E)) / (2 * E)) * (1 - E2)


def _series(m, x, terms):
    return x + sum(c * m.sin(x * (2 * (k + 1))) for k, c in enumerate(terms))


def _cea(m, lon, lat):
    return m.rad(lon) * (A * _K0), _q(m, lat) * (A / (2 * _K0))


def _cea_back(m, x, y):
    beta = m.asin(m.greatest(m.least(y * (2 * _K0 / (A * _QP)), 1.0), -1.0))
    return m.deg(x / (A * _K0)), m.deg(_series(m, beta, _AUTHALIC))


def _laea(sign):
    def forward(m, lon, lat):
        left = _q(m, lat) * -sign + _QP
        rho = m.where(m.abs(left) < 1e-6, m.lit(0.0), m.sqrt(m.greatest(left, 0.0)) * A)
        return rho * m.sin(m.rad(lon)), rho * m.cos(m.rad(lon)) * -sign

    def back(m, x, y):
        beta = m.asin(m.greatest((x * x + y * y) / (-A * A * _QP) + 1.0, -1.0)) * sign
        return m.deg(m.atan2(x, y * -sign)), m.deg(_series(m, beta, _AUTHALIC))

    return forward, back


def _t(m, lat):
    """exp(-isometric latitude) of a northern latitude."""
    s = m.sin(m.rad(lat))
    return m.tan(m.rad(lat) / -2 + math.pi / 4) / m.exp(m.ln((1 - s * _C) / (1 + s * _C)) * (_C / 2))


def _stereo(sign, lon0, scale, east):
    """scale: metres of rho for each unit of t."""

    def forward(m, lon, lat):
        rho, lam = _t(m, lat * sign) * scale, m.rad(lon - lon0)
        return rho * m.sin(lam) + east, rho * m.cos(lam) * -sign + east

    def back(m, x, y):
        x, y = x - east, y - east
        chi = m.atan(m.sqrt(x * x + y * y) / scale) * -2 + math.pi / 2
        lon = m.deg(m.atan2(x, y * -sign)) + lon0
        lon = m.where(lon <= -180.0, lon + 360.0, m.where(lon > 180.0, lon - 360.0, lon))
        return lon, m.deg(_series(m, chi, _CONFORMAL)) * sign

    return forward, back


def _true_at(lat):
    s, c = math.sin(math.radians(lat)), math.cos(math.radians(lat))
    t = math.tan(math.pi / 4 - math.radians(lat) / 2) / ((1 - _C * s) / (1 + _C * s)) ** (_C / 2)
    return A * c / math.sqrt(1 - _C2 * s * s) / t


_UPS = 2 * A * 0.994 / math.sqrt((1 + _C) ** (1 + _C) * (1 - _C) ** (1 - _C))


def _merc(m, lon, lat):
    return m.rad(lon) * A, m.ln(_t(m, lat)) * -A


def _merc_back(m, x, y):
    chi = m.atan(m.exp(y / -A)) * -2 + math.pi / 2
    return m.deg(x / A), m.deg(_series(m, chi, _CONFORMAL))


_FORMULAS = {
    "G": (_cea, _cea_back), "N": _laea(1), "S": _laea(-1), "PS_N": _stereo(1, -45.0, _true_at(70), 0.0), "PS_S": _stereo(-1, 0.0, _true_at(70), 0.0),
    "UPS_N": _stereo(1, 0.0, _UPS, 2e6), "UPS_S": _stereo(-1, 0.0, _UPS, 2e6), "MERC_G": (_merc, _merc_back),
}


def _formula(projection: str):
    if projection not in _FORMULAS:
        raise NotImplementedError(f"projection {projection} isn't supported")
    return _FORMULAS[projection]


def lonlat_to_xy(projection: str, lon, lat, m=SPARK):
    """(x, y) of a position, by one of PROJECTIONS."""
    return _formula(projection)[0](m, lon, lat)


def xy_to_lonlat(projection: str, x, y, m=SPARK):
    """(lon, lat) of a place on the map."""
    return _formula(projection)[1](m, x, y)


def scale_factor(projection: str, lat, m=SPARK):
    """How many metres on the map a metre on the ground takes at a latitude (polar stereographic)."""
    sign = 1.0 if projection.endswith("N") else -1.0
    s = m.sin(m.rad(lat * sign))
    rho = _t(m, lat * sign) * (_true_at(70) if projection.startswith("PS") else _UPS)
    return rho * m.sqrt(-(s * s * _C2) + 1) / (m.cos(m.rad(lat)) * A)


def cell_centre(grid: Grid | str, row, col):
    """(x, y) of a cell's centre."""
    g = GRIDS[grid] if isinstance(grid, str) else grid
    return col * g.step("x") + g.first("x"), row * -g.step("y") + g.first("y")


def nearest_cell(grid: Grid | str, x, y, m=SPARK):
    """(row, col) of the cell whose centre is nearest to (x, y), kept inside the grid."""
    g = GRIDS[grid] if isinstance(grid, str) else grid
    col = m.floor((x - g.first("x")) / g.step("x") + 0.5)
    row = m.floor((y - g.first("y")) / -g.step("y") + 0.5)
    return m.least(m.greatest(row, 0), g.n_rows - 1), m.least(m.greatest(col, 0), g.n_cols - 1)


def xy_to_rowcol(grid: Grid | str, x, y):
    """Fractional (row, col) on a grid centred on (0, 0)."""
    g = GRIDS[grid] if isinstance(grid, str) else grid
    return y / -g.res + (g.n_rows - 1) / 2, x / g.res + (g.n_cols - 1) / 2


def cell_area(grid: Grid | str, lat, m=SPARK):
    """Square metres of a cell; on stereographic grids it depends on the latitude."""
    g = GRIDS[grid] if isinstance(grid, str) else grid
    if g.family != "STEREO":
        return m.lit(g.res * g.res)
    k = scale_factor(g.projection, lat, m)
    return g.res * g.res / (k * k)


def to_sphere(lon, lat, m=SPARK, radius: float = R_SEARCH):
    """(X, Y, Z) on a sphere."""
    c = m.cos(m.rad(lat)) * radius
    return c * m.cos(m.rad(lon)), c * m.sin(m.rad(lon)), m.sin(m.rad(lat)) * radius


def to_ecef(lon, lat, m=SPARK):
    """(X, Y, Z) of a place on the WGS84 ellipsoid."""
    s, c = m.sin(m.rad(lat)), m.cos(m.rad(lat))
    n = A / m.sqrt(-(s * s * _C2) + 1)
    return n * c * m.cos(m.rad(lon)), n * c * m.sin(m.rad(lon)), n * s * (1 - _C2)


def from_ecef(x, y, z, m=SPARK):
    """(lon, lat) of a place on the WGS84 ellipsoid."""
    return m.deg(m.atan2(y, x)), m.deg(m.atan2(z, m.sqrt(x * x + y * y) * (1 - _C2)))


def great_circle(lon1, lat1, lon2, lat2, m=SPARK, radius: float = R_CELL):
    """Arc by the law of cosines, 0 for equal points."""
    p, q = m.rad(lat1), m.rad(lat2)
    c = m.sin(p) * m.sin(q) + m.cos(p) * m.cos(q) * m.cos(m.rad(lon2 - lon1))
    arc = m.acos(m.least(m.greatest(c, -1.0), 1.0)) * radius
    return m.where((lon1 == lon2) & (lat1 == lat2), m.lit(0.0), arc)


def vincenty(lon1, lat1, lon2, lat2, m=SPARK, radius: float = R_VINCENTY):
    """Arc on a sphere by Vincenty's formula, exact for near and opposite points as well."""
    p, q, d = m.rad(lat1), m.rad(lat2), m.rad(lon2 - lon1)
    u = m.cos(q) * m.sin(d)
    v = m.cos(p) * m.sin(q) - m.sin(p) * m.cos(q) * m.cos(d)
    return m.atan2(m.sqrt(u * u + v * v), m.sin(p) * m.sin(q) + m.cos(p) * m.cos(q) * m.cos(d)) * radius


def normalise(x, y, z, m=SPARK):
    """The unit vector; a zero vector stays as it is."""
    n = m.sqrt(x * x + y * y + z * z)
    n = m.where(n == 0.0, m.lit(1.0), n)
    return x / n, y / n, z / n


def cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def rotate(axis: str, angle, x, y, z, m=SPARK):
    """(x, y, z) turned about an axis by an angle in radians."""
    c, s = m.cos(angle), m.sin(angle)
    if axis == "x":
        return x, c * y - s * z, s * y + c * z
    if axis == "y":
        return c * x + s * z, y, c * z - s * x
    if axis == "z":
        return c * x - s * y, s * x + c * y, z
    raise ValueError("the axis must be x, y or z")


def change_of_frame(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The matrix that takes coordinates in the frame of the columns of `old` to that of `new`. ValueError if they span no space."""
    old, new = np.asarray(old, float).T, np.asarray(new, float).T
    if abs(np.linalg.det(old)) < 1e-12 or abs(np.linalg.det(new)) < 1e-12:
        raise ValueError("the axes don't span the space")
    return new @ np.linalg.inv(old)


def sphere_hit(angle: float, radius: float, height: float) -> tuple[float, float]:
    """Where a ray from (0, radius + height), tilted from straight down, first meets the circle. ValueError if it doesn't."""
    top, s, c = radius + height, math.sin(angle), math.cos(angle)
    inside = radius * radius - (top * s) ** 2
    if inside < 0:
        raise ValueError("the ray misses the sphere")
    t = top * c - math.sqrt(inside)
    return t * s, top - t * c


def morton(x: Column, y: Column, bits: int = 31) -> Column:
    """Bits of x and y interleaved, x in the even places; both from 0 to 2**bits - 1. A key for tiles that are near each other."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        one = F.shiftleft(F.shiftright(x.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), 2 * k)
        two = F.shiftleft(F.shiftright(y.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), 2 * k + 1)
        out = out.bitwiseOR(one).bitwiseOR(two)
    return out


def unmorton(z: Column, bits: int = 31) -> tuple[Column, Column]:
    """(x, y) of a code."""
    out = []
    for odd in (0, 1):
        v = F.lit(0).cast("long")
        for k in range(bits):
            v = v.bitwiseOR(F.shiftleft(F.shiftright(z, 2 * k + odd).bitwiseAND(F.lit(1).cast("long")), k))
        out.append(v)
    return out[0], out[1]


def uv_to_polar(u, v, m=SPARK):
    """(theta, phi) in radians of director cosines; phi from 0 up to 2 pi."""
    phi = m.atan2(v, u)
    return m.acos(m.sqrt(m.greatest(-(u * u) - v * v + 1, 0.0))), m.where(phi < 0, phi + 2 * math.pi, phi)


def polar_to_uv(theta, phi, m=SPARK):
    return m.sin(theta) * m.cos(phi), m.sin(theta) * m.sin(phi)
