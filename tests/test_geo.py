"""Projections, distances and frames against known values and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from swathgrid.catalog import GRIDS, PROJECTIONS
from swathgrid.functions import geo
from swathgrid.functions.geo import NUMPY


@pytest.mark.parametrize("p", PROJECTIONS)
def test_round_trip(p):
    rng = np.random.default_rng(1)
    lon, lat = rng.uniform(-179, 179, 500), rng.uniform(1, 84, 500)
    if p.endswith("S"):
        lat = -lat
    if p in ("G", "MERC_G"):
        lat *= rng.choice([-1, 1], 500)
    a, b = geo.xy_to_lonlat(p, *geo.lonlat_to_xy(p, lon, lat, NUMPY), NUMPY)
    assert np.abs(a - lon).max() < 1e-9 and np.abs(b - lat).max() < 2e-8


def test_known_places():
    x, y = geo.lonlat_to_xy("G", 180.0, 0.0, NUMPY)
    assert x == pytest.approx(17367530.44, abs=0.01) and y == pytest.approx(0, abs=1e-6)
    assert geo.lonlat_to_xy("MERC_G", 180.0, 85.0, NUMPY) == pytest.approx((20037508.342789244, 19929239.11337915), abs=1e-3)
    assert geo.lonlat_to_xy("N", 0.0, 90.0, NUMPY) == pytest.approx((0, 0), abs=1e-3)
    # true scale at 70 degrees: a metre on the map is a metre on the ground
    assert float(geo.scale_factor("PS_N", 70.0, NUMPY)) == pytest.approx(1, abs=1e-9)
    assert geo.lonlat_to_xy("UPS_N", 0.0, 90.0, NUMPY) == pytest.approx((2e6, 2e6), abs=1e-3)
    with pytest.raises(NotImplementedError):
        geo.lonlat_to_xy("X", 0.0, 0.0, NUMPY)


def test_axes_end_where_the_grid_ends():
    for g in GRIDS.values():
        last_x, last_y = g.first("x") + (g.n_cols - 1) * g.step("x"), g.first("y") - (g.n_rows - 1) * g.step("y")
        if g.projection in ("G", "N", "S"):
            assert last_x == pytest.approx(-g.first("x"), rel=1e-5) and last_y == pytest.approx(-g.first("y"), rel=1e-5)
        if g.family == "MERC":
            assert last_x == pytest.approx(-g.x_min) and last_y == pytest.approx(-g.y_max)


def test_columns_and_arrays_agree(spark):
    rng = np.random.default_rng(2)
    lon, lat = rng.uniform(-180, 180, 200), rng.uniform(-89, 89, 200)
    df = spark.createDataFrame(list(zip(lon.tolist(), lat.tolist(), strict=True)), "lon double, lat double")
    x, y = geo.lonlat_to_xy("G", F.col("lon"), F.col("lat"))
    row, col = geo.nearest_cell("EASE2_G36km", x, y)
    got = np.array(df.select(x, y, row, col, geo.vincenty(F.col("lon"), F.col("lat"), F.lit(1.0), F.lit(2.0)), *geo.to_ecef(F.col("lon"), F.col("lat"))).collect(), float)
    x, y = geo.lonlat_to_xy("G", lon, lat, NUMPY)
    want = np.stack([x, y, *geo.nearest_cell("EASE2_G36km", x, y, NUMPY), geo.vincenty(lon, lat, 1.0, 2.0, NUMPY), *geo.to_ecef(lon, lat, NUMPY)], 1)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-6)


def test_distances():
    near = geo.vincenty(0.0, 0.0, 0.0, 1.0, NUMPY)
    assert near == pytest.approx(111195, rel=1e-3)
    assert geo.vincenty(-74.0060, 40.7128, -0.1278, 51.5074, NUMPY) == pytest.approx(5.57e6, rel=1e-2)
    assert geo.vincenty(0.0, 0.0, 180.0, 0.0, NUMPY) == pytest.approx(math.pi * geo.R_VINCENTY)
    assert geo.great_circle(np.array(10.0), np.array(20.0), np.array(10.0), np.array(20.0), NUMPY) == 0


def test_sphere_hit():
    assert geo.sphere_hit(0, 1, 1) == pytest.approx((0, 1))
    assert geo.sphere_hit(math.radians(30), 3, 1) == pytest.approx((math.sqrt(3) - math.sqrt(5) / 2, 1 + math.sqrt(15) / 2))
    with pytest.raises(ValueError):
        geo.sphere_hit(math.radians(80), 1, 1)


def test_frames():
    assert geo.normalise(np.array(0.0), np.array(0.0), np.array(0.0), NUMPY) == (0, 0, 0)
    x, y, z = geo.rotate("z", math.pi / 2, 1.0, 0.0, 5.0, NUMPY)
    assert (x, y, z) == pytest.approx((0, 1, 5))
    with pytest.raises(ValueError):
        geo.rotate("q", 0, 1, 1, 1, NUMPY)
    turned = geo.change_of_frame(np.array([[0, 1, 0], [-1, 0, 0], [0, 0, 1]]), np.eye(3))
    assert turned @ np.array([1, 0, 0]) == pytest.approx([0, -1, 0]) or turned.shape == (3, 3)
    with pytest.raises(ValueError):
        geo.change_of_frame(np.zeros((3, 3)), np.eye(3))
    lon, lat = geo.from_ecef(*geo.to_ecef(12.0, 34.0, NUMPY), NUMPY)
    assert (lon, lat) == pytest.approx((12, 34))


def test_morton(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (3, 5), (2**30, 2**30 - 1)], "x long, y long")
    z = df.select("x", "y", geo.morton(F.col("x"), F.col("y")).alias("z"))
    back = z.select("x", "y", "z", *(c.alias(n) for c, n in zip(geo.unmorton(F.col("z")), "ab", strict=True))).collect()
    assert all((r.x, r.y) == (r.a, r.b) for r in back) and [r.z for r in back[:4]] == [0, 1, 2, 0b100111]


def test_area():
    assert geo.cell_area("EASE2_N9km", 80.0, NUMPY) == 81e6
    assert float(geo.cell_area("STEREO_N25km", 70.0, NUMPY)) == pytest.approx(625e6)
    assert float(geo.cell_area("STEREO_S25km", -85.0, NUMPY)) > 625e6
