"""Neighbour search, reductions, reconstructions, inversion and scores against brute force and known cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from swathgrid.catalog import GRIDS
from swathgrid.functions import geo, patterns
from swathgrid.functions.geo import NUMPY
from swathgrid.operators import inversion, metrics, neighbours, reconstruct, simple, sparse


def points(spark, lon, lat, start=0, name="sample_id", **more):
    return spark.createDataFrame(pd.DataFrame({name: np.arange(start, start + len(lon)), "longitude": lon, "latitude": lat, **more}))


def brute(s_lon, s_lat, t_lon, t_lat, radius, k):
    s, t = np.stack(geo.to_sphere(s_lon, s_lat, NUMPY), 1), np.stack(geo.to_sphere(t_lon, t_lat, NUMPY), 1)
    d = np.linalg.norm(t[:, None] - s[None], axis=2)
    out = {}
    for i, row in enumerate(d):
        order = sorted((round(x, 3), j) for j, x in enumerate(row) if x <= radius)[:k]
        if order:
            out[i] = [j for _, j in order]
    return out


@pytest.mark.parametrize("radius,k,spread", [(300_000.0, 3, "samples"), (300_000.0, 3, "targets"), (2_000_000.0, 1, "samples"), (50_000.0, 10, "targets"), (9_000_000.0, 2, "samples")])
def test_nearest_everywhere(spark, radius, k, spread):
    """Poles and the date line included."""
    rng = np.random.default_rng(3)
    s_lon, s_lat = rng.uniform(-180, 180, 400), np.degrees(np.arcsin(rng.uniform(-1, 1, 400)))
    t_lon, t_lat = np.concatenate([rng.uniform(-180, 180, 80), [0, 180, -180, 10]]), np.concatenate([rng.uniform(-90, 90, 80), [90, -90, 0, 89.9]])
    got = neighbours.nearest(points(spark, s_lon, s_lat), points(spark, t_lon, t_lat, name="target_id"), radius, k, (), ("longitude",), spread).orderBy("target_id", "rank").collect()
    assert all(r.longitude == s_lon[r.sample_id] for r in got)
    found = {}
    for r in got:
        found.setdefault(r.target_id, []).append(r.sample_id)
    assert found == brute(s_lon, s_lat, t_lon, t_lat, radius, k)


@pytest.mark.parametrize("radius,k", [(1_000_000.0, 6), (10_000_000.0, 3), (13_000_000.0, 1), (200_000.0, 4)])
def test_any_radius_is_the_same(spark, radius, k):
    """A swath and targets all over the sphere, near and far, poles and date line included; two scan directions, equal places."""
    rng = np.random.default_rng(4)
    along, across = rng.uniform(-80, 80, 3000), rng.normal(0, 4, 3000)
    s_lon, s_lat = (along / 2 + across + 170 + 180) % 360 - 180, along
    s_lon[100:140], s_lat[100:140] = s_lon[0], s_lat[0]
    t_lon, t_lat = np.concatenate([rng.uniform(-180, 180, 150), [0, 180, -180, 10], s_lon[:20]]), np.concatenate([rng.uniform(-90, 90, 150), [90, -90, 0, 89.9], s_lat[:20]])
    s = points(spark, s_lon, s_lat).withColumn("scan_direction", F.when(F.col("sample_id") % 3 == 0, "aft").otherwise("fore"))
    t = points(spark, t_lon, t_lat, name="target_id")
    got: dict = {"aft": {}, "fore": {}}
    rows = neighbours.nearest_any(s, t, radius, k, ("scan_direction",), ("longitude",)).orderBy("target_id", "rank").collect()
    assert all(r.longitude == s_lon[r.sample_id] for r in rows)
    for r in rows:
        got[r.scan_direction].setdefault(r.target_id, []).append(r.sample_id)
    for way, own in (("aft", np.arange(3000) % 3 == 0), ("fore", np.arange(3000) % 3 > 0)):
        number = np.flatnonzero(own)
        want = brute(s_lon[own], s_lat[own], t_lon, t_lat, radius, k)
        assert got[way] == {i: [number[j] for j in js] for i, js in want.items()}


def test_what_a_wide_search_compares(spark):
    """Pairs grow with k times the targets, not with the radius or the samples."""
    rng = np.random.default_rng(6)

    def pairs(n, targets, radius, k):
        lat = rng.uniform(-70, 70, n)
        s = points(spark, lat / 2 + rng.uniform(-8, 8, n), lat)
        t_lat = rng.uniform(-70, 70, targets)
        t = points(spark, t_lat / 2 + rng.uniform(-8, 8, targets), t_lat, name="target_id")
        return neighbours.nearest_any(s, t, radius, k, candidates=True).count() / (targets * k)

    for n in (3000, 24_000):
        near, far = (pairs(n, 1500, radius, 6) for radius in (1e6, 1e7))
        assert near < 100 and far < 100


def test_what_a_search_moves_and_takes_of_one_place(spark):
    """No exchange carries pairs: samples, targets, counts and lists of cubes only. 5000 samples at one place, and more targets there than a task takes."""
    s = points(spark, np.full(5000, 7.0), np.full(5000, 50.0)).withColumn("scan_direction", F.when(F.col("sample_id") % 2 == 0, "fore"))
    t = points(spark, np.full(neighbours.DEAL + 50, 7.0), np.full(neighbours.DEAL + 50, 50.5), name="target_id")
    found = neighbours.nearest_any(s, t, 1e6, 2, ("scan_direction",))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("FlatMapCoGroupsInArrow")  # nothing is ranked or moved after a block's search
    rows = found.groupBy("scan_direction", "sample_id", "rank").count().collect()
    assert {tuple(r) for r in rows} == {("fore", 0, 1, neighbours.DEAL + 50), ("fore", 2, 2, neighbours.DEAL + 50)}
    at, of, d, rank = neighbours._closest(np.zeros((3, 3)), np.zeros((100, 3)), np.arange(100)[::-1], 4, 1.0, False, False)
    assert of.tolist() == [99, 98, 97, 96] * 3 and rank.tolist() == [0, 1, 2, 3] * 3 and not d.any()


def test_any_radius_with_nothing_to_find(spark):
    s = points(spark, [0.0], [0.0])
    bad = spark.createDataFrame([(1, None, 0.0), (2, 0.0, 99.0)], "sample_id long, longitude double, latitude double")
    t = s.withColumnRenamed("sample_id", "target_id")
    assert neighbours.nearest_any(bad, t, 1e7, 1).collect() == [] == neighbours.nearest_any(s.where("false"), t, 1e7, 1, n_samples=9).collect()
    got = neighbours.nearest_any(s, t, 1e7, 5, n_samples=10**6).collect()
    assert [(r.target_id, r.sample_id, r["rank"]) for r in got] == [(0, 0, 1)]


def test_search_refuses_nonsense(spark):
    s = points(spark, [0.0], [0.0])
    for radius, k in ((-10.0, 1), (10.0, 0), (10.0, 1.5)):
        with pytest.raises(ValueError):
            neighbours.nearest(s, s.withColumnRenamed("sample_id", "target_id"), radius, k)
    bad = spark.createDataFrame([(1, None, 0.0), (2, 0.0, 99.0)], "sample_id long, longitude double, latitude double")
    assert neighbours.nearest(bad, s.withColumnRenamed("sample_id", "target_id"), 1e6, 1).collect() == []


def test_cells_hold_what_falls_into_them(spark):
    g = GRIDS["EASE2_N36km"]
    rng = np.random.default_rng(5)
    lon, lat = rng.uniform(-180, 180, 200), rng.uniform(30, 90, 200)
    got = neighbours.assign_cells(points(spark, lon, lat), "EASE2_N36km").orderBy("sample_id").toPandas()
    x, y = geo.lonlat_to_xy("N", lon, lat, NUMPY)
    cx, cy = geo.cell_centre(g, got["cell_row"].to_numpy(), got["cell_col"].to_numpy())
    assert np.abs(cx - x).max() <= g.res / 2 + 1 and np.abs(cy - y).max() <= g.res / 2 + 1
    assert got["distance"].max() < g.res


def test_targets_of_a_block(spark):
    t = neighbours.grid_targets(spark, "EASE2_G36km", rows=(10, 12), cols=(5, 6)).collect()
    assert sorted((r.cell_row, r.cell_col) for r in t) == [(i, j) for i in (10, 11, 12) for j in (5, 6)]
    assert all(r.target_id == r.cell_row * 964 + r.cell_col for r in t)


def rows(spark):
    return spark.createDataFrame(
        [(1, 10, 1.0, 5.0, 0.3), (1, 11, 2.0, 9.0, 0.3), (1, 12, 3.0, None, 0.3), (2, 13, 0.0, 7.0, 0.2), (2, 14, 1.0, 1.0, 0.4), (3, 15, 2.0, 8.0, 0.1), (3, 16, 2.0, 4.0, 0.1)],
        "target_id long, sample_id long, distance double, v double, nedt double",
    )


def test_simple_reductions(spark):
    nn = {r.target_id: r.v for r in simple.nn(rows(spark), ["target_id"], ["v"]).collect()}
    assert nn == {1: 5.0, 2: 7.0, 3: 8.0}
    dib = {r.target_id: r.v for r in simple.dib(rows(spark), ["target_id"], ["v"]).collect()}
    assert dib == {1: 7.0, 2: 4.0, 3: 6.0}
    ids = {r.target_id: (r.v, r.nedt) for r in simple.ids(rows(spark), ["target_id"], ["v"], ["nedt"]).collect()}
    w = np.array([1, 1 / 4, 1 / 9])
    assert ids[1] == pytest.approx(((5 + 9 / 4) / (1 + 1 / 4), 0.3 * (w**2).sum() / w.sum() ** 2))
    assert ids[2] == pytest.approx((7.0, 0.2))  # right at the sample: its own value
    assert {r.target_id: r.regridding_n_samples for r in simple.n_samples(rows(spark), ["target_id"]).collect()} == {1: 3, 2: 2, 3: 2}


def test_pivot_and_back(spark):
    long = spark.createDataFrame([(1, "fore", 1.0), (1, "aft", 2.0), (2, "aft", 3.0)], "cell long, scan_direction string, v double")
    wide = simple.pivot_directions(long, ["cell"], ["v"])
    assert {(r.cell, r.v_fore, r.v_aft) for r in wide.collect()} == {(1, 1.0, 2.0), (2, None, 3.0)}
    assert {tuple(r) for r in simple.unpivot_directions(wide, ["cell"], ["v"]).collect()} == {tuple(r) for r in long.collect()}


def test_bg_weights():
    rng = np.random.default_rng(6)
    p = patterns.normalised(rng.uniform(0, 1, (5, 4, 50)), None)
    t = patterns.normalised(rng.uniform(0, 1, (5, 50)), None)
    there = np.array([[1, 1, 1, 1], [1, 1, 1, 0], [1, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, 0]], bool)
    a = reconstruct.bg_weights(p, t, there, 0.01)
    assert np.allclose(a[:4].sum(1), 1) and a[3].tolist() == pytest.approx([1, 0, 0, 0]) and np.isnan(a[4]).all()
    assert (a[:4][~there[:4]] == 0).all()
    # two samples: the textbook solution
    g = p[2, :2] @ p[2, :2].T + 0.01 * np.eye(2)
    u, v = np.ones(2), p[2, :2] @ t[2]
    inv = np.linalg.inv(g)
    want = inv @ (v + (1 - u @ inv @ v) / (u @ inv @ u) * u)
    assert a[2, :2] == pytest.approx(want)
    same = np.repeat(p[:1, :1], 2, 1)
    assert np.isnan(reconstruct.bg_weights(same, t[:1], np.ones((1, 2), bool))).all()  # singular


def test_rsir_against_loops():
    rng = np.random.default_rng(7)
    p, t, z = patterns.normalised(rng.uniform(0, 1, (1, 3, 20)), None), patterns.normalised(rng.uniform(0, 1, (1, 20)), None), rng.uniform(150, 250, (1, 3))
    h = p[0]
    a = (h * z[0][:, None]).sum(0) / h.sum(0)
    for k in range(4):
        assert reconstruct.rsir(p, t, z, k)[0] == pytest.approx((t[0] * a).sum())
        f = (h * a).sum(1) / h.sum(1)
        d = np.sqrt(z[0] / f)
        u = np.array([[1 / ((1 - 1 / d[i]) / (2 * f[i]) + 1 / (a[j] * d[i])) if d[i] >= 1 else 0.5 * f[i] * (1 - d[i]) + a[j] * d[i] for j in range(20)] for i in range(3)])
        a = (h * u).sum(0) / h.sum(0)
    assert np.isnan(reconstruct.rsir(p, t, np.full((1, 3), np.nan), 2))[0]


def test_reconstructions_keep_a_constant_scene(spark):
    rng = np.random.default_rng(8)
    s = points(spark, rng.uniform(5, 12, 150), rng.uniform(40, 46, 150), bt_h=np.full(150, 222.0), nedt_h=np.full(150, 0.3)).withColumn("scan_direction", F.lit("all"))
    t = neighbours.grid_targets(spark, "EASE2_G36km", rows=(64, 70), cols=(500, 508))
    n = neighbours.nearest(s, t, 80000.0, 5, ("scan_direction",))
    f = reconstruct.Footprints("EASE2_G36km", 50000.0, 50000.0, 36032.22)
    bg = reconstruct.backus_gilbert(n, s, t, ["bt_h"], f, 0.01, ["nedt_h"], 0.1, ("scan_direction",)).toPandas()
    assert len(bg) > 20 and np.allclose(bg["bt_h"].dropna(), 222.0) and (bg["nedt_h"].dropna() >= 0.1).all()
    rs = reconstruct.reconstruct_rsir(n, s, t, ["bt_h"], f, 3, ("scan_direction",)).toPandas()
    assert len(rs) == len(bg) and np.allclose(rs["bt_h"].dropna(), 222.0)
    cg = inversion.invert(s, ["bt_h"], f, "CG", 16, 1.0, 1e-6, 200, 1e-8, keys=("scan_direction",)).toPandas().dropna()
    s_rows = s.toPandas()
    x, y = geo.lonlat_to_xy("G", s_rows["longitude"].to_numpy(), s_rows["latitude"].to_numpy(), NUMPY)
    row, col = geo.nearest_cell("EASE2_G36km", x, y, NUMPY)
    image = {(r.cell_row, r.cell_col): r.bt_h for r in cg.itertuples()}
    inner = [image[k] for k in zip(row.astype(int), col.astype(int), strict=True) if k in image]
    assert np.median(inner) == pytest.approx(222, rel=0.2)


@pytest.mark.parametrize("a,y", [([[4, 1], [1, 3]], [1, 2]), (np.diag([1.0, 2, 3, 4, 5]) + 0.1, [1, 2, 3, 4, 5])])
def test_solvers(a, y):
    a, y = np.array(a, float), np.array(y, float)
    exact = np.linalg.solve(a, y)
    x, steps = inversion.conjugate_gradient(a, y, 0.0, 1000, 1e-10)
    assert x == pytest.approx(exact, rel=1e-6) and steps <= 10
    x, steps = inversion.landweber(a, y, 0.0, None, 20000, 1e-4)
    assert np.linalg.norm(a @ x - y) / np.linalg.norm(y) < 1e-4 and steps < 20000
    damped, _ = inversion.conjugate_gradient(a, y, 0.5, 1000, 1e-12)
    assert damped == pytest.approx(np.linalg.solve(a.T @ a + 0.5 * np.eye(len(y)), a.T @ y), rel=1e-6)


def test_bilinear(spark):
    image = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(200, 206) for j in range(480, 486)], "cell_row long, cell_col long, v double")
    g = GRIDS["EASE2_G36km"]
    at = [(202.0, 482.0), (202.5, 482.25), (203.9, 484.1)]
    lonlat = [geo.xy_to_lonlat("G", *geo.cell_centre(g, r, c), NUMPY) for r, c in at]
    t = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(lonlat)], "target_id long, longitude double, latitude double")
    got = {r.target_id: r.v for r in inversion.bilinear(image, t, "EASE2_G36km", ["v"]).collect()}
    assert [got[k] for k in range(3)] == pytest.approx([10 * r + c for r, c in at], abs=1e-3)


def test_scores(spark):
    image = spark.createDataFrame([(0, 0, 2.0), (0, 1, 4.0), (1, 0, 6.0), (1, 1, None)], "cell_row long, cell_col long, v double")
    truth = spark.createDataFrame([(0, 0, 1.0), (0, 1, 5.0), (1, 0, 6.0), (1, 1, 3.0)], "cell_row long, cell_col long, v double")
    r = metrics.scores(metrics.pair(image, truth, "v")).first()
    assert r.rmse == pytest.approx(math.sqrt(2 / 3)) and r.mae == pytest.approx(2 / 3) and r.peak_error == 0 and r.valid_pixel_overlap == 0.75
    assert r.normalised_difference == pytest.approx(math.sqrt(2) / math.sqrt(62)) and r.correlation == pytest.approx(np.corrcoef([2, 4, 6], [1, 5, 6])[0, 1])
    ramp = spark.createDataFrame([(i, j, float(2 * j)) for i in range(5) for j in range(5)], "cell_row long, cell_col long, v double")
    assert metrics.gradient_sum(ramp, "v").first()[0] == pytest.approx(9 * 16)
    half = ramp.withColumn("v", F.col("v") / 2)
    assert metrics.sharpening_factor(ramp, half, "v").first()[0] == pytest.approx(2)


def test_used_and_unused(spark):
    s = points(spark, [0.0, 1.0, 50.0], [0.0, 0.0, 0.0])
    n = spark.createDataFrame([(9, 0), (8, 0), (8, 1)], "target_id long, sample_id long")
    assert {r.sample_id: r.used for r in neighbours.used_samples(s, n).collect()} == {0: 1, 1: 1, 2: 0}
    assert [r.sample_id for r in neighbours.orphans(s, n).collect()] == [2]


# ---- patterns


def test_gaussian_patterns():
    assert patterns.gaussian_radius(1000, 2000, 0.001) == pytest.approx(2000 * math.sqrt(-2 * math.log(0.001)))
    lon, lat = np.meshgrid(np.linspace(-1, 1, 21), np.linspace(-1, 1, 21))
    g = patterns.normalised(patterns.gaussian_raw(lon.ravel(), lat.ravel(), 0.0, 0.0, 30000.0, 60000.0, 0.0, NUMPY))
    assert g.sum() == pytest.approx(1) and g.argmax() == 220
    wide = g.reshape(21, 21)
    assert wide[10, 13] < wide[13, 10]  # narrow along the parallel
    assert patterns.footprint_radius(0.0, 100000.0, math.radians(2)) == pytest.approx(1.1 * 3492.1105641045438)


def test_windows_follow_the_neighbours(spark):
    """The same values however wide the search was, at any latitude, and windows no larger than the neighbours need."""
    rng = np.random.default_rng(12)
    lon, lat = np.concatenate([rng.uniform(-1, 1, 150), rng.uniform(-3, 3, 150)]), np.concatenate([rng.uniform(-1, 1, 150), rng.uniform(71, 72, 150)])
    s = points(spark, lon, lat, bt_h=rng.uniform(150, 250, 300))
    t = points(spark, np.concatenate([rng.uniform(-0.7, 0.7, 20), rng.uniform(-2, 2, 20)]), np.concatenate([rng.uniform(-0.7, 0.7, 20), rng.uniform(71.2, 71.8, 20)]), name="target_id").withColumns({"cell_row": F.lit(0), "cell_col": F.lit(0)})
    f = reconstruct.Footprints("EASE2_G9km", 15000.0, 15000.0, 12000.0, threshold=0.05, target_threshold=0.05)
    near, far = (neighbours.nearest_any(s, t, radius, 3) for radius in (90_000.0, 5e6))
    for run in (lambda n: reconstruct.backus_gilbert(n, s, t, ["bt_h"], f, 0.01), lambda n: reconstruct.reconstruct_rsir(n, s, t, ["bt_h"], f, 3)):
        one, two = ({r.target_id: r.bt_h for r in run(n).collect()} for n in (near, far))
        assert len(one) == 40 and one == pytest.approx(two, rel=1e-9)
    halves = reconstruct._halves(f, np.zeros(2), np.array([0.0, 71.0]), np.array([[0.2, np.nan], [0.2, 0.3]]), np.array([[0.1, np.nan], [71.0, 71.1]]))
    around = math.ceil(patterns.gaussian_radius(15000.0, 15000.0, 0.05) / 9008.05) + 1
    assert halves.tolist() == [[around + 2, around + 2], [around, around + 3]]


def test_window_and_date_line(spark):
    df = spark.createDataFrame([(1, 179.9, 0.0), (1, -179.9, 0.0), (2, 0.0, 0.0)], "k long, longitude double, latitude double")
    got = {r.k: r for r in patterns.window_bounds(df, ["k"], "EASE2_G36km", 50000.0).collect()}
    assert got[1].i_first > got[1].i_last and got[2].i_first < got[2].i_last
    cells = patterns.window_cells(patterns.window_bounds(df, ["k"], "EASE2_G36km", 50000.0), ["k"], "EASE2_G36km")
    assert cells.where("k = 1").count() < 60 and cells.where("k = 1").agg(F.min(F.abs("lon"))).first()[0] > 178
    pole = spark.createDataFrame([(1, 0.0, 89.9)], "k long, longitude double, latitude double")
    b = patterns.window_bounds(pole, ["k"], "EASE2_N36km", 40000.0).first()
    assert b.i_first < 250 <= b.i_last and b.j_first < 250 <= b.j_last + 1


def test_tabulated_pattern_on_the_ground():
    phi, theta = np.linspace(0, 2 * np.pi, 73), np.linspace(0, np.radians(10), 41)
    g = np.exp(-(theta[None, :] ** 2) / 0.002) + 0 * phi[:, None]
    zero = np.zeros_like(g)
    table = {f"G{k}{p}": g if k == 1 else zero for k in range(1, 5) for p in "hv"}
    ap = patterns.Tabulated.of(phi, theta, table, threshold=0.01)
    assert ap.scalar(np.array([0.3]), np.array([0.0]))[0] == pytest.approx(ap._norm(ap.hco, ap.hcx, ap.vco, ap.vcx).max())
    assert ap.scalar(np.array([0.3]), np.array([0.5]))[0] == 0 and 0 < ap.below < 0.2 and ap.widest() < theta[-1]
    m = ap.mueller(np.array([1.0]), np.array([0.01]))[0]
    assert m.shape == (4, 4) and m[0, 0] == pytest.approx(m[1, 1]) and m[0, 1] == 0
    position = np.array([7e6, 0.0, 0.0])
    attitude = patterns.attitude_from_motion(position, np.array([0.0, 7000.0, 0.0]))
    axes = patterns.antenna_axes(0.0, 0.0)
    lon, lat = patterns.boresight_to_earth(position, attitude, axes)
    assert (lon, lat) == pytest.approx((0, 0), abs=1e-9)
    cells = np.meshgrid(np.linspace(-0.5, 0.5, 11), np.linspace(-0.5, 0.5, 11))
    share = patterns.to_earth(ap.scalar, *cells, position, attitude, axes)
    assert share.sum() == pytest.approx(1) and share.argmax() == 60
    away = patterns.antenna_axes(math.radians(80), 0.0)
    assert math.isnan(patterns.boresight_to_earth(position, attitude, away)[0])


def test_bg_with_projected_patterns(spark):
    """An instrument straight above its samples: patterns are seen where the samples lie."""
    phi, theta = np.linspace(0, 2 * np.pi, 37), np.linspace(0, np.radians(6), 31)
    g = np.exp(-(theta[None, :] ** 2) / 0.0008) + 0 * phi[:, None]
    horn = patterns.Tabulated.of(phi, theta, {f"G{k}{p}": g if k == 1 else 0 * g for k in range(1, 5) for p in "hv"})
    lon, lat = np.array([10.0, 10.5, 11.0]), np.array([45.0, 45.2, 45.1])
    up = np.stack(geo.to_ecef(lon, lat, NUMPY), 1) * (1 + 8e5 / 6.37e6)
    east = np.stack([-np.sin(np.radians(lon)), np.cos(np.radians(lon)), 0 * lon], 1) * 7000
    more = {f"{a}_position": up[:, i] for i, a in enumerate("xyz")} | {f"{a}_velocity": east[:, i] for i, a in enumerate("xyz")}
    s = points(spark, lon, lat, bt_h=np.array([200.0, 210.0, 220.0]), processing_scan_angle=np.zeros(3), feed_horn_number=np.zeros(3, int), **more)
    t = points(spark, lon[:1] + 0.01, lat[:1], name="target_id").withColumns({"cell_row": F.lit(0), "cell_col": F.lit(0)})
    n = neighbours.nearest(s, t, 150000.0, 3)
    source = reconstruct.Projected({0: horn.scalar}, 0.0, 100000.0)
    f = reconstruct.Footprints("EASE2_G9km", target=15000.0, source=source)
    got = reconstruct.backus_gilbert(n, s, t, ["bt_h"], f, 1e-4).first()
    assert got.regridding_n_samples == 3 and abs(got.bt_h - 200) < 6
    again = reconstruct.reconstruct_rsir(n, s, t, ["bt_h"], f, 3).first()
    assert 190 < again.bt_h < 225


def test_normal_equations_of_pieces():
    random = np.random.default_rng(5)
    a, y = random.random((40, 6)), random.random((40, 2))
    y[3, 0] = y[7, 1] = y[9, 1] = np.nan
    held = inversion._summed(inversion.normal_equations(a[i : i + 9], y[i : i + 9]) for i in range(0, 40, 9))
    for v in range(2):
        there = ~np.isnan(y[:, v])
        square = held["square"] + held.get(f"square{v}", 0.0)
        assert square == pytest.approx(a[there].T @ a[there])
        assert held["right"][:, v] == pytest.approx(a[there].T @ y[there, v]) and held["size"][v] == pytest.approx((y[there, v] ** 2).sum())
        for whole, normal in inversion.METHODS.values():
            x, steps = whole(a[there], y[there, v], 1e-3, iterations=60, tolerance=1e-2)
            again, taken = normal(square, held["right"][:, v], float(held["size"][v]), 1e-3, iterations=60, tolerance=1e-2)
            assert steps == taken and again == pytest.approx(x, rel=1e-6)


def test_rows_by_their_entries():
    """Compressed rows give what the full matrix gives: products, norm of A'A, both methods; empty rows and stretches too."""
    random = np.random.default_rng(8)
    full = np.where(random.random((300, 50)) < 0.1, random.random((300, 50)), 0.0)
    full[[0, 131, 299]] = 0.0
    rows = sparse.Rows.of((full[i : i + 70] for i in range(0, 300, 70)), 50)
    x, y = random.random(50), random.random(300)
    assert rows.shape == (300, 50) and rows @ x == pytest.approx(full @ x) and rows.T @ y == pytest.approx(full.T @ y)
    assert rows.square_norm() == pytest.approx(np.linalg.norm(full.T @ full)) and rows.column_sums() == pytest.approx(full.sum(0))
    assert np.array_equal(np.concatenate(list(rows.stretches())), full)
    there = random.random(300) < 0.5
    assert np.array_equal(np.concatenate(list(rows.chosen(there).stretches())), full[there])
    assert sparse.Rows.of([], 50) @ x == pytest.approx(np.zeros(0)) and sparse.Rows.of([], 50).square_norm() == 0
    for whole, _ in inversion.METHODS.values():
        a, steps = whole(full, y, 1e-3, iterations=40)
        b, taken = whole(rows, y, 1e-3, iterations=40)
        assert steps == taken and b == pytest.approx(a, rel=1e-8, abs=1e-8)


def test_many_rows_are_gone_through_once(monkeypatch):
    """Norm and normal equations of more rows than cells take no pairs of stretches, and only the cells that a stretch reaches."""
    rng = np.random.default_rng(12)
    full = np.zeros((900, 60))
    for i in range(900):
        full[i, i // 20 : i // 20 + 6] = rng.uniform(0.1, 1, 6)
    a = sparse.Rows.of([full], 60)
    assert max(len(c) for c, _ in a.reached()) < 20
    y = rng.normal(size=(900, 2))
    y[::7, 1] = np.nan
    monkeypatch.setattr(sparse.Rows, "stretches", None)
    assert a.square_norm() == pytest.approx(np.linalg.norm(full.T @ full))
    got, want = inversion._normal_of({"count": a.count, "cell": a.cell, "share": a.share, "y": y}, 60), inversion.normal_equations(full, y)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_pieces_together():
    """Rows stay rows while they are smaller than A'A; beyond that they add up to the same normal equations."""
    random = np.random.default_rng(9)
    full, y = np.where(random.random((900, 12)) < 0.3, 1.0, 0.0), random.random((900, 2))
    y[::7, 1] = np.nan
    parts = []
    for i in range(0, 900, 300):
        a = sparse.Rows.of([full[i : i + 300]], 12)
        parts.append({"count": a.count, "cell": a.cell, "share": a.share, "y": y[i : i + 300]})
    assert "count" in inversion.together(parts, 12000) and len(inversion.together(parts, 12000)["y"]) == 900
    got, want = inversion.together(parts, 12), inversion.normal_equations(full, y)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_fine_integration_grid_needs_no_square(spark):
    """On a 3 km grid with footprints of 20 km the rows of a tile are a small part of its A'A, and give the same image as a matrix
    (once converged: conjugate gradients magnify rounding on the way)."""
    random = np.random.default_rng(3)
    n, g = 400, GRIDS["EASE2_N3km"]
    lon, lat = random.uniform(10, 11.2, n), random.uniform(79, 79.4, n)
    y = 200 + 20 * np.sin(3 * lon)
    s = points(spark, lon, lat, bt_h=y)
    f = reconstruct.Footprints(g.name, 20000.0, 20000.0, 20000.0)
    image = inversion.invert(s, ["bt_h"], f, "CG", 32, 1.3, 1e-3, 400, 1e-12).toPandas()

    rim = int(np.ceil(1.3 * patterns.gaussian_radius(20000.0, 20000.0, f.threshold) / g.res))
    row, col = geo.nearest_cell(g, *geo.lonlat_to_xy(g.projection, lon, lat, geo.NUMPY), geo.NUMPY)
    tr, tc = int(np.median(row)) // 32, int(np.median(col)) // 32
    rr, cc = (x.ravel() for x in np.meshgrid(np.arange(tr * 32 - rim, tr * 32 + 32 + rim), np.arange(tc * 32 - rim, tc * 32 + 32 + rim), indexing="ij"))
    near = (abs(row - tr * 32 - 15.5) <= 16 + rim) & (abs(col - tc * 32 - 15.5) <= 16 + rim)
    c_lon, c_lat = geo.xy_to_lonlat(g.projection, *geo.cell_centre(g, rr, cc), geo.NUMPY)
    full = patterns.normalised(patterns.gaussian_raw(c_lon[None], c_lat[None], lon[near, None], lat[near, None], 20000.0, 20000.0, 0.0, geo.NUMPY), f.threshold)
    rows = sparse.Rows.of([full], len(rr))
    assert near.sum() > 100 and 20 * rows.nbytes < 8 * len(rr) ** 2
    want, _ = inversion.conjugate_gradient(full, y[near], 1e-3, 400, 1e-12)
    keep = (rr // 32 == tr) & (cc // 32 == tc) & (full.sum(0) > 0)
    got = image.set_index(["cell_row", "cell_col"])["bt_h"]
    assert keep.sum() > 50 and np.allclose([got[r, c] for r, c in zip(rr[keep], cc[keep], strict=True)], want[keep], rtol=1e-6)


@pytest.mark.parametrize("method", ["CG", "LW"])
def test_a_full_tile_goes_in_pieces(spark, method):
    """A place with many samples gives the same image however it is cut; samples without a value count for the others."""
    rows = [(k, "fore" if k % 3 else None, 0.3 * (k % 17), 75.0 + 0.11 * (k % 13), 200.0 + k % 7, None if k % 5 == 0 else 150.0 + k % 4) for k in range(120)]
    s = spark.createDataFrame(rows, "sample_id long, scan_direction string, longitude double, latitude double, bt_h double, bt_v double")
    f = reconstruct.Footprints("EASE2_N36km", 30000.0, 30000.0, 36000.0)
    at = ["scan_direction", "cell_row", "cell_col"]
    got = [inversion.invert(s, ["bt_h", "bt_v"], f, method, 16, 1.0, 1e-3, 400 if method == "CG" else 30, 1e-11, keys=("scan_direction",), piece=n).toPandas().sort_values(at).reset_index(drop=True) for n in (4096, 5)]
    assert len(got[0]) > 200 and got[0]["bt_v"].notna().any() and got[0]["bt_h"].isna().any()
    for other in got[1:]:
        assert other[at].equals(got[0][at])
        for v in ("bt_h", "bt_v"):
            assert np.allclose(other[v], got[0][v], rtol=1e-6, equal_nan=True)


@pytest.fixture(scope="module")
def instrument():
    phi, theta = np.linspace(0, 2 * np.pi, 37), np.linspace(0, np.radians(6), 31)
    g = np.exp(-(theta[None, :] ** 2) / 0.0008) * (1 + 0.3 * np.cos(phi[:, None]))
    return patterns.Tabulated.of(phi, theta, {f"G{k}{p}": g if k == 1 else 0 * g for k in range(1, 5) for p in "hv"}, threshold=0.05)


def flown(n, tilt=math.radians(30), seed=3):
    """(lon, lat, position, velocity, scan) of samples that a tilted antenna sees from a flight to the east."""
    rng = np.random.default_rng(seed)
    position = np.stack(geo.to_ecef(10 + rng.uniform(-1, 1, n), 45 + rng.uniform(-1, 1, n), NUMPY), 1) * (1 + 8e5 / 6.37e6)
    lon = np.arctan2(position[:, 1], position[:, 0])
    velocity, scan = np.stack([-np.sin(lon), np.cos(lon), 0 * lon], 1) * 7000, rng.uniform(0, 360, n)
    frame = patterns.attitude_from_motion(position, velocity)
    places = [patterns.boresight_to_earth(p, a, x) for p, a, x in zip(position, frame, patterns.antenna_axes(tilt, np.radians(scan)), strict=True)]
    return *np.array(places).T, position, velocity, scan


def columns_of(position, velocity, scan, attitude=None):
    out = {f"{a}_{w}": x[:, i][:, None] for w, x in (("position", position), ("velocity", velocity)) for i, a in enumerate("xyz")}
    out |= {"processing_scan_angle": scan[:, None], "feed_horn_number": np.zeros((len(scan), 1))}
    return out | ({c: attitude.reshape(-1, 9)[:, i][:, None] for i, c in enumerate(reconstruct.ATTITUDE)} if attitude is not None else {})


def test_projected_patterns_against_one_at_a_time(instrument):
    """All samples of a stack at once give what each gives by itself, and the pattern's middle lies where the sample does."""
    lon, lat, position, velocity, scan = flown(7)
    cells = np.stack([x.ravel() for x in np.meshgrid(np.linspace(-0.6, 0.6, 25), np.linspace(-0.6, 0.6, 25))])
    w_lon, w_lat = lon[:, None] + cells[0], lat[:, None] + cells[1]
    inside = np.ones(w_lon.shape, bool)
    source = reconstruct.Projected({0: instrument.scalar}, math.radians(30), 1e5)
    got = source.on(w_lon, w_lat, inside, columns_of(position, velocity, scan))
    for i in range(7):
        axes = patterns.antenna_axes(math.radians(30), math.radians(scan[i]))
        want = patterns.to_earth(instrument.scalar, w_lon[i], w_lat[i], position[i], patterns.attitude_from_motion(position[i], velocity[i]), axes)
        assert got[i, 0] == pytest.approx(want, abs=1e-12) and got[i, 0].sum() == pytest.approx(1)
        assert abs((got[i, 0] * w_lon[i]).sum() - lon[i]) < 0.2 and abs((got[i, 0] * w_lat[i]).sum() - lat[i]) < 0.2


def test_attitude_of_each_sample(instrument):
    """The frame from the motion changes nothing, a missing element falls back to it, and a rolled one moves the pattern to where its boresight goes."""
    lon, lat, position, velocity, scan = flown(6)
    frame = patterns.attitude_from_motion(position, velocity)
    roll = math.radians(2)
    turn = np.array([[math.cos(roll), 0, math.sin(roll)], [0, 1, 0], [-math.sin(roll), 0, math.cos(roll)]])
    rolled = turn @ frame
    tilt = math.radians(30)
    moved = np.array([patterns.boresight_to_earth(p, a, x) for p, a, x in zip(position, rolled, patterns.antenna_axes(tilt, np.radians(scan)), strict=True)])
    source = reconstruct.Projected({0: instrument.scalar}, tilt, 1e5, attitude=True)
    plain = reconstruct.Projected({0: instrument.scalar}, tilt, 1e5)
    cells = np.stack([x.ravel() for x in np.meshgrid(np.linspace(-0.9, 0.9, 37), np.linspace(-0.9, 0.9, 37))])

    def centres(of, at, attitude):
        w_lon, w_lat = at[:, :1] + cells[0], at[:, 1:] + cells[1]
        share = of.on(w_lon, w_lat, np.ones(w_lon.shape, bool), columns_of(position, velocity, scan, attitude))[:, 0]
        return share, np.stack([(share * w_lon).sum(1), (share * w_lat).sum(1)], 1)

    at = np.stack([lon, lat], 1)
    usual, middle = centres(plain, at, None)
    same, _ = centres(source, at, frame)
    assert same == pytest.approx(usual, abs=1e-12)
    part = frame.copy()
    part[:, 1, 2] = np.nan
    assert centres(source, at, part)[0] == pytest.approx(usual, abs=1e-12)
    _, shifted = centres(source, moved, rolled)
    # the pattern isn't round, so its centre lies off the boresight: off the moved one by about as much
    assert np.abs((shifted - moved) - (middle - at)).max() < 0.06 < np.abs(moved - at).max()


@pytest.mark.parametrize("method", ["LW", "CG"])
def test_inversion_with_instrument_patterns(spark, instrument, method):
    lon, lat, position, velocity, scan = flown(120)
    held = {c: x[:, 0] for c, x in columns_of(position, velocity, scan).items()}
    s = points(spark, lon, lat, bt_h=200 + 10 * np.sin(3 * lon), **held)
    f = reconstruct.Footprints("EASE2_G9km", source=reconstruct.Projected({0: instrument.scalar}, math.radians(30), 60000.0))
    image = inversion.invert(s, ["bt_h"], f, method, 32, 1.0, 1e-6, 3000 if method == "LW" else 100, 1e-4).toPandas().set_index(["cell_row", "cell_col"])["bt_h"]
    # of the many images that explain the samples the smallest is found: high where patterns overlap
    row, col = geo.nearest_cell(GRIDS["EASE2_G9km"], *geo.lonlat_to_xy("G", lon, lat, NUMPY), NUMPY)
    seen = image.reindex(list(zip(row.tolist(), col.tolist(), strict=True))).to_numpy()
    assert np.isfinite(seen).all() and 100 < np.median(seen) < 400 and image.notna().sum() < 9000


def test_instrument_targets_in_a_run(spark, instrument):
    """Targets of another band with their own projected patterns: BG and RSIR see the field that both look at."""
    lon, lat, position, velocity, scan = flown(150)
    held = {c: x[:, 0] for c, x in columns_of(position, velocity, scan).items()}
    s = points(spark, lon, lat, bt_h=200 + 0 * lon, **held)
    t = points(spark, lon[:10], lat[:10], name="target_id", cell_row=np.arange(10), cell_col=np.zeros(10, int), **{c: x[:10] for c, x in held.items()})
    one = reconstruct.Projected({0: instrument.scalar}, math.radians(30), 60000.0)
    f = reconstruct.Footprints("EASE2_G9km", source=one, aim=one)
    n = neighbours.nearest_any(s, t, 1e6, 4)
    for got in (reconstruct.backus_gilbert(n, s, t, ["bt_h"], f, 1e-3), reconstruct.reconstruct_rsir(n, s, t, ["bt_h"], f, 3)):
        assert [r.bt_h for r in got.collect()] == pytest.approx([200.0] * 10, rel=1e-6)
