"""Elliptical footprints, target patterns of another band, Mueller matrices, and what a run reads and refuses."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from swathgrid import __main__ as cli
from swathgrid import queries as q
from swathgrid.config import Config
from swathgrid.functions.geo import NUMPY
from swathgrid.functions.patterns import Tabulated, nadir_angle
from swathgrid.operators import neighbours
from swathgrid.plans import regrid
from swathgrid.sources import swath

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    s = q.clean(spark, SMALLEST).withColumn("band", F.lit("L")).where("latitude between 40 and 60")
    return s.withColumns({"sub_satellite_lon": F.col("longitude") - 3, "sub_satellite_lat": F.col("latitude") - 2}).cache()


def config(algorithm, **more):
    return Config(**{
        "type": "SMAP", "grid_definition": "EASE2_N36km", "projection_definition": "N", "MRF_grid_definition": "EASE2_N36km", "regridding_algorithm": algorithm, "search_radius": 120000.0, "max_neighbours": 4,
        "variables_to_regrid": ("bt_h",), "source_gaussian_params": (30000.0, 90000.0), "rsir_iteration": 3, "max_iterations": 20, "bg_smoothing": 1e-4} | more)


@pytest.mark.parametrize("algorithm", ["BG", "RSIR", "CG"])
def test_ellipses_are_turned_to_the_nadir_point(spark, rows, algorithm):
    def values(samples):
        return {(r.scan_direction, r.target_id): r.bt_h for r in regrid.regrid(spark, samples, config(algorithm)).where("bt_h is not null").collect()}

    one, other = values(rows), values(rows.withColumn("sub_satellite_lon", F.col("longitude") + 3))
    assert len(one) > 50 and sum(abs(one[k] - other[k]) > 1e-6 for k in one if k in other) > 10
    with pytest.raises(ValueError):
        regrid.regrid(spark, rows.drop("sub_satellite_lat"), config(algorithm))
    turned = regrid.with_angle(rows).select("longitude", "latitude", "sub_satellite_lon", "sub_satellite_lat", "footprint_angle").toPandas().to_numpy()
    assert np.allclose(turned[:, 4], nadir_angle(*turned[:, :4].T, NUMPY))


@pytest.mark.parametrize("algorithm", ["BG", "RSIR"])
def test_a_target_band_has_its_own_footprint(spark, rows, algorithm):
    targets = neighbours.band_targets(rows.withColumn("longitude", F.col("longitude") + 0.2).where("scan_direction = 'fore'"))

    def values(**more):
        c = config(algorithm, type="CIMR", grid_type="L1R", target_band=("C",), source_gaussian_params=(60000.0, 60000.0), MRF_grid_definition="EASE2_N36km", search_radius=300000.0, **more)
        return {(r.scan_direction, r.target_id): r.bt_h for r in regrid.regrid(spark, rows, c, targets).collect()}

    narrow, wide, long = (values(target_gaussian_params=p) for p in ((30000.0, 30000.0), (90000.0, 90000.0), (30000.0, 90000.0)))
    assert len(narrow) > 20
    for a, b in ((narrow, wide), (narrow, long)):
        assert sum(a[k] is not None and b[k] is not None and abs(a[k] - b[k]) > 1e-6 for k in a) > 5


def test_mueller_matrix_against_fields():
    rng = np.random.default_rng(3)
    hh, hv, vv, vh = (rng.normal(size=(2, 2)) + 1j * rng.normal(size=(2, 2)) for _ in range(4))
    ap = Tabulated(np.array([0.0, 1.0]), np.array([0.0, 1.0]), hh, hv, vv, vh)
    m = ap.mueller(np.array([0.0]), np.array([1.0]))[0]
    gain = np.array([[vv[0, 1], vh[0, 1]], [hv[0, 1], hh[0, 1]]])
    for _ in range(20):
        e = rng.normal(size=2) + 1j * rng.normal(size=2)
        stokes = lambda x: np.array([abs(x[0]) ** 2, abs(x[1]) ** 2, 2 * (x[0] * x[1].conj()).real, 2 * (x[0] * x[1].conj()).imag])
        assert np.allclose(m @ stokes(e), stokes(gain @ e))


def test_columns_that_nobody_asked_for(spark, rows, tmp_path, capsys):
    some = rows.select("sample_id", "scan_number", "sample_number", "longitude", "latitude", "bt_h", "processing_scan_angle", F.when(F.col("sample_id") % 2 == 0, F.col("bt_v")).alias("bt_v"))
    some.write.parquet(str(tmp_path / "in" / "L"))
    c = Config(type="SMAP", path=str(tmp_path / "in"), output_path=str(tmp_path / "out"), grid_definition="EASE2_G36km", regridding_algorithm="DIB", variables_to_regrid=("bt_h",), suffix="x")
    assert "bt_v" not in cli.needed(c)
    got = spark.read.parquet(cli.run(spark, c) + "/data")
    assert got.agg(F.sum("regridding_n_samples")).first()[0] == some.count()
    both = c.with_overrides(variables_to_regrid=("bt_h", "bt_v"), suffix="y")
    assert spark.read.parquet(cli.run(spark, both) + "/data").agg(F.sum("regridding_n_samples")).first()[0] == some.where("bt_v is not null").count()
    assert cli.run(spark, c.with_overrides(save_to_disk=False, suffix="z")) == "" and not (tmp_path / "out" / "SMAP_L1C_G_DIB_36km_z").exists()
    raw = swath.read_l1b(spark, f"{c.path}/L", "SMAP", cli.needed(c))
    assert "bt_v" not in raw._jdf.queryExecution().executedPlan().toString()


def test_settings_without_effect_are_refused():
    for wrong in ({"polarisation_method": "mueller"}, {"source_antenna_method": "gaussian_projected"}, {"type": "SMAP", "boresight_shift": True}, {"grid_type": "L1R", "target_band": ("C", "X")}, {"MRF_grid_definition": "EASE2_N9km", "MRF_projection_definition": "G"}):
        with pytest.raises(ValueError):
            Config(**wrong)


@pytest.mark.parametrize("algorithm", ["DIB", "NN"])
def test_unused_samples_without_a_search(spark, rows, algorithm):
    c = Config(type="SMAP", grid_definition="EASE2_G36km", regridding_algorithm=algorithm, variables_to_regrid=("bt_h",))
    used = regrid.unused(spark, rows, c).agg(F.sum("used"), F.count("*")).first()
    made = regrid.regrid(spark, rows, c)
    assert used[1] == rows.count() and used[0] == (made.count() if algorithm == "NN" else rows.count())
