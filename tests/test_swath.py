"""From files to samples."""

import math

import pytest
from pyspark.sql import functions as F
from swathgrid.catalog import Grid
from swathgrid.sources import swath


def test_fill_nan_and_listwise(spark):
    df = spark.createDataFrame([(1, 1.0, [1.0, 2.0]), (2, -9999.0, [1.0, 2.0]), (3, math.nan, [1.0, 2.0]), (4, None, [1.0, 2.0]), (5, 2.0, [1.0, math.nan]), (6, 2.0, None)], "id long, v double, a array<double>")
    filled = {r.id: r.v for r in swath.fill_to_null(df).collect()}
    assert filled == {1: 1.0, 2: None, 3: None, 4: None, 5: 2.0, 6: 2.0}
    assert [r.id for r in swath.listwise(swath.fill_to_null(df)).collect()] == [1]


def test_quality_takes_all_flags_together(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 0, 4), (4, None, 0)], "id long, scan_quality_flag int, data_quality_h int")
    out = swath.quality_filter(df)
    assert out.columns == ["id"] and sorted(r.id for r in out.collect()) == [1, 4]


def test_bounds_apply_both_rules(spark):
    g = Grid("EASE2_N3km", 6931, -9e6, 9e6, 3000.0, 6000, 1000, 20)
    df = spark.createDataFrame([(1, 0.0, 10.0), (2, 0.0, 60.0), (3, 180.0, 85.0), (4, 180.0, 21.0), (5, 0.0, None)], "id long, longitude double, latitude double")
    # rows reach only 3000 km down from the top: y of (180, 21) lies there, others below or out by latitude
    assert [r.id for r in swath.in_bounds(df, g, "N").collect()] == [4]


def test_split_is_inclusive(spark):
    df = spark.createDataFrame([(89.9,), (90.0,), (270.0,), (270.1,)], "processing_scan_angle double")
    assert [r.scan_direction for r in swath.split_fore_aft(df, "SMAP").collect()] == ["fore", "aft", "aft", "fore"]
    assert {r.scan_direction for r in swath.split_fore_aft(df, "AMSR2").collect()} == {"all"}


def test_overlap(spark):
    df = spark.range(10).withColumnRenamed("id", "scan_number")
    assert [r[0] for r in swath.trim_overlap(df, 2, 10).orderBy("scan_number").collect()] == [2, 3, 4, 5, 6, 7]
    for bad in (-1, 6):
        with pytest.raises(ValueError):
            swath.trim_overlap(df, bad, 10)


def test_feeds_keep_their_own_attitude(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0], [9.0] * 9)], "scan_number long, bt_h array<double>, attitude array<double>")
    rows = swath.explode_feeds(df, ["bt_h"], 2).orderBy("feed_horn_number").collect()
    assert [(r.feed_horn_number, r.bt_h, len(r.attitude)) for r in rows] == [(0, 1.0, 9), (1, 2.0, 9)]


def test_coregistration(spark):
    df = spark.createDataFrame([("6G-1.1500,7G--0.2500,10G-0.5",)], "t string")
    assert df.select(swath.coregistration(F.col("t"))).first()[0] == [1.15, -0.25, 0.5]


def test_low_frequency_keeps_the_first_point_at_zero(spark):
    df = spark.createDataFrame([(0, 0, 10.0, 20.0), (0, 1, 10.2, 20.1), (0, 2, 181.0, 0.0), (0, 3, 1.0, 1.0)], "scan_number long, sample_number long, longitude double, latitude double")
    rows = swath.low_frequency(df, 0.0, 0.0).orderBy("sample_number").collect()
    assert (rows[0].longitude, rows[0].latitude) == pytest.approx((10.0, 20.0)) and rows[1].longitude == -9999.0
    one = swath.low_frequency(df, 1.0, 0.0).orderBy("sample_number").first()
    assert (one.longitude, one.latitude) == pytest.approx((10.2, 20.1))


def test_times(spark):
    df = spark.createDataFrame([("2020-01-01T00:00:00.500Z",)], "t string")
    assert df.select(swath.iso_to_posix(F.col("t"))).first()[0] == 1577836800.5
    assert df.select(swath.days_to_posix(F.lit(1), F.lit(2), F.lit(500000))).first()[0] == 946684800 + 86402.5
    assert df.select(swath.tai93_to_posix(F.lit(37.0))).first()[0] == 725846400


def test_normalise_and_read(spark, tmp_path):
    rows = [(1.0, 70.0, 200.0, 0, 10.0), (2.0, 71.0, -9999.0, 0, 20.0), (3.0, 72.0, 210.0, 1, 100.0), (4.0, -70.0, 220.0, 0, 100.0), (5.0, 75.0, 230.0, 0, 100.0)]
    df = spark.createDataFrame(rows, "tb_lon double, tb_lat double, tb_h double, antenna_scan_qual_flag int, antenna_scan_angle double")
    df.write.parquet(str(tmp_path / "g"))
    got = swath.read_l1b(spark, str(tmp_path / "g"), "SMAP")
    assert "bt_h" in got.columns
    out = swath.normalise(got, "SMAP", "L", "STEREO_N25km").orderBy("longitude").collect()
    assert [(r.longitude, r.scan_direction) for r in out] == [(1.0, "fore"), (5.0, "aft")]
    with pytest.raises(ValueError):
        swath.read_l1b(spark, "x", "OTHER")


def test_small_derivations(spark):
    df = spark.createDataFrame([("L", [1.0, 2.0, 3.0], 4.0)], "band string, position array<double>, raw double")
    out = swath.scaled(swath.with_processing_flag(swath.with_nedt(swath.components(df, "position", ["x_position", "y_position", "z_position"]))), {"raw": 0.01}).first()
    assert (out.x_position, out.z_position, out.nedt_h, out.processing_flag, out.raw) == (1.0, 3.0, 0.3, 0, 0.04)
    assert swath.max_altitude(spark.createDataFrame([(7e6, 0.0, 0.0), (0.0, 7.1e6, 0.0)], "x_position double, y_position double, z_position double")).first()[0] == 729000.0
