"""Configuration, whole runs, the product on disk, beams, streams, and the driver's entry."""

import importlib
import shutil
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from swathgrid import __main__ as cli
from swathgrid import config as cfg
from swathgrid import queries as q
from swathgrid.config import Config
from swathgrid.operators import neighbours
from swathgrid.plans import product, regrid
from swathgrid.sources import beam, swath
from swathgrid.streaming import granules

REPO = Path(__file__).resolve().parents[1]
SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "bad",
    [
        {"type": "OTHER"}, {"type": "SMAP", "grid_type": "L1R"}, {"grid_definition": "EASE2_G5km"}, {"projection_definition": "PS_N"}, {"regridding_algorithm": "XX"},
        {"source_band": ("Q",)}, {"source_band": ("C",)}, {"grid_type": "L1R"}, {"search_radius": -1.0}, {"max_neighbours": 0}, {"rsir_iteration": -1},
        {"reduced_grid_inds": (5, 1, 0, 1)}, {"reduced_grid_inds": (-1, 1, 0, 1)}, {"creator_email": "nobody"}, {"variables_to_regrid": ("other",)},
        {"source_gaussian_params": (1.0,)}, {"polarisation_method": "x"}, {"nedt": {"L": -0.1}}, {"max_chunk_size": 0},
    ],
)
def test_config_refuses(bad):
    with pytest.raises(ValueError):
        Config(**bad)


def test_config_settles():
    assert Config(type="amsr2", source_band=("6",), target_band=("6",), split_fore_aft=True).split_fore_aft is False
    assert Config(regridding_algorithm="nn", max_neighbours=50).max_neighbours == 1
    assert Config(grid_type="L1R", target_band=("C",)).search_radius == 36500.0 and Config().search_radius is None
    assert Config(type="SMAP", quality_control=True).quality_control and not Config(quality_control=True).quality_control
    assert "bt_h" in Config().variables_to_regrid and Config(grid_definition="EASE2_S3km", projection_definition="S")
    assert Config().with_overrides(bg_smoothing=2.0).bg_smoothing == 2.0


XML = """<config><InputData><type>CIMR</type><path>in</path><split_fore_aft>True</split_fore_aft><source_band>L C</source_band><target_band>L C</target_band></InputData>
<GridParams><grid_type>L1C</grid_type><grid_definition>EASE2_G9km</grid_definition><projection_definition>G</projection_definition><reduced_grid_inds>1 2 3 4</reduced_grid_inds></GridParams>
<ReGridderParams><regridding_algorithm>IDS</regridding_algorithm><search_radius>18</search_radius><max_neighbours>20</max_neighbours><cimr_L_nedt>0.5</cimr_L_nedt><source_gaussian_params>1000 2000</source_gaussian_params></ReGridderParams>
<OutputData><output_path>out</output_path><suffix/></OutputData></config>"""
JOB = """<Ipf_Job_Order><Ipf_Conf><Version>1.2</Version></Ipf_Conf><List_of_Ipf_Procs><Ipf_Proc><List_of_Inputs>
<Input><File_Type>CFG_RGB_</File_Type><List_of_File_Names><File_Name>c.xml</File_Name></List_of_File_Names></Input>
<Input><File_Type>L1B_</File_Type><List_of_File_Names><File_Name>l1b</File_Name></List_of_File_Names></Input>
<Input><File_Type>AntennaPattern</File_Type><List_of_File_Names><File_Name>ap</File_Name></List_of_File_Names></Input></List_of_Inputs>
<List_of_Outputs><Output><File_Type>OUT_L1C</File_Type><File_Name>here</File_Name></Output></List_of_Outputs></Ipf_Proc></List_of_Ipf_Procs></Ipf_Job_Order>"""


def test_config_from_xml_and_job_order():
    c = cfg.from_xml(XML, max_neighbours=7)
    assert (c.search_radius, c.max_neighbours, c.source_band, c.reduced_grid_inds, c.nedt["L"], c.source_gaussian_params) == (18000.0, 7, ("L", "C"), (1, 2, 3, 4), 0.5, (1000.0, 2000.0))
    j = cfg.job_config(JOB, XML)
    assert (j.path, j.antenna_patterns_path, j.output_path) == ("l1b", "ap", "here") and cfg.parse_job_order(JOB)["version"] == "1.2"
    with pytest.raises(ValueError):
        cfg.parse_job_order(JOB.replace("L1B_", "X"))
    with pytest.raises(ValueError):
        cfg.as_bool("maybe", "x")


@pytest.fixture(scope="module")
def swath_rows(spark):
    return q.clean(spark, SMALLEST).withColumn("band", F.lit("L")).where("latitude between 30 and 60").cache()


@pytest.mark.parametrize("algorithm", ["NN", "DIB", "IDS", "BG", "RSIR", "LW", "CG"])
def test_every_algorithm_runs(spark, swath_rows, algorithm):
    c = Config(
        type="SMAP", grid_definition="EASE2_N36km", projection_definition="N", MRF_grid_definition="EASE2_N36km", regridding_algorithm=algorithm, search_radius=80000.0, max_neighbours=4,
        variables_to_regrid=("bt_h", "nedt_h"), source_gaussian_params=(60000.0, 60000.0), rsir_iteration=3, max_iterations=30, max_chunk_size=64, reduced_grid_inds=(150, 350, 150, 350),
    )
    out = regrid.regrid(spark, swath_rows, c)
    got = out.where("bt_h is not null").agg(F.count("*"), F.min("cell_row"), F.max("cell_row"), F.percentile_approx("bt_h", 0.5)).first()
    assert got[0] > 50 and got[1] >= 150 and got[2] <= 350
    assert 100 < got[3] < 600 or algorithm in ("LW", "CG")


def test_algorithms_agree_on_a_smooth_scene(spark, swath_rows):
    s = swath_rows.withColumn("bt_h", 200 + F.col("latitude"))
    def run(name):
        c = Config(type="SMAP", grid_definition="EASE2_N36km", projection_definition="N", MRF_grid_definition="EASE2_N36km", regridding_algorithm=name, search_radius=80000.0, max_neighbours=4, variables_to_regrid=("bt_h",), source_gaussian_params=(60000.0, 60000.0), bg_smoothing=0.01, rsir_iteration=2)
        return regrid.regrid(spark, s, c).select("scan_direction", "target_id", F.col("bt_h").alias(name))
    met = run("IDS").join(run("NN"), ["scan_direction", "target_id"]).join(run("BG"), ["scan_direction", "target_id"]).join(run("RSIR"), ["scan_direction", "target_id"])
    off = met.agg(*(F.avg(F.abs(F.col(n) - F.col("IDS")) / F.col("IDS")).alias(n) for n in ("NN", "BG", "RSIR"))).first()
    assert max(off) < 0.01


def test_l1r_needs_targets(spark, swath_rows):
    with pytest.raises(ValueError):
        regrid.regrid(spark, swath_rows, Config(grid_type="L1R", target_band=("C",)))


def test_registered_algorithm(spark, swath_rows):
    def highest(t):  # the warmest of the neighbours
        return regrid._placed(t.neighbours.groupBy("scan_direction", "target_id").agg(F.max("bt_h").alias("bt_h")), t)

    c = Config(type="SMAP", grid_definition="EASE2_N36km", projection_definition="N", search_radius=80000.0, max_neighbours=4, variables_to_regrid=("bt_h",), regridding_algorithm="DIB")
    before = regrid.REGISTRY["DIB"]
    try:
        mean = regrid.regrid(spark, swath_rows, c).select("scan_direction", "target_id", F.col("bt_h").alias("mean"))
        regrid.register("DIB", highest)
        got = regrid.regrid(spark, swath_rows, c).join(mean, ["scan_direction", "target_id"])
        assert got.count() == mean.count() > 50 and got.where("bt_h < mean - 1e-9").count() == 0 < got.where("bt_h > mean + 1").count()
    finally:
        regrid.register("DIB", before)


def test_product_on_disk(spark, swath_rows, tmp_path):
    c = Config(type="SMAP", grid_definition="EASE2_G36km", regridding_algorithm="DIB", variables_to_regrid=("bt_h",), suffix="x", creator_email="a@b.org")
    p = regrid.regrid(spark, swath_rows, c)
    assert product.file_name(c) == "SMAP_L1C_G_DIB_36km_x"
    assert product.file_name(c.with_overrides(suffix=""), datetime(2020, 1, 2, 3, 4, 5)).endswith("2020-01-02_03-04-05")
    product.write_product(p, str(tmp_path / "p"), c)
    back, told = product.read_product(spark, str(tmp_path / "p"))
    assert back.count() == p.count() and told["grid"] == "EASE2_G36km" and told["variables"]["bt_h"]["units"] == "K" and told["variables"]["bt_h"]["type"] == "f8"
    assert "band=L" in " ".join(x.name for x in (tmp_path / "p" / "data").iterdir())
    assert product.variable_attributes("bt_v_fore", "L", "9")["long_name"].startswith("L band fore") and product.variable_attributes("odd", "L", "9") is None
    box = product.extent(swath_rows).first()
    assert box.lat_min >= 30 and box.lat_max <= 60 and box.wkt.startswith("POLYGON ((")
    scores = spark.createDataFrame([(1.0,)], "rmse double")
    product.append_scores(scores, str(tmp_path / "s"), test="a")
    product.append_scores(scores.withColumn("mae", F.lit(2.0)), str(tmp_path / "s"), test="b", k=4)
    assert set(spark.read.option("mergeSchema", "true").parquet(str(tmp_path / "s")).columns) == {"rmse", "mae", "test", "k"}


def test_beams(spark, tmp_path):
    (tmp_path / "beams").mkdir()
    (tmp_path / "beams" / "C2-12345-E-FR.grd").write_text(q.beam_text())
    limited = "made\n++++\n1\n1 3 2 1\n0 0\n0 0 1 1\n2 2 1\n1 2\n0 0 1 0\n0 0 2 0\n2 1\n0 0 3 0\n"
    (tmp_path / "beams" / "S-12345-E-BK.grd").write_text(limited)
    points = beam.read_beams(spark, str(tmp_path / "beams"))
    assert {(r.band, r.horn, r.half_space) for r in points.collect()} == {("C", 2, "FR"), ("S", 1, "BK")}
    assert [(r.i, r.j, r.co_re) for r in points.where("band = 'S'").orderBy("j", "i").collect()] == [(0, 0, 1.0), (1, 0, 2.0), (1, 1, 3.0)]
    top = beam.recentre(points.where("band = 'C'")).orderBy(F.desc("co_re")).first()
    assert (top.u, top.v) == pytest.approx((0, 0), abs=1e-12)
    polar = beam.to_polar(beam.recentre(points.where("band = 'C'")), 3.0, 0.5, 30.0)
    centre = polar.where("i_theta = 0").agg(F.min("co_re"), F.max("co_re")).first()
    assert centre[0] == pytest.approx(1, abs=0.01) and centre[1] == pytest.approx(1, abs=0.01) and polar.count() == 7 * 13
    beam.preprocess(spark, str(tmp_path / "beams"), str(tmp_path / "out"), 3.0, 0.5, 30.0)
    assert spark.read.parquet(str(tmp_path / "out")).where("band = 'C' and horn = 2").count() == 91
    with pytest.raises(NotImplementedError):
        list(beam.parse(limited.replace("1 3 2 1", "1 3 2 7")))


def test_beams_are_taken_up_again(spark, tmp_path):
    """A second run does nothing, a new or changed file or another setting is worked on alone, two files of a horn are refused."""
    given, out = tmp_path / "beams", tmp_path / "out"
    given.mkdir()
    (given / "C1-12345-E-FR.grd").write_text(q.beam_text())
    (given / "C2-12345-E-FR.grd").write_text(q.beam_text(centre=(0.0, 0.0)))
    (given / "C2-12345-E-BK.grd").write_text(q.beam_text())
    run = lambda *more: [Path(p).name for p in beam.preprocess(spark, str(given), str(out), 3.0, 0.5, 30.0, *more)]
    assert run() == ["C1-12345-E-FR.grd", "C2-12345-E-FR.grd"]
    first = {p: p.stat().st_mtime_ns for p in out.rglob("*.parquet") if "band=" in str(p)}
    assert run() == []
    (given / "X1-12345-E-FR.grd").write_text(q.beam_text())
    assert run() == ["X1-12345-E-FR.grd"] and all(p.stat().st_mtime_ns == t for p, t in first.items())
    assert {(r.band, r.horn) for r in spark.read.parquet(str(out)).select("band", "horn").distinct().collect()} == {("C", 1), ("C", 2), ("X", 1)}
    (given / "C1-12345-E-FR.grd").write_text(q.beam_text(n=11))
    assert run() == ["C1-12345-E-FR.grd"] and spark.read.parquet(str(out)).count() == 3 * 91
    assert len(run(False)) == 3
    (given / "C1-99999-E-FR.grd").write_text(q.beam_text())
    with pytest.raises(ValueError):
        run()


def test_unused_samples_in_the_product(spark, tmp_path):
    """Asked for, each sample's flag is written beside the product, by band and for every method."""
    rows = q.clean(spark, SMALLEST).where("latitude between 30 and 60").withColumn("band", F.lit("L"))
    (rows.drop("band", "scan_direction").write.parquet(str(tmp_path / "in" / "L")))
    c = Config(type="SMAP", path=str(tmp_path / "in"), output_path=str(tmp_path / "out"), grid_definition="EASE2_G36km", regridding_algorithm="IDS", search_radius=15000.0, max_neighbours=1, variables_to_regrid=("bt_h", "regridding_l1b_orphans"), suffix="x")
    out = cli.run(spark, c)
    flags = spark.read.parquet(f"{out}/orphans")
    used = neighbours.nearest_any(rows, neighbours.grid_targets(spark, "EASE2_G36km"), 15000.0, 1, ("scan_direction",)).select("sample_id").distinct().count()
    assert flags.count() == rows.count() and flags.agg(F.sum("regridding_l1b_orphans")).first()[0] == used and 0 < used < rows.count()
    assert {"band", "scan_direction", "scan_number", "sample_number", "regridding_l1b_orphans"} <= set(flags.columns)
    assert "regridding_l1b_orphans" not in spark.read.parquet(f"{out}/data").columns


def test_counts_of_a_run(spark, tmp_path):
    """What the run itself counts equals counts made apart."""
    rows = q.samples(spark, SMALLEST).withColumn("bt_h", F.when(F.col("sample_id") % 7 == 0, -9999.0).otherwise(F.col("bt_h")))
    rows.drop("scan_direction").write.parquet(str(tmp_path / "in" / "L"))
    c = Config(type="SMAP", quality_control=True, path=str(tmp_path / "in"), output_path=str(tmp_path / "out"), grid_definition="EASE2_N36km", projection_definition="N", regridding_algorithm="IDS", search_radius=200000.0, max_neighbours=3, variables_to_regrid=("bt_h",), suffix="x", reduced_grid_inds=(100, 400, 100, 400))
    made, told = product.read_product(spark, cli.run(spark, c))
    good = rows.where("scan_quality_flag = 0")
    inside = swath.in_bounds(good, "EASE2_N36km", "N")
    want = {"L read": rows.count(), "L good": good.count(), "L in bounds": inside.count(), "L samples": inside.where("bt_h != -9999").count()}
    assert {k: told["counts"][k]["rows"] for k in want} == want
    held = told["counts"]["product"]
    assert held["rows"] == made.count() > 0 and held["no_bt_h"] == made.where("bt_h is null").count() and held["samples_used"] == made.agg(F.sum("regridding_n_samples")).first()[0]


def test_granules_as_a_stream(spark, swath_rows, tmp_path):
    source = str(tmp_path / "in")
    swath_rows.where("sample_id % 2 = 0").coalesce(1).write.parquet(source)
    swath_rows.where("sample_id % 2 = 1").coalesce(1).write.mode("append").parquet(source)
    c = Config(type="SMAP", grid_definition="EASE2_G36km", regridding_algorithm="DIB", variables_to_regrid=("bt_h",))
    stream = spark.readStream.schema(swath_rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    granules.regrid_stream(spark, stream, c, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() == 2 and got.agg(F.sum("regridding_n_samples")).first()[0] == swath_rows.count()
    timed = spark.readStream.schema(swath_rows.schema).parquet(source).withColumn("acq_time_utc", F.col("acq_time_utc").cast("timestamp"))
    daily = granules.cell_means(timed, "EASE2_G36km", ["bt_h"])
    run = daily.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    run.awaitTermination(120)
    assert spark.sql("select sum(regridding_n_samples) from daily").first()[0] == swath_rows.count()


def test_entry_and_oracles(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(name in entry.queries() for name in q.QUERIES)


def test_library_stands_without_the_other_part(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)


def test_command_line(spark, swath_rows, tmp_path, capsys):
    from swathgrid import __main__ as cli

    rows = swath_rows.select("sample_id", "scan_number", "sample_number", "longitude", "latitude", "bt_h", "processing_scan_angle")
    rows.write.parquet(str(tmp_path / "in" / "L"))
    rows.withColumn("longitude", F.col("longitude") + 0.1).write.parquet(str(tmp_path / "in" / "C"))
    text = XML.replace("L C", "L").replace("<path>in<", f"<path>{tmp_path}/in<").replace(">out<", f">{tmp_path}/out<").replace("EASE2_G9km", "EASE2_G36km").replace("<reduced_grid_inds>1 2 3 4</reduced_grid_inds>", "")
    (tmp_path / "c.xml").write_text(text)
    cli.main(["run", str(tmp_path / "c.xml"), "--set", "search_radius=60000.0", "suffix=one"])
    got, told = product.read_product(spark, capsys.readouterr().out.strip().splitlines()[-1])
    assert got.count() > 100 and told["algorithm"] == "IDS"
    cli.main(["run", str(tmp_path / "c.xml"), "--set", "grid_type=L1R", "target_band=('C',)", "search_radius=20000.0", "suffix=two"])
    got, _ = product.read_product(spark, capsys.readouterr().out.strip().splitlines()[-1])
    assert 0 < got.count() <= 2 * rows.count()


def test_patterns_from_disk(spark, tmp_path):
    from swathgrid.sources.beam import load_patterns

    (tmp_path / "beams").mkdir()
    (tmp_path / "beams" / "C2-12345-E-FR.grd").write_text(q.beam_text())
    beam.preprocess(spark, str(tmp_path / "beams"), str(tmp_path / "out"), 3.0, 0.5, 30.0)
    held = load_patterns(spark, str(tmp_path / "out"), "C", 0.001, 2.5)
    assert set(held) == {2} and held[2].hco.shape == (13, 7) and held[2].widest() <= 0.06
    c = Config(type="CIMR", source_band=("C",), target_band=("C",), search_radius=1.0, regridding_algorithm="BG", source_antenna_method="instrument", antenna_patterns_path=str(tmp_path / "out"), source_antenna_threshold=0.001)
    f = regrid._footprints(regrid.Task(c, spark.range(1), spark.range(1), None, [], [], "C"), 9000.0)
    assert f.source is not None and f.source.radius > 1000 and set(f.source.gains) == {2}


def test_band_to_band_is_its_sql_where_samples_coincide(spark, tmp_path):
    """A sample right at a target: the SQL's inverse squares give NaN there."""
    import duckdb

    rows = [(e, 7, "view", 50.0 + e) for e in (0, 1, 2, 3)] + [(118250 + e, 7 + 250, "view", 60.0 + e) for e in (0, 1, 7)]  # 118250 and 250 on is the same place
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").selectExpr("*", "timestamp'2024-01-01' AS ts").distinct().write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("l1r_ids", "l1r_ids_wide_radius"):
        got = sorted(str(tuple(r)) for r in q.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(str(r) for r in con.execute(q.ORACLES[name]).fetchall()) and any("nan" in r for r in got)


def test_morton_beyond_its_bits(spark, tmp_path):
    """Numbers that 20 bits don't hold."""
    import duckdb

    spark.createDataFrame([(k, 3 * k) for k in (0, 5, 2**20 - 1, 2**20, 2**20 + 77, 6_000_000, 2**33 + 9, -1, -(2**21) - 3)], "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(tuple(r) for r in q.QUERIES["morton"](spark, str(tmp_path)).collect()) == sorted(con.execute(q.ORACLES["morton"]).fetchall())
