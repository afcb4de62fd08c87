"""The pipeline over the smallest tables, stage by stage."""

import corpus_pipeline
from swathgrid.llm import decontaminate, pii, queries, simhash_dedup

SMALLEST = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SMALLEST).cache()
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    classes = simhash_dedup.near_duplicates(spark.read.parquet(f"{SMALLEST}/documents.parquet"))
    assert docs.join(classes, "doc_id").groupBy("component_id").count().where("count > 1").count() == 0
    assert decontaminate.contaminated(docs, spark.read.parquet(f"{SMALLEST}/benchmark.parquet")).count() == 0
    found = pii.find(docs).selectExpr("sum(n_email + n_ip + n_card + n_phone) as n").first().n
    assert found == 0


def test_run_gives_every_kept_document_once(spark):
    out = corpus_pipeline.run(spark, SMALLEST)
    assert out.count() == out.select("doc_id").distinct().count() > 100
    assert out.groupBy("bucket", "batch").agg({"padded_tokens": "sum"}).where("`sum(padded_tokens)` > 32768").count() <= out.where("padded_tokens > 32768").count()


def test_all_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]
    assert set(queries.oracle_sql()) <= set(names)


def test_every_stage_on_hard_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, an extra column with a clashing name, no rows."""
    long = " ".join("".join("abcdefghij"[int(c)] for c in str(k)) for k in range(30_000))
    rows = [(1, None, None, None, None, "a"), (None, "some text without an id here", "en", "s", 4, "b"), (2, "", "en", "s", 0, None), (3, long, None, "s", 9, "c"), (3, long, None, "s", 9, "c"), (4, "İİ mail a.b@example.org now", "de", None, 5, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, docs, SMALLEST), stage(spark, docs.where("false"), SMALLEST)
        assert none.count() == 0
        kept = got.collect()
        assert len(kept) <= len(rows)
        if name != "packing":
            assert got.columns == docs.columns
        if name == "near_duplicates":  # texts without words are copies of each other, rows without an id stay
            assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 3, 3, 4]
        if name in ("decontamination", "pii", "packing"):
            assert len(kept) == len(rows)
        if name == "pii":
            assert [r.text for r in kept if r.doc_id == 4] == ["İİ mail <EMAIL> now"] and {r.text for r in kept if r.doc_id in (1, 3)} == {None, long}
