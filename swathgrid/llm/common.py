"""Helpers that several operators share: the shared folder, bounded samples, and work per Arrow batch."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where it is unset (tests on one machine) a local one."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def per_batch(df: DataFrame, schema: T.StructType | str, work: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int | None = None) -> DataFrame:
    """Apply work to each Arrow batch, or to `rows` of it at a time; batches without rows give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows or batch.num_rows):
                yield work(batch.slice(at, rows or batch.num_rows))

    return df.mapInArrow(run, schema)


def free_name(taken: list[str], name: str) -> str:
    """name, or name with underscores in front until no column clashes with it."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def fold(doc_id: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo parts: the fold that decides what a model may learn from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def bounded_sample(rows: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """At most per_label rows of each label: those whose hashed key comes first.

    The same rows are chosen however the table is partitioned. Of a label with many rows only those go into the ranking
    whose hash lies in the lowest part that holds per_label of them with certainty (ten standard deviations more), so
    that no task ranks more than that, however large the table is. `rows` has only key and label.
    """
    h = F.xxhash64(F.col(key), F.col(label).cast("string"))
    counts = rows.groupBy(F.col(label).alias("_label")).agg(((per_label + 10 * per_label**0.5 + 100) / F.count("*")).alias("_part"))
    # a row for each label, which are few beside the rows: a model holds a part for each of them anyway
    low = rows.join(F.broadcast(counts), F.col(label).eqNullSafe(F.col("_label"))).where(h / 2.0**64 + 0.5 <= F.col("_part")).select(*rows.columns)
    first = Window.partitionBy(label).orderBy(h, key)
    return low.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= per_label).drop("_rank")


def one_text(data: DataFrame, *keys: str) -> DataFrame:
    """(keys, _text): of rows that repeat the keys the first text, so that a sample of keys bounds the rows."""
    return data.groupBy(*keys).agg(F.min("_text").alias("_text"))


def train_once(rows: DataFrame, fit: Callable[[pa.Table | None], bytes]) -> bytes:
    """Run fit on a bounded table inside one task and bring back only the fitted model.

    The caller bounds `rows`; a lost executor only means that the task runs again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        data = pa.Table.from_batches(held) if held else None
        yield pa.RecordBatch.from_pydict({"model": pa.array([fit(data)], pa.binary())})

    row = rows.repartition(1).mapInArrow(run, "model binary").first()
    return bytes(row[0]) if row else fit(None)  # Spark leaves out the task of a plan that it knows to be empty
