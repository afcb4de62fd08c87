"""A training corpus from `documents`, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and gives the columns of
documents; the last gives the packed layout. All stages work on whole texts of any length, keep repeated rows and
extra columns as they are (whatever their names), and give an empty table for an empty one. run() writes each stage's rows as Parquet into the shared
folder of the session and reads them again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from swathgrid.llm import decontaminate, packing, pii, quality, simhash_dedup
from swathgrid.llm.common import shared_folder, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: texts that the quality classifier rejects go. It may learn from all labels.

    Null and empty texts get the score of an empty text; equal texts get equal scores. Without labels everything stays.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near copies (similarity of five-word shingles from 0.8) the smallest id stays.

    Of rows that repeat the kept id all stay. Null texts count as empty ones, and texts without words are copies of each
    other; rows with a null id stay.
    """
    return simhash_dedup.keep_one(docs, words=5, share=(4, 5))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: texts that hold a benchmark item go.

    Null and empty texts hold none; rows with a null id stay; all rows that share an id with such a text go.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: personal data in the texts gives way to its kind; n_chars follows.

    Null texts stay null; ids don't matter.
    """
    return pii.redact(docs)


def pack_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: (doc_id, n_tokens, bucket, padded_tokens, batch), a row for each row.

    Null and empty texts have no tokens; null and repeated ids are packed like others, in a fixed order.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pii", redact_personal),
    ("packing", pack_texts),
]

#: The stages learn a classifier and search fingerprints: SQL can't say that, tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for `documents` in sf_dir."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
