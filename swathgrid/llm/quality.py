"""Quality classifier: supervised subword embeddings.

A text is the mean of learned vectors of its hashed words, word pairs and character n-grams; a softmax
layer over that mean gives the probability of label 1. Vectors and layer are trained together by
stochastic gradient descent (AdaGrad steps) in numpy, in one task, on a bounded sample of labelled
rows. The mean goes through a linear layer, so for scoring each bucket's vector is multiplied with the
layer beforehand and a text costs one lookup for each feature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashed_text as ht
from .common import bounded_sample, fold, free_name, one_text, per_batch, train_once

BITS = 17
GRAMS = (3, 4)
DIM = 8


def feature_blocks(s: ht.Slice, bits: int = BITS, grams: tuple[int, ...] = GRAMS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """[(buckets, starts, ends)]: of text k, buckets[starts[k]:ends[k]] are its own."""
    out = []
    for n in grams:
        out.append((ht.char_grams(s, n, bits), s.bounds[:-1], np.maximum(s.bounds[1:] - n + 1, s.bounds[:-1])))
    w = ht.words(s)
    out.append((ht.bucket(w.hashes, bits, 1), w.bounds[:-1], w.bounds[1:]))
    if len(w.hashes) > 1:
        out.append((ht.bucket(ht.pair_hashes(w.hashes), bits, 2), w.bounds[:-1], np.maximum(w.bounds[1:] - 1, w.bounds[:-1])))
    return out


def fit(texts: pa.Array, labels: np.ndarray, weights: np.ndarray, dim: int = DIM, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> np.ndarray:
    """Train and return, for each bucket, its pull towards label 1; the last entry is the bias.

    Without rows, or with one label only, the pull is 0 and the bias says how often label 1 is seen.
    """
    size = 1 << BITS
    share = float(np.average(labels, weights=weights)) if len(labels) else 0.5
    bias = np.log((share + 1e-3) / (1 - share + 1e-3))
    if len(set(labels.tolist())) < 2:
        return np.concatenate([np.zeros(size), [bias]]).astype(np.float32)
    docs = []
    for s in ht.slices(texts):
        blocks = feature_blocks(s)
        for k in range(len(s)):
            own = np.concatenate([b[i[k] : j[k]] for b, i, j in blocks])
            ids, counts = np.unique(own, return_counts=True)
            docs.append((ids.astype(np.int32), (counts / max(1, len(own))).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    layer = np.zeros((dim, 2), np.float32)
    offset = np.array([0, bias], np.float32)
    seen_v, seen_l = np.full(size, 1e-6, np.float32), np.full((dim, 2), 1e-6, np.float32)
    layer += rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(docs)):
            ids, part = docs[i]
            if not len(ids):
                continue
            mean = part @ vectors[ids]
            z = mean @ layer + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weights[i]
            back = layer @ p
            grad = np.outer(mean, p)
            seen_l += grad * grad
            layer -= step * 0.2 * grad / np.sqrt(seen_l)
            offset -= step * 0.02 * p
            # one AdaGrad accumulator for each bucket: the features' shares times the gradient's length
            seen_v[ids] += part * part * (back @ back)
            vectors[ids] -= (step * part / np.sqrt(seen_v[ids]))[:, None] * back
    pull = vectors @ (layer[:, 1] - layer[:, 0])
    return np.concatenate([pull, [offset[1] - offset[0]]]).astype(np.float32)


def scores(column: pa.Array, model: np.ndarray) -> np.ndarray:
    """The probability of label 1 for each text; an empty text gets the bias alone."""
    out = np.zeros(len(column))
    pull, bias = model[:-1], float(model[-1])
    for s in ht.slices(column):
        total, number = np.zeros(len(s)), np.zeros(len(s))
        for ids, i, j in feature_blocks(s):
            total += ht.sums(pull[ids], i, j)
            number += j - i
        out[s.first : s.first + len(s)] = 1 / (1 + np.exp(-np.clip(total / np.maximum(number, 1) + bias, -40, 40)))
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", learn: F.Column | None = None, per_label: int = 2000) -> np.ndarray:
    """Fit on at most `per_label` rows of each label, drawn by hashed id from the labels that `learn` allows.

    The rows' weights restore how often each label is seen over all allowed rows. Null labels and ids are
    left out; of an id with several labels the largest counts, of one with several texts the first in order.
    """
    allowed = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (learn if learn is not None else F.lit(True)))
    rows = allowed.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    counts = {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}
    picked = bounded_sample(rows, "_id", "_y", per_label)
    data = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")
    total = sum(counts.values()) or 1
    weight = {y: counts.get(y, 0) / total * 2 / max(1, min(per_label, counts.get(y, 0))) for y in (0, 1)}

    def run(table: pa.Table | None) -> bytes:
        if table is None:
            return fit(pa.array([], pa.string()), np.zeros(0, int), np.zeros(0)).tobytes()
        table = table.sort_by("_id").combine_chunks()
        y = table["_y"].to_numpy()
        w = np.array([weight[v] for v in y.tolist()])
        return fit(table["_text"].combine_chunks(), y, w / w.mean()).tobytes()

    return np.frombuffer(train_once(one_text(data, "_id", "_y").select("_id", "_text", "_y"), run), np.float32)


def score(docs: DataFrame, model: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with one more column: the probability of label 1 (null text: as empty). All columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(free_name(docs.columns, out), T.DoubleType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(batch.column(at), held.value))], names=schema.names)

    return per_batch(docs, schema, work)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1, threshold: float = 0.5, per_label: int = 2000) -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs, null and empty texts included.

    Labels are learnt only from ids whose crc32 modulo `folds` is not `held`. Other columns are not read.
    """
    model = train(docs, labels, "quality", id_col, text_col, fold(id_col, folds) != held, per_label)
    scored = score(docs.select(id_col, text_col), model, text_col)
    return scored.select(
        id_col, (fold(id_col, folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, per_label: int = 2000) -> DataFrame:
    """The rows of docs that score at least the threshold; all columns stay as they are."""
    model = train(docs, labels, "quality", id_col, text_col, None, per_label)
    name = free_name(docs.columns, "score")
    return score(docs, model, text_col, name).where(F.col(name) >= threshold).drop(name)
