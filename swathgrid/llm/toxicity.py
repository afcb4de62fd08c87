"""Toxicity: a factorization machine over hashed terms.

A text is the set of its hashed terms: its words (letters and digits, lower-cased) and their beginnings,
so that an insult is met in all its endings. Its score is the logistic of
bias + sum of the terms' weights + sum over pairs of terms of the product of their factor vectors, so a
pair such as an insult with a mention of a group can weigh more than its two terms alone. Trained by
AdaGrad in numpy, in one task, on a bounded sample of labelled rows.

Terms get weight and factors if they tell the labels apart by themselves (`apart` standard errors, seen in `least` sampled
texts), or in a pair: of the `paired` terms seen most, all pairs are tested for texts whose label single terms don't
explain, so that both terms of a pair may be as common under either label. Other terms have no weight, so that a long
text isn't judged by the sum of what its common words weigh by chance.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashed_text as ht
from .common import bounded_sample, fold, free_name, one_text, per_batch, train_once

BITS = 20
FACTORS = 4
#: Bytes of the word beginnings that are terms of their own.
PREFIXES = (4, 5, 6)


def terms(s: ht.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(text of the slice, bucket), each pair once, ordered by text."""
    w = ht.words(s, proper=True)
    doc = np.repeat(np.arange(len(s)), np.diff(w.bounds))
    own = [doc << BITS | ht.bucket(w.hashes, BITS, 4)]
    for size in PREFIXES:
        at, h = w.prefixes(size)
        own.append(doc[at] << BITS | ht.bucket(h, BITS, 4 + size))
    both = np.unique(np.concatenate(own))
    return both >> BITS, both & ((1 << BITS) - 1)


def _linear(docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, size: int, bias: float, rng: np.random.Generator, epochs: int = 3, rate: float = 0.1) -> np.ndarray:
    """The probability of label 1 for each text by its terms' weights alone."""
    w, seen = np.zeros(size, np.float32), np.full(size, 1e-4, np.float32)
    for epoch in range(epochs):
        for i in rng.permutation(len(docs)):
            ids = docs[i]
            g = (1 / (1 + np.exp(-np.clip(bias + w[ids].sum(), -30, 30))) - labels[i]) * weights[i]
            seen[ids] += g * g
            w[ids] -= rate * (1 - epoch / epochs) * g / np.sqrt(seen[ids])
    return 1 / (1 + np.exp(-np.clip([bias + w[ids].sum() for ids in docs], -30, 30)))


def interacting(docs: list[np.ndarray], labels: np.ndarray, p: np.ndarray, terms: np.ndarray, size: int, apart: float, block: int = 2048) -> np.ndarray:
    """Those of the terms that meet another one in texts whose label is not what single terms say (p), by `apart` standard errors.

    Exact over all pairs of the terms: what is left of the labels, summed over the texts that hold both, against its
    standard error.
    """
    place = np.full(size, -1)
    place[terms] = np.arange(len(terms))
    rest, spread = np.zeros((len(terms), len(terms)), np.float32), np.zeros((len(terms), len(terms)), np.float32)
    for at in range(0, len(docs), block):
        own = docs[at : at + block]
        held = np.zeros((len(own), len(terms)), np.float32)
        for row, ids in enumerate(own):
            held[row, place[ids][place[ids] >= 0]] = 1
        expected = p[at : at + block]
        rest += (held * (labels[at : at + block] - expected)[:, None].astype(np.float32)).T @ held
        spread += (held * (expected * (1 - expected))[:, None].astype(np.float32)).T @ held
    z = np.abs(rest) / np.sqrt(np.maximum(spread, 0.5))
    np.fill_diagonal(z, 0)
    return terms[(z >= apart).any(axis=1)]


def fit(
    texts: pa.Array, labels: np.ndarray, weights: np.ndarray, least: int = 3, apart: float = 3.0, paired: int = 3072, pair_apart: float = 6.0,
    epochs: int = 12, rate: float = 0.1, decay: float = 2e-4, seed: int = 3,
) -> dict[str, np.ndarray]:
    """{slot: of each bucket, 0 for none; w, v: of each slot; bias}."""
    docs = []
    for s in ht.slices(texts, lower=True):
        doc, ids = terms(s)
        ends = np.searchsorted(doc, np.arange(len(s) + 1))
        docs += [ids[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
    seen = [np.bincount(np.concatenate([np.zeros(0, int), *(d for d, y in zip(docs, labels, strict=True) if y == k)]), minlength=1 << BITS) for k in (0, 1)]
    n, both = [max(1, int((labels == k).sum())) for k in (0, 1)], seen[0] + seen[1]
    even = both / (n[0] + n[1])
    z = (seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(np.maximum(even * (1 - even), 1e-12) * (1 / n[0] + 1 / n[1]))
    known = np.flatnonzero((both >= least) & (np.abs(z) >= apart))
    rng = np.random.default_rng(seed)
    share = float(np.average(labels, weights=weights)) if len(labels) else 0.5
    bias = np.log((share + 1e-3) / (1 - share + 1e-3))
    learns = len(set(labels.tolist())) == 2

    def chosen(kept: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        slot = np.zeros(1 << BITS, np.int32)
        slot[kept] = np.arange(1, len(kept) + 1)
        return slot, [(x := slot[d])[x > 0] for d in docs]

    if learns:
        # beside the terms that tell labels apart by themselves, those that do so in pairs
        p = _linear(chosen(known)[1], labels, weights, len(known) + 1, bias, rng)
        often = np.argsort(np.where(both >= max(least, 2 * pair_apart), -both, 0), kind="stable")[:paired]
        often = often[both[often] >= max(least, 2 * pair_apart)]
        known = np.union1d(known, interacting(docs, labels, p, often, 1 << BITS, pair_apart))
    slot, docs = chosen(known)
    w = np.zeros(len(known) + 1, np.float32)
    v = rng.normal(0, 0.01, (len(known) + 1, FACTORS)).astype(np.float32)
    v[0] = 0
    if learns:
        seen_w, seen_v, seen_b = np.full(len(w), 1e-4, np.float32), np.full(v.shape, 1e-4, np.float32), 1e-4
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for i in rng.permutation(len(docs)):
                ids = docs[i]
                total = v[ids].sum(0)
                z = bias + w[ids].sum() + 0.5 * float(total @ total - (v[ids] ** 2).sum())
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]) * weights[i]
                seen_b += g * g
                bias -= step * g / np.sqrt(seen_b)
                if len(ids):
                    gw = g + decay * w[ids]
                    gv = g * (total - v[ids]) + decay * v[ids]
                    seen_w[ids] += gw * gw
                    seen_v[ids] += gv * gv
                    w[ids] -= step * gw / np.sqrt(seen_w[ids])
                    v[ids] -= 0.2 * step * gv / np.sqrt(seen_v[ids])
    return {"slot": slot, "w": w, "v": v, "bias": np.array([bias])}


def scores(column: pa.Array, model: dict[str, np.ndarray]) -> np.ndarray:
    """The probability of label 1 for each text; an empty text gets the bias alone."""
    out = np.zeros(len(column))
    for s in ht.slices(column, lower=True):
        doc, ids = terms(s)
        at = model["slot"][ids]
        doc, at = doc[at > 0], at[at > 0]
        ends = np.searchsorted(doc, np.arange(len(s) + 1))
        v = model["v"][at].astype(np.float64)
        total = ht.sums(v, ends[:-1], ends[1:])
        z = float(model["bias"][0]) + ht.sums(model["w"][at], ends[:-1], ends[1:]) + 0.5 * ((total**2).sum(1) - ht.sums((v**2).sum(1), ends[:-1], ends[1:]))
        out[s.first : s.first + len(s)] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return out


def _pack(model: dict[str, np.ndarray]) -> bytes:
    np.savez_compressed(out := io.BytesIO(), **model)
    return out.getvalue()


def _unpack(octets: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(octets)) as held:
        return {k: held[k] for k in held.files}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", learn: F.Column | None = None, per_label: int = 5000) -> dict[str, np.ndarray]:
    """Fit on at most `per_label` rows of each label, drawn by hashed id from the labels that `learn` allows.

    The rows' weights restore how often each label is seen. Null labels and ids are left out; of an id
    with several labels the largest counts, of one with several texts the first in order.
    """
    allowed = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (learn if learn is not None else F.lit(True)))
    rows = allowed.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    counts = {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}
    picked = bounded_sample(rows, "_id", "_y", per_label)
    data = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")
    total = sum(counts.values()) or 1
    weight = {y: counts.get(y, 0) / total / max(1, min(per_label, counts.get(y, 0))) for y in (0, 1)}

    def run(table: pa.Table | None) -> bytes:
        if table is None:
            return _pack(fit(pa.array([], pa.string()), np.zeros(0, int), np.zeros(0)))
        table = table.sort_by("_id")
        y = table["_y"].to_numpy()
        w = np.array([weight[k] for k in y.tolist()])
        return _pack(fit(table["_text"].combine_chunks(), y, w / w.mean()))

    return _unpack(train_once(one_text(data, "_id", "_y").select("_id", "_text", "_y"), run))


def score(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with one more column: the probability that a text is toxic (null text: as empty). All columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(free_name(docs.columns, out), T.DoubleType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(batch.column(at), held.value))], names=schema.names)

    return per_batch(docs, schema, work)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held: int = 2, threshold: float = 0.3, per_label: int = 5000) -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs, null and empty texts included.

    Labels are learnt only from ids whose crc32 modulo `folds` is not `held`. Other columns are not read.
    """
    model = train(docs, labels, "toxic", id_col, text_col, fold(id_col, folds) != held, per_label)
    scored = score(docs.select(id_col, text_col), model, text_col)
    return scored.select(
        id_col, (fold(id_col, folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
