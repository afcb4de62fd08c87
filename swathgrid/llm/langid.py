"""Language identification by error-correcting output codes over hashed n-grams.

Each language has a codeword of bits. One binary linear classifier for each bit, over hashed character
n-grams and words, says how far a text leans to 1 or 0. The nearest codeword wins, where each bit's
logistic loss counts by how reliable that bit's classifier was on rows kept from its training. If the
second nearest is almost as near, the text is flagged as ambiguous.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashed_text as ht
from .common import bounded_sample, fold, one_text, per_batch, train_once

BITS = 16
GRAMS = (2, 3, 4)
#: Up to so many languages have all 2**(k-1) - 1 splits as bits; more get random codes.
EXHAUSTIVE = 6


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """A k x L matrix of +1 and -1: every split of the languages, or of many draws the code with the widest least distance."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= EXHAUSTIVE:
        return np.array([[1 if i == 0 or not j >> (i - 1) & 1 else -1 for j in range(1, 1 << (k - 1))] for i in range(k)])
    rng, best = np.random.default_rng(seed), None
    for _ in range(200):
        code = rng.choice([-1, 1], (k, int(np.ceil(10 * np.log2(k)))))
        apart = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        split = np.abs(code.sum(0)).max() < k
        if split and (best is None or apart > best[0]):
            best = (apart, code)
    return best[1]


def feature_blocks(s: ht.Slice) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = [(ht.char_grams(s, n, BITS), s.bounds[:-1], np.maximum(s.bounds[1:] - n + 1, s.bounds[:-1])) for n in GRAMS]
    w = ht.words(s, proper=True)
    return [*out, (ht.bucket(w.hashes, BITS, 3), w.bounds[:-1], w.bounds[1:])]


def fit(texts: pa.Array, langs: list[str], epochs: int = 5, rate: float = 1.0, seed: int = 5) -> dict[str, np.ndarray]:
    """{names, code, pull: bucket x bit, trust: of each bit}. Without rows there are no names."""
    names = sorted(set(langs))
    code = codewords(len(names))
    pull = np.zeros((1 << BITS, code.shape[1] if names else 1), np.float32)
    model = {"names": np.array(names, dtype="U"), "code": code.astype(np.float32), "pull": pull, "trust": np.ones(pull.shape[1], np.float32)}
    if len(names) < 2:
        return model
    docs, target = [], code[[names.index(x) for x in langs]].astype(np.float32)
    for s in ht.slices(texts, lower=True):
        blocks = feature_blocks(s)
        for k in range(len(s)):
            ids, counts = np.unique(np.concatenate([b[i[k] : j[k]] for b, i, j in blocks]), return_counts=True)
            docs.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    kept, learnt = order[: len(docs) // 10], order[len(docs) // 10 :]
    balance = {x: len(langs) / len(names) / langs.count(x) for x in names}
    seen = np.full(pull.shape[0], 1e-6, np.float32)
    for epoch in range(epochs):
        for i in rng.permutation(learnt):
            ids, part = docs[i]
            if len(ids):
                lean = part @ pull[ids]
                back = -target[i] / (1 + np.exp(np.clip(target[i] * lean, -30, 30))) * balance[langs[i]]
                seen[ids] += part * part * (back @ back)
                pull[ids] -= (rate * (1 - epoch / epochs) * part / np.sqrt(seen[ids]))[:, None] * back
    right = np.array([np.sign(docs[i][1] @ pull[docs[i][0]]) == target[i] for i in kept if len(docs[i][0])])
    share = right.mean(0) if len(right) else np.full(pull.shape[1], 0.75)
    share = np.clip(share, 0.5 + 1e-3, 1 - 1e-3)
    trust = np.log(share / (1 - share))
    return model | {"trust": (trust / trust.sum()).astype(np.float32)}


def decode(lean: np.ndarray, model: dict[str, np.ndarray], ambiguous: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, ambiguous) from each text's lean on each bit, by the trusted sum of the bits' logistic losses."""
    loss = np.stack([(np.logaddexp(0, -lean * row) * model["trust"]).sum(1) for row in model["code"]], 1)
    odds = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
    odds /= odds.sum(1, keepdims=True)
    two = np.sort(odds, 1)[:, ::-1]
    close = two[:, 0] - two[:, 1] < ambiguous if odds.shape[1] > 1 else np.zeros(len(odds), bool)
    return loss.argmin(1), two[:, 0], close


def leans(column: pa.Array, model: dict[str, np.ndarray]) -> np.ndarray:
    out = np.zeros((len(column), model["pull"].shape[1]))
    for s in ht.slices(column, lower=True):
        total, number = np.zeros((len(s), out.shape[1])), np.zeros(len(s))
        for ids, i, j in feature_blocks(s):
            total += ht.sums(model["pull"][ids], i, j)
            number += j - i
        out[s.first : s.first + len(s)] = total / np.maximum(number, 1)[:, None]
    return out


def _pack(model: dict[str, np.ndarray]) -> bytes:
    np.savez(out := io.BytesIO(), **model)
    return out.getvalue()


def _unpack(octets: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(octets)) as held:
        return {k: held[k] for k in held.files}


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", learn: F.Column | None = None, per_lang: int = 1200) -> dict[str, np.ndarray]:
    """Fit on at most `per_lang` rows of each language, drawn by hashed id. Null languages, texts and ids
    are left out; of rows that repeat id and language the first text in order counts."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (learn if learn is not None else F.lit(True)))
    rows = rows.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    if rows.isEmpty():
        return fit(pa.array([], pa.string()), [])
    picked = bounded_sample(rows.distinct(), "_id", "_lang", per_lang)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_l"))
    data = texts.join(F.broadcast(picked), (texts["_id"] == picked["_id"]) & (F.col("_l") == F.col("_lang"))).select(texts["_id"].alias("_id"), "_text", "_lang")

    def run(table: pa.Table | None) -> bytes:
        if table is None:
            return _pack(fit(pa.array([], pa.string()), []))
        table = table.sort_by([("_id", "ascending"), ("_lang", "ascending")])
        return _pack(fit(table["_text"].combine_chunks(), table["_lang"].to_pylist()))

    return _unpack(train_once(one_text(data, "_id", "_lang").select("_id", "_text", "_lang"), run))


def identify(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", ambiguous: float = 0.1) -> DataFrame:
    """(id, lang_pred, score, ambiguous) for every row. `und` with score 0 for null texts and texts without a letter, and if nothing was learnt."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, column = held.value, batch.column(1)
        lettered = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
        if len(own["names"]):
            best, score, close = decode(leans(column, own), own, ambiguous)
            names = np.where(lettered, own["names"][best], "und")
            score, close = np.where(lettered, score, 0.0), close & lettered
        else:
            names, score, close = np.full(len(column), "und"), np.zeros(len(column)), np.zeros(len(column), bool)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(close)], names=schema.names)

    return per_batch(docs.select(id_col, text_col), schema, work)


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, per_lang: int = 1200) -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous) for every row of docs; learns only from ids whose crc32 modulo `folds` isn't `held`."""
    model = train(docs, lang_col, id_col, text_col, fold(id_col, folds) != held, per_lang)
    found = identify(docs, model, id_col, text_col)
    return found.select(id_col, (fold(id_col, folds) == held).alias("held_out"), "lang_pred", "score", "ambiguous")
