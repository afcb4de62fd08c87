"""Ranked lexical search with a bit-sliced impact index.

An item's terms are looked for in all documents; a document's score is the sum over the item's terms of the term's weight times
the term's impact there, all in whole numbers. One pass over the texts counts what the weights need. A second one
builds the index, in blocks of documents: a term's impacts in a block are kept as bitmaps over the block's documents, one for
each bit of the number. A query adds its terms' bitmaps into slices of a sum by bitwise carries, sixty-four
documents to a machine word; the k best fall out of the slices from the highest down. Each block gives its
k best for each item, and Spark ranks these.

A block ends at DOCUMENTS documents or POSTINGS pairs of document and term, so a task's memory doesn't grow with the table.
Every document is in the index and nothing is left out of a sum: the result is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import cut

#: Limits of a block of the index.
DOCUMENTS, POSTINGS = 1 << 15, 2_000_000
#: Items of one pass over the documents, and bytes of their text (or one item, if that is longer).
ITEMS, ITEM_BYTES = 1024, 8 << 20
#: Items whose sums are held at once in a task.
TOGETHER = 128

#: Bytes that belong to a term (letters, digits, all beyond ASCII), A-Z as a-z; all others part terms.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ") if text else []


def counted(text: str | None) -> tuple[Counter, int]:
    """How often each term is in the text, and all of them together."""
    tally = Counter(terms(text))
    tally.pop(b"", None)
    return tally, sum(tally.values())


def weight(documents: int, holding: int) -> int:
    return int(np.floor(1000 * np.log((2 * documents + 2) / (2 * holding + 1))))


def slices(values: np.ndarray, places: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of the bits of values, lowest first: bit p of row b is bit b of the value at place p."""
    depth = int(values.max()).bit_length()
    bits = np.zeros((depth, 64 * words), np.uint8)
    bits[:, places] = (values[None, :] >> np.arange(depth)[:, None]) & 1
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def add(sums: np.ndarray, rows: np.ndarray, addend: np.ndarray, shift: int = 0) -> None:
    """sums[rows] += addend << shift, where sums is (slice, item, word) and addend (slice, word): a ripple of carries."""
    carry = np.zeros((len(rows), addend.shape[1]), np.uint64)
    for level in range(shift, len(sums)):
        own = sums[level, rows]
        more = addend[level - shift] if level - shift < len(addend) else None
        if more is None:
            if not carry.any():
                return
            sums[level, rows] = own ^ carry
            carry &= own
        else:
            either = own ^ more
            sums[level, rows] = either ^ carry
            carry = (own & more) | (either & carry)
    if carry.any():
        raise OverflowError("a sum needs more slices")


def best(sums: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each item the places of its k greatest sums above 0 (ties: first places) in order of place, and these sums."""
    some = np.bitwise_or.reduce(sums, axis=0)
    sure, open_ = np.zeros_like(some), some.copy()
    for level in range(len(sums) - 1, -1, -1):
        with_bit = open_ & sums[level]
        enough = np.bitwise_count(sure | with_bit).sum(axis=1, dtype=np.int64) >= k
        # k or more have this bit: the others are out; fewer: all of these are in, and the others stay open
        sure = np.where(enough[:, None], sure, sure | with_bit)
        open_ = np.where(enough[:, None], with_bit, open_ & ~sums[level])
    out = []
    for item in range(sums.shape[1]):
        surely = _places(sure[item])
        found = np.sort(np.concatenate([surely, _places(open_[item])[: k - len(surely)]]))
        word, bit = np.divmod(found, 64)
        held = (sums[:, item, word] >> bit.astype(np.uint64)) & np.uint64(1)
        out.append((found, (held.astype(np.int64) << np.arange(len(sums))[:, None]).sum(axis=0)))
    return out


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Block:
    """Documents and their postings of the terms that are asked for; `scores` turns them into slices and adds."""

    def __init__(self) -> None:
        self.ids, self.norms, self.terms, self.places, self.tf = [], [], [], [], []

    def full(self) -> bool:
        return len(self.ids) >= DOCUMENTS or len(self.terms) >= POSTINGS

    def put(self, doc_id: object, tally: Counter, vocabulary: dict[bytes, int], norm: int) -> None:
        """A document and its terms; one without any of the vocabulary has no bit in the index."""
        own = [(vocabulary[t], times) for t, times in tally.items() if t in vocabulary]
        if own:
            self.places += [len(self.ids)] * len(own)
            self.ids.append(doc_id)
            self.norms.append(norm)
            self.terms += [t for t, _ in own]
            self.tf += [times for _, times in own]

    def scores(self, weights: np.ndarray, queries: list[dict[int, int]], k: int) -> Iterator[tuple[int, object, int]]:
        """(item's number, document, score) of each item's k best here."""
        if not self.ids:
            return
        # places follow the ids, so that of equal sums the first place has the smallest id
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i]))
        ids, place_of = [self.ids[i] for i in order], np.empty(len(order), np.int64)
        place_of[order] = np.arange(len(order))
        term, places, tf = np.array(self.terms, np.int64), np.array(self.places, np.int64), np.array(self.tf, np.int64)
        values = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.array(self.norms, np.int64)[places]))
        places, by_term = place_of[places], np.argsort(term, kind="stable")
        runs = np.split(by_term, np.flatnonzero(np.diff(term[by_term])) + 1)
        # an impact is at most 1000000: the greatest sum that can come up
        most = max((sum(int(weights[t]) * times for t, times in q.items()) for q in queries), default=0) * 1_000_000
        depth, words = max(1, most.bit_length()), -(-len(ids) // 64)
        for begin in range(0, len(queries), TOGETHER):
            own = queries[begin : begin + TOGETHER]
            askers: dict[int, list[tuple[int, int]]] = {}
            for number, query in enumerate(own):
                for t, times in query.items():
                    askers.setdefault(t, []).append((number, times))
            sums = np.zeros((depth, len(own), words), np.uint64)
            for run in runs:
                asking = askers.get(int(term[run[0]]))
                if asking and values[run].any():
                    bitmaps = slices(values[run], places[run], words)
                    for bit in range(max(times for _, times in asking).bit_length()):
                        rows = np.array([n for n, times in asking if times >> bit & 1], np.int64)
                        if len(rows):
                            add(sums, rows, bitmaps, bit)
            for n, (found, scores) in enumerate(best(sums, k)):
                yield from ((begin + n, ids[p], int(s)) for p, s in zip(found, scores, strict=True))


def _statistics(texts: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and the documents that hold each term of the vocabulary, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, total, holding = 0, 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tally, n = counted(text)
                documents, total = documents + (n > 0), total + n
                holding[[vocabulary[t] for t in tally.keys() & vocabulary.keys()]] += 1
        some = np.flatnonzero(holding)
        numbers = np.concatenate([[-2, -1], some])
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(np.concatenate([[documents, total], holding[some]]), pa.int64())], names=["term", "n"])

    # one row for each term of the items, whose number is bounded
    found = {r[0]: r[1] for r in texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()}
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(t, 0) for t in range(len(vocabulary))], np.int64)


def _ranked(docs: DataFrame, items: list[tuple], k: int, schema: T.StructType) -> DataFrame:
    """(_item, id, document, score): each block's k best for each of the items [(id, tally of terms)]."""
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(tally for _, tally in items))))}
    documents, total, holding = _statistics(docs.select("_text"), vocabulary)
    weights = np.array([weight(documents, int(x)) for x in holding], np.int64)
    queries, names = [{vocabulary[t]: times for t, times in tally.items()} for _, tally in items], [name for name, _ in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(block: Block) -> pa.RecordBatch:
            found = list(block.scores(weights, queries, k))
            columns = [[n for n, _, _ in found], [names[n] for n, _, _ in found], [d for _, d, _ in found], [s for _, _, s in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

        block, kinds = Block(), None
        for batch in batches:
            kinds = [pa.int64(), item_kind, batch.schema.field(0).type, pa.int64()]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tally, n = counted(text)
                if n:
                    block.put(doc_id, tally, vocabulary, 100 - 75 + 75 * n * documents // total)
                if block.full():
                    yield rows(block)
                    block = Block()
        if block.ids:
            yield rows(block)

    item_kind = to_arrow_type(schema[1].dataType)
    return docs.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank, document, score): each item's k best documents with a score above 0, equal scores by ascending id.

    A term is a run of letters, digits and characters beyond ASCII, A-Z in lower case. Null and empty texts have none: such
    items give no rows, such documents are found by none and count for nothing. Repeated rows of docs are documents of their
    own. Repeated rows of items give one ranking; one id with several texts a ranking for each text. A null document id comes after all
    others of its score. Empty tables give an empty result. Other columns are not read, so their names can't clash.

    Items come to the driver in packs of about ITEMS rows or ITEM_BYTES bytes, whatever their number; each pack reads the
    documents twice. What leaves a task is k rows for each item and block.
    """
    asked = cut(items.select(F.col(item_col).alias("_item"), F.col(item_text_col).alias("_text")).where("_text is not null").distinct())
    size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    packs = max(1, -(-size[0] // ITEMS), -(-size[1] // ITEM_BYTES))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kinds = [T.LongType(), items.schema[item_col].dataType, docs.schema[id_col].dataType, T.LongType()]
    schema = T.StructType([T.StructField(n, kind) for n, kind in zip(("_number", "_item", "_id", "_score"), kinds, strict=True)])
    found = None
    for pack in range(packs):
        own = [(name, counted(text)[0]) for name, text in asked.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(packs)) == pack).collect()]
        own = [(name, tally) for name, tally in own if tally]
        if own:
            part = _ranked(texts, own, k, schema).withColumn("_pack", F.lit(pack))
            found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema).withColumn("_pack", F.lit(0))
    first = Window.partitionBy("_pack", "_number").orderBy(F.col("_score").desc(), F.col("_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.select(F.col("_item").alias(item_col), "rank", F.col("_id").alias(id_col), F.col("_score").alias("score"))


def oracle(k: int = 10) -> str:
    """The same by DuckDB over documents and benchmark: postings joined and summed."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    split = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {split} AS t FROM documents),
g AS (SELECT count(*) AS nn, CAST(sum(len(t)) AS BIGINT) AS ll FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY r, doc_id, n, term),
b AS (SELECT item_id, q, term, count(*) AS times FROM (SELECT item_id, row_number() OVER () AS q, unnest({split}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, q, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g WHERE term IN (SELECT term FROM b) GROUP BY term, nn),
s AS (SELECT item_id, q, doc_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll)))) AS BIGINT) AS score
 FROM b JOIN w USING (term) JOIN p USING (term), g GROUP BY item_id, q, doc_id, r),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= {k}"""
