"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask such as 111011 says which words of a window are hashed and which are passed over, so a window is found though the
words passed over differ. Every item gets the first family of masks, heaviest first, that is proven to cover it: however the words
that may differ are placed, one window of one mask is free of them. (For items of up to five words of which none may differ, and
where no family covers, the mask passes over nothing: the whole item, or a block of it by pigeonhole.) All windows of the
training texts are hashed under the masks in use, where the texts are read, and joined with the items' hashes. At
each hit the text is laid beside the whole item, word by word, and the agreeing words are counted.

Up to BLOCK benchmark hashes are broadcast and no text is shuffled: the words at a hit go along with it. Beyond, the hashes
of both sides are shuffled once, and only texts with hits are read again.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

#: Families of masks, heaviest first.
FAMILIES = (("111101", "111011"), ("11101",), ("11011",), ("11101", "110011"), ("11101", "10111"), ("1101",), ("1101", "1011"))
#: Rows of benchmark hashes that are broadcast (about 50 bytes each).
BLOCK = 1_000_000
#: Words of the benchmark up to which its items are broadcast for the count.
WORDS = 4_000_000


@cache
def tolerance(n: int, masks: tuple[str, ...]) -> int:
    """A number of words that may be replaced anywhere in n words, and yet a window of a mask is free of them; -1 if no mask fits in.

    Exact up to 24 words. Beyond, the two halves are taken: of a + b + 1 replaced words the first half holds at most
    a or the second at most b.
    """
    if n > 24:
        return tolerance(n // 2, masks) + tolerance(n - n // 2, masks) + 1
    windows = [frozenset(at + i for i, c in enumerate(m) if c == "1") for m in masks for at in range(n - len(m) + 1)]

    def hit(left: int, free: list[frozenset]) -> bool:
        """Can `left` replaced words hit all windows?"""
        return not free or left > 0 and any(hit(left - 1, [w for w in free if p not in w]) for p in free[0])

    k = 0
    while not hit(k, windows):
        k += 1
    return k - 1


def masks_for(n: int, share: float) -> tuple[str, ...]:
    """The masks for items of n words, of which at least `share` must agree."""
    lost = n - math.ceil(share * n - 1e-9)
    if not lost and n < len(FAMILIES[0][0]):
        return ("1" * n,)
    return next((f for f in FAMILIES if tolerance(n, f) >= lost), ("1" * max(1, n // (lost + 1)),))


def words(text: str) -> Column:
    """Lower-cased runs of letters and digits; none for a null text."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def windows(rows: DataFrame, along: list[str], masks: list[str]) -> DataFrame:
    """(along, _at, _mask, _seed): every window of rows' `_w` under every mask, from one pass over the words.

    Only hashes of words go from row to row: each laid beside those of the words that follow it.
    """
    span = max(map(len, masks))
    hashed = rows.select(*along, F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))
    # arrays_zip lays NULL beside the last words: a window that has one is not whole
    beside = [F.slice("_h", k + 1, F.greatest(F.size("_h") - k, F.lit(0))).alias(f"_{k}") for k in range(span)]
    laid = hashed.where(F.size("_h") >= min(map(len, masks))).select(*along, F.inline(F.arrays_zip(F.sequence(F.lit(0), F.size("_h") - 1).alias("_at"), *beside)))
    seeds = [F.xxhash64(F.lit(m), *(f"_{i}" for i, c in enumerate(m) if c == "1")) for m in masks]
    marked = [F.when(F.col(f"_{len(m) - 1}").isNotNull(), F.struct(F.lit(m).alias("_mask"), seed.alias("_seed"))) for m, seed in zip(masks, seeds, strict=True)]
    return laid.select(*along, "_at", F.inline(F.array(*marked))).where("_seed is not null")


def _item_hashes(items: DataFrame, share: float) -> tuple[DataFrame | None, list[str]]:
    """((_key, _item, _iat, _n) for all windows of all items under their own masks, the masks in use)."""
    sizes = [r[0] for r in items.select(F.size("_w").alias("n")).distinct().collect()]  # as many as there are lengths
    own = [(n, m) for n in sizes for m in masks_for(n, share)]
    masks = sorted({m for _, m in own})
    if not own:
        return None, []
    uses = F.broadcast(items.sparkSession.createDataFrame(own, "_n int, _mask string"))
    laid = windows(items.withColumn("_n", F.size("_w")), ["_item", "_n"], masks).join(uses, ["_n", "_mask"])
    return cut(laid.select(F.col("_seed").alias("_key"), "_item", F.col("_at").alias("_iat"), "_n").distinct()), masks


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    share: float = 0.8, block: int = BLOCK,
) -> DataFrame:
    """(id, item, item_words, matched, share): each pair of a text and a benchmark item that it holds.

    A pair counts if, laid side by side somewhere, at least `share` of the item's words agree (the most of
    all its hits is told); the item may reach beyond the text. Every such pair is found. Null and empty texts and items, or
    such without words, match nothing. Null ids are kept as an id; repeated rows give one pair. Empty tables give an empty
    result. Other columns are not read, so their names can't clash.
    """
    items = cut(benchmark.select(F.col(item_col).alias("_item"), words(item_text_col).alias("_w")).where(F.size("_w") > 0).distinct())
    hashes, masks = _item_hashes(items, share)
    names = (id_col, item_col, "item_words", "matched", "share")
    if hashes is None:
        kinds = (docs.schema[id_col].dataType, items.schema["_item"].dataType, "int", "int", "double")
        return items.select(*(F.lit(None).cast(kind).alias(x) for x, kind in zip(names, kinds, strict=True))).where("false")
    small = (items.agg(F.sum(F.size("_w"))).first()[0] or 0) <= WORDS
    sides = items.select(F.col("_item").alias("_own"), F.col("_w").alias("_iw"))
    sides = F.broadcast(sides) if small else sides
    texts = docs.select(F.col(id_col).alias("_id"), words(text_col).alias("_w"))
    begin, n = F.col("_begin"), F.col("_n")
    if hashes.count() <= block:
        laid = windows(texts.withColumn("_text_words", F.col("_w")), ["_id", "_text_words"], masks)
        met = laid.join(F.broadcast(hashes), F.col("_seed") == F.col("_key")).select("_id", "_text_words", "_item", "_n", (F.col("_at") - F.col("_iat")).alias("_begin"))
    else:
        hits = windows(texts, ["_id"], masks).join(hashes, F.col("_seed") == F.col("_key"))
        hits = hits.select(F.col("_id").alias("_hit"), "_item", "_n", (F.col("_at") - F.col("_iat")).alias("_begin")).distinct()
        met = texts.withColumnRenamed("_w", "_text_words").join(hits, F.col("_id").eqNullSafe(F.col("_hit")))
    # the words where the item would be in the text, as far as the text reaches
    beside = F.slice("_text_words", F.greatest(begin, F.lit(0)) + 1, F.greatest(n + F.least(begin, F.lit(0)), F.lit(0)))
    both = met.select("_id", "_item", "_n", "_begin", beside.alias("_beside")).join(sides, F.col("_item").eqNullSafe(F.col("_own")) & (F.size("_iw") == n))
    mine = F.slice("_iw", F.greatest(-begin, F.lit(0)) + 1, F.size("_iw"))
    same = F.size(F.filter(F.zip_with(mine, "_beside", lambda a, b: a == b), lambda x: x))
    enough = F.col("matched") >= F.ceil(F.lit(share) * F.col("item_words") - 1e-9)
    found = both.select("_id", "_item", n.alias("item_words"), same.alias("matched")).where(enough)
    pairs = found.groupBy("_id", "_item").agg(F.max("item_words").alias("item_words"), F.max("matched").alias("matched"))
    return pairs.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "item_words", "matched", F.round(F.col("matched") / F.col("item_words"), 6).alias("share"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs whose id holds no benchmark item; all columns stay. Rows with a null id stay."""
    name = free_name(docs.columns, "contaminated_id")
    gone = contaminated(docs, benchmark, id_col, text_col, **how).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")


def oracle(share: float = 0.8) -> str:
    """The same by DuckDB over documents and benchmark: agreeing words counted at every offset, without masks."""
    split = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH b AS (SELECT item_id, w, row_number() OVER () AS k FROM (SELECT DISTINCT item_id, {split} AS w FROM benchmark)),
d AS (SELECT doc_id, {split} AS w, row_number() OVER () AS r FROM documents),
bw AS (SELECT k, item_id, len(w) AS n, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM b),
dw AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
hit AS (SELECT doc_id, item_id, any_value(n) AS n, count(*) AS matched FROM dw JOIN bw USING (word) GROUP BY r, k, dw.pos - bw.pos, doc_id, item_id)
SELECT doc_id, item_id, CAST(max(n) AS INTEGER) AS item_words, CAST(max(matched) AS INTEGER) AS matched, round(max(matched) / max(n)::DOUBLE, 6) AS share
FROM hit WHERE matched >= ceil({share}::DOUBLE * n - 1e-9) GROUP BY doc_id, item_id"""
