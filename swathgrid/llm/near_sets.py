"""Links between texts by the Jaccard similarity of their shingle sets, SimHash first and then what it misses.

SimHash fingerprints of the sets are searched by the pigeonhole principle, and compared within a wider radius
where texts share one of a few shingles; each link that this gives is counted exactly. It ties most groups of
near copies together at the cost of a few rows a text. But a near copy at similarity 0.8 is 9 of 64 bits away
on average and may be farther, too far for any radius that a search can afford, so an exact join completes the
links: the shingles of all texts are put into one order, the frequent ones (by a sample) last. Two sets of similarity >= s then share a shingle among the first n - ceil(s n) + 1 of each:
whatever the order, no pair is missed, and the order only decides how many candidates come up. Pairs that
SimHash has tied already are never made; most others go by a lower bound of the sets' difference (the bits in
which their parities differ); what is left is counted exactly before it is linked.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_batch, shared_folder
from .components import connected_components
from .simhash_dedup import fingerprint_of, near_links, shingle_hashes

#: Similarity from which two texts are near copies, as a fraction: 4 of 5.
SHARE = (4, 5)
#: Bits within which SimHash looks for links everywhere, and among texts that share one of LEAST shingles.
RADIUS, WIDE, LEAST = 4, 16, 8
#: Of those that share a shingle, so many are tried for each text before the join.
NEAREST = 6
#: Rows of one shingle that meet in one task; a longer list is dealt out in pairs of chunks.
BLOCK = 2048
#: Nodes that are broadcast at once (about 40 bytes each).
BROADCAST = 400_000
#: Rows of a list that a task sorts.
ROWS = 1_500_000
#: The order is chosen from one text in EVERY (of few texts more, up to SAMPLE) and the FREQUENT shingles
#: that come up most in them, three times at least. A share, not a number: lists stay short as texts grow.
EVERY, SAMPLE, FREQUENT = 8, 4096, 200_000
#: Rows that a task turns into sets at once.
FEW = 1024


def shingle_set(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's shingles in rising order; none without words."""
    return np.unique(np.array(shingle_hashes(text, words, seed), np.uint64))


def near(a: np.ndarray, b: np.ndarray, share: tuple[int, int] = SHARE) -> bool:
    """Jaccard similarity of two sets in rising order >= share; two empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * sum(share) >= share[0] * (len(a) + len(b))


def parities(own: np.ndarray) -> np.ndarray:
    """For each of about 2 to 4 bits a member (a power of two), whether an odd number of the set's hashes falls on it; as octets."""
    bits = 1 << max(6, (2 * len(own)).bit_length())
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)


def may_be_near(a: np.ndarray, b: np.ndarray, sizes: int, share: tuple[int, int] = SHARE) -> bool:
    """False only if the parities (of sets of so many members together) show too many members that are in one set alone."""
    if len(a) > len(b):
        a, b = b, a
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum()) * sum(share) <= sizes * (share[1] - share[0])


def _frequent(texts: DataFrame, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in rising order, in how many texts of a sample they are) for the most frequent ones."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words, seed) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["key"])

    step = min(EVERY, max(1, texts.count() // SAMPLE))
    some = texts.where(F.pmod(F.xxhash64("_id"), F.lit(step)) == 0).select("_text")
    seen = per_batch(some, "key long", work, FEW).groupBy("key").count().where("count >= 3").orderBy(F.desc("count"), "key").limit(FREQUENT).collect()
    keys, counts = np.array([r[0] for r in seen], np.int64).view(np.uint64), np.array([r[1] for r in seen], np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _candidates(share: tuple[int, int]):
    """For mapInArrow over (key, pair, n, node, tied, pos) sorted by (key, pair, n, node): pairs (a, b) that can be near.

    pair: -1 where a list is whole; else two chunks (x, y, x <= y) of a long list as x * 2^16 + y, and `own` is the row's chunk.
    tied: what SimHash has linked a node with; such pairs are left out.
    """
    num, den = share

    def met(key, pair, own, n, node, tied, pos) -> pa.RecordBatch:
        new = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
        first = np.concatenate([[0], new])
        sizes = np.diff(np.append(first, len(key)))
        ends = np.repeat(first + sizes, sizes)
        # lists of one node, or of nodes that are tied together, make no pair
        alike = np.minimum.reduceat(tied, first) == np.maximum.reduceat(tied, first)
        at, out, d = np.flatnonzero(~np.repeat(alike, sizes)), [np.empty((0, 2), np.int64)], 0
        crossed = pair >= 0
        crossed &= (pair >> 16) != (pair & 0xFFFF)
        while len(at):
            d += 1
            at = at[at + d < ends[at]]
            at = at[n[at] * den >= num * n[at + d]]  # sizes rise within a list: what is too long stays so
            to = at + d
            least = -(-num * (n[at] + n[to]) // (num + den))
            ok = (np.minimum(n[at] - pos[at], n[to] - pos[to]) >= least) & (tied[at] != tied[to])
            # two chunks of a long list: what lies within one of them is met where it meets itself
            ok &= ~crossed[at] | (own[at] != own[to])
            x, y = node[at[ok]], node[to[ok]]
            out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            last = int(np.flatnonzero((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]))[0])
            if last:
                yield met(*(x[:last] for x in rows))
            held = [x[last:] for x in rows]
        if held is not None:
            yield met(*held)

    return run


def _stars(share: tuple[int, int], radius: int, block: int):
    """For mapInArrow over (key, node, n, fp) sorted by (key, node): pairs (a, b) of one list within the radius.

    Each node is laid to the nearest of those before it and to the NEAREST of all, so a list gives a few pairs a
    row at most. A list of more than `block` rows is read in pieces: these pairs come first, not instead of the join's.
    """
    num, den = share

    def nearest(node, n, fp) -> list[np.ndarray]:
        out, at = [], np.arange(len(node))
        for k in range(0, len(node), 256):
            own = at[k : k + 256, None]
            far = np.bitwise_count(fp[own] ^ fp)
            far[(np.minimum(n[own], n) * den < num * np.maximum(n[own], n)) | (own == at)] = 255
            for some in (np.where(at < own, far, 255), *[far] * min(NEAREST, len(node) - 1)):
                best = some.argmin(1)
                ok = some[at[: len(best)], best] <= radius
                out.append(np.sort(np.stack([node[own[:, 0]][ok], node[best[ok]]], 1), 1))
                some[at[: len(best)], best] = 255
        return out

    def met(key, node, n, fp) -> pa.RecordBatch:
        fp, out = fp.view(np.uint64), [np.empty((0, 2), np.int64)]
        first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        ends = np.append(first[1:], len(key))
        for i, j in zip(first[ends - first > 1].tolist(), ends[ends - first > 1].tolist(), strict=True):
            for at in range(i, j, block):
                own = slice(at, min(at + block, j))
                out += nearest(node[own], n[own], fp[own])
        found = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            last = last or (len(rows[0]) if len(rows[0]) > 4 * block else 0)  # a long list needn't be whole
            if last:
                yield met(*(x[:last] for x in rows))
            held = [x[last:] for x in rows] if last < len(rows[0]) else None
        if held is not None:
            yield met(*held)

    return run


def _few(nodes: DataFrame, most: int = BROADCAST) -> DataFrame:
    """nodes, broadcast if they are counted to be few."""
    return F.broadcast(nodes) if nodes.count() <= most else nodes


def near_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: tuple[int, int] = SHARE, seed: int = 42, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(_id, component) for every row of docs with an id: rows are linked if their sets' similarity is at least share.

    A null or empty text has the empty set, which is like any other empty set. Equal sets count once, however
    many rows have them, and stand for all of these.
    """
    spark, (num, den) = docs.sparkSession, share
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where("_id is not null")
    order_of = spark.sparkContext.broadcast(_frequent(texts, words, seed))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, counts = order_of.value
        nodes, prints, sizes, firsts, odd = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            own = shingle_set(text, words, seed)
            n, order = len(own), own
            if n and len(keys):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                order = own[np.argsort(np.where(keys[at] == own, counts[at], 0), kind="stable")]
            nodes.append(xxhash.xxh64_intdigest(own.tobytes(), seed))
            prints.append(fingerprint_of(own))
            sizes.append(n)
            firsts.append(order[: n + num * -n // den + 1 if n else 0].view(np.int64))
            odd.append(parities(own).tobytes())
        longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)]
        columns = [batch.column(0), *longs, pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(odd, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["_id", "node", "fp", "n", "firsts", "odd"])

    folder = f"{shared_folder(spark)}/near-sets-{uuid.uuid4()}"
    per_batch(texts, "_id long, node long, fp long, n long, firsts array<long>, odd binary", work, FEW).write.parquet(folder)
    held = spark.read.parquet(folder)
    one = cut(held.groupBy("node").agg(F.min("_id").alias("_id"), F.first("fp").alias("fp"), F.first("n").alias("n")))

    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words, seed) for t in batch.column(1).to_pylist()]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "own_set"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = [near(np.frombuffer(x[k].as_buffer(), np.uint64), np.frombuffer(y[k].as_buffer(), np.uint64), share) for k in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    def linked(some: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are near, by the whole sets of their texts, which are read again."""
        need = cut(some.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(one.select("node", "_id"), "node"))
        few = _few(need.select("_id", F.col("node").alias("_node")))
        mine = per_batch(texts.join(few.select("_id").distinct(), "_id", "left_semi"), "node long, own_set binary", sets_of, FEW)
        # rows that repeat an id may have other texts: only the nodes asked for are kept, each once
        sets = cut(mine.join(_few(need.select("node")), "node", "left_semi").dropDuplicates(["node"]))
        first, second = (sets.select(F.col("node").alias(x), F.col("own_set").alias(f"set_{x}")) for x in "ab")
        both = some.join(first, "a").join(second, "b").select("a", "b", "set_a", "set_b")
        return cut(both.mapInArrow(verified, "a long, b long"))

    # SimHash: nodes of one fingerprint, forests of what lies within the radius, and stars of what shares a shingle
    prints = cut(one.groupBy("fp").agg(F.min("node").alias("node")))
    same = one.join(prints.withColumnRenamed("node", "b"), "fp").where("node != b").select(F.col("node").alias("a"), "b")
    # joined by the node alone, so that rows of one node lie together for what follows
    single = held.join(one.select("node", F.col("_id").alias("_keep")), "node").where("_id = _keep").drop("_keep").dropDuplicates(["node"])
    least = single.select(F.explode(F.slice(F.array_sort("firsts"), 1, LEAST)).alias("key"), "node", "n", "fp")
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stars = least.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(_stars(share, WIDE, block), "a long, b long")
    links = linked(cut(near_links(prints.select("node", "fp"), radius).select("a", "b").union(same).union(stars).distinct()))
    tied = cut(connected_components(links))

    # the rest: lists of the first shingles, of each node once
    group = one.join(_few(tied), "node", "left").select("node", F.coalesce("component", "node").alias("tied"))
    lists = single.select("node", "n", "odd", "firsts").join(group, "node")
    lists.write.parquet(f"{folder}-lists")
    lists = spark.read.parquet(f"{folder}-lists")
    rows = lists.agg(F.sum(F.size("firsts"))).first()[0] or 0
    listed = lists.select("node", "n", "tied", F.posexplode("firsts").alias("pos", "key"))
    # which lists are long is guessed from a share of the nodes: it only decides how the work is dealt out
    step = max(1, block // 64)
    some = listed.where(F.pmod("node", F.lit(step)) == 0).groupBy("key").agg(F.count("*").alias("count")).where(F.col("count") * step > block)
    long = cut(some.select("key", F.ceil(F.col("count") * step / block).cast("int").alias("chunks")))
    whole = listed.select("key", F.lit(-1).alias("pair"), F.lit(0).alias("own"), "n", "node", "tied", "pos")
    if not long.isEmpty():
        own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        parted = listed.join(_few(long), "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        parted = parted.select("key", (F.least("own", "other") * 65536 + F.greatest("own", "other")).cast("int").alias("pair"), "own", "n", "node", "tied", "pos")
        whole = whole.join(_few(long.select("key")), "key", "left_anti").unionByName(parted)
    ready = whole.repartition(max(parts, rows // ROWS), "key", "pair").sortWithinPartitions("key", "pair", "n", "node")
    met = cut(ready.mapInArrow(_candidates(share), "a long, b long").distinct())

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, sizes = batch.column(2), batch.column(3), batch.column(4).to_pylist()
            ok = [may_be_near(np.frombuffer(x[k].as_buffer(), np.uint8), np.frombuffer(y[k].as_buffer(), np.uint8), sizes[k], share) for k in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    first, second = (lists.select(F.col("node").alias(x), F.col("odd").alias(f"odd_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    both = met.join(first, "a").join(second, "b").select("a", "b", "odd_a", "odd_b", F.col("n_a") + F.col("n_b"))
    pairs = cut(both.mapInArrow(likely, "a long, b long"))

    found = connected_components(links.union(linked(pairs)))
    return held.select("_id", "node").join(found, "node", "left").select("_id", F.coalesce("component", "node").alias("component"))
