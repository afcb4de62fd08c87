"""Near duplicates by SimHash and a generalised pigeonhole search.

A 64-bit fingerprint is cut into m parts of correlated bits with thresholds t_1..t_m whose sum is
r - m + 1. Two fingerprints within r bits then have a part i in which they differ by at most t_i bits,
so looking up each part within its own threshold finds every pair. Which bits go together, m, and the
thresholds are chosen from a bounded sample: dynamic programming over the parts picks the thresholds
with the least estimated work (rows probed plus candidates verified). The choice only decides how
long the search takes; it is exact for every choice.

For a threshold t, a fingerprint is listed under its part with up to t of the clear bits set. Two
parts at distance d <= t meet under their bitwise OR, where the bits that both have set add up to d.
Rows that meet under one key are compared in numpy blocks, and only the edges of a spanning forest
of what is within r leave the task, so that a group of g near copies gives g - 1 rows, not g * g.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, per_batch
from .components import connected_components

BITS = 64
#: Rows compared at once under one key; a longer list is dealt out in pairs of blocks.
BLOCK = 2048
#: Fingerprints from which bit groups and thresholds are chosen.
SAMPLE = 4096


def shingle_hashes(text: str | None, words: int, seed: int) -> list[int]:
    """The hash of each shingle of a text; a text of fewer words is one shingle, one without words has none."""
    tokens = (text or "").encode().lower().split()
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(tokens), seed)] if tokens else []
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], seed) for i, j in zip((ends - sizes).tolist(), ends[words - 1 :].tolist(), strict=False)]


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash over the hashes of all shingles of a text; 0 without words."""
    return fingerprint_of(np.array(shingle_hashes(text, words, seed), np.uint64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 if there are none."""
    if not len(hashes):
        return 0
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(octets), 1 << 16):  # a very long text takes bounded memory
        ones += np.unpackbits(octets[k : k + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp long) for every row. A null or empty text has fingerprint 0; a null id stays null."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.fromiter((fingerprint(t, words, seed) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=[id_col, "fp"])

    kept = docs.select(id_col, text_col)
    return per_batch(kept, T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())]), work)


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the 64 bits into parts of nearly equal size, each bit next to those it is correlated with."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    bits -= bits.mean(0)
    norm = np.sqrt((bits**2).sum(0))
    link = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(link, 0)
    free, out = set(range(BITS)), []
    for p in range(parts):
        size = BITS // parts + (p < BITS % parts)
        own = [min(free, key=lambda b: (-link[b, sorted(free)].max(initial=0), b))]
        free.discard(own[0])
        while len(own) < size:
            best = min(free, key=lambda b: (-link[b, own].sum(), b))
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def choose_parts(sample: np.ndarray, rows: int, radius: int) -> list[tuple[int, int]]:
    """[(mask of a part, its threshold)] with the least estimated work for `rows` fingerprints.

    Estimates come from the distances between a sample's parts; a part with threshold -1 isn't looked up.
    """
    sample = sample if len(sample) else np.zeros(1, np.uint64)
    best: tuple[float, list[tuple[int, int]]] | None = None
    for m in range(1, radius + 2):
        groups = group_bits(sample, m)
        total = radius - m + 1
        costs = []
        for bits in groups:
            mask, width = np.uint64(_mask(bits)), len(bits)
            own = sample & mask
            near = np.zeros(radius + 1)
            for k in range(0, len(own), 256):
                found = np.bitwise_count(own[k : k + 256, None] ^ own[None, :])
                near += np.bincount(found[found <= radius].ravel(), minlength=radius + 1)[: radius + 1]
            near[0] -= len(own)
            share = np.cumsum(near) / max(1, len(own) * (len(own) - 1))
            # a sample sees no pair rarer than one in its square: what is below comes from even bits
            even = np.cumsum([float(_choose(width, j)) for j in range(radius + 1)]) / 2.0**width
            share = np.maximum(share, even)
            probes = np.cumsum([_choose(width, j) / 2.0**j for j in range(radius + 1)])
            # a probed row is hashed, shuffled and sorted; a candidate is one comparison in numpy
            costs.append([0.0] + [rows * probes[t] + 0.02 * rows * rows * share[t] / 2 for t in range(radius + 1)])
        # threshold t of a part costs costs[i][t + 1]; their sum has to be `total`
        table = {0: (0.0, ())}
        for cost in costs:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (paid, ts) in table.items():
                for t in range(-1, radius + 1):
                    new = (paid + cost[t + 1], (*ts, t))
                    if used + t not in step or new < step[used + t]:
                        step[used + t] = new
            table = step
        paid, ts = table[total]
        if best is None or paid < best[0]:
            best = (paid, [(_mask(g), t) for g, t in zip(groups, ts, strict=True)])
    return best[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _keys(fps: np.ndarray, mask: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fingerprint its part with up to t clear bits set: (row, key, bits set)."""
    own = fps & np.uint64(mask)
    rows, keys, sets = [np.arange(len(fps))], [own], [np.zeros(len(fps), np.int8)]
    bits = [b for b in range(BITS) if mask >> b & 1]
    for n in range(1, t + 1):
        for chosen in itertools.combinations(bits, n):
            add = np.uint64(_mask(list(chosen)))
            at = np.flatnonzero((own & add) == 0)
            rows.append(at)
            keys.append(own[at] | add)
            sets.append(np.full(len(at), n, np.int8))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sets)


def _forest(nodes: np.ndarray, fps: np.ndarray, sets: np.ndarray, t: int, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the rows of one key that are within radius of each other.

    Rows are taken off the list as they are reached, so a tight group costs about one pass a row.
    """
    out, rest = [], np.arange(len(nodes))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = (np.bitwise_count(fps[rest] ^ fps[i]) <= radius) & (sets[rest] + sets[i] <= t)
            if near.any():
                found = rest[near]
                out += [(int(nodes[i]), int(nodes[j])) for j in found]
                queue += found.tolist()
                rest = rest[~near]
    return out


class _Find:
    """Union-find over the edges of one task, so that only a forest of them leaves it."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


LISTED = "key long, part byte, pair int, node long, fp long, sets byte"
FOUND = "a long, b long, key long, part byte, chunk int, node long, fp long, sets byte"


def _links(radius: int, thresholds: list[int], block: int | None):
    """For mapInArrow over LISTED rows sorted by (key, part, pair): FOUND rows.

    A list of at most `block` rows gives edges (a, b). A longer one is handed on unread, in numbered
    chunks of `block` rows, and the task never holds more of it than a batch and a chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held, chunks = _Find(), None, 0

        def edges_of(key, part, pair, node, fp, sets) -> list[tuple[int, int]]:
            t = thresholds[part[0]]
            if len(node) == 2:
                near = int(fp[0] ^ fp[1]).bit_count() <= radius and sets[0] + sets[1] <= t
                return [(int(node[0]), int(node[1]))] if near else []
            return _forest(node, fp, sets, t, radius)

        def found(edges: list[tuple[int, int]], later: list[list[np.ndarray]]) -> pa.RecordBatch:
            edges = [e for e in edges if find.join(*e)]
            n, none = len(edges), [None] * sum(len(x[0]) for x in later)
            a = pa.array([e[0] for e in edges] + none, pa.int64())
            b = pa.array([e[1] for e in edges] + none, pa.int64())
            rest = []
            for k, kind in enumerate((pa.int64(), pa.int8(), pa.int32(), pa.int64(), pa.int64(), pa.int8())):
                parts = [pa.nulls(n, kind), *(pa.array(x[k].view(np.int64) if k == 4 else x[k], kind) for x in later)]
                rest.append(pa.concat_arrays(parts))
            return pa.RecordBatch.from_arrays([a, b, *rest], names=[x.split()[0] for x in FOUND.split(", ")])

        def chunked(rows: list[np.ndarray], first: int) -> list[np.ndarray]:
            return [rows[0], rows[1], (first + np.arange(len(rows[0])) // block).astype(np.int32), *rows[3:]]

        def done(rows: list[np.ndarray], goes_on: int) -> pa.RecordBatch:
            """goes_on: chunks already handed on of the first list."""
            cuts = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(rows[0])]])
            edges, later = [], []
            if goes_on:
                later.append(chunked([x[: ends[0]] for x in rows], goes_on))
                starts, ends = starts[1:], ends[1:]
            more = ends - starts > 1
            for i, j in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
                own = [x[i:j] for x in rows]
                if block and j - i > block:
                    later.append(chunked(own, 0))
                else:
                    edges += edges_of(*own)
            return found(edges, later)

        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows[4] = rows[4].view(np.uint64)
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            last = int(np.flatnonzero((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1]))[0])
            if last:
                yield done([x[:last] for x in rows], chunks)
                rows, chunks = [x[last:] for x in rows], 0
            if block and len(rows[0]) > block:
                full = (len(rows[0]) - 1) // block * block  # at least a row stays, so that the list's end is seen
                yield found([], [chunked([x[:full] for x in rows], chunks)])
                rows, chunks = [x[full:] for x in rows], chunks + full // block
            held = rows
        if held is not None:
            yield done(held, chunks)

    return run


def near_links(reps: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """reps (node long, fp long; fp distinct) -> edges (a, b) that connect exactly what links within radius connect."""
    spark = reps.sparkSession
    rows = reps.count()
    sample = np.array([r[0] for r in reps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    parts = choose_parts(sample, rows, radius)
    active = [(k, mask, t) for k, (mask, t) in enumerate(parts) if t >= 0]
    thresholds = [t for _, t in parts]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                few = batch.slice(at, 4096)
                node = few.column(0).to_numpy()
                fps = few.column(1).to_numpy().view(np.uint64)
                for k, mask, t in active:
                    row, key, sets = _keys(fps, mask, t)
                    one, none = np.full(len(row), k, np.int8), np.zeros(len(row), np.int32)
                    columns = [key.view(np.int64), one, none, node[row], fps[row].view(np.int64), sets]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "part", "pair", "node", "fp", "sets"])

    n = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 50_000)
    keyed = reps.select("node", "fp").repartition(n, "node").mapInArrow(listed, LISTED)
    order = ["key", "part", "pair", "sets", "node"]
    ready = keyed.repartition(n, "key", "part").sortWithinPartitions(*order)
    found = cut(ready.mapInArrow(_links(radius, thresholds, block), FOUND))
    edges = found.where("a is not null").select("a", "b")
    later = found.where("a is null")
    if later.isEmpty():
        return edges
    # what is left are lists of more than `block` rows: each two chunks of a list meet in a task
    count = later.groupBy("key", "part").agg((F.max("chunk") + 1).alias("chunks"))
    pairs = (
        later.join(count, ["key", "part"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("other != chunk")
        .select("key", "part", (F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")).cast("int").alias("pair"), "node", "fp", "sets")
    )
    met = pairs.repartition(n, "key", "part", "pair").sortWithinPartitions(*order)
    return edges.union(met.mapInArrow(_links(radius, thresholds, None), FOUND).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs, by whole texts.

    Rows whose fingerprints differ in at most `radius` bits are linked; component_id is the smallest id
    reachable. Null and empty texts have fingerprint 0 and are linked like any other. Rows with a null
    id are kept and have the component_id of their group, which they may tie together; it is null if no row of
    the group has an id. Repeated rows stay repeated. Other
    columns are not read, whatever their names.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words, seed).select(F.col(id_col).cast("long").alias("_id"), "fp"))
    reps = cut(prints.groupBy("fp").agg(F.min("_id").alias("_least")))
    # fingerprints are the nodes, so that those of rows without an id link others, too
    found = connected_components(near_links(reps.select(F.col("fp").alias("node"), "fp"), radius))
    group = reps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "_least", F.coalesce("component", "fp").alias("_group"))
    least = group.groupBy("_group").agg(F.min("_least").alias("component_id"))
    classes = group.join(least, "_group").select("fp", "component_id")
    return prints.join(classes, "fp", "left").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: tuple[int, int] | None = (4, 5), **how) -> DataFrame:
    """The rows of docs without near duplicates: of each group the row with the smallest id stays.

    share: the Jaccard similarity of shingle sets, as a fraction, from which two texts are linked. SimHash finds
    most links, an exact join those that lie beyond its radius (near_sets.py). None: texts are linked by their
    fingerprints alone, as near_duplicates() says. Rows with a null id are all kept. Of rows that repeat an id
    all are kept or none. Null and empty texts are copies of each other. An empty table stays empty; other
    columns stay, whatever their names.
    """
    if share is None:
        classes = near_duplicates(docs, id_col, text_col, words, **how).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col("component_id").alias("component"))
    else:
        from .near_sets import near_sets  # it takes this module's search

        classes = near_sets(docs, id_col, text_col, words, share, **how)
    name = free_name(docs.columns, "gone_id")
    least = classes.groupBy("component").agg(F.min("_id").alias("_least"), F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")
    gone = classes.join(least, "component").where("_id != _least").select(F.col("_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")
