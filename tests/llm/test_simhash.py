"""SimHash near duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from swathgrid.llm import simhash_dedup as sd
from swathgrid.llm.components import connected_components


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = list(zip(ids, fps, strict=True))
    for k, (a, f) in enumerate(pairs):
        for b, g in pairs[:k]:
            if (f ^ g).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_fingerprints_follow_the_definition():
    for text in (None, "", "  \n", "One", "one TWO three", "A b C d", "É a\x0bb c d e f g" * 3, "x y z w v"):
        assert sd.fingerprint(text) == brute_fingerprint(text)


def test_groups_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(0, None), (1, ""), (2, " \n "), (3, "same text"), (4, "Same TEXT"), (5, "x")]
    for k in range(60):
        base = [word() for _ in range(rng.choice([5, 40, 300]))]
        for _ in range(rng.choice([1, 1, 3])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = word()
            rows.append((100 + len(rows), " ".join(copy)))
        if k % 7 == 0:
            rows.append((100 + len(rows), " ".join(base)))
    got = sd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components([i for i, _ in rows], [fps[i] for i, _ in rows], 4)
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("block", [8, 64])
def test_links_when_lists_are_dealt_out(spark, block):
    """A tight ball of fingerprints makes lists far longer than a block."""
    rng = np.random.default_rng(1)
    fps = {int(0)}
    while len(fps) < 150:
        f = 0
        for b in rng.choice(64, 3, replace=False):
            f |= 1 << int(b)
        fps.add(f)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 100)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    reps = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    found = {r.node: r.component for r in connected_components(sd.near_links(reps, 4, block)).collect()}
    want = brute_components(range(len(signed)), sorted(fps), 4)
    assert {i: found.get(i, i) for i in want} == want


def test_the_choice_of_parts_keeps_the_pigeonhole_sum():
    rng = np.random.default_rng(2)
    sample = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    for rows in (10, 100_000, 100_000_000):
        parts = sd.choose_parts(sample, rows, 4)
        assert sum(t for _, t in parts) == 4 - len(parts) + 1
        assert sum(m.bit_count() for m, _ in parts) == 64
    assert sd.choose_parts(np.zeros(0, np.uint64), 0, 4)


def test_empty_clashing_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sd.near_duplicates(none).collect() == []
    rows = [(7, "a b c d e f", "x", 1), (7, "a b c d e f", "x", 1), (None, "a b c d e f", "y", 2), (9, "a b c d e f", "z", 3), (10, "other words stand in this one", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp int")
    got = sorted((r.doc_id or 0, r.component_id) for r in sd.near_duplicates(docs).collect())
    assert got == [(0, 7), (7, 7), (7, 7), (9, 7), (10, 10)]
    kept = sd.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 7, 7, 10]


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 100 for i in range(100, 160)) and len(got) == 120
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_very_long_text(spark):
    text = "word " * 300_000
    got = sd.near_duplicates(spark.createDataFrame([(1, text), (2, "word word word word word")], "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {1}


def test_a_row_without_an_id_ties_others(spark):
    rng = random.Random(12)
    while True:
        text = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        a, c = list(text), list(text)
        a[rng.randrange(60)], c[rng.randrange(60)] = "x", "y"
        fps = [sd.fingerprint(" ".join(t)) for t in (a, text, c)]
        ab, bc, ac = ((fps[i] ^ fps[j]).bit_count() for i, j in ((0, 1), (1, 2), (0, 2)))
        if ac > max(ab, bc) > 0 and max(ab, bc) <= 6:
            break
    rows = [(5, " ".join(a)), (None, " ".join(text)), (9, " ".join(c))]
    for kept, wanted in ((rows, {5: 5, None: 5, 9: 5}), (rows[::2], {5: 5, 9: 9}), (rows[1:2], {None: None})):
        got = sd.near_duplicates(spark.createDataFrame(kept, "doc_id long, text string"), radius=max(ab, bc)).collect()
        assert {r.doc_id: r.component_id for r in got} == wanted
