"""The pipeline's near copies against brute force over all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from swathgrid.llm import near_sets, simhash_dedup


def brute_kept(docs, words=5):
    sets = {}
    for i, text in docs:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i for i in up if up[i] == i}


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    notice = [word() for _ in range(30)]
    docs = [(0, None), (1, " "), (2, "one two"), (3, "One  two"), (4, "one two three")]
    while len(docs) < 200:
        text = [word() for _ in range(rng.choice([6, 20, 120, 250]))]
        if rng.random() < 0.3:
            text = notice + text
        docs.append((len(docs), " ".join(text)))
        for _ in range(rng.randrange(3)):  # a copy of what was changed already: chains are met too
            for _ in range(rng.randrange(5)):
                text[rng.randrange(len(text))] = word()
            docs.append((len(docs), " ".join(text)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("block", "radius"), [(3, 1), (2048, 4)])
def test_keep_one(spark, copies, block, radius):
    d = spark.createDataFrame([*copies, (None, copies[9][1])], "doc_id long, text string")
    got = [r.doc_id for r in simhash_dedup.keep_one(d, block=block, radius=radius).collect()]
    assert got.count(None) == 1 and sorted(i for i in got if i is not None) == sorted(brute_kept(copies))


def test_stage_drops_near_copies_that_fingerprints_miss(spark, copies):
    d = spark.createDataFrame(copies, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, d, "").collect()} == brute_kept(copies)


def test_parities_pass_every_near_pair():
    rng, passed = np.random.default_rng(8), 0
    for _ in range(2000):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.6, 1)], rng.integers(0, 1 << 63, rng.integers(0, 80), dtype=np.uint64)]))
        may = near_sets.may_be_near(near_sets.parities(a), near_sets.parities(b), len(a) + len(b))
        assert may or not near_sets.near(a, b)
        passed += may
    assert passed < 1500
