"""Classifiers: held-out accuracy, edge cases, and that folds are kept apart."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from swathgrid.llm import hashed_text as ht
from swathgrid.llm import langid, quality, toxicity
from swathgrid.llm.common import fold

VOCAB = {"aa": "the of and to in is that it was for", "bb": "der die und das von ist nicht mit den ein", "cc": "le la et les des en un que une pour"}


def prose(rng, lang="aa", n=60):
    own = VOCAB[lang].split()
    stems = {"aa": "thing ing er on", "bb": "sch ung keit ich", "cc": "eau oux tion aie"}[lang].split()
    return " ".join(rng.choice(own) if rng.random() < 0.5 else rng.choice(stems) + rng.choice(stems) for _ in range(n))


def test_words_and_grams_belong_to_their_text():
    texts = pa.array(["ab cd", None, "", "  ", "cd", "é cd\tab", "ab"])
    (s,) = ht.slices(texts)
    w = ht.words(s)
    per = [set(w.hashes[w.bounds[k] : w.bounds[k + 1]].tolist()) for k in range(len(texts))]
    assert [len(p) for p in per] == [2, 0, 0, 0, 1, 3, 1]
    assert per[4] < per[0] and per[6] < per[0] and per[0] < per[5]
    one = ht.char_grams(s, 2, 16)
    alone = next(iter(ht.slices(pa.array(["cd"]))))
    assert one[s.bounds[4]] == ht.char_grams(alone, 2, 16)[0]
    assert [len(x) for x in ht.slices(texts, most=4)] and sum(len(x) for x in ht.slices(texts, most=4)) == len(texts)


def test_scores_don_t_depend_on_the_batch():
    rng = random.Random(1)
    texts = [prose(rng) for _ in range(30)] + ["", None]
    model = quality.fit(pa.array(texts), np.array([k % 2 for k in range(32)]), np.ones(32), epochs=1)
    whole = quality.scores(pa.array(texts), model)
    assert whole.tolist() == [quality.scores(pa.array([t], pa.string()), model)[0] for t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        lang = rng.choice(list(VOCAB))
        text = prose(rng, lang, rng.choice([20, 60, 400]))
        bad, toxic = i % 3 == 0, i % 4 == 0
        if bad:
            text = " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in text.split())
        if toxic:
            words = text.split()
            words.insert(rng.randrange(len(words)), rng.choice(["idiotling", "idiotisch", "moronic"]))
            text = " ".join(words)
        rows.append((i, text, lang, int(not bad), int(toxic)))
    rows += [(1000, None, None, None, None), (1001, "", "aa", None, None), (1002, "12 -- 34", "bb", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, toxic int")
    return df.select("doc_id", "text", "lang", df.quality.alias("score")).cache(), df.select("doc_id", "quality", "toxic").cache()


def test_quality(docs):
    got = quality.classify(*docs).collect()
    want = {r.doc_id: r.quality for r in docs[1].collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and want[r.doc_id] is not None]
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) for r in got)
    kept = quality.keep_good(*docs)
    assert kept.columns == docs[0].columns and 200 < kept.count() < 330


def test_toxicity(docs):
    got = toxicity.classify(*docs).collect()
    want = {r.doc_id: r.toxic for r in docs[1].collect()}
    held = [r for r in got if r.held_out and want[r.doc_id] is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in got) and len(got) == 403


def test_toxicity_learns_a_pair():
    """Either term alone is harmless, both together are not: no sum of weights can say that."""
    rng = random.Random(4)
    texts, labels = [], []
    for _ in range(800):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["insult"] * a + ["people"] * b + ["plain"] * (a != b) + [prose(rng, "aa", 5)]))
        labels.append(int(a and b))
    model = toxicity.fit(pa.array(texts), np.array(labels), np.ones(800), epochs=20)
    told = toxicity.scores(pa.array(texts), model)
    assert np.mean((told > 0.5) == np.array(labels)) > 0.97
    assert np.abs(model["v"]).max() > 0.1


def mixed(rng, n):
    return [prose(rng, "aa", rng.choice([10, 30])).split() for _ in range(n)]


def test_toxicity_learns_a_pair_whose_terms_are_balanced():
    """Each term is as common under either label; the two together are not. And exclusive or, where no term tells anything."""
    rng = random.Random(8)

    def balanced(n):
        rows = mixed(rng, n)
        for k, w in enumerate(rows):
            w[3:3] = (["insult", "people"] if k % 2 and k % 4 == 1 else ["vile"] if k % 2 else ["insult"] if k % 4 == 0 else ["people"])
        return [" ".join(w) for w in rows], np.arange(n) % 2

    def exclusive(n):
        rows, labels = mixed(rng, n), []
        for w in rows:
            a, b = rng.random() < 0.5, rng.random() < 0.5
            w[3:3] = ["insult"] * a + ["people"] * b
            labels.append(int(a != b))
        return [" ".join(w) for w in rows], np.array(labels)

    for made in (balanced, exclusive):
        texts, labels = made(1600)
        model = toxicity.fit(pa.array(texts), labels, np.ones(1600))
        texts, labels = made(400)
        told = toxicity.scores(pa.array(texts), model) >= 0.5
        assert np.mean(told[labels == 1]) > 0.97 and np.mean(told[labels == 0]) < 0.03


def test_interacting_against_loops():
    rng = np.random.default_rng(2)
    docs = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(300)]
    labels, p = rng.integers(0, 2, 300), rng.random(300) * 0.8 + 0.1
    among = np.array([0, 2, 3, 5, 8, 11])
    want = set()
    for a in among:
        for b in among:
            own = [i for i, d in enumerate(docs) if a in d and b in d]
            if a != b and abs(sum(labels[i] - p[i] for i in own)) >= 1.5 * max(0.5, sum(p[i] * (1 - p[i]) for i in own)) ** 0.5:
                want |= {a, b}
    got = toxicity.interacting(docs, labels, p, among, 12, 1.5, block=70)
    assert set(got.tolist()) == want and 0 < len(want) < 6


# ---- scores by plain loops over words and bytes

MASK = 2**64 - 1


def plain_hash(octets):
    return sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 2**64) for k, c in enumerate(octets)) & MASK


def plain_bucket(h, bits, salt):
    h = ((h ^ (salt * 0x51ED270B27D4EB4F & MASK)) * 0xD6E8FEB86659FD93) & MASK
    return (((h ^ (h >> 32)) * 0x9E3779B97F4A7C15) & MASK) >> (64 - bits)


def plain_gram(octets, bits):
    h = len(octets) * 0x9E3779B1 & 0xFFFFFFFF
    for c in octets:
        h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
    return (((h ^ (h >> 15)) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - bits)


def grams(octets, sizes, bits):
    return [plain_gram(octets[k : k + n], bits) for n in sizes for k in range(len(octets) - n + 1)]


def plain_words(octets, proper):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+" if proper else rb"[^\x20\x09-\x0d]+", octets)


def sigmoid(z):
    return 1 / (1 + math.exp(-min(40, max(-40, z))))


def lowered(text):
    """Code point by code point, as Arrow does it."""
    return pc.utf8_lower(pa.scalar(text or "")).as_py().encode()


def plain_quality(text, model):
    octets = (text or "").encode()
    words = [plain_hash(w) for w in plain_words(octets, False)]
    own = grams(octets, quality.GRAMS, quality.BITS) + [plain_bucket(h, quality.BITS, 1) for h in words]
    for a, b in itertools.pairwise(words):
        pair = 0x2545F4914F6CDD1D if a == b else (a * 0xD6E8FEB86659FD93 + (b ^ (b >> 29)) * 0x9E3779B97F4A7C15) & MASK
        own.append(plain_bucket(pair, quality.BITS, 2))
    return sigmoid(sum(float(model[k]) for k in own) / max(1, len(own)) + float(model[-1]))


def plain_toxicity(text, model):
    own = set()
    for w in plain_words(lowered(text), True):
        own.add(plain_bucket(plain_hash(w), toxicity.BITS, 4))
        own |= {plain_bucket(plain_hash(w[:n]), toxicity.BITS, 4 + n) for n in toxicity.PREFIXES if len(w) > n}
    slots = [model["slot"][k] for k in own if model["slot"][k]]
    z = float(model["bias"][0]) + sum(float(model["w"][k]) for k in slots)
    for a, b in itertools.combinations(slots, 2):
        z += float(model["v"][a].astype(float) @ model["v"][b].astype(float))
    return sigmoid(z)


def plain_language(text, model):
    octets = lowered(text)
    own = grams(octets, langid.GRAMS, langid.BITS) + [plain_bucket(plain_hash(w), langid.BITS, 3) for w in plain_words(octets, True)]
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    lean = [sum(float(model["pull"][k][bit]) for k in own) / max(1, len(own)) for bit in range(len(model["trust"]))]
    loss = [sum(float(t) * math.log1p(math.exp(-x * c)) for x, c, t in zip(lean, row, model["trust"], strict=True)) for row in model["code"]]
    odds = [math.exp(-4 * (x - min(loss))) for x in loss]
    return model["names"][loss.index(min(loss))], max(odds) / sum(odds)


HARD = [None, "", " ", "a", "\t\n", "Idiotling der", "the the the", "é É \u0130 ß 中文 x", "--- !!", "12 34", "a" * 5000, "the of " * 3000, "das ist moronic" + "\u00a0" + "und", "\x00x"]


def test_scores_against_plain_loops(spark, docs):
    """The scores of whole queries equal sums over words, bytes and pairs of terms in plain Python."""
    extra = spark.createDataFrame([(2000 + k, t, None, None) for k, t in enumerate(HARD)], docs[0].schema)
    every = docs[0].union(extra)
    texts = {r.doc_id: r.text for r in every.collect()}
    model = quality.train(every, docs[1], learn=fold("doc_id", 3) != 1)
    got = quality.classify(every, docs[1]).collect()
    assert len(got) == len(texts) and all(r.score == pytest.approx(plain_quality(texts[r.doc_id], model), abs=1e-6) for r in got)
    model = toxicity.train(every, docs[1], learn=fold("doc_id", 4) != 2)
    got = toxicity.classify(every, docs[1]).collect()
    assert len(got) == len(texts) and all(r.score == pytest.approx(plain_toxicity(texts[r.doc_id], model), abs=1e-6) for r in got)
    model = langid.train(every, learn=fold("doc_id", 3) != 1)
    for r in langid.predict(every).collect():
        lang, score = plain_language(texts[r.doc_id], model)
        assert (r.lang_pred == lang or r.ambiguous) and r.score == pytest.approx(score, abs=1e-5)


def test_repeated_ids_and_labels(spark, docs):
    """A repeated id is learnt once: by its largest label and its first text. Every row gets a score of its own text."""
    seven = docs[0].where("doc_id = 6").first()
    again = spark.createDataFrame([(6, "zzz " + seven.text, seven.lang, None), (None, "the of", "aa", None), (None, "the of", "aa", None)], docs[0].schema)
    label = docs[1].where("doc_id = 6").first()
    more = spark.createDataFrame([(6, 0, 0), (6, 0, 0), (None, 1, 1), (6, None, None)], docs[1].schema)
    assert seven.text < "zzz" and label.quality == 0 and label.toxic == 0
    every, labels = docs[0].union(again).union(docs[0].where("doc_id = 6")), docs[1].union(more)
    for op in (quality.classify, toxicity.classify):
        want = {r.doc_id: r.score for r in op(*docs).collect()}
        got = op(every, labels).collect()
        assert len(got) == len(want) + 4
        own = [r.score for r in got if r.doc_id == 6]
        assert len(own) == 3 and sum(x == want[6] for x in own) >= 2
        assert all(r.score == want[r.doc_id] for r in got if r.doc_id not in (6, None))
    want = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs[0]).collect()}
    got = langid.predict(every).collect()
    assert len(got) == len(want) + 4 and all((r.lang_pred, r.score) == want[r.doc_id] for r in got if r.doc_id not in (6, None))


def test_language(docs):
    got = {r.doc_id: r for r in langid.predict(docs[0]).collect()}
    assert got[1000].lang_pred == got[1001].lang_pred == got[1002].lang_pred == "und" and got[1000].score == 0
    langs = {r.doc_id: r.lang for r in docs[0].collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 1000]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_codewords():
    assert langid.codewords(4).shape == (4, 7)
    for k in (2, 3, 5, 8, 20):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code.tolist()}) == k and all(abs(c.sum()) < k for c in code.T)
    near = {"code": langid.codewords(3).astype(float), "trust": np.ones(3) / 3}
    best, score, close = langid.decode(np.array([[3.0, 3.0, 3.0], [0.0, 0.0, 0.0]]) * near["code"][1], near)
    assert best[0] == 1 and score[0] > 0.9 and not close[0] and close[1]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.classify(docs, labels).collect()] == pytest.approx([0.5, 0.5], abs=0.01)
    assert len(toxicity.classify(docs, labels).collect()) == 2
    none = docs.selectExpr("*", "cast(null as string) as lang")
    assert [r.lang_pred for r in langid.predict(none).collect()] == ["und", "und"]
    empty = docs.where("false")
    assert quality.classify(empty, labels).collect() == [] and langid.predict(empty.selectExpr("*", "'x' as lang")).collect() == []
