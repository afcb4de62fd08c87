"""URL filters, fill-in-middle and ranked search: brute force and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from swathgrid.llm import fill_middle, ranked_search, url_filter

# ---- URL filters


def brute_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else default


def judged(spark, pages, rules, **how):
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), table, **how)
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("per_sweep", [500_000, 7])
def test_rules_like_brute_force(spark, per_sweep):
    """Nested hosts and paths of a small alphabet; small slices deal one group to many sweeps."""
    rng = random.Random(5)
    label, step = lambda: rng.choice(["a", "b", "ab", "ö"]), lambda: rng.choice(["/", "/a", "/ab", "/a/", "/a/b", "/é", ""])
    rules = [(".".join(label() for _ in range(rng.randint(0, 3))), step() + rng.choice(["", "b", "/a"]), rng.choice(["allow", "block"])) for _ in range(60)]
    pages = [(i, rng.choice(["http://", "x://", "://"]) + ".".join(rng.choice([label(), label().upper()]) for _ in range(rng.randint(1, 4))) + step() + step() + rng.choice(["", "?x=/a", "#/b", "b"])) for i in range(400)]
    want = sorted(((i, *brute_verdict(u, rules)) for i, u in pages), key=repr)
    assert judged(spark, pages, rules, per_sweep=per_sweep) == want
    assert len({w[3] for w in want}) > 20


def test_urls_at_the_edge(spark):
    rules = [("org", "/", "block"), ("org", "/", "allow"), ("example.org", "/es/", "allow"), ("net", None, "block"), (None, "/secret", "block"), ("com", "/", None)]
    whole = [(h or "", p or "", v) for h, p, v in rules if v]
    urls = [None, "", "org/", "http://", "http://org", "http://ORG/", "http://x.Example.ORG/es/1", "http://norg/", "http://org:80/", "http://u@org/", "a://b.net?x", "http://x.net", "http://.org/", "http://org./",
            "x://y.com/secret/1", "http://org/a\nb", "://ORG/\x00", "http://org/" + "a" * 100_000, "http://" + "a." * 500 + "org/ä"]
    pages = [(k, u) for k, u in enumerate(urls)] + [(None, "http://org/"), (1, "http://org/"), (1, "http://org/")]
    assert judged(spark, pages, rules) == sorted(((i, *brute_verdict(u, whole)) for i, u in pages), key=repr)


def test_empty_tables_and_clashing_names(spark):
    assert judged(spark, [], [("org", "/", "block")]) == []
    assert judged(spark, [(1, "http://a.org/")], []) == [(1, "a.org", "/", None, "allow")]
    pages = spark.createDataFrame([(1, "http://a.org/", "x", "y", 3, "z")], "page_id long, url string, host string, _path string, verdict int, rule string")
    assert url_filter.judge(pages, url_filter.rule_table(spark, [("org/", "block")])).collect() == [(1, "a.org", "/", "org/", "block")]


def test_sweep_gives_the_whole_stack(spark):
    points = spark.createDataFrame([("g", k) for k in ("abc", "ab", "b", "abx")] + [("h", "abc")], "_by string, _key string").select("*", F.struct("_key").alias("point"))
    rules = spark.createDataFrame([("g", k) for k in ("a", "ab", "abc", "ac", "")], "_by string, _key string").select("*", F.struct("_key").alias("rule"))
    got = {(r[0], r[1]._key, r[2]._key) for r in url_filter.sweep(points, rules, True).collect()}
    assert got == {("g", p, q) for p in ("abc", "ab", "b", "abx") for q in ("a", "ab", "abc", "ac", "") if p.startswith(q)}


# ---- fill-in-middle


def brute_example(doc_id, text, seed=42, fim=50, spm=80):
    text = text or ""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    t = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= fim:
        return len(t), "plain", None, None, text
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(t), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def examples(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fill_middle.fill_in_middle(docs, **how)
    return made.select("*", fill_middle.restored(F.col("form"), F.col("output")).alias("back")).collect()


def test_examples_like_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é\t\n\x0b\x0c\r\u00a0\u2003𝄞<PSM>") for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += ["", None, " ", "\n\n", "a", " a ", "<P>", "a <M> b", "<", "x<S", "\x00 \x1c\x85", "é" * 9000, "a b " * 20_000, "𝄞 " * 5000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a b c d"), (None, "a b c d"), (7, "x y"), (7, "x y"), (-3, "n e g")]
    for at_once in (fill_middle.AT_ONCE, 50):
        monkeypatch.setattr(fill_middle, "AT_ONCE", at_once)
        got = examples(spark, rows, fim=80, spm=50)
        assert sorted(map(repr, [tuple(r)[2:7] for r in got])) == sorted(map(repr, [brute_example(i, t, fim=80, spm=50) for i, t in rows]))
        assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_examples_keep_all_columns(spark):
    docs = spark.createDataFrame([(1, "x", "a b c", 5)], "n long, form string, text string, doc_id long")
    made = fill_middle.fill_in_middle(docs)
    assert made.columns == ["n", "form", "text", "doc_id", "_n", "_form", "prefix_chars", "middle_chars", "output"]
    assert tuple(made.first())[4:] == brute_example(5, "a b c")
    assert fill_middle.fill_in_middle(docs.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=3000))
def test_rank_and_select(bits):
    bits = np.array(bits)
    vector, ones = fill_middle.BitVector(bits), np.flatnonzero(bits)
    assert vector.rank(np.arange(len(bits) + 1)).tolist() == [0, *np.cumsum(bits).tolist()]
    assert vector.select(np.arange(len(ones))).tolist() == ones.tolist()


# ---- ranked search


def brute_ranking(docs, items, k=10):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(tokens(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    count, total, df = len(held), sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in held:
            m = 100 - 75 + 75 * c.total() * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in tokens(text))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def ranking(spark, docs, items, k=10):
    got = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k)
    return sorted(map(tuple, got.collect()), key=repr)


def made_documents(rng, count):
    words = ["The", "the", "a1", "été", "x-y", "über", "zz", "rare", "q", "_", "\u4e2d\u6587"]
    return [(i, " ".join(rng.choices(words, [9, 9, 5, 4, 3, 2, 2, 0.05, 1, 1, 1], k=rng.randint(0, 30)))) for i in range(count)]


def test_ranking_like_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    docs = made_documents(rng, 700)
    docs += [(i, t) for i, t in rng.sample(docs, 50)] + [(1000 + i, docs[3][1]) for i in range(40)]  # repeated rows and many ties
    docs += [(None, "rare zz"), (5000, None), (5001, ""), (5002, "... !"), (5003, "the " * 20_000)]
    items = [(i, t) for i, t in made_documents(rng, 40)] + [(3, "rare rare rare the"), (3, "zz"), (3, "zz"), (50, None), (51, ""), (None, "rare q"), (52, "nowhere"), (53, docs[3][1] * 3)]
    want = brute_ranking(docs, items)
    assert ranking(spark, docs, items) == want
    monkeypatch.setattr(ranked_search, "ITEMS", 9)  # many packs
    assert ranking(spark, docs, items) == want


def test_blocks_and_groups_of_items_change_nothing(monkeypatch):
    rng = random.Random(2)
    docs, items = made_documents(rng, 300), [t for _, t in made_documents(rng, 20)]
    vocabulary = {t: i for i, t in enumerate(sorted({w for t in items for w in ranked_search.counted(t)[0]}))}
    weights, queries = np.arange(1, len(vocabulary) + 1) * 700, [{vocabulary[w]: n for w, n in ranked_search.counted(t)[0].items()} for t in items]

    def best(size):
        out, block = [], ranked_search.Block()
        for n, (i, t) in enumerate(docs):
            tally, words = ranked_search.counted(t)
            block.put(i, tally, vocabulary, 25 + 3 * words)
            if n % size == size - 1 or n == len(docs) - 1:
                out += block.scores(weights, queries, 10)
                block = ranked_search.Block()
        return {q: sorted((-s, i) for n, i, s in out if n == q)[:10] for q in range(len(items))}

    whole = best(300)
    monkeypatch.setattr(ranked_search, "TOGETHER", 3)
    assert best(64) == best(1) == best(300) == whole


def test_empty_tables(spark):
    assert ranking(spark, [], [(1, "the")]) == []
    assert ranking(spark, [(1, "the")], []) == []
    docs = spark.createDataFrame([(1, "the end", 3, "x")], "doc_id long, text string, score long, _item string")
    items = spark.createDataFrame([(7, "end", "y")], "item_id long, text string, doc_id string")
    assert [tuple(r)[:3] for r in ranked_search.search(docs, items).collect()] == [(7, 1, 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5000), min_size=70, max_size=70), min_size=1, max_size=6), st.integers(1, 12))
def test_carries_and_descent(rows, k):
    """Sums of bit slices, and the k best of them, against plain addition and sorting."""
    places, sums = np.arange(70), np.zeros((20, 2, 2), np.uint64)
    for n, row in enumerate(rows):
        if any(row):
            ranked_search.add(sums, np.array([0, 1]) if n % 2 else np.array([1]), ranked_search.slices(np.array(row), places, 2), n % 3)
    for item, (found, scores) in enumerate(ranked_search.best(sums, k)):
        total = sum((np.array(r) << n % 3 for n, r in enumerate(rows) if item or n % 2), np.zeros(70, np.int64))
        want = sorted(p for _, p in sorted((-s, p) for p, s in enumerate(total) if s)[:k])
        assert found.tolist() == want and scores.tolist() == total[want].tolist()
