"""Keyword and vector indexes against scores by hand, and against themselves without pruning."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import keyword_index as ki
from brindle.operators import vector_index as vi

WORDS = [f"w{i}" for i in range(400)]


def corpus(n, seed=1):
    """Few common words, many rare ones, copies, nulls and empty texts."""
    pick = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    texts = [" ".join(pick.choices(WORDS, weights, k=pick.randrange(1, 60))) for _ in range(n)]
    texts[::10] = [texts[0]] * len(texts[::10])
    return [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, ""), (n + 2, "É été, W1-w2!")]


def by_hand(docs, query, k):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bags = {i: Counter(cut(t)) for i, t in docs}
    mean = sum(map(Counter.total, bags.values())) / len(bags)
    df = Counter(t for b in bags.values() for t in b)
    scores = {}
    for i, bag in bags.items():
        hits = [(m, t) for t, m in Counter(cut(query)).items() if t in bag]
        if hits:
            scores[i] = sum(m * math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * bag[t] * 2.2 / (bag[t] + 1.2 * (0.25 + 0.75 * bag.total() / mean)) for m, t in hits)
    return sorted(((-round(s, 6), i) for i, s in scores.items()))[:k]


def test_pruned_unpruned_and_by_hand(spark):
    docs, pick = corpus(3000), random.Random(9)
    queries = [(q, " ".join(pick.choices(WORDS, k=pick.randrange(1, 5)) + pick.choices(WORDS[:3], k=2))) for q in range(40)] + [(90, "w0 w0 w0"), (91, "not there"), (92, None), (93, "été W2")]
    index = ki.build(spark.createDataFrame(docs, "id long, text string").repartition(4), "id", "text", block=32)
    asked = spark.createDataFrame(queries, "q long, text string")
    pruned, plain = ([tuple(r) for r in ki.search(index, asked, "q", "text", 5, pruned=way).orderBy("q", "rank").collect()] for way in (True, False))
    assert [(q, g, r, i) for q, g, r, i, _ in pruned] == [(q, g, r, i) for q, g, r, i, _ in plain]
    assert np.allclose([s for *_, s in pruned], [s for *_, s in plain], atol=1e-6)
    for q, text in queries:
        want = by_hand(docs, text, 5)
        got = [(-s, i) for qq, _, _, i, s in pruned if qq == q]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want], atol=2e-6)
    terms = ki._asked(index, asked, "q", "text")
    every = terms.join(index.postings, "term").select("query", "grp", "block").distinct().count()
    assert ki.candidates(index, terms, 5).count() < 0.8 * every  # it does prune


def test_groups_have_their_own_best(spark):
    docs = spark.createDataFrame(corpus(600, 4), "id long, text string")
    asked = spark.createDataFrame([(1, "w0 w30 w7"), (2, "w90")], "q long, text string")
    group = F.col("id") % 3
    index = ki.build(docs, "id", "text", group=group, block=16)
    found = ki.search(index, asked, "q", "text", 4)
    whole = ki.search(index, asked, "q", "text", 10_000, pruned=False)
    want = [tuple(r) for r in whole.where("rank <= 4").orderBy("q", "grp", "rank").collect()]
    assert [tuple(r)[:4] for r in found.orderBy("q", "grp", "rank").collect()] == [w[:4] for w in want]
    assert {r["grp"] for r in found.collect()} == {0, 1, 2}


def test_keyword_index_of_nothing(spark):
    none = spark.createDataFrame([], "id long, text string")
    asked = spark.createDataFrame([(1, "w0")], "q long, text string")
    assert ki.search(ki.build(none, "id", "text"), asked, "q", "text", 3).count() == 0
    assert ki.search(ki.build(spark.createDataFrame([(1, None)], none.schema), "id", "text"), asked, "q", "text", 3).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, a third of all rows equal, and rows without a direction."""
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(30, 16))
    x = centres[draw.integers(0, 30, 3000)] + 0.7 * draw.normal(size=(3000, 16))
    x[1::3] = x[1]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16)]
    return spark.createDataFrame(rows, "id long, vec array<double>").repartition(6), x


def by_cosine(x, q, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(u @ u[q], vi.DIGITS) + 0.0
    return sorted(zip(-score, range(len(x)), strict=True))[:k]


@pytest.mark.parametrize("shard", [100, 20_000])
def test_exact_search_in_parts(spark, vectors, monkeypatch, shard):
    df, x = vectors
    monkeypatch.setattr(vi, "SHARD", shard)
    monkeypatch.setattr(vi, "QUERIES", max(7, shard // 100))
    got = vi.exact(df, df.where("id % 100 = 0"), "id", "vec", 10).collect()
    assert {r["query"] for r in got} == set(range(0, 3000, 100)) | set()
    for q in range(0, 3000, 100):
        mine = sorted((r["rank"], r["id"], r["score"]) for r in got if r["query"] == q)
        assert [(-s, i) for _, i, s in mine] == by_cosine(x, q, 10)


def test_recall_of_the_index(spark, vectors):
    df, _ = vectors
    queries = df.where("id % 100 = 0")
    index = vi.build(df, "id", "vec")
    assert len(index.centres) > 40 and index.rows.count() == 3000
    probes, told = vi.calibrated(index, queries, "id", "vec", 10)
    share = vi.recall(vi.search(index, queries, "id", "vec", 10, probes), vi.exact(df, queries, "id", "vec", 10))
    assert share >= 0.9 and told >= 0.95 and probes < len(index.centres) / 2
    assert vi.recall(vi.search(index, queries, "id", "vec", 10, len(index.centres)), vi.exact(df, queries, "id", "vec", 10)) == 1.0
    assert vi.search(index, queries, "id", "vec", 10, 2, least=0.9).where("score < 0.9").count() == 0


def test_vector_index_of_nothing(spark, vectors):
    df, _ = vectors
    assert vi.exact(df.limit(0), df, "id", "vec", 3).count() == 0
    assert vi.exact(df, df.where("id > 4000"), "id", "vec", 3).count() == 0
