"""The join against all pairs, with families of near copies that cross tiles, blocks and components."""

import time
import random
import re

import pytest

from brindle.llm import jaccard


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), key), key)
    return {key: (len(sets[i]), low[find(i)]) for i, (key, _) in enumerate(rows)}


@pytest.mark.parametrize(("seed", "hot", "dense"), [(1, 2048, 256), (2, 4, 256), (3, 16, 256), (4, 4, 4), (5, 2048, 1)])
def test_against_all_pairs(spark, seed, hot, dense):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(30, 120))
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 3)] = rng.choices(words, k=rng.randint(0, 3))
            rows.append(" ".join(copy))
    rows += [None, "", " \t\n", "One two", "one TWO", "one two three", "É é", "x " * 50, *rows[:5]]
    rows = [(1000 - i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = jaccard.near_duplicates(df, hot=hot, dense=dense).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(rows)


def test_a_family_just_below_the_threshold(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(86)]
    rows = [(i, " ".join(base + [f"o{rng.randrange(10**9)}" for _ in range(17)])) for i in range(90)]
    rows += [(200 + i, rows[3 * i][1] + " end") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = jaccard.near_duplicates(df, dense=70).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(rows)
    assert len({r["component_id"] for r in out}) == 90


def test_bound_is_never_below_the_overlap():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in rng.integers(1, 400, 60)]
    bits = [jaccard.signature(s) for s in sets]
    signatures = jaccard.Signatures(pa.array(bits, pa.binary()), np.array([len(s) for s in sets]))
    a, b = map(np.ravel, np.meshgrid(np.arange(60), np.arange(60)))
    slack = signatures.slack(a, b, 75)
    for i, j, s in zip(a, b, slack, strict=True):
        overlap = len(np.intersect1d(sets[i], sets[j]))
        bound = jaccard.overlap_bound(len(sets[i]), bits[i], len(sets[j]), bits[j])
        assert bound >= overlap
        assert s == bound - jaccard.needed(np.array(len(sets[i])), np.array(len(sets[j])), 75)


def test_one_of_each_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(2, text), (2, text), (1, text + " end"), (3, "other words here"), (None, "null id"), (3, "other words here"), (4, None)]
    out = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == [(0, "null id"), (1, text + " end"), (3, "other words here"), (4, "")]
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_null_ids_cost_what_other_ids_do(spark):
    """A thousand pairs of near copies without ids, and one row without an id many times."""
    rows = []
    for i in range(1000):
        words = [f"w{i}x{k}" for k in range(40)]
        rows += [(None, " ".join(words)), (None, " ".join([*words, "more"]))]
    rows += [(None, "one row that stands here many times over")] * 3000 + [(7, "one row that stands here many times over")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.time()
    out = jaccard.near_duplicates(df).collect()
    assert time.time() - began < 150
    assert len(out) == len(rows)
    of_many = {r["component_id"] for r in out if r["n_shingles"] == 4}
    assert of_many == {7}


def test_links_among_rows_without_ids_and_with_shared_ids(spark):
    base = [f"w{k}" for k in range(30)]
    rows = [(None, " ".join(base)), (9, " ".join([*base, "x"])), (4, " ".join([*base, "x", "y"])), (4, "something else that has no copy at all"), (5, "something else that has no copy at all anywhere"), (4, " ".join(base))]
    got = {(r["id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 26, 4), (9, 27, 4), (4, 28, 4), (4, 4, 4), (5, 5, 4), (4, 26, 4)}
