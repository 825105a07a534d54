"""Repeat removal against a dictionary of every window, and the suffix order against sorted()."""

import hashlib
import random
from collections import Counter

import pytest

from brindle.llm import repeats
from brindle.llm.suffixes import common_prefix, sort_suffixes


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order_and_common_prefixes(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choices(b"ab", k=rng.randint(0, 60))) for _ in range(200)]
    strings += [b"x" * 40 + s for s in strings[:60]] + strings[:20]
    order, shared = sort_suffixes(strings)
    assert [strings[i] for i in order] == sorted(strings)
    assert shared[0] == -1
    for before, this, n in zip(order, order[1:], shared[1:], strict=False):
        a, b = strings[before], strings[this]
        assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) == common_prefix(a, b)


def brute(texts, length):
    texts = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest(), rest))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)] + ["é", "語語"]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    shared = [prose(30) for _ in range(3)]
    texts = [prose(rng.randint(1, 120)) for _ in range(40)]
    texts += [t + " " + rng.choice(shared) + " " + prose(10) for t in texts[:25]]
    texts += texts[:6] + [None, "", "a" * 900, "ab" * 300, texts[3][:-1], "x" + texts[4]]
    return texts


@pytest.mark.parametrize(("seed", "length", "most", "hot"), [(1, 100, 4096, 100_000), (2, 60, 4096, 2), (3, 100, 2, 3), (4, 100, 5, 100_000), (5, 60, 3, 4)])
def test_against_every_window(spark, seed, length, most, hot):
    texts = corpus(seed)
    rows = [(i, t, "extra") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(3)
    out = repeats.remove_repeats(df, length=length, gram=20, most=most, hot=hot).collect()
    want = brute(texts, length)
    assert sum(w[1] for w in want) > 1000
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in out} == dict(enumerate(want))
    assert all(r["n_bytes_in"] == "extra" for r in out)


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(1, text), (1, text), (None, "short"), (None, None)], "doc_id long, text string")
    out = repeats.remove_repeats(df).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in out) == [(0, 0, 0), (5, 0, 0), (len(text), len(text), 1), (len(text), len(text), 1)]
    assert repeats.remove_repeats(df.limit(0)).collect() == []
