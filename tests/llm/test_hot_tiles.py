"""Tiles of hot shingles, dealt over shares, against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import jaccard


def brute(rows):
    sets = {key: set(text.split()) for key, text in rows}
    low = {key: key for key in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return low


@pytest.mark.parametrize("hot", [2])
def test_partners_in_different_shares(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(14)]
    rows = [(i, " ".join(rng.sample(words, rng.randint(4, 8)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = jaccard.near_duplicates(df, size=1).collect()
    assert {r["id"]: r["component_id"] for r in out} == brute(rows)


def test_a_share_keeps_entries_without_a_partner_in_it():
    entries = np.zeros(4, jaccard._ENTRY)
    entries["hash"], entries["sid"], entries["n"] = [7, 8, 8, 9], [1, 2, 3, 4], [10, 10, 100, 10]
    frequent = jaccard.Frequent(np.array([7, 8], np.uint64), np.array([jaccard.HOT, jaccard.HOT]))
    batch = jaccard._dealt(np.zeros(4, np.int32), entries)
    (out,) = jaccard._tile_batches(75, 64, frequent)(iter([batch]))
    assert sorted(out.column("sid").to_pylist()) == [1, 2, 3]  # 4 stands alone in a tile that isn't hot
