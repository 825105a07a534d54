"""Benchmark items of fewer tokens than a seed, and pairs that share too little."""

import pytest

from brindle.llm import decontam


@pytest.mark.parametrize("small_seeds", [0, 1_000])
def test_short_items_are_whole_lines_or_texts(spark, small_seeds):
    bench = spark.createDataFrame([(1, "Yes, indeed!"), (2, "猫と犬"), (3, "one two three four"), (4, "..."), (5, "a long enough item of seven words"), (1, "yes indeed")], "item_id long, text string")
    docs = [(10, "yes indeed"), (11, "He said: yes indeed he did."), (12, "first\n  YES -- indeed. \nlast"), (13, "犬。\n猫と犬。"), (14, "one\ntwo\nthree\nfour"), (15, "one two three four five"), (16, None), (17, "..."), (10, "yes indeed"), (18, "x a long enough item of seven words y")]
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, small_seeds=small_seeds)
    got = sorted((r["doc_id"], r["item_id"], r["coverage"], r["covered_tokens"]) for r in found.collect())
    assert got == sorted([(10, 1, 1.0, 2)] * 4 + [(12, 1, 1.0, 2)] * 2 + [(13, 2, 1.0, 3), (14, 3, 1.0, 4), (18, 5, 1.0, 7)])
    kept = decontam.decontaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, small_seeds=small_seeds)
    assert sorted(r["doc_id"] for r in kept.collect()) == [11, 15, 16, 17]
