"""The permutation is one, both ways, at every size; shards and slots follow from it."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import sharding as sh


@pytest.mark.parametrize("rows", [1, 2, 3, 4, 5, 16, 17, 255, 1000, 65_537])
def test_a_permutation_and_its_inverse(rows):
    for seed in (1, 7):
        f = sh.Feistel(rows, seed)
        out = f.forward(np.arange(rows))
        assert sorted(out.tolist()) == list(range(rows))
        assert f.backward(out).tolist() == list(range(rows))
    big = sh.Feistel(10**15)
    some = np.array([0, 1, 10**9, 10**15 - 1])
    assert big.backward(big.forward(some)).tolist() == some.tolist()


def documents(spark):
    rows = [(i // 2, f"text {i // 4}", f"extra {i}") for i in range(700)] + [(None, None, "x"), (None, "", "x"), (3, "same", "y"), (3, "same", "y")]
    hot = spark.range(900).selectExpr("5L as doc_id", "'one row many times' as text", "'z' as slot")  # more rows than all others
    return spark.createDataFrame(rows, "doc_id long, text string, slot string").unionByName(hot).repartition(7)


def test_shards_are_even_gapless_and_computable(spark):
    df = documents(spark)
    out, f = sh.sharded(df, shards=40)
    got = out.collect()
    n = df.count()
    assert len(got) == n == f.rows and sorted(r["row_number"] for r in got) == list(range(n))
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sizes[shard]))
    number = {(r["shard"], r["slot"]): r["row_number"] for r in got}
    assert all(f.at(s, k) == number[s, k] for s, k in list(number)[:200])
    with pytest.raises(IndexError):
        f.at(0, n)
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["row_number"])]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert {r["slot_in"] for r in got} >= {"z", "x"}
    dealt = out.where("doc_id = 5").select("row_number").groupBy(F.floor(F.col("row_number") / 300)).count().count()
    assert dealt >= 3


def test_the_same_in_every_run(spark):
    key = lambda df: sorted(map(repr, df.select("doc_id", "text", "shard", "slot").collect()))
    df = documents(spark)
    assert key(sh.sharded(df, shards=9)[0]) == key(sh.sharded(df.repartition(2), shards=9)[0])
    assert key(sh.sharded(df, shards=9)[0]) != key(sh.sharded(df, shards=9, seed=2)[0])
    assert sh.sharded(df.limit(0))[0].count() == 0 and sh.sharded(df.limit(1))[0].first()["shard"] == 0


def test_written_shards(spark, tmp_path):
    path = f"{tmp_path}/shards"
    f = sh.write_shards(documents(spark), path, shards=5)
    back = spark.read.parquet(path)
    assert back.count() == f.rows and back.select("shard").distinct().count() == 5
    slots = [r["slot"] for r in spark.read.parquet(f"{path}/shard=3").collect()]
    assert sorted(slots) == list(range(len(slots)))
