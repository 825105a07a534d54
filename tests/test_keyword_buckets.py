"""The keyword index stays where its blocks are: what is shuffled, what a task holds, and the way for many queries."""

import os
import re

import pytest
from pyspark.sql import functions as F

from brindle.operators import keyword_index as ki
from brindle.plans import ranked
from tests.test_indexes import corpus

QUERIES = [(q, f"w{q} w{3 * q} w0 w1 w{399 - q}") for q in range(20)]


def told(df):
    return [tuple(r) for r in df.orderBy("q", "grp", "rank").collect()]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "q long, text string")


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("pruned", [True, False])
def test_no_posting_is_shuffled(spark, asked, grouped, pruned):
    group = F.col("id") % 3 if grouped else None
    index = ki.build(spark.createDataFrame(corpus(1000), "id long, text string"), "id", "text", group=group, block=32)
    found = ki.search(index, asked, "q", "text", 5, pruned)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\w+)#", plan)
    assert dealt and set(dealt) == {("query", "grp")}  # nothing by term, block or document


def test_a_task_holds_a_bucket_however_many_documents(spark, monkeypatch):
    monkeypatch.setattr(ki, "BUCKET_DOCS", 200, raising=False)
    for n in (1000, 4000):
        index = ki.build(spark.createDataFrame(corpus(n), "id long, text string"), "id", "text", block=16)
        each = index.postings.select(F.input_file_name().alias("p"), F.explode("docs.id").alias("id")).distinct()
        held = [r["count"] for r in each.groupBy("p").count().collect()]
        assert sum(held) == n + 1 and max(held) < 3 * 200


def test_labelled_texts_are_not_shuffled(spark, monkeypatch):
    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = ranked._labelled(spark, data)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        monkeypatch.setattr(ranked, "LABELS", 3)
        assert sorted(ranked._labelled(spark, data).select("doc_id").collect()) == sorted(near.select("doc_id").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_more_queries_than_are_broadcast(spark, asked, monkeypatch):
    index = ki.build(spark.createDataFrame(corpus(1000), "id long, text string"), "id", "text", block=32)
    want = told(ki.search(index, asked, "q", "text", 5))
    monkeypatch.setattr(ki, "ASKED_ROWS", 10, raising=False)
    for pruned in (True, False):
        got = told(ki.search(index, asked, "q", "text", 5, pruned))
        assert [r[:4] for r in got] == [r[:4] for r in want] and all(abs(a[4] - b[4]) < 2e-6 for a, b in zip(got, want, strict=True))
