"""Streams with state: equal to their batch forms, whatever the order, with replays and restarts."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from brindle.operators import sync
from brindle.plans import changes, feeds
from brindle.streaming import stateful

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def drop_in(df, path, parts):
    """The rows in ``parts`` files, each written on its own, so that triggers can be one file each."""
    for i in range(parts):
        df.where(F.pmod(F.xxhash64(*df.columns), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)


def forget_last_commit(checkpoint):
    last = max(glob.glob(f"{checkpoint}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    crc = f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"
    if os.path.exists(crc):
        os.remove(crc)


def test_applied_feed_equals_batch_and_replays(spark, tmp_path):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    current = orders.where("o_orderkey % 3 <> 2").select("o_orderkey", F.col("o_orderpriority").alias("digest"))
    digest = F.when(F.col("o_orderkey") % 5 == 0, "new").otherwise(F.col("o_orderpriority"))
    feed = orders.where("o_orderkey % 4 <> 1").select("o_orderkey", digest.alias("digest"), (F.col("o_orderstatus") == "P").alias("gone"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("nth"))
    drop_in(feed, f"{tmp_path}/in", 3)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def run():
        done = stateful.applied(stream, current, by=["o_orderkey"], item="o_orderkey", digest="digest", order="nth", deleted="gone", failed=F.col("price") > 350000, sync_deletions=True)
        stateful.into_batches(done, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(240)
        return sorted((r["o_orderkey"], r["outcome"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    want = sorted(tuple(r) for r in changes.sync_outcomes(spark, DATA).collect())
    assert run() == want
    forget_last_commit(f"{tmp_path}/cp")
    assert run() == want  # the last trigger ran again


def test_items_go_and_come_again(spark, tmp_path):
    rows = [(1, "a", "x", False), (2, "a", "x", False), (3, "a", None, True), (4, "a", None, True), (5, "a", "y", False), (6, "a", "z", False), (7, "b", "x", False), (3, "a", "late", False)]
    schema = "nth long, item string, digest string, gone boolean"
    for i, part in enumerate((rows[:3], rows[3:5], rows[5:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(0.01)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    done = stateful.applied(stream.withColumn("scope", F.lit("s")), None, by=["scope"], item="item", digest="digest", order="nth", deleted="gone", failed=F.col("nth") == 6, sync_deletions=True)
    stateful.into_batches(done, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = [(r["nth"], r["outcome"]) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("nth").collect()]
    assert got == [(1, "created"), (2, "skipped"), (3, "deleted"), (4, "skipped"), (5, "created"), (6, "failed"), (7, "created")]


def test_shuffled_chunks_make_the_same_answers(spark, tmp_path):
    talks = spark.read.parquet(f"{DATA}/conversations.parquet").where("role = 'assistant'")
    count = F.greatest(F.ceil(F.length("text") / 40).cast("int"), F.lit(1))
    each = F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("text"), i * 40 + 1, F.lit(40)))).alias("seq", "chunk")
    chunks = talks.select("conv_id", "turn", each, count.alias("n")).withColumn("done", F.col("seq") == F.col("n") - 1).drop("n")
    drop_in(chunks, f"{tmp_path}/in", 4)
    chunks.limit(20).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # some come twice
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stateful.into_batches(stateful.answers(stream, ["conv_id", "turn"], "seq", "chunk", "done"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(240)
    got = sorted(tuple(r[c] for c in ("conv_id", "turn", "answer", "finished")) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(tuple(r[c] for c in ("conv_id", "turn", "answer", "finished")) for r in feeds.streamed_answers(spark, DATA).collect())


def test_unfinished_answers_come_out_after_a_while(spark, tmp_path):
    schema = "id string, seq long, chunk string, done boolean"
    spark.createDataFrame([("a", 1, "lo", False), ("a", 0, "hel", False), ("b", 0, "x", True)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = stateful.into_batches(stateful.answers(stream, ["id"], "seq", "chunk", "done", wait_ms=1500), f"{tmp_path}/out", f"{tmp_path}/cp", processingTime="500 milliseconds")
    try:
        until = time.time() + 90
        found = []
        while len(found) < 2 and time.time() < until:
            time.sleep(1)
            if glob.glob(f"{tmp_path}/out/batch=*/_SUCCESS"):
                found = sorted(tuple(r[c] for c in ("id", "answer", "finished")) for r in spark.read.schema("id string, answer string, finished boolean").parquet(*[os.path.dirname(p) for p in glob.glob(f"{tmp_path}/out/batch=*/_SUCCESS")]).collect())
    finally:
        query.stop()
    assert found == [("a", "hello", False), ("b", "x", True)]
