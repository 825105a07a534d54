"""Edge cases of the operators, and the streaming and source forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.operators import folds, lookup, writes
from brindle.sources import feed
from brindle.streaming import live

START = dt.datetime(2024, 1, 1)


def events(seed=3, n=300):
    rng = random.Random(seed)
    return [(i, rng.randint(0, 3), START + dt.timedelta(seconds=rng.choice([0, 30, 60, 61]) + 20 * rng.randint(0, 400)), rng.randint(-5, 5)) for i in range(n)]


def greedy(rows, seconds, inclusive):
    last, kept = {}, set()
    for i, key, at, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        gap = (at - last[key]).total_seconds() if key in last else None
        if gap is None or (gap >= seconds if inclusive else gap > seconds):
            last[key] = at
            kept.add(i)
    return kept


@pytest.mark.parametrize("inclusive", [False, True])
def test_throttle_equals_the_greedy_loop(spark, inclusive):
    rows = events()
    df = spark.createDataFrame(rows, "id long, key int, ts timestamp, d long")
    out = folds.throttled(df, ["key"], "ts", "id", 60, inclusive)
    assert {r["id"] for r in out.collect()} == greedy(rows, 60, inclusive)
    assert out.columns == df.columns
    assert folds.throttled(df.limit(0), ["key"], "ts", "id", 60).count() == 0


def test_counter_never_falls_below_zero(spark):
    rows = events(seed=4)
    df = spark.createDataFrame(rows, "id long, key int, ts timestamp, d long")
    want = {}
    for _, key, _, d in sorted(rows, key=lambda r: (r[2], r[0])):
        want[key] = max(want.get(key, 0) + d, 0)
    out = folds.clamped_counter(df, ["key"], ["ts", "id"], "d", F.date_trunc("minute", "ts"))
    assert {r["key"]: r["counter"] for r in out.collect()} == want


def test_lookup_errors_and_blank_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    with pytest.raises(ValueError):
        lookup.where_equal(df, {})
    with pytest.raises(ValueError):
        lookup.where_equal(df, {"nope": 1})
    assert lookup.where_equal(df, {"v": None}).first()["k"] == 2
    assert lookup.where_given(df, {"v": "", "k": None}).count() == 2
    assert lookup.offset_page(df, [F.asc("k")], 0, 0).count() == 1


def test_text_helpers(spark):
    df = spark.createDataFrame([("  x\t\n", "a%b")], "s string, t string")
    row = df.select(tx.strip("s").alias("s"), tx.holds(F.col("t"), "%").alias("p"), tx.holds(F.col("t"), "_").alias("u"), tx.default_tag(F.lit("m")).alias("tag")).first()
    assert tuple(row) == ("x", True, False, "m:latest")
    assert tx.glob_or_regex("/[/") is None


def test_insert_once_within_a_batch_and_update_skips_deleted(spark):
    current = spark.createDataFrame([(1, "x", None), (2, "y", START)], "k int, v string, deleted_at timestamp")
    fresh = spark.createDataFrame([(1, "n", None), (2, "n", None), (2, "m", None)], "k int, v string, deleted_at timestamp")
    out = writes.insert_if_absent(current, fresh, ["k"], ["v"], only=F.col("deleted_at").isNull())
    assert sorted((r["k"], r["v"]) for r in out.collect()) == [(1, "x"), (2, "m"), (2, "y")]
    done = writes.update_where(current, F.col("k") > 0, {"v": F.lit("z")}, live="deleted_at")
    assert sorted((r["k"], r["v"]) for r in done.collect()) == [(1, "z"), (2, "y")]
    assert writes.purge(current, "deleted_at", None).count() == 2


def test_throttled_stream(spark, tmp_path):
    rows = sorted(events(seed=5, n=80), key=lambda r: (r[2], r[0]))
    for part in (rows[:40], rows[40:]):
        spark.createDataFrame(part, "id long, key int, ts timestamp, d long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, key int, ts timestamp, d long").parquet(str(tmp_path / "in"))
    query = live.throttled_stream(stream, ["key"], "ts", "id", 60).writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {r["id"] for r in spark.table("throttled").collect()} == greedy(rows, 60, False)


def test_feed_source_full_and_incremental(spark, tmp_path):
    def fetch(start, most):
        to = min(25, start + most)
        return [(str(i), f"t{i}", None, None, None, i % 7 == 0) for i in range(start, to)], to

    feed.register(spark, "doubles", fetch)
    assert spark.read.format("doubles").option("page", "10").load().count() == 25
    stream = spark.readStream.format("doubles").option("page", "10").load()
    query = stream.writeStream.format("memory").queryName("fed").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(int(r["external_id"]) for r in spark.table("fed").collect()) == list(range(25))
