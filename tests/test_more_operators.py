"""Errors, edges and outside references of the lookups, records, policies, writes and scores."""

import hashlib
import hmac
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.functions import records as rc
from brindle.operators import evaluation as ev
from brindle.operators import folds
from brindle.operators import lookup as lk
from brindle.operators import policy as po
from brindle.operators import retrieval as rt
from brindle.operators import sync
from brindle.operators import writes as wr
from brindle.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_arguments_out_of_range_are_errors(spark):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    for limit, offset in ((0, 0), (101, 0), (10, -1)):
        with pytest.raises(ValueError):
            lk.checked_page(df, lk.ordered("id"), limit, offset)
    with pytest.raises(ValueError):
        lk.allowed_order("password", ("id",), "id")
    with pytest.raises(ValueError):
        rc.without(df, {"passwort"})
    assert lk.by_keys(df, "id", []).collect() == []


def test_a_missing_row_is_an_error_when_the_plan_runs(spark):
    df = spark.createDataFrame([(1, None)], "id long, name string")
    assert lk.or_fail(df, "x.not_found").collect() == [(1, None)]
    gone = lk.or_fail(df.where("id = 2"), "x.not_found")
    with pytest.raises(Exception, match="x.not_found"):
        gone.collect()


def test_null_counts_as_the_largest_value(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id long, v int")
    assert [r["id"] for r in df.orderBy(*lk.ordered("v desc", "id")).collect()] == [2, 3, 1]
    assert [r["id"] for r in df.orderBy(*lk.ordered("v", "id")).collect()] == [1, 3, 2]


def test_order_of_ids_stays(spark):
    ids = spark.createDataFrame([(0, 3), (1, 1), (2, 9), (3, 3)], "pos int, id long")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    assert [r["name"] for r in lk.in_order(ids, rows, "id").collect()] == ["c", "a", "c"]


def test_optional_table(spark):
    assert lk.optional_rows(spark, "not_there_yet", "id long").count() == 0
    spark.range(3).createOrReplaceTempView("there_already")
    assert lk.optional_rows(spark, "there_already", "id long").count() == 3


@pytest.mark.parametrize("key", [b"k", b"0123456789abcdef0123456789abcdef", b"x" * 100])
def test_hmac(spark, key):
    for text in ("", "message", "é" * 200):
        assert one(spark, rc.hmac_sha256(key, F.lit(text))) == hmac.new(key, text.encode(), hashlib.sha256).hexdigest()


def test_sealed_values(spark):
    key = b"0123456789abcdef"
    first, second = one(spark, rc.sealed(F.lit("geheim"), key)), one(spark, rc.sealed(F.lit("geheim"), key))
    assert first != second and first.startswith("enc:v1:") and "=" not in first
    assert one(spark, rc.sealed(F.lit(first), key)) == first
    assert tuple(one(spark, rc.opened(F.lit(first), key))) == ("geheim", True)
    assert tuple(one(spark, rc.opened(F.lit(first), key[::-1]))) == ("", False)
    assert tuple(one(spark, rc.opened(F.lit("enc:v1:!!"), key))) == ("", False)
    assert tuple(one(spark, rc.opened(F.lit("plain"), key))) == ("plain", True)


@pytest.mark.parametrize(("path", "safe"), [("a/b", True), ("../x", False), ("a/../..", False), ("/a", False), (None, True), ("a/../b/./..", True), ("..\\x", False), ("...", True)])
def test_safe_prefix(spark, path, safe):
    assert one(spark, rc.safe_prefix(F.lit(path).cast("string"))) is safe


@pytest.mark.parametrize(("host", "number"), [("1.2.3.4", 16909060), ("255.255.255.255", 2**32 - 1), ("01.2.3.4", None), ("256.1.1.1", None), ("a.b.c.d", None), ("1.2.3", None)])
def test_ip_number(spark, host, number):
    assert one(spark, po.ip_number(F.lit(host))) == number


@pytest.mark.parametrize(("host", "like"), [("2130706433", True), ("4294967296", False), ("0x7f.0.0.1", True), ("0177.0.0.1", True), ("0400.0.0.1", False), ("1.2.3.4", True), ("a.b.c.d", False), ("host", False)])
def test_ip_like(spark, host, like):
    assert one(spark, po.ip_like(F.lit(host))) is like


def test_inserted_ids_go_on(spark):
    current = spark.createDataFrame([(7, 1, "a")], "id long, t int, name string")
    rows = spark.createDataFrame([(t, f"n{t}") for t in range(20)], "t int, name string").repartition(5)
    new, fresh = wr.inserted(current, rows, "id", ["t"], F.floor(F.col("t") / 3))
    assert sorted((r["id"], r["t"]) for r in fresh.collect()) == [(8 + t, t) for t in range(20)]
    assert new.count() == 21
    assert sorted(r["id"] for r in wr.inserted(current.limit(0), rows, "id", ["t"], F.lit(0))[1].collect()) == list(range(1, 21))


def test_dead_rows_stay_beside_upserted_ones(spark):
    current = spark.createDataFrame([("a", 1, None), ("b", 1, "gone"), ("c", 1, None)], "k string, v int, deleted_at string")
    rows = spark.createDataFrame([("a", 2, 1), ("b", 2, 1), ("b", 3, 2)], "k string, v int, t int")
    new, affected = wr.upsert_live(current, rows, ["k"], ["t"])
    assert sorted(map(tuple, new.collect()), key=repr) == sorted([("a", 2, None), ("b", 1, "gone"), ("b", 3, None), ("c", 1, None)], key=repr)
    assert sorted(r["k"] for r in affected.collect()) == ["a", "b"]


def test_stale_children_whose_parents_hold_marks(spark):
    stored = spark.createDataFrame([(x,) for x in ("p#f#1", "p#f#2", "p#q#f#1", "pq#f#1", "p")], "child string")
    parents = spark.createDataFrame([("p#q", []), ("x", [])], "parent string, keep array<string>")
    assert [r["child"] for r in sync.stale_children(stored, parents, "child", "parent", "keep").collect()] == ["p#q#f#1"]
    parents = spark.createDataFrame([("p", ["p#f#2"])], "parent string, keep array<string>")
    assert sorted(r["child"] for r in sync.stale_children(stored, parents, "child", "parent", "keep").collect()) == ["p#f#1", "p#q#f#1"]


def test_longest_common_subsequence(spark):
    rng = random.Random(4)
    pairs = [(i, " ".join(rng.choices("abcd", k=rng.randint(0, 90))), " ".join(rng.choices("abcd", k=rng.randint(0, 90)))) for i in range(30)]

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = list(row)
            for j, y in enumerate(b, 1):
                row[j] = before[j - 1] + 1 if x == y else max(row[j - 1], before[j])
        return row[-1]

    df = spark.createDataFrame(pairs, "i int, a string, b string")
    got = {r["i"]: r["n"] for r in df.select("i", ev.common_subsequence(ev.words(F.col("a")), ev.words(F.col("b"))).alias("n")).collect()}
    assert got == {i: plain(a.split(), b.split()) for i, a, b in pairs}


def test_bleu_by_hand(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the cat sat down"), (2, "a b", "a b"), (3, "x", "y"), (4, "", "a")], "i int, t string, r string")
    got = {r["i"]: r for r in ev.bleu(df, ["i"], "t", "r", [1, 2]).collect()}
    assert got[1]["bleu1"] == pytest.approx(math.exp(1 - 4 / 3)) and got[1]["bleu2"] == pytest.approx(math.exp(1 - 4 / 3))
    assert got[2]["bleu2"] == 1.0 and got[3]["bleu1"] == 0.0 and got[4]["bleu1"] == 0.0


def test_a_query_vector_that_is_missing(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in rt.nearest(vectors, vectors.where("vec_id = 2").select("embedding"), 5, 0.0).collect()] == [2, 1]
    assert rt.nearest(vectors, vectors.where("vec_id = 9").select("embedding"), 5, 0.0).collect() == []


def test_separated_chunks(spark):
    df = spark.createDataFrame([(1, "aa\nbb\n\ncccccccc\nd"), (2, ""), (3, None)], "id int, text string")
    got = rt.separated_chunks(df, "id", "text", "\n", 5).orderBy("id", "chunk_index").collect()
    assert [(r["id"], r["chunk_index"], r["chunk"]) for r in got] == [(1, 0, "aa\nbb"), (1, 1, "ccccc"), (1, 2, "ccc\nd")]


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("bucket", [0, 300, 86_400])
def test_rate_limit_across_buckets(spark, inclusive, bucket):
    rng = random.Random(bucket)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1, None]), rng.randrange(0, 20_000) // 5 * 5) for i in range(3_000)]
    df = spark.createDataFrame(rows, "id long, k string, j int, s long").select("id", "k", "j", F.timestamp_seconds("s").alias("ts")).repartition(3)
    kept, last = set(), {}
    for i, k, j, s in sorted(rows, key=lambda r: (r[3], r[0])):
        before = last.get((k, j))
        if before is None or (s - before >= 60 if inclusive else s - before > 60):
            kept.add(i)
            last[k, j] = s
    assert {r["id"] for r in folds.throttled(df, ["k", "j"], "ts", "id", 60, inclusive, bucket_seconds=bucket).collect()} == kept


def test_batches_of_a_stream(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    live.in_batches(stream, lambda rows, number: seen.append((number, rows.count())), str(tmp_path / "cp")).awaitTermination(60)
    assert sum(n for _, n in seen) == 10


def test_stream_state_goes_with_the_watermark(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    rows = [(i, "k", at(s)) for i, s in enumerate((0, 30, 61, 100, 122))]
    spark.createDataFrame(rows, "id long, key string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, key string, ts timestamp").parquet(str(tmp_path / "in"))
    out = live.throttled_stream(stream, ["key"], "ts", "id", 60, late="10 seconds")
    query = out.writeStream.format("memory").queryName("throttled_late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["id"] for r in spark.table("throttled_late").collect()) == [0, 2, 4]


@pytest.mark.parametrize(("dense", "inclusive"), [(20, False), (20, True), (3, False)])
def test_dense_buckets_are_cut(spark, dense, inclusive):
    rng = random.Random(12)
    rows = [(i, "hot" if i % 3 else None, 1_700_000_000_000_000 + rng.randrange(2 * 3600 * 1_000_000)) for i in range(900)] + [(9000 + i, "calm", 1_700_000_000_000_000 + i * 86_400_000_000) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, k string, us long").select("id", "k", F.timestamp_micros("us").alias("ts")).repartition(5)
    last, kept = {}, set()
    for i, k, us in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or (us - last[k] >= 30_000_000 if inclusive else us - last[k] > 30_000_000):
            kept.add(i)
            last[k] = us
    assert {r["id"] for r in folds.throttled(df, ["k"], "ts", "id", 30, inclusive, dense=dense).collect()} == kept
    assert {r["id"] for r in folds.throttled(df, ["k"], "ts", "id", 30, inclusive).collect()} == kept


def test_groups_over_many_batches():
    keys = [1] * 70 + [2] + [3] * 29 + [None] * 40 + [None] * 3
    table = pa.table({"k": pa.array(keys), "v": list(range(len(keys)))})
    for size in (1, 7, 70, 1000):
        pieces = list(folds._whole_groups(iter(table.to_batches(max_chunksize=size)), lambda t: ["k"]))
        assert pa.concat_tables([p for p, _ in pieces]).to_pydict() == table.to_pydict()
        assert [len(p) for p, _ in pieces for _ in (0,)] and sum(len(f) for _, f in pieces) == 4
