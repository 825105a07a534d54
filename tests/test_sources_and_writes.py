"""Ranges read on executors, staged writes, rewritten partitions, networks and deep pages."""

import glob
import ipaddress
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from brindle.operators import lookup as lk
from brindle.operators import networks as nw
from brindle.operators import rewrites as rw
from brindle.operators import writes as wr
from brindle.sources import ranges
from brindle.streaming import stateful


def connector(folder, upto):
    """A feed of ``upto`` items that tells where it was asked, and fails once for a range if a file says so."""

    def fetch(start, most):
        to = min(upto, start + min(most, 7))  # fewer than asked for
        with open(f"{folder}/asked", "a") as f:
            f.write(f"{os.getpid()} {start}\n")
        if start <= 40 < to and os.path.exists(f"{folder}/fail"):
            raise RuntimeError("the connector is down")
        return [(str(i), f"t{i}", None, None, None, i % 7 == 0) for i in range(start, to)], to

    def head():
        with open(f"{folder}/head") as f:
            return int(f.read())

    return fetch, head


def put_head(folder, n):
    with open(f"{folder}/head", "w") as f:
        f.write(str(n))


def test_ranges_are_read_by_tasks_and_restart(spark, tmp_path):
    folder = str(tmp_path)
    fetch, head = connector(folder, 100)
    put_head(folder, 30)
    ranges.register(spark, "ranged", fetch, head)
    assert sorted(int(r[0]) for r in spark.read.format("ranged").option("page", "8").load().select("external_id").collect()) == list(range(30))
    assert spark.read.format("ranged").option("page", "8").load().rdd.getNumPartitions() == 4
    with open(f"{folder}/asked") as f:
        assert str(os.getpid()) not in {line.split()[0] for line in f}

    def run():
        stream = spark.readStream.format("ranged").option("page", "8").load()
        stateful.into_batches(stream, f"{folder}/out", f"{folder}/cp", once=True).awaitTermination(120)

    run()
    put_head(folder, 100)
    open(f"{folder}/fail", "w").close()
    with pytest.raises(Exception, match="down"):
        run()
    os.remove(f"{folder}/fail")
    run()
    assert sorted(int(r["external_id"]) for r in spark.read.parquet(f"{folder}/out").collect()) == list(range(100))


def items(ingestor):
    return sorted(json.loads(line)["id"] for uri in ingestor.published() for line in open(uri.removeprefix("file://")))


def test_a_sink_publishes_all_or_nothing(spark, tmp_path):
    ingestor = ranges.FolderIngestor(f"file://{tmp_path}/sink")
    ranges.register_sink(spark, "items", ingestor)
    spark.range(50).repartition(4).write.format("items").mode("append").save()
    assert items(ingestor) == list(range(50))
    assert spark.range(0).write.format("items").mode("append").save() is None and items(ingestor) == list(range(50))
    bad = spark.range(40).repartition(4).select(F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("items").mode("append").save()
    assert items(ingestor) == list(range(50))
    assert len(glob.glob(f"{tmp_path}/sink/items/*")) == len(ingestor.published())  # nothing is left behind


def test_what_killed_tasks_have_staged_is_taken_back(spark, tmp_path):
    class Slow(ranges.FolderIngestor):
        """One task fails when the others have staged their items but have not told of it."""

        def stage(self, *args):
            rows = list(args[-1])
            if any(r["id"] == 33 for r in rows):
                time.sleep(3)
                raise RuntimeError("broken")
            name = ranges.FolderIngestor.stage(self, *args[:-1], iter(rows))
            time.sleep(30)
            return name

    ingestor = Slow(f"file://{tmp_path}/sink")
    ranges.register_sink(spark, "slow_items", ingestor)
    ranges.register_sink(spark, "slow_stream_items", Slow(f"file://{tmp_path}/of_stream"))
    with pytest.raises(Exception, match="broken"):
        spark.range(0, 40, 1, 4).write.format("slow_items").mode("append").save()
    assert ingestor.published() == [] and [f for f in glob.glob(f"{tmp_path}/sink/**", recursive=True) if os.path.isfile(f)] == []
    spark.range(0, 40, 1, 4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.format("slow_stream_items")
    with pytest.raises(Exception, match="broken"):
        stream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(60)
    assert [f for f in glob.glob(f"{tmp_path}/of_stream/**", recursive=True) if os.path.isfile(f)] == []


def test_a_job_that_was_taken_back_stages_nothing_more_and_others_stay(tmp_path):
    ingestor = ranges.FolderIngestor(f"file://{tmp_path}/sink")
    for job in ("one", "two"):
        ingestor.begin(job)
    lost, told = (ingestor.stage("one", iter([{"id": i}])) for i in range(2))
    other = ingestor.stage("two", iter([{"id": 2}]))
    ingestor.publish("one", [told], None)
    assert items(ingestor) == [1] and lost not in " ".join(glob.glob(f"{tmp_path}/sink/**", recursive=True))
    with pytest.raises(OSError):
        ingestor.stage("one", iter([{"id": 3}]))
    ingestor.publish("two", [other], None)
    assert items(ingestor) == [1, 2] and os.listdir(f"{tmp_path}/sink/staged") == []
    ingestor.begin("three")
    kept = ingestor.stage("three", iter([{"id": 4}]))
    with pytest.raises(OSError):
        ingestor.publish("three", [kept, "missing.jsonl"], None)
    ingestor.discard("three")
    assert items(ingestor) == [1, 2] and len(os.listdir(f"{tmp_path}/sink/items")) == 2


def test_a_stream_of_several_batches_is_published_whole(spark, tmp_path):
    ingestor = ranges.FolderIngestor(f"file://{tmp_path}/sink")
    ranges.register_sink(spark, "more_items", ingestor)
    spark.range(0, 30, 1, 3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.format("more_items")
    stream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(60)
    assert items(ingestor) == list(range(30)) and len(os.listdir(f"{tmp_path}/sink/manifests")) == 3


def test_a_streams_batch_is_published_once(spark, tmp_path):
    ingestor = ranges.FolderIngestor(f"file://{tmp_path}/sink")
    ranges.register_sink(spark, "stream_items", ingestor)
    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        stream.writeStream.format("stream_items").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(60)

    run()
    os.remove(f"{tmp_path}/cp/commits/0")  # as if the driver had been lost there
    os.remove(f"{tmp_path}/cp/commits/.0.crc")
    run()
    assert items(ingestor) == list(range(30)) and len(glob.glob(f"{tmp_path}/sink/items/*")) == len(ingestor.published())


def files(path):
    return {f: (os.path.getmtime(f), os.path.getsize(f)) for f in glob.glob(f"{path}/*/*.parquet")}


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = f"{tmp_path}/table"
    current = spark.range(1000).select("id", F.concat(F.lit("v"), "id").alias("v"), (F.col("id") + 5).alias("made"), (F.col("id") % 10).cast("int").alias("p"))
    current.repartition("p").write.partitionBy("p").parquet(path)
    kept = lambda: sorted(tuple(r[c] for c in ("id", "v", "made", "p")) for r in spark.read.parquet(path).collect())
    rows = spark.createDataFrame([(3, "new", 0, 3), (14, "moved", 0, 5), (5000, "added", 1, 11)], "id long, v string, made long, p int")
    want = sorted(tuple(r[c] for c in ("id", "v", "made", "p")) for r in wr.upsert(current, rows, ["id"], ["made"]).collect())
    before = files(path)
    rw.upsert(spark, path, rows, ["id"], ["made"], ["p"])
    assert kept() == want
    after = files(path)
    assert {f.split("/")[-2] for f in before if after.get(f) != before[f]} == {"p=3", "p=4", "p=5"}
    assert {f.split("/")[-2] for f in after if f not in before} == {"p=3", "p=4", "p=5", "p=11"}

    rw.delete(spark, path, F.col("p").isin(11, 9) | (F.col("id") == 8), ["p"])
    assert kept() == [r for r in want if r[3] not in (11, 9) and r[0] != 8]
    assert not os.path.exists(f"{path}/p=11") and not os.path.exists(f"{path}/p=9")
    rw.update(spark, path, F.col("id") == 17, {"v": F.lit("set")}, ["p"])
    rw.replace(spark, path, spark.createDataFrame([(26, "whole", -1), (9999, "not there", -1)], "id long, v string, made long"), "id", ("made",), ["p"])
    assert {r[0]: r[1:3] for r in kept()}[17] == ("set", 22) and {r[0]: r[1:3] for r in kept()}[26] == ("whole", 31) and 9999 not in {r[0] for r in kept()}
    with pytest.raises(ValueError, match="partition"):
        rw.update(spark, path, F.lit(True), {"p": F.lit(1)}, ["p"])
    unchanged = files(path)
    rw.delete(spark, path, F.lit(False), ["p"])
    assert files(path) == unchanged


HOSTS = [
    "1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "::", "::1", "1::", "2001:db8::8:800:200c:417a", "2001:DB8:0:0:8:800:200C:417A", "::ffff:10.0.0.1", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8",
    "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", "1::2::3", ":::", "12345::", "g::", "", ":", "1:", ":1", "fe80::1%eth0", "::1.2.3", "::1.2.3.4.5", "1.2.3.4::", "::ffff:1.2.3.400", "0:0:0:0:0:0:1.2.3.4", "host", "1:2:3:4:5:6:1.2.3.4",
]


def test_addresses_equal_the_standard_library(spark):
    pick = random.Random(8)
    hosts = HOSTS + [str(ipaddress.ip_address(pick.getrandbits(pick.choice([16, 64, 128])))) for _ in range(200)] + [ipaddress.IPv6Address(pick.getrandbits(128)).exploded for _ in range(50)]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", nw.address(F.col("h")).alias("a"))
    for r in df.collect():
        try:
            ip = ipaddress.ip_address(r["h"])
            want = (ip.version, int(ip) if ip.version == 4 else int(ipaddress.IPv6Address(str(ip).split("%")[0])))
        except ValueError:
            want = None
        got = None if r["a"] is None else (r["a"]["version"], (r["a"]["hi"] % 2**64 << 64) + r["a"]["lo"] % 2**64)
        assert got == want, r["h"]


def test_longest_prefix_of_many_networks(spark):
    pick = random.Random(2)
    nets = []
    for _ in range(3000):
        bits = pick.choice([32, 128])
        space = 0x0A000000 if bits == 32 else 0x20010DB8 << 96
        base = space + (pick.getrandbits(12) << (bits - 20 if bits == 32 else bits - 44))
        nets.append(f"{(ipaddress.IPv4Address if bits == 32 else ipaddress.IPv6Address)(base)}/{pick.randrange(bits // 4, bits // 2)}")
    nets += ["0.0.0.0/0", "10.0.0.1", "bad/8", "1.2.3.4/33", "::/129", "10.0.0.0/x", None, ""]
    hosts = ["10.0.0.1", "9.9.9.9", "::1", "name", None, "::ffff:10.0.0.1"] + [str(ipaddress.IPv4Address(0x0A000000 + pick.getrandbits(24))) for _ in range(150)] + [str(ipaddress.IPv6Address((0x20010DB8 << 96) + pick.getrandbits(96))) for _ in range(150)]
    networks = spark.createDataFrame([(i, n) for i, n in enumerate(nets)], "nr long, net string")
    got = {r["h"]: (r["nr"], r["prefix"]) for r in nw.longest_prefix(spark.createDataFrame([(h,) for h in hosts], "h string"), "h", networks, "net", ["nr"]).collect()}
    known = []
    for i, n in enumerate(nets):
        try:
            known.append((ipaddress.ip_network(n or "-", strict=False), i))
        except ValueError:
            pass
    for h in hosts:
        try:
            ip = ipaddress.ip_address(h or "-")
            best = max(((net.prefixlen, -i) for net, i in known if ip in net), default=None)
        except ValueError:
            best = None
        assert got[h] == ((None, None) if best is None else (-best[1], best[0])), h


@pytest.mark.parametrize("offset", [0, 1, 4_000, 9_990, 10_004, 10_005, 99_999])
def test_deep_pages(spark, offset):
    pick = random.Random(6)
    rows = [(pick.choice([None, 5.0, 5.0, 5.0, pick.random() * 10]), pick.choice(["a", "b", None]), i) for i in range(10_005)]
    df = spark.createDataFrame(rows, "x double, s string, i long").repartition(4)
    specs = ["x desc", "s", "i"]
    want = [tuple(r) for r in df.orderBy(*lk.ordered(*specs)).collect()][offset : offset + 20]
    page = lk.deep_page(df, specs, offset, 20, ranges=16, rows_a_range=300)
    assert [tuple(r) for r in page.collect()] == want
