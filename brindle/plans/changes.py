"""Sync runs, rate limits, expiry, counters and writes on the driver's tables; see ``lookups`` for the stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import folds, sync
from brindle.operators import lookup as lk
from brindle.operators import writes as wr
from brindle.plans.lookups import memberships
from brindle.sources.tables import table

NOW = "timestamp_ntz'1997-06-01 00:00:00'"


def _feed(spark, sf_dir) -> DataFrame:
    """A feed over the customers' items: the current table holds ids below two thirds, the feed those from a third on."""
    orders = table(spark, sf_dir, "orders")
    current = orders.where("o_orderkey % 3 <> 2").select("o_orderkey", F.col("o_orderpriority").alias("digest"))
    digest = F.when(F.col("o_orderkey") % 5 == 0, "new").otherwise(F.col("o_orderpriority"))
    feed = orders.where("o_orderkey % 4 <> 1").select("o_orderkey", "o_custkey", digest.alias("digest"), (F.col("o_orderstatus") == "P").alias("gone"), (F.col("o_totalprice") > 350000).alias("bad"))
    return sync.outcomes(current, feed, "o_orderkey", "digest", deleted="gone", failed=F.col("bad"), sync_deletions=True)


def sync_outcomes(spark, sf_dir):
    return _feed(spark, sf_dir).select("o_orderkey", "outcome")


def sync_tally(spark, sf_dir):
    return sync.tally(_feed(spark, sf_dir), ["o_custkey"])


def error_samples(spark, sf_dir):
    return sync.error_samples(_feed(spark, sf_dir).withColumn("message", F.concat(F.lit("item "), F.col("o_orderkey"))), ["o_custkey"], "o_orderkey", "message", 3)


def throttle_greedy(spark, sf_dir):
    return folds.throttled(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 240 * 60).select("event_id", "user_id", "event_type", "ts")


def throttle_inclusive(spark, sf_dir):
    return folds.throttled(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 3600, inclusive=True).select("event_id", "user_id", "ts")


def expire_sweep(spark, sf_dir):
    late = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.expr(NOW))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(late, "expired").otherwise(F.col("o_orderstatus")).alias("status"))


def retention_purge(spark, sf_dir):
    return wr.purge(table(spark, sf_dir, "orders"), "o_orderdate", F.expr(NOW)).select("o_orderkey", "o_orderdate")


def recent_counts(spark, sf_dir):
    bounds = (F.col("ts") >= F.expr("timestamp_ntz'2024-01-05 00:00:00'")) & (F.col("ts") < F.expr("timestamp_ntz'2024-01-06 00:00:00'"))
    return table(spark, sf_dir, "events").where(bounds).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def insert_if_absent(spark, sf_dir):
    current = memberships(spark, sf_dir).where("o_orderkey % 2 = 0").select("o_custkey", "o_orderkey", "deleted_at")
    rows = memberships(spark, sf_dir).where("o_orderkey % 2 = 1").select("o_custkey", "o_orderkey", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    return wr.insert_if_absent(current, rows, ["o_custkey"], ["o_orderkey"], only=F.col("deleted_at").isNull())


def upsert_merge(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    current = customers.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_name").alias("created_by"), F.col("c_mktsegment").alias("value"))
    rows = customers.where("c_custkey % 2 = 0").select("c_custkey", F.lit("sync").alias("created_by"), F.lit("NEW").alias("value"))
    return wr.upsert(current, rows, ["c_custkey"], ["created_by"])


def soft_delete_view(spark, sf_dir):
    rows = wr.soft_delete(memberships(spark, sf_dir), F.col("o_custkey") % 10 == 0, F.expr(NOW))
    return lk.live(rows).select("o_orderkey", "o_custkey")


def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = lk.marked(memberships(spark, sf_dir), gone, "o_custkey", "hit")
    return wr.soft_delete(rows, F.col("hit"), F.expr(NOW)).select("o_orderkey", "deleted_at")


def clear_default(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("is_default", F.col("p_size") <= 5)
    match = (F.col("p_brand") == "Brand#11") & (F.col("p_partkey") != 7)
    return wr.update_where(parts, match, {"is_default": F.lit(False)}).select("p_partkey", "is_default")


def clamped_counter(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    delta = F.when(F.col("event_type").isin("purchase", "signup"), F.round("value").cast("bigint")).otherwise(-F.round(F.col("value") / 2).cast("bigint"))
    return folds.clamped_counter(events.withColumn("delta", delta), ["user_id"], ["ts", "event_id"], "delta", F.to_date("ts"))


def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return lk.latest_per_key(rows, ["user_id"], ["ts", "event_id"])


def backfill_hashes(spark, sf_dir):
    users = table(spark, sf_dir, "customer").withColumn("key_hash", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("migrated-tenant-"), F.col("c_custkey"))).otherwise(F.md5("c_name")))
    return wr.update_where(users, F.col("key_hash").startswith("migrated-tenant-"), {"key_hash": F.sha2("c_name", 256)}).select("c_custkey", "key_hash")


_FEED = """
with current as (select o_orderkey, o_orderpriority as digest from orders where o_orderkey % 3 <> 2),
feed as (select o_orderkey, o_custkey, case when o_orderkey % 5 = 0 then 'new' else o_orderpriority end as digest, o_orderstatus = 'P' as gone, o_totalprice > 350000 as bad from orders where o_orderkey % 4 <> 1),
done as (select f.*, case when bad then 'failed' when gone and c.o_orderkey is not null then 'deleted' when gone then 'skipped' when c.o_orderkey is null then 'created'
                          when f.digest = c.digest then 'skipped' else 'updated' end as outcome from feed f left join current c using (o_orderkey))
"""
_THROTTLE = """
with recursive e as (select *, row_number() over (partition by {keys} order by ts, event_id) as rn from events),
kept as (select {keys}, rn, event_id, ts from e where rn = 1
         union all
         select {qual}, n.rn, n.event_id, n.ts from kept k join lateral (select * from e where {same} and e.ts {op} k.ts + interval {minutes} minute order by e.rn limit 1) n on true)
select event_id, {keys}, ts from kept
"""
QUERIES = {f.__name__: f for f in (
    sync_outcomes, sync_tally, error_samples, throttle_greedy, throttle_inclusive, expire_sweep, retention_purge, recent_counts, insert_if_absent,
    upsert_merge, soft_delete_view, cascade_delete, clear_default, clamped_counter, latest_per_key, backfill_hashes,
)}
SQL = {
    "sync_outcomes": _FEED + "select o_orderkey, outcome from done",
    "sync_tally": _FEED + """, t as (select o_custkey, count(*) as total, count(*) filter (where outcome = 'created') as created, count(*) filter (where outcome = 'updated') as updated,
  count(*) filter (where outcome = 'deleted') as deleted, count(*) filter (where outcome = 'skipped') as skipped, count(*) filter (where outcome = 'failed') as failed from done group by 1)
select *, case when failed = 0 then 'success' when failed >= total then 'failed' else 'partial' end as status from t""",
    "error_samples": _FEED + "select o_custkey, string_agg('item ' || o_orderkey, '; ' order by o_orderkey) as errors from (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from done where outcome = 'failed') where n <= 3 group by 1",
    "throttle_greedy": _THROTTLE.format(keys="user_id, event_type", qual="k.user_id, k.event_type", same="e.user_id = k.user_id and e.event_type = k.event_type", op=">", minutes=240),
    "throttle_inclusive": _THROTTLE.format(keys="user_id", qual="k.user_id", same="e.user_id = k.user_id", op=">=", minutes=60),
    "expire_sweep": "select o_orderkey, case when o_orderstatus = 'O' and o_orderdate < timestamp '1997-06-01' then 'expired' else o_orderstatus end as status from orders",
    "retention_purge": "select o_orderkey, o_orderdate from orders where o_orderdate >= timestamp '1997-06-01'",
    "recent_counts": "select user_id, event_type, count(*) as n from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-06' group by 1, 2",
    "insert_if_absent": """
with m as (select o_custkey, o_orderkey, case when o_orderstatus = 'P' then o_orderdate end as deleted_at from orders),
cur as (select * from m where o_orderkey % 2 = 0), fresh as (select o_custkey, min(o_orderkey) as o_orderkey from m where o_orderkey % 2 = 1 group by 1)
select * from cur union all select o_custkey, o_orderkey, null from fresh where o_custkey not in (select o_custkey from cur where deleted_at is null)
""",
    "upsert_merge": """
select c_custkey, case when c_custkey % 3 <> 0 then c_name else 'sync' end as created_by, case when c_custkey % 2 = 0 then 'NEW' else c_mktsegment end as value
from customer where c_custkey % 3 <> 0 or c_custkey % 2 = 0
""",
    "soft_delete_view": "select o_orderkey, o_custkey from orders where o_orderstatus <> 'P' and o_custkey % 10 <> 0",
    "cascade_delete": "select o_orderkey, case when o_orderstatus = 'P' then o_orderdate when c_acctbal < 0 then timestamp '1997-06-01' end as deleted_at from orders left join customer on c_custkey = o_custkey",
    "clear_default": "select p_partkey, p_size <= 5 and not (p_brand = 'Brand#11' and p_partkey <> 7) as is_default from part",
    "clamped_counter": """
with recursive e as (select user_id, row_number() over (partition by user_id order by ts, event_id) as rn,
  case when event_type in ('purchase', 'signup') then round(value)::bigint else -round(value / 2)::bigint end as d from events),
f as (select user_id, rn, greatest(d, 0) as x from e where rn = 1 union all select e.user_id, e.rn, greatest(f.x + e.d, 0) from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)
select user_id, arg_max(x, rn)::bigint as counter from f group by 1
""",
    "latest_per_key": "select user_id, event_id, ts, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "backfill_hashes": "select c_custkey, case when c_custkey % 4 = 0 then sha256(c_name) else md5(c_name) end as key_hash from customer",
}
