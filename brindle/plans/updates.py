"""Writes as table rewrites with the rows they touch; see ``lookups`` for the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import folds
from brindle.operators import writes as wr
from brindle.plans.changes import NOW
from brindle.plans.lookups import memberships
from brindle.sources.tables import table


def _tagged(new, affected, *columns):
    """Both results of a write in one table."""
    return new.select(F.lit("table").alias("part"), *columns).unionByName(affected.select(F.lit("affected").alias("part"), *columns))


def insert_returning(spark, sf_dir):
    """New events appended with ids above the stored ones, in the order of their time."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    new = events.where("event_id % 7 = 3").select("ts", "user_id")
    current = events.where("event_id % 7 <> 3")
    _, fresh = wr.inserted(current, new, "event_id", ["ts", "user_id"], F.to_date("ts"))
    return fresh.select("event_id", "ts", "user_id")


def user_conflict(spark, sf_dir):
    """Users inserted unless their name or their address is taken."""
    users = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("username"), F.concat(F.lit("u"), F.col("c_custkey")).alias("email"))
    key = F.col("c_custkey")
    new = users.select((key + 1_000_000).alias("c_custkey"), F.when(key % 3 == 0, F.col("username")).otherwise(F.concat(F.lit("new"), key)).alias("username"), F.when(key % 5 == 0, F.col("email")).otherwise(F.concat(F.lit("n"), key % 50)).alias("email"))
    _, fresh = wr.inserted_if_free(users, new, [["username"], ["email"]], ["c_custkey"])
    return fresh


def invite_absent(spark, sf_dir):
    """Invitations inserted where the invitee has no pending one; share links, which have no invitee, always are."""
    orders = table(spark, sf_dir, "orders")
    current = orders.where("o_orderkey % 2 = 0 and o_orderstatus = 'O'").select(F.col("o_custkey").alias("invitee"), "o_orderkey")
    new = orders.where("o_orderkey % 2 = 1").select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("invitee"), "o_orderkey")
    named, links = new.where("invitee is not null"), new.where("invitee is null")
    _, fresh = wr.inserted_if_free(current, named, [["invitee"]], ["o_orderkey"])
    return fresh.unionByName(links.select(*fresh.columns))


def kv_upsert(spark, sf_dir):
    """Values written over the live rows of their keys; rows that were deleted stay beside them."""
    orders = table(spark, sf_dir, "orders")
    live = F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate"))
    current = orders.groupBy("o_custkey").agg(F.min_by(F.struct(F.col("o_orderpriority").alias("value"), live.alias("deleted_at")), "o_orderkey").alias("r")).select("o_custkey", "r.*")
    rows = orders.where("o_orderkey % 3 = 0").select("o_custkey", F.concat(F.lit("new "), "o_orderkey").alias("value"), "o_orderkey")
    new, affected = wr.upsert_live(current, rows, ["o_custkey"], ["o_orderkey"])
    return _tagged(new, affected, "o_custkey", "value", "deleted_at")


def approval_upsert(spark, sf_dir):
    """Approvals written over stored ones: only the flag and the time change."""
    parts = table(spark, sf_dir, "part")
    current = parts.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_brand").alias("tool"), F.lit(False).alias("needed"), F.lit("old").alias("updated"))
    rows = parts.where("p_partkey % 3 = 0").select("p_partkey", F.col("p_type").alias("tool"), F.lit(True).alias("needed"), F.lit("new").alias("updated"))
    return wr.upsert(current, rows, ["p_partkey"], ["tool"])


def full_row_update(spark, sf_dir):
    """Whole rows written back, but for their key and brand."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    rows = parts.where("p_partkey % 4 = 1").select((F.col("p_partkey") * 2).alias("p_partkey"), F.lit("Brand#0").alias("p_brand"), F.upper("p_name").alias("p_name"), F.lit(-1).alias("p_size"))
    return _tagged(*wr.replaced(parts, rows, "p_partkey", ("p_brand",)), "p_partkey", "p_brand", "p_name", "p_size")


def tenant_scoped_update(spark, sf_dir):
    """An update that names tenant and key, so another tenant's key hits nothing."""
    match = (F.col("o_custkey") == 13) & (F.col("o_orderkey") % 2 == 0)
    new, affected = wr.updated(memberships(spark, sf_dir), match, {"o_orderpriority": F.lit("0-NONE")}, live="deleted_at")
    return _tagged(new.where("o_custkey < 20"), affected, "o_orderkey", "o_custkey", "o_orderpriority")


def cancel_running(spark, sf_dir):
    """Logs that still run are cancelled when their source is deleted; counted for each source."""
    sources = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    logs = table(spark, sf_dir, "lineitem").join(sources.withColumn("gone", F.lit(True)), "l_suppkey", "left")
    new, _ = wr.updated(logs, F.col("gone") & (F.col("l_linestatus") == "O"), {"l_linestatus": F.lit("C")})
    return new.groupBy("l_suppkey").agg(F.count_if(F.col("l_linestatus") == "C").alias("cancelled"), F.count("*").alias("logs"))


def bulk_quota(spark, sf_dir):
    users = table(spark, sf_dir, "customer").withColumn("deleted_at", F.when(F.col("c_acctbal") < 0, F.expr(NOW)))
    new, affected = wr.updated(users.withColumn("quota", F.col("c_custkey") * 10), F.lit(True), {"quota": F.lit(4096).cast("bigint")}, live="deleted_at")
    return _tagged(new, affected, "c_custkey", "quota")


def revoke_all(spark, sf_dir):
    """All keys of some users revoked; how many that were, for each user."""
    users = table(spark, sf_dir, "customer").where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("hit"))
    keys = table(spark, sf_dir, "orders").withColumn("revoked_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).join(users, "o_custkey", "left")
    _, affected = wr.updated(keys, F.col("hit"), {"revoked_at": F.expr(NOW)}, live="revoked_at")
    return affected.groupBy("o_custkey").agg(F.count("*").alias("revoked"))


def touch_last_used(spark, sf_dir):
    """Each key's last use, written at most once an hour: the last call that the limit lets through."""
    calls = folds.throttled(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id", 3600, inclusive=True)
    return calls.groupBy("user_id").agg(F.max("ts").alias("last_used_at"), F.count("*").alias("writes"))


def set_default(spark, sf_dir):
    """The default pointer of one tenant."""
    users = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("default_backend"))
    new, affected = wr.updated(users, F.col("c_custkey") == 11, {"default_backend": F.lit(99).cast("bigint")})
    return _tagged(new, affected, "c_custkey", "default_backend")


def guarded_transition(spark, sf_dir):
    """Pending invitations move on; answers to others find nothing to change. The first answer to an invitation counts."""
    answers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.struct("l_linenumber", "l_shipdate", "l_returnflag"))["l_returnflag"].alias("answer"))
    rows = memberships(spark, sf_dir).join(answers, "o_orderkey", "left")
    status = F.when(F.col("answer") == "R", "declined").otherwise("accepted")
    new, affected = wr.updated(rows, (F.col("o_orderstatus") == "O") & F.col("answer").isNotNull(), {"o_orderstatus": status}, live="deleted_at")
    return _tagged(new, affected, "o_orderkey", "o_orderstatus")


def accepted_count(spark, sf_dir):
    """Share links' counters, one more for each acceptance of a link that is live."""
    links = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(3).cast("bigint").alias("accepted"), (F.col("s_acctbal") < 0).alias("dead"))
    uses = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    rows = links.join(uses, "s_suppkey", "left")
    return rows.select("s_suppkey", F.when(F.col("dead"), F.col("accepted")).otherwise(F.col("accepted") + F.coalesce("n", F.lit(0))).alias("accepted"))


QUERIES = {f.__name__: f for f in (
    insert_returning, user_conflict, invite_absent, kv_upsert, approval_upsert, full_row_update, tenant_scoped_update, cancel_running, bulk_quota,
    revoke_all, touch_last_used, set_default, guarded_transition, accepted_count,
)}
SQL = {
    "insert_returning": """
select (select max(event_id) from events where event_id % 7 <> 3) + row_number() over (order by ts, user_id) as event_id, ts, user_id from events where event_id % 7 = 3
""",
    "user_conflict": """
with n as (select c_custkey + 1000000 as c_custkey, 'new' || c_custkey as username, 'n' || c_custkey % 50 as email from customer where c_custkey % 3 <> 0 and c_custkey % 5 <> 0)
select * from n qualify row_number() over (partition by email order by c_custkey) = 1
""",
    "invite_absent": """
with cur as (select o_custkey from orders where o_orderkey % 2 = 0 and o_orderstatus = 'O'),
n as (select case when o_orderkey % 5 <> 0 then o_custkey end as invitee, o_orderkey from orders where o_orderkey % 2 = 1)
select invitee, min(o_orderkey) as o_orderkey from n where invitee is not null and invitee not in (select o_custkey from cur) group by 1
union all select invitee, o_orderkey from n where invitee is null
""",
    "kv_upsert": """
with cur as (select o_custkey, o_orderpriority as value, case when o_orderstatus = 'P' then o_orderdate end as deleted_at from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1),
n as (select o_custkey, 'new ' || max(o_orderkey) as value, null::timestamp as deleted_at from orders where o_orderkey % 3 = 0 group by 1)
select 'table' as part, * from cur where deleted_at is not null or o_custkey not in (select o_custkey from n)
union all select 'table', * from n union all select 'affected', * from n
""",
    "approval_upsert": """
select p_partkey, case when p_partkey % 2 = 0 then p_brand else p_type end as tool, p_partkey % 3 = 0 as needed, case when p_partkey % 3 = 0 then 'new' else 'old' end as updated
from part where p_partkey % 2 = 0 or p_partkey % 3 = 0
""",
    "full_row_update": """
with u as (select a.p_partkey, a.p_brand, coalesce(upper(b.p_name), a.p_name) as p_name, case when b.p_partkey is null then a.p_size else -1 end as p_size, b.p_partkey is not null as hit
           from part a left join part b on b.p_partkey % 4 = 1 and b.p_partkey * 2 = a.p_partkey)
select 'table' as part, p_partkey, p_brand, p_name, p_size from u union all select 'affected', p_partkey, p_brand, p_name, p_size from u where hit
""",
    "tenant_scoped_update": """
with u as (select o_orderkey, o_custkey, o_custkey = 13 and o_orderkey % 2 = 0 and o_orderstatus <> 'P' as hit, o_orderpriority from orders where o_custkey < 20)
select 'table' as part, o_orderkey, o_custkey, case when hit then '0-NONE' else o_orderpriority end as o_orderpriority from u
union all select 'affected', o_orderkey, o_custkey, '0-NONE' from u where hit
""",
    "cancel_running": """
select l_suppkey, count(*) filter (where s_acctbal < 0 and l_linestatus = 'O') as cancelled, count(*) as logs from lineitem left join supplier on s_suppkey = l_suppkey group by 1
""",
    "bulk_quota": """
select 'table' as part, c_custkey, case when c_acctbal < 0 then c_custkey * 10 else 4096 end as quota from customer union all select 'affected', c_custkey, 4096 from customer where c_acctbal >= 0
""",
    "revoke_all": "select o_custkey, count(*) as revoked from orders join customer on c_custkey = o_custkey where c_mktsegment = 'FURNITURE' and o_orderstatus <> 'F' group by 1",
    "touch_last_used": """
with recursive e as (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events),
kept as (select user_id, rn, ts from e where rn = 1
         union all
         select k.user_id, n.rn, n.ts from kept k join lateral (select * from e where e.user_id = k.user_id and e.ts >= k.ts + interval 60 minute order by e.rn limit 1) n on true)
select user_id, max(ts) as last_used_at, count(*) as writes from kept group by 1
""",
    "set_default": "select 'table' as part, c_custkey, case when c_custkey = 11 then 99 else c_nationkey end::bigint as default_backend from customer union all select 'affected', 11, 99",
    "guarded_transition": """
with a as (select l_orderkey, l_returnflag from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, l_shipdate, l_returnflag) = 1),
u as (select o_orderkey, o_orderstatus = 'O' and l_orderkey is not null as hit, case when l_returnflag = 'R' then 'declined' else 'accepted' end as after, o_orderstatus from orders left join a on l_orderkey = o_orderkey)
select 'table' as part, o_orderkey, case when hit then after else o_orderstatus end as o_orderstatus from u union all select 'affected', o_orderkey, after from u where hit
""",
    "accepted_count": "select s_suppkey, 3 + case when s_acctbal < 0 then 0 else (select count(*) from lineitem where l_suppkey = s_suppkey) end as accepted from supplier",
}
