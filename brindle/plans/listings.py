"""Point lookups, orders and pages of the list endpoints; see ``lookups`` for the stand-ins.

NULL counts as the largest value, so it comes first in a descending list. Every list ends in a unique column, so pages never
overlap. ``pos`` is a row's place on its page.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import lookup as lk
from brindle.plans.lookups import memberships
from brindle.sources.tables import table

#: fixed values: columns that a scan may be ordered by
ORDERS = ("o_orderkey", "o_orderdate", "o_totalprice")


def pk_lookup(spark, sf_dir):
    return lk.by_key(memberships(spark, sf_dir), "o_orderkey", 7).select("o_orderkey", "o_custkey", "o_orderdate")


def first_match(spark, sf_dir):
    rows = lk.first_match(memberships(spark, sf_dir), {"o_orderpriority": "2-HIGH", "deleted_at": None}, lk.ordered("o_orderkey"))
    return rows.select("o_orderkey", "o_custkey")


def required_row(spark, sf_dir):
    rows = lk.first_match(table(spark, sf_dir, "customer"), {"c_mktsegment": "FURNITURE"}, lk.ordered("c_custkey"))
    return lk.or_fail(rows, "customer.not_found").select("c_custkey", "c_name")


def ordered_scan(spark, sf_dir):
    order = lk.allowed_order("o_totalprice desc", ORDERS, "o_orderkey")
    return lk.numbered(memberships(spark, sf_dir).orderBy(*order).offset(40).limit(100), order).select("pos", "o_orderkey", "o_totalprice")


def ids_in(spark, sf_dir):
    users = table(spark, sf_dir, "customer")
    return lk.by_keys(users, "c_custkey", [5, 3, 99_999_999, 5]).unionByName(lk.by_keys(users, "c_custkey", [])).select("c_custkey", "c_name")


def newest_first(spark, sf_dir):
    order = lk.ordered("o_orderdate desc", "o_orderkey desc")
    return lk.numbered(lk.offset_page(lk.live(memberships(spark, sf_dir)), order, 2, 25), order).select("pos", "o_orderkey", "o_orderdate")


def nulls_first(spark, sf_dir):
    """Newest deletion first: live rows, whose mark is NULL, stand before them."""
    order = lk.ordered("deleted_at desc", "o_orderkey desc")
    recent = memberships(spark, sf_dir).where("o_orderkey < 60")
    return lk.numbered(lk.offset_page(recent, order, 1, 50), order).select("pos", "o_orderkey", "deleted_at")


def oldest_first(spark, sf_dir):
    order = lk.ordered("deleted_at", "o_orderkey")
    recent = memberships(spark, sf_dir).where("o_orderkey < 60")
    return lk.numbered(lk.offset_page(recent, order, 1, 50), order).select("pos", "o_orderkey", "deleted_at")


def category_order(spark, sf_dir):
    order = lk.ordered("p_brand", "p_name", "p_partkey")
    return lk.numbered(lk.offset_page(table(spark, sf_dir, "part"), order, 1, 100), order).select("pos", "p_brand", "p_name", "p_partkey")


def codepoint_order(spark, sf_dir):
    """Sorted keys of each brand; the types are a bounded vocabulary."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


def registration_order(spark, sf_dir):
    """Suppliers listed in the order in which their regions were registered, then by key."""
    registry = spark.sql("select posexplode(array(3, 1, 4, 0, 2)) as (registered, n_regionkey)")
    nations = table(spark, sf_dir, "nation").join(F.broadcast(registry), "n_regionkey")
    order = lk.ordered("registered", "s_suppkey")
    suppliers = table(spark, sf_dir, "supplier")
    rows = suppliers.join(nations, suppliers["s_nationkey"] == nations["n_nationkey"])
    return lk.numbered(lk.offset_page(rows, order, 1, 40), order).select("pos", "s_suppkey", "n_regionkey")


def oldest_alias(spark, sf_dir):
    """Each user's oldest finished membership: an aggregate instead of one sort and limit per user."""
    aliases = memberships(spark, sf_dir).where("o_orderstatus = 'F'")
    return aliases.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("alias"))


def page_if_asked(spark, sf_dir):
    """A page where both numbers are given, all rows where one is missing."""
    users, order = table(spark, sf_dir, "customer"), lk.ordered("c_acctbal desc", "c_custkey")
    some = lk.page_if_asked(users, order, 2, 10).select(F.lit("page").alias("asked"), "c_custkey")
    return some.unionByName(lk.page_if_asked(users.where("c_custkey < 50"), order, 2, 0).select(F.lit("all").alias("asked"), "c_custkey"))


def invitation_page(spark, sf_dir):
    """Pending invitations of one inviter's segment, newest first; numbers out of range are clamped."""
    order = lk.ordered("o_orderdate desc", "o_orderkey desc")
    rows = memberships(spark, sf_dir).where("o_orderstatus = 'O' and o_orderpriority in ('1-URGENT', '2-HIGH')")
    return lk.numbered(lk.offset_page(rows, order, 0, 1000), order).select("pos", "o_orderkey", "o_orderdate")


def sync_log_page(spark, sf_dir):
    """One source's logs, latest first; numbers out of range are errors."""
    order = lk.ordered("l_shipdate desc", "l_orderkey", "l_linenumber")
    rows = lk.where_equal(table(spark, sf_dir, "lineitem"), {"l_suppkey": 3})
    return lk.numbered(lk.checked_page(rows, order, 50, 10), order).select("pos", "l_orderkey", "l_linenumber", "l_shipdate")


def first_items(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type = 'error'")
    order = lk.ordered("ts", "event_id")
    cut = lk.first_items(events, order, 30).select(F.lit("first").alias("taken"), "event_id")
    return cut.unionByName(lk.first_items(events, order, 0).select(F.lit("all").alias("taken"), "event_id"))


def page_with_total(spark, sf_dir):
    """A page and the count of all rows that it is a page of, as a scalar subquery."""
    rows = lk.live(memberships(spark, sf_dir)).where("o_orderpriority = '3-MEDIUM'")
    total = rows.agg(F.count("*").alias("n")).scalar()
    return lk.offset_page(rows, lk.ordered("o_orderdate", "o_orderkey"), 2, 20).select("o_orderkey", total.alias("total"))


def other_owner_count(spark, sf_dir):
    """Owners that would be left in each segment if one user went."""
    users = table(spark, sf_dir, "customer")
    rows = lk.live(memberships(spark, sf_dir)).where("o_orderpriority = '1-URGENT' and o_custkey != 7")
    return rows.join(users, rows["o_custkey"] == users["c_custkey"]).groupBy("c_mktsegment").agg(F.count_distinct("o_custkey").alias("owners"))


def optional_relation_count(spark, sf_dir):
    """References of each source from a table that isn't there yet."""
    held = lk.optional_rows(spark, "brindle_knowledge_bases", "s_suppkey bigint").groupBy("s_suppkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "supplier").join(held, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("references"))


def default_pointer(spark, sf_dir):
    return lk.where_equal(table(spark, sf_dir, "customer"), {"c_custkey": 11}).select("c_nationkey")


def membership_join_order(spark, sf_dir):
    """One user's tenants in the order in which they were joined; a missing tenant falls out."""
    joined = lk.live(memberships(spark, sf_dir)).where("o_custkey = 13").select("o_orderdate", "o_orderkey", F.pmod("o_totalprice", F.lit(30)).cast("int").alias("n_nationkey"))
    return lk.in_order(joined, table(spark, sf_dir, "nation"), "n_nationkey", ("o_orderdate", "o_orderkey")).select("o_orderkey", "n_name")


def empty_scope(spark, sf_dir):
    """A scope that is empty or NULL counts as no scope."""
    scope = F.when(F.col("o_orderstatus") == "F", "").when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").withColumn("scope", scope).where(F.coalesce("scope", F.lit("")) == "").select("o_orderkey", "o_orderstatus")


def provider_support(spark, sf_dir):
    """Types whose words hold the asked one; a blank question gives all of them."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("kinds"))
    asked = lambda kind: parts.where(F.array_contains("kinds", kind)) if kind else parts
    one = asked("widget").select(F.lit("widget").alias("asked"), "p_partkey")
    return one.unionByName(asked("").where("p_partkey < 20").select(F.lit("").alias("asked"), "p_partkey"))


def id_or_keyword(spark, sf_dir):
    """An id counts only above 0, a keyword only if it isn't blank; one or the other has to hold, nothing asked gives all."""
    users = table(spark, sf_dir, "customer")

    def found(name, number, keyword):
        asked = [F.col("c_custkey") == number] * (number > 0) + [F.col("c_name").contains(keyword)] * bool(keyword.strip())
        rows = users.where(asked[0] if len(asked) == 1 else asked[0] | asked[1]) if asked else users
        return rows.select(F.lit(name).alias("asked"), "c_custkey")

    return found("both", 7, "00012").unionByName(found("keyword", 0, "0001")).unionByName(found("id", 9, " ")).unionByName(found("none", -1, "").where("c_custkey < 30"))


def live_task(spark, sf_dir):
    """The first task of each user that is still active."""
    tasks = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return tasks.groupBy("user_id").agg(F.min_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("t")).select("user_id", "t.*")


def ttl_live(spark, sf_dir):
    """Cached entries that are still good: they end strictly after now."""
    ends = F.col("ts").cast("timestamp") + F.make_dt_interval(mins=F.lit(5))
    return table(spark, sf_dir, "events").where(ends > F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")


def key_expired(spark, sf_dir):
    """A key is rejected strictly after its end; one without an end never is."""
    ends = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))
    expired = F.coalesce(F.expr("timestamp_ntz'1997-06-01 00:00:00'") > ends, F.lit(False))
    return table(spark, sf_dir, "orders").select("o_orderkey", expired.alias("expired"))


def deep_page(spark, sf_dir):
    """The page of twenty lines in the middle of all of them, dearest first; only ranges of 5,000 rows that hold it are sorted."""
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber")
    return lk.deep_page(lines, ["l_extendedprice desc", "l_orderkey", "l_linenumber"], lines.count() // 2, 20, rows_a_range=5_000)


QUERIES = {f.__name__: f for f in (
    pk_lookup, first_match, required_row, ordered_scan, ids_in, newest_first, nulls_first, oldest_first, category_order, codepoint_order,
    registration_order, oldest_alias, page_if_asked, invitation_page, sync_log_page, first_items, page_with_total, other_owner_count,
    optional_relation_count, default_pointer, membership_join_order, empty_scope, provider_support, id_or_keyword, live_task, ttl_live, key_expired, deep_page,
)}
_MEMBERS = "(select *, case when o_orderstatus = 'P' then o_orderdate end as deleted_at from orders)"
SQL = {
    "deep_page": """
select l_extendedprice, l_orderkey, l_linenumber from (
  select l_extendedprice, l_orderkey, l_linenumber, row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber) as r, count(*) over () // 2 as h from lineitem)
where r > h and r <= h + 20
""",
    "pk_lookup": "select o_orderkey, o_custkey, o_orderdate from orders where o_orderkey = 7 and o_orderstatus <> 'P'",
    "first_match": "select o_orderkey, o_custkey from orders where o_orderkey = (select min(o_orderkey) from orders where o_orderpriority = '2-HIGH' and o_orderstatus <> 'P')",
    "required_row": "select c_custkey, c_name from customer where c_mktsegment = 'FURNITURE' order by c_custkey limit 1",
    "ordered_scan": "select (r - 40)::int as pos, o_orderkey, o_totalprice from (select *, row_number() over (order by o_totalprice desc, o_orderkey) as r from orders) where r between 41 and 140",
    "ids_in": "select c_custkey, c_name from customer where c_custkey = 3 or c_custkey = 5",
    "newest_first": "select (r - 25)::int as pos, o_orderkey, o_orderdate from (select *, row_number() over (order by o_orderdate desc, o_orderkey desc) as r from orders where o_orderstatus <> 'P') where r between 26 and 50",
    "nulls_first": f"select r::int as pos, o_orderkey, deleted_at from (select *, row_number() over (order by deleted_at is not null, deleted_at desc, o_orderkey desc) as r from {_MEMBERS} where o_orderkey < 60) where r <= 50",
    "oldest_first": f"select r::int as pos, o_orderkey, deleted_at from (select *, row_number() over (order by deleted_at is null, deleted_at, o_orderkey) as r from {_MEMBERS} where o_orderkey < 60) where r <= 50",
    "category_order": "select r::int as pos, p_brand, p_name, p_partkey from (select *, row_number() over (order by p_brand, p_name, p_partkey) as r from part) where r <= 100",
    "codepoint_order": "select p_brand, string_agg(p_type, ',' order by p_type) as types from (select distinct p_brand, p_type from part) group by 1",
    "registration_order": """
select r::int as pos, s_suppkey, n_regionkey from (
  select *, row_number() over (order by case n_regionkey when 3 then 0 when 1 then 1 when 4 then 2 when 0 then 3 else 4 end, s_suppkey) as r
  from supplier join nation on s_nationkey = n_nationkey) where r <= 40
""",
    "oldest_alias": "select o_custkey, o_orderkey as alias from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from orders where o_orderstatus = 'F') where r = 1",
    "page_if_asked": """
select 'page' as asked, c_custkey from (select *, row_number() over (order by c_acctbal desc, c_custkey) as r from customer) where r between 11 and 20
union all select 'all', c_custkey from customer where c_custkey < 50
""",
    "invitation_page": "select r::int as pos, o_orderkey, o_orderdate from (select *, row_number() over (order by o_orderdate desc, o_orderkey desc) as r from orders where o_orderstatus = 'O' and o_orderpriority < '3') where r <= 100",
    "sync_log_page": "select (r - 10)::int as pos, l_orderkey, l_linenumber, l_shipdate from (select *, row_number() over (order by l_shipdate desc, l_orderkey, l_linenumber) as r from lineitem where l_suppkey = 3) where r between 11 and 60",
    "first_items": """
select 'first' as taken, event_id from (select *, row_number() over (order by ts, event_id) as r from events where event_type = 'error') where r <= 30
union all select 'all', event_id from events where event_type = 'error'
""",
    "page_with_total": "select o_orderkey, n as total from (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as r, count(*) over () as n from orders where o_orderpriority = '3-MEDIUM' and o_orderstatus <> 'P') where r between 21 and 40",
    "other_owner_count": "select c_mktsegment, count(*) as owners from customer c where c_custkey <> 7 and exists (select 1 from orders where o_custkey = c.c_custkey and o_orderpriority = '1-URGENT' and o_orderstatus <> 'P') group by 1",
    "optional_relation_count": "select s_suppkey, 0::bigint as \"references\" from supplier",
    "default_pointer": "select c_nationkey from customer where c_custkey = 11",
    "membership_join_order": "select o_orderkey, n_name from orders join nation on n_nationkey = floor(o_totalprice - 30 * floor(o_totalprice / 30)) where o_custkey = 13 and o_orderstatus <> 'P' order by o_orderdate, o_orderkey",
    "empty_scope": "select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'O'",
    "provider_support": "select 'widget' as asked, p_partkey from part where ' ' || p_name || ' ' like '% widget %' union all select '', p_partkey from part where p_partkey < 20",
    "id_or_keyword": """
select 'both' as asked, c_custkey from customer where c_custkey = 7 or c_name like '%00012%' union all select 'keyword', c_custkey from customer where c_name like '%0001%'
union all select 'id', c_custkey from customer where c_custkey = 9 union all select 'none', c_custkey from customer where c_custkey < 30
""",
    "live_task": "select user_id, event_id, event_type from events where event_type in ('click', 'view') qualify row_number() over (partition by user_id order by ts, event_id) = 1",
    "ttl_live": "select event_id from events where ts > timestamp '2024-01-19 23:55:00'",
    "key_expired": "select o_orderkey, o_orderstatus <> 'O' and o_orderdate < timestamp '1997-06-01' as expired from orders",
}
