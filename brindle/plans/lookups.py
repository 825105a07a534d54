"""Scans, filters, pages, joins, registries and set operations on the driver's tables.

Stand-ins: audit log = events, tenants and users = customer, memberships = orders, sources = supplier, sync logs =
lineitem, registries = nation and region, web hits = pages. An order is soft-deleted where its status is P.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.operators import lookup as lk
from brindle.sources.tables import table

#: fixed values: blacklist rules of a web search, one of them no valid pattern
BLACKLIST = ("*cheap-pills*", r"/^https?:\/\/blog\./", "/[/")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.withColumn("deleted_at", F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")))


def live_scan_eq(spark, sf_dir):
    rows = lk.where_equal(lk.live(memberships(spark, sf_dir)), {"o_orderpriority": "1-URGENT"})
    return rows.select("o_orderkey", "o_custkey", "o_orderdate")


def null_aware_lookup(spark, sf_dir):
    return lk.where_equal(memberships(spark, sf_dir), {"o_orderpriority": "5-LOW", "deleted_at": None}).select("o_orderkey", "o_custkey")


def optional_filters(spark, sf_dir):
    rows = lk.where_given(table(spark, sf_dir, "events"), {"event_type": "error", "user_id": None, "props": ""})
    return rows.select("event_id", "user_id", "value")


def keyset_page_events(spark, sf_dir):
    return lk.keyset_page(table(spark, sf_dir, "events"), "event_id", 700, 50).select("event_id", "ts", "event_type")


def offset_page_members(spark, sf_dir):
    users = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0)
    rows = lk.live(memberships(spark, sf_dir)).join(users, F.col("o_custkey") == F.col("c_custkey"))
    return lk.offset_page(rows, [F.asc("o_orderdate"), F.asc("o_orderkey")], 3, 20).select("o_orderkey", "c_name", "o_orderdate")


def count_live_members(spark, sf_dir):
    rows = lk.live(memberships(spark, sf_dir))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("members"), F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("owners"))


def search_or(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where((F.col("doc_id") == 7) | tx.holds(F.col("text"), "%")).select("doc_id", "lang")


def search_ci_join(spark, sf_dir):
    users = table(spark, sf_dir, "customer").where(tx.holds(F.col("c_name"), " CUSTOMER#00000000 ", fold=True) | tx.holds(F.col("c_mktsegment"), "auto", fold=True))
    rows = lk.live(memberships(spark, sf_dir))
    return rows.join(users, rows["o_custkey"] == users["c_custkey"]).select("o_orderkey", "o_custkey", "c_mktsegment")


def visibility_or(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.where((F.col("p_brand") == "Brand#11") | (F.col("p_size") == 1)).select("p_partkey", "p_brand", "p_size")


def blacklist_urls(spark, sf_dir):
    url = F.col("url")
    hit = F.lit(False)
    for pattern in filter(None, map(tx.glob_or_regex, BLACKLIST)):
        hit = hit | url.rlike(pattern)
    return table(spark, sf_dir, "pages").where(~hit).select("page_id", "url")


def url_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(tx.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


def role_levels(spark, sf_dir):
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in (("system", 40), ("assistant", 30), ("user", 10)) for x in pair]), F.col("role")), F.lit(0))
    return table(spark, sf_dir, "conversations").withColumn("level", level).select("conv_id", "turn", "level", (F.col("level") >= 30).alias("allowed"))


def registry_overlay(spark, sf_dir):
    """Each nation's setting: the smallest account balance of its suppliers if any is stored, else its region's number."""
    stored = table(spark, sf_dir, "supplier").where("s_nationkey % 3 = 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_acctbal").alias("setting"))
    registry = table(spark, sf_dir, "nation").withColumn("fallback", F.col("n_regionkey").cast("double"))
    return lk.overlay(registry, stored, "n_nationkey", "setting", "fallback").select("n_nationkey", "n_name", "setting")


def registry_merge_union(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    remote = nation.where("k >= 10").select((F.col("k") + 5).alias("k"), F.when(F.col("k") % 2 == 0, F.upper("name")).alias("name"))
    return lk.merged(nation.where("k < 20"), remote, "k", ["name"])


def batch_lookup_ordered(spark, sf_dir):
    ids = spark.sql("select posexplode(array(9L, 2L, 100000000L, 2L, 5L)) as (pos, c_custkey)")
    return lk.in_order(ids, table(spark, sf_dir, "customer"), "c_custkey").select("pos", "c_custkey", "c_name")


def mark_join(spark, sf_dir):
    return lk.marked(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "labelled")


def exists_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang")


def guard_anti(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return lk.unreferenced(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", labels.where("quality = 1").select("doc_id"), labels.where("toxic = 1").select("doc_id"))


def effective_role(spark, sf_dir):
    rows = lk.live(memberships(spark, sf_dir)).groupBy("o_custkey").agg(F.max("o_orderpriority").alias("r"))
    users = table(spark, sf_dir, "customer")
    return users.join(rows, users["c_custkey"] == rows["o_custkey"], "left").select("c_custkey", F.coalesce("r", F.lit("")).alias("role"))


def union_env_first(spark, sf_dir):
    virtual = spark.sql("select posexplode(filter(transform(split(' es, , qdrant,nope ', ','), x -> trim(x)), x -> x != '')) as (pos, name)")
    known = virtual.where(F.col("name").isin("es", "qdrant", "milvus")).select(F.lit(0).alias("rank"), F.col("pos").cast("bigint").alias("pos"), "name")
    stored = table(spark, sf_dir, "supplier").select(F.lit(1).alias("rank"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"))
    return known.unionByName(stored)


def set_except_distinct(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("user_id").subtract(events.where("value > 150").select("user_id"))


def canonical_intersect(spark, sf_dir):
    asked = tx.ordered_distinct(F.split("p_type", " "), lower=True)
    canonical = F.array(*map(F.lit, ("brass", "copper", "nickel", "steel", "tin", "economy", "promo")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_intersect(canonical, asked), ",").alias("kinds"))


def json_extract_key(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


def normalize_array(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.ordered_distinct(F.split("text", "[ ,;]"))).cast("bigint").alias("n"))


def hash_columns(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


def mask_map(spark, sf_dir):
    m = F.create_map(F.lit("user"), F.col("c_name"), F.lit("password"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.masked(m, ["password", "api_key"])["password"].alias("password"))


def typed_settings(spark, sf_dir):
    """Stored value over environment over default; what isn't a number falls to the default."""
    raw = F.when(F.col("p_size") % 5 == 0, "on").when(F.col("p_size") % 7 == 0, None).otherwise(F.col("p_size").cast("string"))
    value = F.when(raw.isNull(), F.lit(64)).otherwise(F.coalesce(raw.try_cast("int"), F.lit(10)))
    return table(spark, sf_dir, "part").select("p_partkey", value.alias("setting"), F.coalesce(F.lower(tx.strip(raw)).isin("1", "true", "yes", "on"), F.lit(False)).alias("truthy"))


QUERIES = {f.__name__: f for f in (
    live_scan_eq, null_aware_lookup, optional_filters, keyset_page_events, offset_page_members, count_live_members, search_or, search_ci_join,
    visibility_or, blacklist_urls, url_hosts, role_levels, registry_overlay, registry_merge_union, batch_lookup_ordered, mark_join, exists_semi,
    guard_anti, effective_role, union_env_first, set_except_distinct, canonical_intersect, json_extract_key, normalize_array, hash_columns, mask_map,
    typed_settings,
)}
SQL = {
    "live_scan_eq": "select o_orderkey, o_custkey, o_orderdate from orders where o_orderstatus <> 'P' and o_orderpriority = '1-URGENT'",
    "null_aware_lookup": "select o_orderkey, o_custkey from orders where not o_orderstatus = 'P' and o_orderpriority = '5-LOW'",
    "optional_filters": "select event_id, user_id, value from events where event_type = 'error'",
    "keyset_page_events": "select event_id, ts, event_type from events where event_id < 700 order by event_id desc limit 50",
    "offset_page_members": "select o_orderkey, c_name, o_orderdate from orders join customer on o_custkey = c_custkey where o_orderstatus <> 'P' and c_acctbal > 0 order by o_orderdate, o_orderkey limit 20 offset 40",
    "count_live_members": "select o_custkey, count(*) as members, count(*) filter (where o_orderpriority = '1-URGENT') as owners from orders where o_orderstatus <> 'P' group by 1",
    "search_or": r"select doc_id, lang from documents where doc_id = 7 or text like '%\%%' escape '\'",
    "search_ci_join": "select o_orderkey, o_custkey, c_mktsegment from orders join customer on o_custkey = c_custkey where o_orderstatus <> 'P' and (c_name ilike '%customer#00000000%' or c_mktsegment ilike '%auto%')",
    "visibility_or": "select p_partkey, p_brand, p_size from part where p_brand = 'Brand#11' or p_size = 1",
    "blacklist_urls": "select page_id, url from pages where url not like '%cheap-pills%' and not regexp_matches(url, '^https?://blog\\.')".replace("\\\\", "\\"),
    "url_hosts": "select lower(regexp_extract(url, '://([^/:?#]+)', 1)) as host, count(*) as pages from pages group by 1",
    "role_levels": "select conv_id, turn, case role when 'system' then 40 when 'assistant' then 30 when 'user' then 10 else 0 end as level, role in ('system', 'assistant') as allowed from conversations",
    "registry_overlay": "select n_nationkey, n_name, coalesce((select min(s_acctbal) from supplier where s_nationkey = n_nationkey and n_nationkey % 3 = 0), n_regionkey::double) as setting from nation",
    "registry_merge_union": """
with l as (select n_nationkey as k, n_name as name from nation where n_nationkey < 20),
r as (select n_nationkey + 5 as k, case when n_nationkey % 2 = 0 then upper(n_name) end as name from nation where n_nationkey >= 10)
select l.k, coalesce(r.name, l.name) as name, 'local' as origin from l left join r using (k)
union all select k, name, 'remote' from r where k not in (select k from l)
""",
    "batch_lookup_ordered": "select pos::int as pos, c_custkey, c_name from (values (0, 9), (1, 2), (2, 100000000), (3, 2), (4, 5)) ids(pos, id) join customer on c_custkey = id",
    "mark_join": "select doc_id, doc_id in (select doc_id from labels) as labelled from documents",
    "exists_semi": "select doc_id, lang from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and toxic = 1)",
    "guard_anti": "select doc_id from documents where doc_id not in (select doc_id from labels where quality = 1 or toxic = 1)",
    "effective_role": "select c_custkey, coalesce(max(o_orderpriority), '') as role from customer left join orders on o_custkey = c_custkey and o_orderstatus <> 'P' group by 1",
    "union_env_first": "select 0 as rank, 0::bigint as pos, 'es' as name union all select 0, 1, 'qdrant' union all select 1, s_suppkey, s_name from supplier",
    "set_except_distinct": "select user_id from events except select user_id from events where value > 150",
    "canonical_intersect": "select p_partkey, array_to_string(list_filter(['brass', 'copper', 'nickel', 'steel', 'tin', 'economy', 'promo'], lambda x: list_contains(string_split(lower(p_type), ' '), x)), ',') as kinds from part",
    "json_extract_key": "select (props::json ->> 'k')::bigint as k, count(*) as n from events group by 1",
    "normalize_array": r"select doc_id, len(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[ ,;]'), lambda x: trim(x, chr(9) || chr(10) || chr(13) || ' ')), lambda x: x <> '')))::bigint as n from documents",
    "hash_columns": "select doc_id, sha256(text) as sha, md5(text) as md5 from documents",
    "mask_map": "select c_custkey, case when c_acctbal < 0 then '' else '***' end as password from customer",
    "typed_settings": "select p_partkey, case when p_size % 5 = 0 then 10 when p_size % 7 = 0 then 64 else p_size end as setting, p_size % 5 = 0 or p_size = 1 as truthy from part",
}
