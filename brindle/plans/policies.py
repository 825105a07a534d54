"""Access decisions and resolutions across tables; see ``lookups`` for the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import records as rc
from brindle.operators import networks as nw
from brindle.operators import policy as po
from brindle.plans.lookups import memberships
from brindle.sources.tables import table

#: fixed values: engines with the setting that names an index, and its default
ENGINES = (("FURNITURE", "index_name", "furniture_default"), ("BUILDING", "collection_prefix", "building_default"), ("MACHINERY", "collection_name", "machinery_default"))


def route_policy(spark, sf_dir):
    """Events as calls: event types are routes, what a user holds follows from its number."""
    of_type = lambda *types: F.col("event_type").isin(*types)
    wanted = F.when(of_type("purchase"), F.array(F.lit("pay"), F.lit("read"))).when(of_type("signup", "click"), F.array(F.lit("read"))).otherwise(F.array().cast("array<string>"))
    held = F.when(F.col("user_id") % 3 == 0, F.array(F.lit("read"))).otherwise(F.array(F.lit("write")))
    decision = po.route_decision(
        known=~of_type("view"), platform_only=of_type("signup"), needs_full=F.col("event_id") % 2 == 0, wanted=wanted,
        is_platform=F.col("user_id") % 2 == 0, full_access=F.col("user_id") % 5 == 0, held=held,
    )
    return table(spark, sf_dir, "events").select("event_id", decision.alias("decision"))


def ownership_or_role(spark, sf_dir):
    orders, users = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    role = F.when(F.col("o_orderpriority") == "1-URGENT", "owner").when(F.col("o_orderpriority") == "2-HIGH", "editor").otherwise("guest")
    decision = po.owner_or_role(
        is_key=F.col("o_orderkey") % 11 == 0, role=role, least="admin", is_admin=F.col("c_acctbal") < 0, found=F.col("o_orderstatus") != "P",
        creator=F.when(F.col("o_orderkey") % 2 == 0, F.col("c_name")), actor=F.col("c_name"),
    )
    return orders.join(users, orders["o_custkey"] == users["c_custkey"]).select("o_orderkey", decision.alias("decision"))


def kb_access(spark, sf_dir):
    """Documents that a caller may read: own ones, ones shared with its organisation, ones shared through an agent."""
    docs, labels, talks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), table(spark, sf_dir, "conversations")
    own = docs.where("source in ('src0', 'src1')").select("doc_id")
    shared = labels.where("quality = 1").select("doc_id")
    agent = talks.select(F.col("conv_id").alias("doc_id")).distinct()
    return po.best_grants([("own", own), ("organisation", shared), ("agent", agent)], ["doc_id"])


def ssrf_hosts(spark, sf_dir):
    """The pages' addresses with made-up ones beside them, judged before names are resolved."""
    made = "'http://10.1.2.3/a', 'http://10.2.0.1/', 'https://2130706433/', 'http://0x7f.0.0.1/', 'http://0177.0.0.1/', 'ftp://a.b/', '', 'http://localhost:80/', 'http://x.internal/', 'http://www.example.com', 'http://example.com/', 'https://good.net/x', 'http://1.2.3/', 'http://999.1.1.1/', 'http://[::1]/', 'http://[::ffff:10.1.0.1]:80/x', 'https://[2001:db8:7::5]/', 'https://[2001:DB8:8::5]/', 'http://[fe80::1%25eth0]/', 'http://[1::2::3]/', 'http://u:p@[2001:db8:7:ffff::]/'"
    extra = spark.sql(f"select posexplode(array({made})) as (page_id, url)").select((-F.col("page_id") - 1).cast("bigint").alias("page_id"), "url")
    pages = table(spark, sf_dir, "pages").select("page_id", "url").unionByName(extra)
    decision = po.url_decision(F.col("url"), allowed=["*.example.com", "10.1.0.0/16", "2001:db8:7::/48", "bad/cidr", " "], restricted={"localhost"}, suffixes=(".internal", ".local"))
    return pages.select("page_id", decision.alias("decision"))


def address_networks(spark, sf_dir):
    """Customers' addresses of both versions, each with the longest of the nations' networks that holds it."""
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    part = lambda at: F.lower(F.hex(F.shiftright(k, at).bitwiseAND(0xFFFF)))  # noqa: E731  (a group holds 16 bits of a key)
    six = F.concat(F.lit("2001:db8:"), F.lower(F.hex(k % 32)), F.lit("::"), F.concat_ws(":", *[part(at) for at in (48, 32, 16, 0)]))
    four = F.format_string("10.%d.%d.%d", k % 4, k % 16, k % 256)
    addresses = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 2 == 0, four).when(k % 5 == 0, F.concat(F.lit("::ffff:"), four)).otherwise(six).alias("address"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    texts = F.array(F.format_string("10.%d.%d.7/24", n % 4, n % 8), F.format_string("10.%d.0.0/16", n % 3), F.concat(F.lit("2001:DB8:"), F.hex(n), F.lit("::/48")), F.lit("2001:db8::/36"))
    nets = nations.select("n_nationkey", F.explode(texts).alias("net"))
    return nw.longest_prefix(addresses, "address", nets, "net", ["n_nationkey"]).select("c_custkey", "n_nationkey", "prefix")


def _stores(spark, sf_dir):
    """Customers as stores: market segments are engines, JSON configs follow from the key."""
    key = F.col("c_custkey")
    config = F.when(key % 4 == 0, F.format_string('{"addr": "h%d", "database": "d%d"}', key % 3, key % 2)).when(key % 4 == 1, F.format_string('{"host": "h%d", "port": %d}', key % 3, key % 2 + 9000))
    config = config.when(key % 4 == 2, F.when(key % 3 == 0, '{"host": "h"}').otherwise('{"addr": "h1", "database": ""}')).otherwise(F.when(key % 3 == 0, '{"use_default_connection": true}').otherwise("{}"))
    index = F.when(key % 2 == 0, F.format_string('{"index_name": "i%d", "collection_prefix": "p%d"}', key % 2, key % 3)).otherwise('{"index_name": ""}')
    defaults = spark.createDataFrame(list(ENGINES), "engine string, field string, fallback string")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("engine"), F.col("c_nationkey").alias("tenant"), config.alias("config"), index.alias("index"))
    rows = rows.join(F.broadcast(defaults), "engine", "left")
    named = F.try_element_at(F.from_json("index", "map<string, string>"), F.coalesce("field", F.lit("index_name")))
    return rows.select("c_custkey", "tenant", "engine", rc.endpoint_key(F.col("config")).alias("endpoint"), F.coalesce(F.nullif(named, F.lit("")), "fallback", F.lit("")).alias("index_name"))


def store_keys(spark, sf_dir):
    """Each store's normalised endpoint and effective index name."""
    return _stores(spark, sf_dir)


def duplicate_stores(spark, sf_dir):
    """Stores for which the same tenant has another one with equal engine, endpoint and index: a count per computed key."""
    rows, keys = _stores(spark, sf_dir), ["tenant", "engine", "endpoint", "index_name"]
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(twice, keys, "left_semi").select("c_custkey", "endpoint", "index_name")


def provider_status(spark, sf_dir):
    """Every supported provider, whether it is allowed and whether it is available, in the order of the registry."""
    registry = spark.sql("select posexplode(array('local', 'NATION_1', 'NATION_2', 'NATION_3', 'NATION_4')) as (pos, name)")
    allowed = F.transform(F.split(F.lit("nation_1; NATION_3|local\n"), r"[,;|\n\t ]+"), F.lower)
    configured = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name")).distinct()
    out = registry.join(configured.withColumn("_held", F.lit(True)), "name", "left")
    return out.select("pos", "name", F.array_contains(allowed, F.lower("name")).alias("allowed"), (F.col("_held").isNotNull() | (F.col("name") == "local")).alias("available"))


def log_recheck(spark, sf_dir):
    """Logs that belong to a source of the asked tenant; others read as if they weren't there."""
    logs, sources = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").where("s_nationkey < 12")
    return logs.join(sources, logs["l_suppkey"] == sources["s_suppkey"], "left_semi").where("l_linenumber = 1").select("l_orderkey", "l_suppkey")


def backend_resolution(spark, sf_dir):
    """The backend that a request means: its id, else its provider's oldest alias, else the tenant's default. Inactive
    or unknown ones are errors, but an alias is taken as it is."""
    orders, users, suppliers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    key = F.col("o_orderkey")
    asked = orders.select("o_orderkey", "o_custkey", F.when(key % 3 == 0, key % 13).alias("asked_id"), F.when(key % 2 == 0, F.pmod(key, F.lit(40)).cast("int")).alias("provider"))
    alias = suppliers.groupBy(F.col("s_nationkey").alias("provider")).agg(F.min("s_suppkey").alias("alias_id"))
    default = users.select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 17).alias("default_id"))
    rows = asked.join(alias, "provider", "left").join(default, "o_custkey", "left")
    by_alias = F.col("asked_id").isNull() & F.col("alias_id").isNotNull()
    rows = rows.withColumn("backend", F.coalesce("asked_id", "alias_id", "default_id")).withColumn("by_alias", by_alias)
    state = suppliers.select(F.col("s_suppkey").alias("backend"), (F.col("s_acctbal") >= 0).alias("active"))
    outcome = (
        F.when(F.col("backend").isNull(), "none").when(F.col("by_alias"), "ok").when(F.col("active").isNull(), "not_found")
        .when(~F.col("active"), "not_active").otherwise("ok")
    )
    return rows.join(state, "backend", "left").select("o_orderkey", "backend", outcome.alias("outcome"))


def role_gate(spark, sf_dir):
    """Live members of each tenant who may do what an editor may; unknown roles rank lowest."""
    role = F.when(F.col("o_orderpriority") == "1-URGENT", "owner").when(F.col("o_orderpriority") == "2-HIGH", "editor").when(F.col("o_orderpriority") == "3-MEDIUM", "viewer").otherwise("?")
    rows = memberships(spark, sf_dir).where("deleted_at is null").withColumn("level", po.level(role))
    return rows.where(F.col("level") >= po.ROLES["editor"]).select("o_orderkey", "o_custkey", "level")


QUERIES = {f.__name__: f for f in (
    route_policy, ownership_or_role, kb_access, ssrf_hosts, address_networks, store_keys, duplicate_stores, provider_status, log_recheck, backend_resolution, role_gate,
)}
_STORES = """
with s as (
  select c_custkey, c_mktsegment as engine, c_nationkey as tenant,
    case c_custkey % 4 when 0 then 'h' || c_custkey % 3 || '/d' || c_custkey % 2 when 1 then 'h' || c_custkey % 3 || ':' || (c_custkey % 2 + 9000)
      when 2 then case when c_custkey % 3 = 0 then 'h:6334' else 'h1' end else case when c_custkey % 3 = 0 then '__default_postgres__' else '' end end as endpoint,
    case c_mktsegment when 'BUILDING' then case when c_custkey % 2 = 0 then 'p' || c_custkey % 3 else 'building_default' end
      when 'MACHINERY' then 'machinery_default' when 'FURNITURE' then case when c_custkey % 2 = 0 then 'i0' else 'furniture_default' end
      else case when c_custkey % 2 = 0 then 'i0' else '' end end as index_name
  from customer)
"""
SQL = {
    "route_policy": """
select event_id, case when event_type = 'view' then 'denied:route' when event_type = 'signup' and user_id % 2 <> 0 then 'denied:platform_only' when user_id % 5 = 0 then 'allowed'
  when event_type in ('purchase', 'signup', 'click') then case when user_id % 3 = 0 then 'allowed' else 'denied:scope' end
  when event_id % 2 <> 0 then 'allowed' else 'denied:scope' end as decision from events
""",
    "ownership_or_role": """
select o_orderkey, case when o_orderkey % 11 = 0 then 'key' when o_orderpriority = '1-URGENT' then 'role' when c_acctbal < 0 then 'admin' when o_orderstatus = 'P' then 'missing'
  when o_orderkey % 2 = 0 then 'owner' else 'denied' end as decision from orders join customer on c_custkey = o_custkey
""",
    "kb_access": """
select doc_id, case min(r) when 0 then 'own' when 1 then 'organisation' else 'agent' end as granted_by from (
  select doc_id, 0 as r from documents where source in ('src0', 'src1') union all select doc_id, 1 from labels where quality = 1 union all select conv_id, 2 from conversations) group by 1
""",
    "ssrf_hosts": """
select page_id, case when split_part(split_part(url, '://', 2), '/', 1) like '%.example.com' or split_part(split_part(url, '://', 2), '/', 1) = 'example.com' then 'allowed' else 'to_resolve' end as decision from pages
union all select * from (values (-1, 'allowed'), (-2, 'address'), (-3, 'disguised_address'), (-4, 'disguised_address'), (-5, 'disguised_address'), (-6, 'scheme'), (-7, 'empty'),
  (-8, 'restricted'), (-9, 'restricted_suffix'), (-10, 'allowed'), (-11, 'allowed'), (-12, 'to_resolve'), (-13, 'to_resolve'), (-14, 'to_resolve'),
  (-15, 'address'), (-16, 'address'), (-17, 'allowed'), (-18, 'address'), (-19, 'address'), (-20, 'to_resolve'), (-21, 'allowed'))
""",
    "address_networks": """
with f as (select n_nationkey as n, n_nationkey % 4 as a, n_nationkey % 8 as b from nation),
m as (select c_custkey, c_custkey as k, case when c_custkey % 2 = 0 then 4 when c_custkey % 5 = 0 then 0 else 6 end as v from customer),
r as (select m.*, (select min(n) from f where v = 4 and a = k % 4 and b = k % 16) as n24, (select min(n) from f where v = 4 and n % 3 = k % 4) as n16,
        (select min(n) from f where v = 6 and n = k % 32) as n48 from m)
select c_custkey, case when v = 4 then coalesce(n24, n16) when v = 6 then coalesce(n48, 0) end::bigint as n_nationkey,
  case when n24 is not null then 24 when n16 is not null then 16 when n48 is not null then 48 when v = 6 then 36 end::int as prefix from r
""",
    "store_keys": _STORES + "select c_custkey, tenant, engine, endpoint, index_name from s",
    "duplicate_stores": _STORES + "select c_custkey, endpoint, index_name from s qualify count(*) over (partition by tenant, engine, endpoint, index_name) > 1",
    "provider_status": """
select pos::int as pos, name, name in ('local', 'NATION_1', 'NATION_3') as allowed, name = 'local' or name in (select n_name from nation join supplier on s_nationkey = n_nationkey) as available
from (values (0, 'local'), (1, 'NATION_1'), (2, 'NATION_2'), (3, 'NATION_3'), (4, 'NATION_4')) r(pos, name)
""",
    "log_recheck": "select l_orderkey, l_suppkey from lineitem where l_linenumber = 1 and l_suppkey in (select s_suppkey from supplier where s_nationkey < 12)",
    "backend_resolution": """
with a as (select s_nationkey, min(s_suppkey) as alias_id from supplier group by 1),
r as (select o_orderkey, case when o_orderkey % 3 = 0 then o_orderkey % 13 end as asked, alias_id, case when o_custkey % 4 <> 0 then o_custkey % 17 end as fallback
      from orders left join a on o_orderkey % 2 = 0 and s_nationkey = o_orderkey % 40)
select o_orderkey, coalesce(asked, alias_id, fallback) as backend,
  case when coalesce(asked, alias_id, fallback) is null then 'none' when asked is null and alias_id is not null then 'ok' when s_suppkey is null then 'not_found' when s_acctbal < 0 then 'not_active' else 'ok' end as outcome
from r left join supplier on s_suppkey = coalesce(asked, alias_id, fallback)
""",
    "role_gate": "select o_orderkey, o_custkey, case o_orderpriority when '1-URGENT' then 40 else 20 end as level from orders where o_orderstatus <> 'P' and o_orderpriority < '3'",
}
