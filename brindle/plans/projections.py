"""What list and detail endpoints show of a row, and the keys and codes made from it; see ``lookups`` for the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import records as rc
from brindle.plans.overview import source_overview
from brindle.sources.tables import table

KEY = b"0123456789abcdef0123456789abcdef"


def user_projection(spark, sf_dir):
    return rc.without(table(spark, sf_dir, "customer"), {"c_acctbal", "c_nationkey"})


def tenant_projection(spark, sf_dir):
    """Without its hidden columns, its JSON settings parsed."""
    rows = rc.without(table(spark, sf_dir, "events"), {"value", "user_id"})
    return rows.withColumn("k", F.from_json("props", "k bigint")["k"]).drop("props", "ts")


def store_projection(spark, sf_dir):
    """A store's config with its secrets masked; empty ones stay empty, so that set and unset can be told apart."""
    config = F.create_map(F.lit("name"), F.col("s_name"), F.lit("password"), F.when(F.col("s_acctbal") < 0, "").otherwise(F.col("s_name")), F.lit("api_key"), F.lit("k"))
    rows = table(spark, sf_dir, "supplier").withColumn("config", config)
    shown = F.transform_values("config", lambda k, v: F.when(k.isin("password", "api_key") & (v != ""), rc.MASK).otherwise(v))
    return rc.without(rows, {"s_acctbal", "s_nationkey"}).select("s_suppkey", F.to_json(shown).alias("config"))


def redact_headers(spark, sf_dir):
    token = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("Bearer "), F.col("event_id")))
    headers = F.to_json(F.struct(token.alias("AUTHORIZATION"), F.col("event_type").alias("X-Kind"), F.col("event_id").alias("X-Number"), F.lit("a=b").alias("Cookie")))
    headers = F.when(F.col("event_id") % 10 == 7, "not json").otherwise(headers)
    return table(spark, sf_dir, "events").select("event_id", F.to_json(rc.redacted_headers(headers)).alias("headers"))


def env_presence(spark, sf_dir):
    env = F.concat(F.lit('{"HOME": "/x", "": 1, "'), F.upper("event_type"), F.lit('": "'), F.col("event_id"), F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(rc.presence(env)).alias("env"))


def secret_merge(spark, sf_dir):
    incoming = F.when(F.col("c_custkey") % 4 == 0, rc.MASK).when(F.col("c_custkey") % 4 == 1, "").when(F.col("c_custkey") % 4 == 2, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", rc.merged_secret(incoming, F.col("c_name")).alias("secret"))


def partial_update(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return rc.partial(rows, {"p_name": F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")), "p_size": F.when(F.col("p_partkey") % 5 == 0, F.lit(0))})


def config_merge(spark, sf_dir):
    """Incoming settings with the credentials that are stored."""
    orders, users = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    stored = F.struct(F.col("c_mktsegment").alias("settings"), F.md5("c_name").alias("credentials"))
    incoming = F.struct(F.col("o_orderpriority").alias("settings"), F.lit(None).cast("string").alias("credentials"))
    rows = orders.join(users, orders["o_custkey"] == users["c_custkey"]).select("o_orderkey", stored.alias("old"), incoming.alias("new"))
    kept = F.col("new").withField("credentials", F.coalesce("new.credentials", "old.credentials"))
    return rows.select("o_orderkey", kept.alias("config")).select("o_orderkey", "config.settings", "config.credentials")


def feed_urls(spark, sf_dir):
    key = F.col("page_id")
    settings = F.when(key % 3 == 0, F.col("url")).when(key % 3 == 1, "  ")
    credentials = F.when(key % 2 == 0, F.concat(F.lit(" "), F.col("url"), F.lit(" "))).otherwise("\t")
    return table(spark, sf_dir, "pages").select("page_id", rc.surfaced(settings, credentials).alias("feed_urls"))


def data_source_view(spark, sf_dir):
    """A source as it is shown: total and latest log joined in, and whether credentials are configured instead of them."""
    shown = source_overview(spark, sf_dir)
    own = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") > 0).alias("credentials_configured"))
    return shown.join(own, "s_suppkey").select("s_suppkey", "s_name", "credentials_configured", "total_items", "latest_order")


def place_keys(spark, sf_dir):
    key = F.col("s_suppkey")
    provider = F.when(key % 2 == 0, "minio").otherwise("s3")
    mode = F.when(key % 3 == 0, " docker ").when(key % 3 == 1, " ")
    made = rc.place_key(provider, mode, F.concat(F.lit(" "), F.col("s_name")), F.lit(None).cast("string"), F.lit("bucket\t"), F.concat(F.lit("/p/"), key, F.lit("//")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", made.alias("place"))


def safe_prefixes(spark, sf_dir):
    prefix = F.element_at(F.array(*map(F.lit, ("a/b", "../x", "a/../../b", "/abs", "", "a/./b/..", "..", "a\\..\\..\\b", " c/.. "))), (F.col("c_custkey") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", rc.safe_prefix(prefix).alias("safe"))


def route_paths(spark, sf_dir):
    path = F.concat(F.lit("//api///"), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "//").otherwise(""))
    path = F.when(F.col("event_id") % 11 == 0, "/").when(F.col("event_id") % 11 == 1, "").otherwise(path)
    return table(spark, sf_dir, "events").select("event_id", rc.route_path(path).alias("path"))


def url_base64(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rc.url_base64(F.unhex(F.md5("text"))).alias("code"))


def signed_params(spark, sf_dir):
    made = rc.signing_text({"x-name": F.col("p_name"), "body": F.md5("p_type"), "note": F.concat(F.lit("ü*~ &"), F.col("p_brand"))})
    return table(spark, sf_dir, "part").select("p_partkey", F.md5(made).alias("signature"))


def hmac_states(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", rc.hmac_sha256(KEY, F.col("c_name")).alias("mac"))


def sealed_secrets(spark, sf_dir):
    """Sealed and opened again with the right key, and opened with a wrong one."""
    plain = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", rc.sealed(plain, KEY).alias("stored"))
    key = F.when(F.col("c_custkey") % 2 == 0, rc.opened(F.col("stored"), KEY)).otherwise(rc.opened(F.col("stored"), KEY[::-1]))
    return rows.select("c_custkey", F.col("stored").startswith("enc:v1:").alias("sealed"), key.alias("o")).select("c_custkey", "sealed", "o.text", "o.ok")


def error_classes(spark, sf_dir):
    details = ("HTTP 401", "Forbidden: 403", "model Not Found", "context deadline exceeded", "dial tcp: refused", "unauthorized, then timeout", "broken", "Connect")
    detail = F.element_at(F.array(*map(F.lit, details)), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", rc.error_class(detail).alias("kind"))


def layered_settings(spark, sf_dir):
    """Settings of each type by stored value, environment and default."""
    key = F.col("p_partkey")
    stored = F.when(key % 4 == 0, "17").when(key % 4 == 1, " true ").when(key % 4 == 2, "a, b,,c ")
    env = F.when(key % 3 == 0, "8")
    made = {kind: rc.setting(stored, env, default, kind) for kind, default in (("int", F.lit(5)), ("bool", F.lit(False)), ("text", F.lit("none")))}
    listed = F.array_join(rc.setting(stored, env, F.array(F.lit("x")), "list"), "|")
    return table(spark, sf_dir, "part").select("p_partkey", *[v.alias(f"as_{k}") for k, v in made.items()], listed.alias("as_list"))


def scope_and_timeout(spark, sf_dir):
    """A scope that isn't the platform's is the tenant's; timeouts stay within 1 and 60 seconds."""
    scope = F.when(F.lower(F.trim("event_type")) == "signup", "platform").otherwise("tenant")
    timeout = F.greatest(F.least(F.col("value").cast("bigint") - 100, F.lit(60)), F.lit(1))
    return table(spark, sf_dir, "events").select("event_id", scope.alias("scope"), timeout.alias("timeout"))


def subtree_ids(spark, sf_dir):
    """Ids of a document's parts, made of its own, a kind and a token."""
    made = F.concat_ws("#", F.concat(F.lit("doc"), F.col("conv_id")), F.lit("file"), F.col("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("child_id"), F.concat(F.lit("doc"), F.col("conv_id"), F.lit("#")).alias("prefix"))


def content_keys(spark, sf_dir):
    """One document of each content hash, the first; an aggregate, so copies never meet in one task."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def iso_times(spark, sf_dir):
    """ISO times parsed, bad ones NULL, with the end of a seven-day invitation."""
    raw = F.when(F.col("o_orderkey") % 7 == 0, "someday").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    at = raw.try_cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select("o_orderkey", at.alias("at"), (at + F.expr("interval 7 days")).alias("expires_at"))


def dirty_columns(spark, sf_dir):
    """Columns that an update may write: all but those that never change."""
    names = table(spark, sf_dir, "part").columns
    all_of, fixed = (F.array(*map(F.lit, x)) for x in (names, ["p_partkey", "p_brand"]))
    return table(spark, sf_dir, "part").where("p_partkey < 50").select("p_partkey", F.array_join(F.array_except(all_of, fixed), ",").alias("columns"))


def first_addresses(spark, sf_dir):
    """Addresses of each host without repeats, in the order in which they were seen."""
    parts = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_distinct(F.concat(parts, F.array("p_type"), parts)), ",").alias("addresses"))


QUERIES = {f.__name__: f for f in (
    user_projection, tenant_projection, store_projection, redact_headers, env_presence, secret_merge, partial_update, config_merge, feed_urls,
    data_source_view, place_keys, safe_prefixes, route_paths, url_base64, signed_params, hmac_states, sealed_secrets, error_classes,
    layered_settings, scope_and_timeout, subtree_ids, content_keys, iso_times, dirty_columns, first_addresses,
)}


def _pad(byte: int) -> str:
    return "from_hex('" + bytes(b ^ byte for b in KEY.ljust(64, b"\0")).hex() + "')"


SQL = {
    "user_projection": "select c_custkey, c_name, c_mktsegment from customer",
    "tenant_projection": "select event_id, event_type, (props::json ->> 'k')::bigint as k from events",
    "store_projection": """select s_suppkey, '{"name":"' || s_name || '","password":"' || case when s_acctbal < 0 then '' else '***' end || '","api_key":"***"}' as config from supplier""",
    "redact_headers": """select event_id, case when event_id % 10 <> 7 then '{"AUTHORIZATION":"' || case when event_id % 3 = 0 then '' else '***' end || '","X-Kind":"' || event_type || '","Cookie":"***"}' end as headers from events""",
    "env_presence": """select event_id, '{"HOME":"***","' || upper(event_type) || '":"***"}' as env from events""",
    "secret_merge": "select c_custkey, case when c_custkey % 4 = 2 then c_mktsegment else c_name end as secret from customer",
    "partial_update": "select p_partkey, case when p_partkey % 3 = 0 then upper(p_name) else p_name end as p_name, case when p_partkey % 5 = 0 then 0 else p_size end as p_size from part",
    "config_merge": "select o_orderkey, o_orderpriority as settings, md5(c_name) as credentials from orders join customer on c_custkey = o_custkey",
    "feed_urls": "select page_id, case when page_id % 3 = 0 then url when page_id % 2 = 0 then ' ' || url || ' ' when page_id % 3 = 1 then '  ' end as feed_urls from pages",
    "data_source_view": """
with ranked as (select *, row_number() over (partition by l_suppkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) as r from lineitem),
total as (select l_suppkey, sum(case when l_returnflag in ('A', 'R') then cast(l_quantity as bigint) else 0 end)::bigint as total_items from lineitem group by 1)
select s_suppkey, s_name, s_acctbal > 0 as credentials_configured, coalesce(total_items, 0)::bigint as total_items, l_orderkey as latest_order
from supplier left join ranked on ranked.l_suppkey = s_suppkey and r = 1 left join total on total.l_suppkey = s_suppkey
""",
    "place_keys": """
select s_suppkey, case when s_suppkey % 2 = 0 then 'minio' else 's3' end || '|' || case when s_suppkey % 3 = 0 then 'docker' when s_suppkey % 2 = 0 then 'remote' else '' end
  || '|' || s_name || '||bucket|p/' || s_suppkey as place from supplier
""",
    "safe_prefixes": "select c_custkey, c_custkey % 9 in (0, 4, 5, 8) as safe from customer",
    "route_paths": "select event_id, case when event_id % 11 = 0 then '/' when event_id % 11 = 1 then '' else '/api/' || event_type end as path from events",
    "url_base64": "select doc_id, rtrim(replace(replace(to_base64(from_hex(md5(text))), '+', '-'), '/', '_'), '=') as code from documents",
    "signed_params": "select p_partkey, md5('body=' || md5(p_type) || '&note=' || url_encode('ü*~ &' || p_brand) || '&x-name=' || url_encode(p_name)) as signature from part",
    "hmac_states": f"select c_custkey, sha256({_pad(0x5C)} || from_hex(sha256({_pad(0x36)} || encode(c_name)))) as mac from customer",
    "sealed_secrets": "select c_custkey, c_custkey % 5 <> 0 as sealed, case when c_custkey % 5 <> 0 and c_custkey % 2 = 0 then c_name else '' end as text, c_custkey % 5 = 0 or c_custkey % 2 = 0 as ok from customer",
    "error_classes": "select event_id, ['unauthorized', 'forbidden', 'not_found', 'timeout', 'unreachable', 'unauthorized', 'other', 'unreachable'][event_id % 8 + 1] as kind from events",
    "layered_settings": """
select p_partkey, case p_partkey % 4 when 0 then 17 when 3 then case when p_partkey % 3 = 0 then 8 else 5 end else 5 end as as_int,
  p_partkey % 4 = 1 as as_bool, case p_partkey % 4 when 0 then '17' when 1 then ' true ' when 2 then 'a, b,,c ' else case when p_partkey % 3 = 0 then '8' else 'none' end end as as_text,
  case p_partkey % 4 when 0 then '17' when 1 then 'true' when 2 then 'a|b|c' else case when p_partkey % 3 = 0 then '8' else 'x' end end as as_list from part
""",
    "scope_and_timeout": "select event_id, case when event_type = 'signup' then 'platform' else 'tenant' end as scope, greatest(least(trunc(value)::bigint - 100, 60), 1)::bigint as timeout from events",
    "subtree_ids": "select conv_id, turn, 'doc' || conv_id || '#file#' || turn as child_id, 'doc' || conv_id || '#' as prefix from conversations",
    "content_keys": "select sha256(text) as content_hash, min(doc_id) as doc_id, count(*) as copies from documents group by text",
    "iso_times": "select o_orderkey, case when o_orderkey % 7 <> 0 then o_orderdate end as at, case when o_orderkey % 7 <> 0 then o_orderdate + interval 7 day end as expires_at from orders",
    "dirty_columns": "select p_partkey, 'p_name,p_type,p_size,p_retailprice' as columns from part where p_partkey < 50",
    "first_addresses": "select p_partkey, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda x: list_position(l, x[1]) = x[2]), lambda x: x[1]), ',') as addresses from (select p_partkey, string_split(p_name, ' ') || [p_type] as l from part)",
}
