"""Connectors, their trees and feeds, and line-based answers; see ``lookups`` for the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import lookup as lk
from brindle.operators import sync
from brindle.sources import frames
from brindle.sources.tables import table

#: fixed values: required credentials and required settings of each kind of connector
CONNECTORS = {
    "feishu": (("app_id", "app_secret"), ()), "lark": (("app_id", "app_secret"), ()), "notion": (("api_key",), ()), "confluence": (("base_url", "email", "api_token"), ()),
    "yuque": (("token",), ()), "github": (("access_token",), ()), "google_drive": (("access_token",), ()), "onedrive": (("access_token",), ()),
    "dingtalk": (("app_key", "app_secret"), ()), "web_crawler": ((), ("sitemap_url",)), "slack": (("bot_token",), ()), "imap": (("host", "username", "password"), ()),
    "rss": ((), ("feed_urls",)),
}


def _tree(spark, sf_dir):
    """Regions, nations and suppliers as one tree of resources."""
    region, nation, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    top = region.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    middle = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return top.unionByName(middle).unionByName(supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.concat(F.lit("n"), "s_nationkey").alias("parent")))


def resource_level(spark, sf_dir):
    """One level of the tree, and whether each node on it has children."""
    tree = _tree(spark, sf_dir)
    return lk.marked(lk.where_equal(tree, {"parent": "r1"}), tree.select(F.col("parent").alias("node")).where("node is not null"), "node", "has_children").select("node", "has_children")


def resource_ancestors(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    asked = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 1").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return sync.tree_ancestors(tree, asked, "node", "parent")


def connector_catalogue(spark, sf_dir):
    """Kinds by priority, those with the same priority in the order of their registration, each with the sources of that kind
    and the documents that came from them."""
    rows = [(i, name, len(name) % 3) for i, name in enumerate(CONNECTORS)]
    kinds = spark.createDataFrame(rows, "registered int, kind string, priority int")
    by_source = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    number = F.regexp_extract("source", r"([0-9]+)$", 1).try_cast("int") % len(CONNECTORS)
    used = by_source.groupBy(number.alias("registered")).agg(F.count("*").alias("sources"), F.sum("n").alias("items"))
    every = kinds.join(used, "registered", "left").fillna(0, ["sources", "items"])
    order = lk.ordered("priority", "registered")
    return lk.numbered(every, order).select("pos", "kind", "priority", "sources", "items")


def credential_shape(spark, sf_dir):
    """Each source's first missing field."""
    key = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, CONNECTORS)), (key % len(CONNECTORS) + 1).cast("int"))
    given = F.when(key % 2 == 0, "x").otherwise(" \t")
    credentials = F.create_map(F.lit("app_id"), F.lit("a"), F.lit("host"), F.lit("h"), F.lit("username"), given, F.lit("api_key"), given, F.lit("token"), F.lit("t"), F.lit("base_url"), F.lit("u"), F.lit("email"), F.lit("e"))
    settings = F.create_map(F.lit("feed_urls"), given)
    return table(spark, sf_dir, "supplier").select("s_suppkey", kind.alias("kind"), frames.missing_field(kind, credentials, settings, CONNECTORS).alias("missing"))


def web_hits(spark, sf_dir):
    """Search hits: the first ones of the asked number, dates only if asked for."""
    pages = table(spark, sf_dir, "pages")
    dated = F.make_date(F.lit(2024), F.lit(1), (F.col("page_id") % 28 + 1).cast("int"))
    hits = pages.select(F.col("page_id"), "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), dated.alias("published_at"))
    order = lk.ordered("page_id")
    with_date = lk.numbered(lk.first_items(hits, order, 10), order).select(F.lit(True).alias("dates"), "pos", "url", "title", "published_at")
    without = lk.numbered(lk.first_items(hits, order, 5), order).select(F.lit(False).alias("dates"), "pos", "url", "title", F.lit(None).cast("date").alias("published_at"))
    return with_date.unionByName(without)


def sse_answers(spark, sf_dir):
    """Conversations as event streams: an event line, an empty payload and an answer for each turn; ids repeat."""
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    data = F.concat(F.lit('data: {"jsonrpc": "2.0", "id": "'), F.floor(F.col("turn") / 2), F.lit('", "result": {"n": '), F.col("n"), F.lit("}}  "))
    lines = talks.select("conv_id", F.posexplode(F.array(F.lit("event: message"), F.lit("data: "), data, F.lit(""))).alias("i", "line"), (F.col("turn") * 10).alias("at"))
    found = frames.sse_answers(lines.withColumn("pos", F.col("at") + F.col("i")), "conv_id", "pos", "line")
    return found.select("conv_id", "id", F.get_json_object("result", "$.n").cast("int").alias("n"))


def pull_progress(spark, sf_dir):
    key = F.col("event_id")
    line = F.when(key % 6 == 0, F.format_string('{"status": "pulling", "total": 400, "completed": %d}', key % 400 + 1)).when(key % 6 == 1, '{"status": "verifying"}')
    line = line.when(key % 6 == 2, '{"error": "disk full"}').when(key % 6 == 3, "not json").when(key % 6 == 4, '{"status": 5, "total": "7", "completed": 3}').otherwise('{"status": "x", "total": 0, "completed": 0}')
    return table(spark, sf_dir, "events").select("event_id", frames.pull_progress(line).alias("p")).select("event_id", F.round("p.percent", 4).alias("percent"), "p.message", "p.error")


def _bodies(spark, sf_dir):
    key = F.col("s_suppkey")
    tools = F.format_string('{"tools": [{"name": "t%d", "description": "d", "inputSchema": {"type": "object"}}, 5, {"name": ""}, {"name": 3}, {"name": "u", "description": 1, "inputSchema": []}], "resources": [{"uri": "file:/%d", "name": "r", "mimeType": 4}, {"uri": "x"}]}', key, key)
    body = F.when(key % 4 == 3, '{"tools": {}, "resources": 5}').otherwise(tools)
    return table(spark, sf_dir, "supplier").select("s_suppkey", body.alias("body"))


def rpc_tools(spark, sf_dir):
    return frames.rpc_tools(_bodies(spark, sf_dir), "body")


def rpc_resources(spark, sf_dir):
    return frames.rpc_resources(_bodies(spark, sf_dir), "body")


def probe_sizes(spark, sf_dir):
    """Sizes that test calls report: an embedding's dimension, a ranking's results."""
    body = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit('{"data": [{"embedding": '), F.to_json("embedding"), F.lit("}]}"))).when(F.col("vec_id") % 3 == 1, '{"data": [], "results": [1, {"a": 2}, null]}').otherwise("broken {")
    return table(spark, sf_dir, "embeddings").select("vec_id", frames.list_size(body, "$.data[0].embedding").alias("dimension"), frames.list_size(body, "$.results").alias("results"))


def run_plans(spark, sf_dir):
    """What kind of run each source has next, and its status after the last one."""
    key = F.col("s_suppkey")
    kind = sync.run_plan(force_full=key % 5 == 0, mode=F.when(key % 3 == 0, "full").otherwise("incremental"), cursor=F.when(key % 2 == 0, "c"))
    status = sync.source_status(F.when(key % 4 == 0, "failed").otherwise("partial"), F.when(key % 3 == 0, "paused").otherwise("error"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", kind.alias("run"), status.alias("status"))


def stale_children(spark, sf_dir):
    """Turns of conversations as children; of every third conversation only the first two turns are still there."""
    talks = table(spark, sf_dir, "conversations")
    child = F.concat(F.lit("c"), F.col("conv_id"), F.lit("#turn#"), F.col("turn"))
    stored = talks.select(child.alias("child"))
    keep = F.transform(F.array(F.lit(0), F.lit(1)), lambda t: F.concat(F.lit("c"), F.col("conv_id"), F.lit("#turn#"), t))
    feed = talks.where("conv_id % 3 < 2").select("conv_id").distinct().select(F.concat(F.lit("c"), "conv_id").alias("parent"), F.when(F.col("conv_id") % 3 == 0, keep).otherwise(F.array().cast("array<string>")).alias("keep"))
    return sync.stale_children(stored, feed, "child", "parent", "keep")


def conflict_merge(spark, sf_dir):
    """Feed items against stored ones, by each source's rule."""
    parts = table(spark, sf_dir, "part")
    current = parts.where("p_partkey % 3 <> 0").select("p_partkey", F.col("p_name").alias("value"))
    feed = parts.where("p_partkey % 2 = 0").select("p_partkey", F.upper("p_name").alias("value"), F.when(F.col("p_size") > 25, "overwrite").otherwise("skip").alias("rule"))
    return sync.merged_by_rule(current, feed, "p_partkey", "value", "rule")


def source_retention(spark, sf_dir):
    """Logs older than their own source's number of days go; 0 keeps all."""
    days = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.pmod("s_suppkey", F.lit(5)).alias("weeks"))
    logs = table(spark, sf_dir, "lineitem").join(days, "l_suppkey", "left")
    old = F.col("l_shipdate") < F.timestamp_add("WEEK", -F.col("weeks") * 40, F.lit("2000-01-01").cast("timestamp")).cast("timestamp_ntz")
    return logs.where((F.coalesce("weeks", F.lit(0)) == 0) | ~old).groupBy("l_suppkey").agg(F.count("*").alias("kept"))


def streamed_answers(spark, sf_dir):
    """Assistant turns in chunks of 40 code points, put together again."""
    talks = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    count = F.greatest(F.ceil(F.length("text") / 40).cast("int"), F.lit(1))
    chunks = talks.select("conv_id", "turn", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("text"), i * 40 + 1, F.lit(40)))).alias("seq", "chunk"), count.alias("n"))
    return sync.answers(chunks.withColumn("done", F.col("seq") == F.col("n") - 1), ["conv_id", "turn"], "seq", "chunk", "done")


QUERIES = {f.__name__: f for f in (
    resource_level, resource_ancestors, connector_catalogue, credential_shape, web_hits, sse_answers, pull_progress, rpc_tools, rpc_resources,
    probe_sizes, run_plans, stale_children, conflict_merge, source_retention, streamed_answers,
)}
_KINDS = ", ".join(f"({i}, '{k}', {len(k) % 3})" for i, k in enumerate(CONNECTORS))
SQL = {
    "resource_level": "select 'n' || n_nationkey as node, n_nationkey in (select s_nationkey from supplier) as has_children from nation where n_regionkey = 1",
    "resource_ancestors": """
select distinct unnest(['n' || n_nationkey, 'r' || n_regionkey]) as node from supplier join nation on n_nationkey = s_nationkey where s_suppkey % 4 = 1
""",
    "connector_catalogue": f"""
with u as (select try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % {len(CONNECTORS)} as registered, count(distinct source) as sources, count(*) as items from documents group by 1)
select row_number() over (order by priority, registered)::int as pos, kind, priority, coalesce(sources, 0) as sources, coalesce(items, 0)::bigint as items
from (values {_KINDS}) k(registered, kind, priority) left join u using (registered)
""",
    "credential_shape": f"""
select s_suppkey, kind, case kind when 'feishu' then 'app_secret' when 'lark' then 'app_secret' when 'notion' then case when s_suppkey % 2 = 1 then 'api_key' end
  when 'confluence' then 'api_token' when 'yuque' then null when 'github' then 'access_token' when 'google_drive' then 'access_token' when 'onedrive' then 'access_token'
  when 'dingtalk' then 'app_key' when 'web_crawler' then 'sitemap_url' when 'slack' then 'bot_token' when 'imap' then case when s_suppkey % 2 = 1 then 'username' else 'password' end
  when 'rss' then case when s_suppkey % 2 = 1 then 'feed_urls' end end as missing
from supplier join (values {_KINDS}) k(registered, kind, priority) on registered = s_suppkey % {len(CONNECTORS)}
""",
    "web_hits": """
with p as (select *, row_number() over (order by page_id)::int as pos, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, make_date(2024, 1, (page_id % 28 + 1)::int) as d from pages)
select true as dates, pos, url, title, d as published_at from p where pos <= 10 union all select false, pos, url, title, null from p where pos <= 5
""",
    "sse_answers": "select conv_id, (turn // 2)::varchar as id, length(text)::int as n from conversations qualify row_number() over (partition by conv_id, turn // 2 order by turn) = 1",
    "pull_progress": """
select event_id, case when event_id % 6 = 0 then round((event_id % 400 + 1) / 400.0::double * 100, 4) else 0 end as percent,
  case event_id % 6 when 0 then format('loading: {:.1f}% (pulling)', (event_id % 400 + 1) / 400.0::double * 100) when 1 then 'verifying' when 5 then 'x' else '' end as message,
  case when event_id % 6 = 2 then 'disk full' end as error from events
""",
    "rpc_tools": """
select s_suppkey, 't' || s_suppkey as name, 'd' as description, '{"type":"object"}' as input_schema from supplier where s_suppkey % 4 <> 3
union all select s_suppkey, 'u', null, null from supplier where s_suppkey % 4 <> 3
""",
    "rpc_resources": "select s_suppkey, 'file:/' || s_suppkey as uri, 'r' as name, null::varchar as mime_type from supplier where s_suppkey % 4 <> 3",
    "probe_sizes": "select vec_id, case when vec_id % 3 = 0 then len(embedding) else 0 end::int as dimension, case when vec_id % 3 = 1 then 3 else 0 end as results from embeddings",
    "run_plans": """
select s_suppkey, case when s_suppkey % 5 <> 0 and s_suppkey % 3 <> 0 and s_suppkey % 2 = 0 then 'incremental' else 'full' end as run,
  case when s_suppkey % 4 = 0 then 'error' when s_suppkey % 3 = 0 then 'paused' else 'active' end as status from supplier
""",
    "stale_children": "select 'c' || conv_id || '#turn#' || turn as child from conversations where conv_id % 3 = 1 or conv_id % 3 = 0 and turn > 1",
    "conflict_merge": """
select p_partkey, case when p_partkey % 3 = 0 or (p_partkey % 2 = 0 and p_size > 25) then upper(p_name) else p_name end as value from part where p_partkey % 3 <> 0 or p_partkey % 2 = 0
""",
    "source_retention": "select l_suppkey, count(*) as kept from lineitem where l_suppkey % 5 = 0 or l_shipdate >= timestamp '2000-01-01' - to_days((l_suppkey % 5 * 280)::int) group by 1",
    "streamed_answers": "select conv_id, turn, text as answer, true as finished from conversations where role = 'assistant'",
}
