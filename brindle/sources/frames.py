"""Line-based feeds: server-sent events, progress lines and JSON-RPC lists as tables. Lines come from ``spark.read.text`` or
any other table; nothing is parsed row by row in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import strip


def sse_payload(line: Column) -> Column:
    """The payload of a ``data: `` line, NULL for other lines and empty ones."""
    return F.when(line.startswith("data: "), F.nullif(strip(F.substring(line, F.lit(7), F.length(line))), F.lit("")))


def sse_answers(lines: DataFrame, stream: str, pos: str, line: str) -> DataFrame:
    """(stream, id, result) of each answer: the first payload of a stream with its id. A payload that is no JSON is an error."""
    payload = lines.withColumn("_p", sse_payload(F.col(line))).where(F.col("_p").isNotNull())
    parsed = payload.withColumn("_j", F.parse_json("_p"))
    found = parsed.withColumn("id", F.try_variant_get("_j", "$.id", "string")).where(F.col("id").isNotNull())
    return found.groupBy(stream, "id").agg(F.min_by(F.to_json(F.try_variant_get("_j", "$.result", "variant")), pos).alias("result"))


def pull_progress(line: Column) -> Column:
    """(percent, message, error) of a progress line: done / total where both are positive whole numbers, else the status."""
    j = F.try_parse_json(line)
    text = lambda name: F.when(F.schema_of_variant(F.try_variant_get(j, f"$.{name}", "variant")) == "STRING", F.try_variant_get(j, f"$.{name}", "string"))
    number = lambda name: F.when(F.schema_of_variant(F.try_variant_get(j, f"$.{name}", "variant")) == "BIGINT", F.try_variant_get(j, f"$.{name}", "bigint"))
    done, total = number("completed"), number("total")
    known = F.coalesce((done > 0) & (total > 0), F.lit(False))
    percent = F.when(known, done / total * 100).otherwise(0.0)
    status = F.coalesce(text("status"), F.lit(""))
    message = F.when(known, F.format_string("loading: %.1f%% (%s)", F.bround(percent, 1), status)).otherwise(status)
    return F.struct(percent.alias("percent"), message.alias("message"), F.nullif(text("error"), F.lit("")).alias("error"))


def _entries(answers: DataFrame, body: str, name: str) -> DataFrame:
    items = F.from_json(F.get_json_object(body, f"$.{name}"), "array<variant>")
    return answers.withColumn("_e", F.explode(items)).where(F.startswith(F.schema_of_variant("_e"), F.lit("OBJECT")))


def _text(name: str) -> Column:
    at = F.try_variant_get("_e", f"$.{name}", "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.variant_get(at, "$", "string"))


def rpc_tools(answers: DataFrame, body: str) -> DataFrame:
    """The tools of JSON-RPC results: entries that are no objects or have no name are skipped, wrong types become NULL."""
    schema = F.try_variant_get("_e", "$.inputSchema", "variant")
    shape = F.when(F.startswith(F.schema_of_variant(schema), F.lit("OBJECT")), F.to_json(schema))
    out = _entries(answers, body, "tools").select(*answers.columns, _text("name").alias("name"), _text("description").alias("description"), shape.alias("input_schema"))
    return out.where(F.coalesce("name", F.lit("")) != "").drop(body)


def rpc_resources(answers: DataFrame, body: str) -> DataFrame:
    out = _entries(answers, body, "resources").select(*answers.columns, _text("uri").alias("uri"), _text("name").alias("name"), _text("mimeType").alias("mime_type"))
    return out.where(F.col("uri").isNotNull() & F.col("name").isNotNull()).drop(body)


def list_size(body: Column, path: str) -> Column:
    """Entries of a JSON list at a path, 0 where it is missing or something else."""
    return F.coalesce(F.size(F.from_json(F.get_json_object(body, path), "array<variant>")), F.lit(0)).cast("int")


def missing_field(kind: Column, credentials: Column, settings: Column, specs: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> Column:
    """The first required field that is missing or blank: credentials in the order of the kind's spec, then settings."""
    blank = lambda m, k: strip(F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))) == ""
    out = None
    for name, (keys, needed) in specs.items():
        fields = [(k, blank(credentials, k)) for k in keys] + [(k, blank(settings, k)) for k in needed]
        first = F.coalesce(*[F.when(is_blank, k) for k, is_blank in fields]) if fields else F.lit(None).cast("string")
        out = F.when(kind == name, first) if out is None else out.when(kind == name, first)
    return out
