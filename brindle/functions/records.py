"""What leaves a table: dropped columns, masked and merged secrets, parsed settings, keys of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import blank, strip

MASK = "***"
#: fixed values: header names that carry credentials
AUTH_HEADERS = ("authorization", "cookie", "proxy-authorization")
#: fixed values: words in connection errors, by class, in the order in which they are looked for
ERROR_WORDS = (
    ("unauthorized", ("401", "unauthorized")), ("forbidden", ("403", "forbidden")), ("not_found", ("404", "not found")),
    ("timeout", ("timeout", "context deadline exceeded")), ("unreachable", ("connection refused", "no such host", "dial tcp", "connect")),
)


def without(df: DataFrame, hidden: set[str]) -> DataFrame:
    """All columns but the hidden ones, which have to exist: a misspelt name must not let a secret out."""
    if unknown := hidden - set(df.columns):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    return df.drop(*hidden)


def redacted_headers(headers: Column) -> Column:
    """A JSON object of headers as a map: credentials masked whatever their case, empty ones left empty, values that aren't
    strings dropped. Text that is no JSON object gives NULL."""
    values = F.from_json(headers, "map<string, variant>")
    strings = F.map_filter(values, lambda k, v: F.schema_of_variant(v) == "STRING")
    plain = F.transform_values(strings, lambda k, v: F.variant_get(v, "$", "string"))
    return F.transform_values(plain, lambda k, v: F.when(F.lower(k).isin(*AUTH_HEADERS) & (v != ""), MASK).otherwise(v))


def presence(env: Column) -> Column:
    """Names of a JSON object that are set, each with the mask for a value."""
    return F.transform_values(F.map_filter(F.from_json(env, "map<string, variant>"), lambda k, v: k != ""), lambda k, v: F.lit(MASK))


def merged_secret(incoming: Column, stored: Column) -> Column:
    """The stored secret where the incoming one is missing, blank or the mask; else the incoming one."""
    return F.when(incoming.isNull() | incoming.isin("", MASK), stored).otherwise(incoming)


def partial(df: DataFrame, given: dict[str, Column]) -> DataFrame:
    """Columns replaced where the given value isn't NULL."""
    return df.withColumns({c: F.coalesce(v, F.col(c)) for c, v in given.items()})


def surfaced(settings: Column, credentials: Column) -> Column:
    """A setting that may still stand among the credentials: those are used, untrimmed, only where the setting is blank."""
    return F.when(~blank(settings), settings).when(~blank(credentials), credentials).otherwise(settings)


def place_key(provider: Column, mode: Column, endpoint: Column, region: Column, bucket: Column, prefix: Column) -> Column:
    """What tells storage places apart: trimmed parts joined by bars, NULL as empty, credentials left out."""
    mode = F.when((provider == "minio") & blank(mode), "remote").otherwise(strip(mode))
    parts = [provider, mode, strip(endpoint), strip(region), strip(bucket), F.regexp_replace(strip(prefix), "^/+|/+$", "")]
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def safe_prefix(prefix: Column) -> Column:
    """Whether a path is relative and never climbs above where it starts. Each part moves the depth by one; the lowest
    depth on the way decides."""
    path = F.replace(F.coalesce(strip(prefix), F.lit("")), F.lit("\\"), F.lit("/"))
    steps = F.transform(F.split(path, "/"), lambda p: F.when(p.isin("", "."), 0).when(p == "..", -1).otherwise(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))
    walked = F.aggregate(steps, start, lambda s, x: F.struct((s["depth"] + x).alias("depth"), F.least(s["low"], s["depth"] + x).alias("low")))
    return ~path.startswith("/") & (walked["low"] >= 0)


def route_path(path: Column) -> Column:
    """Doubled slashes collapsed, the last one cut off unless it is all there is."""
    once = F.regexp_replace(F.coalesce(path, F.lit("")), "/+", "/")
    return F.when(F.length(once) > 1, F.regexp_replace(once, "/$", "")).otherwise(once)


def endpoint_key(config: Column) -> Column:
    """The place that a JSON connection config points at: address and database, or host and port, or the default one."""
    text = lambda name: F.nullif(F.get_json_object(config, f"$.{name}"), F.lit(""))
    addr = F.when(text("database").isNotNull(), F.concat_ws("/", text("addr"), text("database"))).otherwise(text("addr"))
    host = F.concat_ws(":", text("host"), F.coalesce(text("port").try_cast("int"), F.lit(6334)).cast("string"))
    default = F.when(F.get_json_object(config, "$.use_default_connection") == "true", "__default_postgres__").otherwise("")
    return F.when(text("addr").isNotNull(), addr).when(text("host").isNotNull(), host).otherwise(default)


def url_base64(data: Column) -> Column:
    """base64 with the URL alphabet and no padding."""
    return F.rtrim(F.translate(F.base64(data), "+/\r\n", "-_"), F.lit("="))


def percent_encoded(c: Column) -> Column:
    """All but letters, digits and ``-_.~`` percent-encoded; form encoding differs in three characters."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def signing_text(params: dict[str, Column]) -> Column:
    """``name=value`` pairs, percent-encoded, sorted by name and joined by ``&``."""
    return F.concat_ws("&", *[F.concat(percent_encoded(F.lit(k)), F.lit("="), percent_encoded(params[k])) for k in sorted(params)])


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC of one key as an expression: the padded keys are literals, so it needs no Python in the tasks."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def sealed(text: Column, key: bytes) -> Column:
    """AES-GCM with a random nonce behind a version mark; empty and sealed values stay as they are."""
    done = F.concat(F.lit("enc:v1:"), url_base64(F.aes_encrypt(text.cast("binary"), F.lit(key), F.lit("GCM"))))
    return F.when((text == "") | text.startswith("enc:v1:"), text).otherwise(done)


def opened(stored: Column, key: bytes) -> Column:
    """(text, ok) of a sealed value; unsealed ones pass, what can't be opened becomes empty and not ok."""
    packed = F.translate(F.substring(stored, F.lit(8), F.length(stored)), "-_", "+/")
    data = F.try_to_binary(F.rpad(packed, F.ceil(F.length(packed) / 4).cast("int") * 4, F.lit("=")), F.lit("base64"))
    text = F.try_aes_decrypt(data, F.lit(key), F.lit("GCM")).cast("string")
    is_sealed = stored.startswith("enc:v1:")
    return F.struct(F.when(is_sealed, F.coalesce(text, F.lit(""))).otherwise(stored).alias("text"), (~is_sealed | text.isNotNull()).alias("ok"))


def error_class(detail: Column) -> Column:
    """A connection error's class by the first of an ordered list of word tests."""
    low = F.lower(detail)
    has = lambda *words: F.greatest(*[low.contains(w) for w in words], F.lit(False))
    out = None
    for name, words in ERROR_WORDS:
        out = F.when(has(*words), name) if out is None else out.when(has(*words), name)
    return out.otherwise("other")


def setting(stored: Column, env: Column, default: Column, kind: str) -> Column:
    """A typed setting: stored over environment over default. A stored value of the wrong type gives the default, not the
    environment's; a boolean is no number; lists are split at commas, trimmed, without blanks."""
    raw = F.coalesce(stored, env)
    if kind == "int":
        return F.when(raw.isNull(), default).otherwise(F.coalesce(strip(raw).try_cast("int"), default))
    if kind == "bool":
        return F.when(raw.isNull(), default).otherwise(F.lower(strip(raw)).isin("1", "true", "yes", "on"))
    if kind == "list":
        return F.when(raw.isNull(), default).otherwise(F.filter(F.transform(F.split(raw, ","), strip), lambda x: x != ""))
    return F.coalesce(raw, default)
