"""Quality rules with host verdicts.

Per document: base counts and six rules. Per host: the share of documents that fail a rule, shrunk towards the
share of all hosts by a beta prior fitted to the hosts themselves (method of moments), so that a host with three
documents is not judged by three documents. The host's verdict joins back to its documents: on a rejected host a
document that fails any rule goes; one that fails none stays, wherever it is from. A base failure goes everywhere.

Defined results: a null or blank text has no words and so fails the base rules; a null host counts as the host ''.
Repeated rows count as often as they stand. No rows give no rows. Extra columns pass through untouched, also those
named like a result column: the result holds them as ``<name>_in``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import textbatch as tb
from brindle.llm.common import small, table, written
from brindle.llm.worker import tidy

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; ``host_rate`` is the shrunk failure share above which a host is rejected."""

    min_words: int = 50
    max_repeat_pct: int = 50
    max_symbol_pct: int = 10
    max_dup_line_pct: int = 30
    mean_word_tenths: tuple[int, int] = (25, 120)
    host_rate: float = 0.6


def _twice(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each entry: how many entries of the same row and value stand before it, 0, 1, ... in input order."""
    order = np.lexsort((values, rows))
    r, v = rows[order], values[order]
    head = np.r_[True, (r[1:] != r[:-1]) | (v[1:] != v[:-1])] if len(r) else np.zeros(0, bool)
    at = np.arange(len(r))
    rank = at - np.maximum.accumulate(np.where(head, at, 0))
    out = np.empty(len(r), np.int64)
    out[order] = rank
    return out


def count_slice(column: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of a slice of texts."""
    n = len(column)
    w = tb.words(column, lower=False)
    raw, ends = w.raw, w.ends_of_rows
    upto = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    lead = upto((raw & 0xC0) != 0x80)
    chars = np.zeros(n, np.int64)
    np.add.at(chars, w.row, lead[w.end] - lead[w.start])
    symbols = upto(_SYMBOL[raw])
    # lines: pieces between newlines, per text
    breaks = np.flatnonzero(raw == 10)
    has_text = np.flatnonzero(np.diff(ends) > 0)
    line_start = np.sort(np.concatenate([ends[has_text], breaks + 1]))
    line_end = np.sort(np.concatenate([ends[has_text + 1], breaks]))
    line_row = np.searchsorted(ends, np.minimum(line_end, len(raw)), side="left") - 1 if n else line_start
    # a line that ends where its text ends belongs to that text, an empty last line too
    line_row = np.where(line_end > line_start, np.searchsorted(ends, line_start, side="right") - 1, line_row)
    worded = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, line_start)
    ls, le, lr = line_start[worded], line_end[worded], line_row[worded]
    hashes = tb.substring_hashes(tb.prefix_hashes(raw, lower=False), ls, le)
    dup = np.bincount(lr[_twice(lr, hashes) > 0], minlength=n) if len(lr) else np.zeros(n, np.int64)
    lines = np.bincount(lr, minlength=n) if len(lr) else np.zeros(n, np.int64)
    # words inside three-word windows that occur twice or more in their text
    repeat = np.zeros(n, np.int64)
    if len(w.hash) >= 3:
        at = np.flatnonzero(w.row[:-2] == w.row[2:])
        keys = tb.mix(w.hash[at] * tb._SHINGLE_CODES[0] + w.hash[at + 1] * tb._SHINGLE_CODES[1] + w.hash[at + 2] * tb._SHINGLE_CODES[2])
        order = np.lexsort((keys, w.row[at]))
        k, r = keys[order], w.row[at][order]
        same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
        often = np.zeros(len(k), bool)
        often[1:] |= same
        often[:-1] |= same
        hit = at[order[often]]
        covered = np.zeros(len(w.hash), bool)
        for step in range(3):
            covered[hit + step] = True
        repeat = np.bincount(w.row[covered], minlength=n)
    return {"n_words": np.diff(w.first), "word_chars": chars, "n_symbols": symbols[ends[1:]] - symbols[ends[:-1]], "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": lines}


def _count_batches(text_at: int, keep_text: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tb.as_strings(batch.column(text_at))
            parts = [count_slice(texts.slice(a, b - a)) for a, b in tb.slices(texts)]
            if parts:
                keep = [c for i, c in enumerate(batch.columns) if keep_text or i != text_at]
                names = [c for i, c in enumerate(batch.schema.names) if keep_text or i != text_at]
                counts = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays(keep + counts, names=[*names, *COUNTS])

    return run


def text_counts(df: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``df`` with the base counts (see ``COUNTS``) and, unless asked for, without its text. Clashing columns become ``<name>_in``."""
    df = df.withColumnsRenamed({c: f"{c}_in" for c in df.columns if c in COUNTS and c != text_col})
    df = df.withColumn(text_col, df[text_col].cast("string"))
    fields = [f for f in df.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in COUNTS])
    return df.mapInArrow(_count_batches(df.columns.index(text_col), keep_text), schema)


def host_of(value):
    """The host of a URL, or the value itself where it is none; null becomes ''."""
    value = F.coalesce(value.cast("string"), F.lit(""))
    return F.lower(F.when(value.contains("://"), F.coalesce(F.try_parse_url(value, F.lit("HOST")), value)).otherwise(value))


def failures(rules: Rules) -> dict:
    """The rules as columns over the base counts: true where a document fails."""
    words, chars = F.col("n_words"), F.col("word_chars")
    low, high = rules.mean_word_tenths
    return {
        "few_words": words < rules.min_words,
        "repeats": 100 * F.col("n_repeat_words") > rules.max_repeat_pct * words,
        "symbols": 100 * F.col("n_symbols") > rules.max_symbol_pct * chars,
        "dup_lines": 100 * F.col("n_dup_lines") > rules.max_dup_line_pct * F.col("n_lines"),
        "short_words": 10 * chars < low * words,
        "long_words": 10 * chars > high * words,
    }


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, host_docs, host_failed, host_rate): failure shares shrunk by a beta prior with the hosts' own moments.

    ``judged`` has host and failed (boolean). The sums are pre-aggregated in each task, so a hot host costs one row a
    task. One row of sums over hosts reaches the driver: n hosts, documents, failures and the squares they need.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    m = hosts.agg(
        F.count("*").alias("hosts"), F.sum("host_docs").alias("docs"), F.sum("host_failed").alias("failed"),
        F.sum(F.col("host_docs") * rate * rate).alias("squares"), F.sum(F.col("host_docs").cast("double") * F.col("host_docs")).alias("docs2"),
    ).first()
    alpha, beta = beta_prior(m["hosts"], m["docs"] or 0, m["failed"] or 0, m["squares"] or 0.0, m["docs2"] or 0.0)
    return hosts.withColumn("host_rate", (F.col("host_failed") + F.lit(alpha)) / (F.col("host_docs") + F.lit(alpha + beta)))


def beta_prior(hosts: int, docs: int, failed: int, squares: float, docs2: float) -> tuple[float, float]:
    """Moment estimate of a beta-binomial prior from sums over hosts.

    With p the pooled share, S = sum n_i (r_i - p)^2 has expectation p(1-p) * ((k-1) + rho * (N - sum n_i^2/N - (k-1)));
    solved for rho, the prior's strength is 1/rho - 1. No spread beyond chance gives the strength of all documents.
    """
    if not docs or not hosts:
        return 1.0, 1.0
    p = min(max(failed / docs, 0.5 / docs), 1 - 0.5 / docs)
    spread = max(squares - docs * (failed / docs) ** 2, 0.0)
    room = docs - docs2 / docs - (hosts - 1)
    rho = (spread / (p * (1 - p)) - (hosts - 1)) / room if room > 0 else 0.0
    strength = min(1 / rho - 1, float(docs)) if rho > 0 else float(docs)
    strength = max(strength, 1e-6)
    return p * strength, (1 - p) * strength


def judge(df: DataFrame, *, text_col: str = "text", host_col: str = "source", rules: Rules | None = None, keep_text: bool = False) -> DataFrame:
    """Each row of ``df`` with counts, ``rules_failed`` (names), ``base_failed``, the host's shrunk rate and ``kept``.

    Hosts join back by broadcast when counted to be few, else by a shuffled join that Spark splits. Counts are written once
    for the rates; with ``keep_text`` the verdicts are made in a second pass over the texts, so that no text is ever
    written or shuffled here."""
    rules = rules or Rules()
    results = {"host", "rules_failed", "base_failed", "kept", "host_docs", "host_failed", "host_rate"}
    df = df.withColumnsRenamed({c: f"{c}_in" for c in df.columns if c in results and c not in (text_col, host_col)})
    df = df.withColumn("host", host_of(df[host_col]))
    tests = failures(rules)
    names = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())
    judged = text_counts(df.select("host", text_col) if keep_text else df, text_col).withColumn("rules_failed", names)
    judged = written(judged, "quality")
    hosts = host_rates(judged.select("host", (F.size("rules_failed") > 0).alias("failed")))
    if keep_text:
        judged = text_counts(df, text_col, keep_text=True).withColumn("rules_failed", names)
    base = F.array_contains("rules_failed", "few_words") | F.array_contains("rules_failed", "repeats")
    out = judged.join(small(hosts), "host", "left").withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & ~((F.col("host_rate") > rules.host_rate) & (F.size("rules_failed") > 0)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = judge(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


OP8_SQL = r"""
with w as (select doc_id, coalesce(lower(source), '') as host, coalesce(text, '') as text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
tri as (select doc_id, i, ws[i] || chr(0) || ws[i + 1] || chr(0) || ws[i + 2] as g
        from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
often as (select doc_id, i from tri qualify count(*) over (partition by doc_id, g) >= 2),
rep as (select doc_id, count(distinct i + k) as n_repeat_words from often, (select unnest([0, 1, 2]) as k) group by doc_id),
ln as (select doc_id, l from (select doc_id, unnest(string_split(text, chr(10))) as l from w) where regexp_matches(l, '[^\x20\x09-\x0D]')),
dup as (select doc_id, count(*) - count(distinct l) as n_dup_lines, count(*) as n_lines from ln group by doc_id),
c as (select w.doc_id, host, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from w left join rep using (doc_id) left join dup using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
             n_words < 50 or 100 * n_repeat_words > 50 * n_words or 100 * n_symbols > 10 * word_chars or 100 * n_dup_lines > 30 * n_lines
             or 10 * word_chars < 25 * n_words or 10 * word_chars > 120 * n_words as failed from c),
h as (select host, count(*)::double as n, sum(failed::int)::double as k from f group by host),
m as (select count(*) as hosts, sum(n) as docs, sum(k) as failed, sum(n * (k / n) * (k / n)) as squares, sum(n * n) as docs2 from h),
p as (select *, least(greatest(failed / docs, 0.5::double / docs), 1 - 0.5::double / docs) as p, greatest(squares - docs * (failed / docs) * (failed / docs), 0) as spread,
             docs - docs2 / docs - (hosts - 1) as room from m),
r as (select *, case when room > 0 then (spread / (p * (1 - p)) - (hosts - 1)) / room else 0 end as rho from p),
s as (select p, greatest(case when rho > 0 then least(1 / rho - 1, docs) else docs end, 1e-6::double) as strength from r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not ((k + p * strength) / (n + p * strength + (1 - p) * strength) > 0.6 and failed) as kept,
       round((k + p * strength) / (n + strength), 6) as host_rate
from f join h using (host), s
"""
QUERIES = {"op8_quality_rules": op8_quality_rules}
SQL = {"op8_quality_rules": OP8_SQL}
