"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits with A-Z folded; a character of a script without blanks is one token. A document and a benchmark item meet when they share a seed: a
window of ``min_match`` tokens, found by its Karp-Rabin hash. The pair's maximal matches are the runs of seeds along
its diagonals; the longest one that is not marked yet is marked in both texts, what overlaps it is cut back to its
unmarked part, and so on until no match of ``min_match`` tokens is left. The tiles need not keep their order, so a
passage that was cut up and put together differently is covered all the same. A document is contaminated by an item
when its tiles cover at least ``coverage`` of the item's tokens.

A benchmark of at most ``SMALL_SEEDS`` seeds (counted) goes to the tasks whole and documents need no shuffle; a larger
one is joined by seed in Spark, each seed's documents against its items, and only pairs that share a seed move. Both ways
give the same rows. In a join a tile of n tokens holds n / ``min_match`` of an item's windows at least, so pairs whose shared
windows can't cover enough of the item are dropped before any text moves; a seed that many documents share is split by adaptive
skew handling.

Defined results: null and empty texts have no tokens and match nothing; an item of fewer than ``min_match`` tokens
can't be told from a common phrase within a sentence, so it is found where it makes up a whole line or the whole text. Repeated benchmark rows are items of their own. Repeated documents give repeated rows; no rows give
none; input columns that clash with results come back as ``<name>_in``. Memory follows a slice of an Arrow batch and the
longest text.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import textbatch as tb
from brindle.llm.common import small, table, text_or_empty, with_row_key, written
from brindle.llm.worker import tidy

MIN_MATCH = 5
COVERAGE = 0.5
SMALL_SEEDS = 2_000_000


# scripts that are written without blanks
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
_SIGNS = r"[\p{P}\p{S}\p{Z}]+"
# UTF-8 lead bytes of all characters but ASCII and the letters from U+00C0 to U+07FF
_OTHER = np.zeros(256, bool)
_OTHER[0xC2] = True
_OTHER[0xE0:] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a slice and each row's first token (n + 1 entries)."""
    if _OTHER[tb.text_bytes(column)[0]].any():
        column = pc.replace_substring_regex(pc.replace_substring_regex(column, _UNSPACED, r" \1 "), _SIGNS, " ")
    w = tb.words(column, breaks=tb.NOT_ALNUM)
    return w.hash, w.first


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of the windows of ``size`` tokens that start at each position (rows are not told apart)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for k in range(size):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return tb.mix(acc)


def tiles(item: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(place in item, place in text, length) of the greedy tiling of two token sequences."""
    a, b = windows(item, min_match), windows(text, min_match)
    if not len(a) or not len(b):
        return []
    order = np.argsort(a, kind="stable")
    low, high = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    at = np.flatnonzero(high > low)
    count = (high - low)[at]
    j = np.repeat(at, count)
    i = order[np.repeat(low[at] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    by = np.lexsort((j, j - i))
    i, j = i[by], j[by]
    head = np.flatnonzero(np.r_[True, (np.diff(j - i) != 0) | (np.diff(j) != 1)]) if len(i) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[head, len(i)]) + min_match - 1
    heap = [(-int(n), int(i[h]), int(j[h])) for n, h in zip(runs, head, strict=True)]
    heapify(heap)
    item_used, text_used = np.zeros(len(item), bool), np.zeros(len(text), bool)
    out = []
    while heap:
        n, p, q = heappop(heap)
        used = item_used[p : p - n] | text_used[q : q - n]
        if not used.any():
            item_used[p : p - n] = text_used[q : q - n] = True
            out.append((p, q, -n))
            continue
        free = np.flatnonzero(np.diff(np.r_[True, used, True].astype(np.int8)))
        for start, end in zip(free[::2], free[1::2], strict=True):
            if end - start >= min_match:
                heappush(heap, (int(start - end), int(p + start), int(q + start)))
    return sorted(out)


@dataclass(frozen=True)
class Benchmark:
    """Items' ids and tokens, and the sorted seeds with the item of each."""

    ids: list
    items: list[np.ndarray]
    seeds: np.ndarray
    owner: np.ndarray


def _pairs_of(texts: pa.Array, bench: Benchmark, min_match: int) -> list[tuple[int, int, float, int, int]]:
    """(row, item, coverage, covered tokens, tiles) of the pairs that share a seed in a slice of documents."""
    hashes, first = tokens(texts)
    found = windows(hashes, min_match)
    low = np.searchsorted(bench.seeds, found, "left")
    hit = np.flatnonzero(bench.seeds[np.minimum(low, len(bench.seeds) - 1)] == found) if len(bench.seeds) else low[:0]
    if not len(hit):
        return []
    row = np.searchsorted(first, hit, side="right") - 1
    inside = hit + min_match <= first[row + 1]  # the window ends in its own text
    hit, row = hit[inside], row[inside]
    end = np.searchsorted(bench.seeds, found[hit], "right")
    pairs = {(int(r), int(o)) for r, a, b in zip(row, low[hit], end, strict=True) for o in bench.owner[a:b]}
    out = []
    for r, o in sorted(pairs):
        marked = tiles(bench.items[o], hashes[first[r] : first[r + 1]], min_match)
        covered = sum(n for _, _, n in marked)
        out.append((r, o, covered / len(bench.items[o]), covered, len(marked)))
    return out


RESULTS = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("covered_tokens", T.LongType()), T.StructField("tiles", T.LongType()),
])


def _tile_batches(text_at: int, bench: Benchmark, min_match: int, coverage: float):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tb.as_strings(batch.column(text_at))
            found = [(a + r, o, c, n, k) for a, b in tb.slices(column) for r, o, c, n, k in _pairs_of(column.slice(a, b - a), bench, min_match) if c >= coverage]
            rows, owner, share, covered, count = zip(*found, strict=True) if found else ((),) * 5
            kept = pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != text_at], names=[c for i, c in enumerate(batch.schema.names) if i != text_at])
            kept = kept.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array([bench.ids[o] for o in owner], pa.int64()), pa.array(share, pa.float64()), pa.array(covered, pa.int64()), pa.array(count, pa.int64())],
                names=[*kept.schema.names, *RESULTS.fieldNames()],
            )

    return run


def _seed_batches(min_match: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, seed, times, tokens): the distinct seeds of each text, how often they stand there, and the text's tokens."""
        for batch in batches:
            column = tb.as_strings(batch.column(1))
            for a, b in tb.slices(column):
                hashes, first = tokens(column.slice(a, b - a))
                found = windows(hashes, min_match)
                row = np.searchsorted(first, np.arange(len(found)), side="right") - 1
                inside = np.arange(len(found)) + min_match <= first[row + 1]
                order = np.lexsort((found[inside], row[inside]))
                seed, of_row = found[inside][order], row[inside][order]
                head = np.flatnonzero(np.r_[True, (seed[1:] != seed[:-1]) | (of_row[1:] != of_row[:-1])]) if len(seed) else np.zeros(0, np.int64)
                times = np.diff(np.r_[head, len(seed)])
                key = batch.column(0).slice(a, b - a).take(pa.array(of_row[head]))
                yield pa.RecordBatch.from_arrays([key, pa.array(seed[head].view(np.int64)), pa.array(times), pa.array(np.diff(first)[of_row[head]])], names=["key", "seed", "times", "tokens"])

    return run


def _pair_batches(min_match: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, item_id, text, item text) -> the tiling of each pair."""
        for batch in batches:
            texts, items = tb.as_strings(batch.column(2)), tb.as_strings(batch.column(3))
            share, covered, count = [], [], []
            for i in range(batch.num_rows):
                item = tokens(items.slice(i, 1))[0]
                marked = tiles(item, tokens(texts.slice(i, 1))[0], min_match)
                covered.append(sum(n for _, _, n in marked))
                share.append(covered[-1] / max(1, len(item)))
                count.append(len(marked))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share), pa.array(covered, pa.int64()), pa.array(count, pa.int64())], names=["key", *RESULTS.fieldNames()])

    return run


def _plain(text: Column) -> Column:
    """A text's tokens with a blank between them."""
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(F.regexp_replace(folded, _UNSPACED.replace(r"\p{", r"\p{Is"), " $1 "), r"[\p{P}\p{S}\p{Z}\p{Cc}]+", " "))


def _whole_lines(df: DataFrame, items: DataFrame, text_col: str, min_match: int) -> DataFrame | None:
    """Results for items of fewer than ``min_match`` tokens, which are lines of a document or all of it; None without such items."""
    size = lambda c: F.size(F.split(c, " "))
    short = items.select("item_id", _plain(F.col("item_text")).alias("_line")).where((F.col("_line") != "") & (size("_line") < min_match))
    if not short.limit(1).count():
        return None
    each = F.array_distinct(F.concat(F.transform(F.split(text_col, "\n"), _plain), F.array(_plain(F.col(text_col)))))
    cut = df.withColumn("_line", F.explode(F.filter(each, lambda x: (x != "") & (size(x) < min_match)))).drop(text_col)
    hits = cut.join(small(short), "_line")
    return hits.select(*[c for c in df.columns if c != text_col], "item_id", F.lit(1.0).alias("coverage"), size("_line").cast("long").alias("covered_tokens"), F.lit(1).cast("long").alias("tiles"))


def contaminated(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, small_seeds: int = SMALL_SEEDS) -> DataFrame:
    """(other columns of ``df``, item_id, coverage, covered_tokens, tiles): one row per document and item that it holds."""
    df = df.withColumnsRenamed({c: f"{c}_in" for c in df.columns if c in RESULTS.fieldNames() and c != text_col})
    df = df.withColumn(text_col, text_or_empty(df, text_col))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), text_or_empty(benchmark, item_text).alias("item_text"))
    kept = [f for f in df.schema.fields if f.name != text_col]
    schema = T.StructType(kept + RESULTS.fields)
    lines = _whole_lines(df, items, text_col, min_match)
    n_seeds = items.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0] // 2  # at most one token in two characters
    if n_seeds <= small_seeds:
        rows = items.toArrow()
        column = tb.as_strings(rows["item_text"])
        tokened = [tokens(column.slice(i, 1))[0] for i in range(len(column))]
        seeds = [np.unique(windows(x, min_match)) for x in tokened]
        every = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        order = np.argsort(every, kind="stable")
        bench = Benchmark(rows["item_id"].to_pylist(), tokened, every[order], owner[order])
        found = df.mapInArrow(_tile_batches(df.columns.index(text_col), bench, min_match, coverage), schema)
        return found if lines is None else found.unionByName(lines)
    keyed = written(df.withColumn("key", F.monotonically_increasing_id()), "decontam-docs")
    numbered = written(items.withColumn("key", F.monotonically_increasing_id()), "decontam-items")
    seeds = lambda rows, c: rows.select("key", c).mapInArrow(_seed_batches(min_match), "key long, seed long, times long, tokens long")
    shared = seeds(keyed, text_col).select("key", "seed").join(seeds(numbered, "item_text").withColumnRenamed("key", "item"), "seed")
    reach = shared.groupBy("key", "item").agg(F.sum("times").alias("times"), F.first("tokens").alias("tokens"))
    pairs = reach.where(F.col("times") * min_match >= coverage * F.col("tokens")).select("key", "item")
    full = pairs.join(keyed.select("key", text_col), "key").join(numbered.select(F.col("key").alias("item"), "item_id", "item_text"), "item")
    tiled = full.select("key", "item_id", text_col, "item_text").mapInArrow(_pair_batches(min_match), T.StructType([T.StructField("key", T.LongType()), *RESULTS.fields]))
    found = keyed.drop(text_col).join(tiled.where(F.col("coverage") >= coverage), "key").select(*[f.name for f in kept], *RESULTS.fieldNames())
    return found if lines is None else found.unionByName(lines)


def decontaminated(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that hold no item of the benchmark. Rows are told apart by a hash of all of them that matters
    here, the text, so null and repeated ids do no harm."""
    keyed = with_row_key(df, text_col)
    hits = written(contaminated(keyed.select("_r1", "_r2", text_col), benchmark, text_col=text_col, **options).select("_r1", "_r2").distinct(), "contaminated")
    return keyed.join(small(hits), ["_r1", "_r2"], "left_anti").drop("_r1", "_r2")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return contaminated(docs, benchmark).select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "covered_tokens", "tiles", F.lit(True).alias("contaminated"))


QUERIES = {"op4_decontamination": op4_decontamination}
SQL: dict[str, str] = {}
