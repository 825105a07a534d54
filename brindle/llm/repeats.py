"""Removal of every long byte string that occurs more than once in a corpus, by suffix sorting.

A byte goes when a string of ``length`` bytes that covers it starts anywhere else too. All suffixes of a corpus can't be
sorted in one place, so the sort is dealt out by content:

1. Anchors. The smallest ``GRAM``-gram (by hash, leftmost) of each window of ``length`` bytes is its anchor. Equal
   windows have equal anchors at equal distances, so only suffixes at anchors with equal grams need to be ordered
   together. Windows that share an anchor form a segment: a run of starts, about ``length / 2`` bytes apart.
2. Counting. Segments travel as hashes. Equal segments are one from here on, however many documents hold them - the
   counts are combined in each task first; a segment that occurs twice is repeated as a whole.
3. Sorting. Only anchors with two or more different segments are looked at further. One copy of each of these is
   fetched, and deep-shallow sorting orders what follows the anchors and, reversed, what precedes them. Two windows are equal
   where both common prefixes reach far enough, so the two orders with their common prefixes show every window's class.
   An anchor with more than ``most`` different segments is split by longer cores, what stands behind it and what stands
   before it; a core that is too large still is split by the longest one, the window itself, of which equal ones are counted.
4. Verdicts go back to the documents by segment; ranges are united and cut out.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing. Repeated rows count as texts of their
own and so lose all of their windows. Overlapping occurrences count. Cutting is on bytes, so a kept text need not be valid
UTF-8: it is returned as binary. No rows give none; extra columns pass through, clashing ones as ``<name>_in``. Windows
are compared by bytes within a group and by 128 bits of hash between tasks. Memory follows a slice of an Arrow batch, the
longest text and ``most``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import textbatch as tb
from brindle.llm.common import small, table, text_or_empty, with_row_key, written
from brindle.llm.suffixes import sort_suffixes
from brindle.llm.worker import tidy

LENGTH = 400
GRAM = 48
#: Different segments of an anchor that one task orders.
MOST = 1_024
#: Texts that hold one segment, beyond which its verdict goes to them.
HOT = 100_000
#: Segments whose classes are told apart in one go.
TOGETHER = 50_000


# --- anchors and segments -------------------------------------------------------------------------------------------------


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` values, by running minima from both ends of blocks."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(raw: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start in its text, starts, anchor's distance, gram's hash, segment's hash) of every segment of a slice."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return (none,) * 6
    prefix = tb.prefix_hashes(raw, lower=False)
    at = np.arange(len(raw) - gram + 1)
    grams = tb.substring_hashes(prefix, at, at + gram)
    ranked = (grams >> np.uint64(31) << np.uint64(31)) | at.astype(np.uint64)  # texts have less than 2**31 bytes
    anchors = (sliding_minimum(ranked, length - gram + 1) & np.uint64((1 << 31) - 1)).astype(np.int64)
    starts = np.arange(len(anchors))
    row = np.searchsorted(ends, starts, side="right") - 1
    inside = starts + length <= ends[row + 1]
    starts, row, anchors = starts[inside], row[inside], anchors[inside]
    if not len(starts):
        return (none,) * 6
    head = np.flatnonzero(np.r_[True, (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])])
    count = np.diff(np.r_[head, len(starts)])
    first, anchor, owner = starts[head], anchors[head], row[head]
    whole = tb.substring_hashes(prefix, first, first + count - 1 + length)
    shape = ((anchor - first).astype(np.uint64) << np.uint64(32)) | count.astype(np.uint64)
    return owner, first - ends[owner], count, anchor - first, grams[anchor].view(np.int64), tb.mix(whole + shape * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


_SEGMENT = T.StructType([T.StructField(n, T.LongType() if n in ("r1", "r2", "gram", "segment") else T.IntegerType()) for n in ("r1", "r2", "start", "starts", "anchor", "gram", "segment")])


def _segment_batches(length: int, gram: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tb.as_strings(batch.column(2))
            for a, b in tb.slices(column):
                owner, start, count, anchor, grams, hashes = segments(*tb.text_bytes(column.slice(a, b - a)), length, gram)
                at = pa.array(owner + a)
                columns = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x.astype(np.int32)) for x in (start, count, anchor)), pa.array(grams), pa.array(hashes)]
                yield pa.RecordBatch.from_arrays(columns, names=_SEGMENT.fieldNames())

    return run


# --- classes of windows within the segments of an anchor ----------------------------------------------------------------


def repeated_starts(groups: list[list[tuple[bytes, int, int]]], length: int, ranges: list[tuple[int, int]] | None = None) -> list[list[int]]:
    """For groups of different segments (bytes, anchor's distance, starts) with one anchor gram each: per segment, in
    order, [from, to) pairs of the starts whose windows stand in another segment of the group too. ``ranges`` limits the
    windows of each group to those that begin so many bytes before their anchor ([from, to))."""
    total = sum(map(len, groups))
    low, high = (np.repeat([r[k] for r in ranges or [(0, length)] * len(groups)], list(map(len, groups))) for k in (0, 1))
    after_order, after_shared, before_order, before_shared = (np.zeros(total, np.int64) for _ in range(4))
    anchor, starts = (np.array([s[k] for g in groups for s in g], np.int64) for k in (1, 2))
    base = 0
    for group in groups:
        to = base + len(group)
        for order, shared, strings in (
            (after_order, after_shared, [data[a:] for data, a, _ in group]),
            (before_order, before_shared, [data[:a][::-1] for data, a, _ in group]),
        ):
            own, depths = sort_suffixes(strings)
            order[base:to], shared[base:to] = np.array(own) + base, depths
        base = to
    # a window ``o`` bytes before its anchor: equal to another one where o bytes before and length - o bytes after agree
    repeated = np.zeros((total, int(anchor.max(initial=0)) + 1), bool)
    before, after = np.zeros(total, np.int64), np.zeros(total, np.int64)
    places = np.arange(total)
    for o in range(repeated.shape[1]):
        has = np.flatnonzero((anchor >= o) & (anchor - starts < o) & (low <= o) & (o < high))
        if len(has) < 2:
            continue
        before[before_order] = np.maximum.accumulate(np.where(before_shared < o, places, 0))
        after[after_order] = np.maximum.accumulate(np.where(after_shared < length - o, places, 0))
        key = before[has] * total + after[has]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        repeated[has[by[1:][same]], o] = repeated[has[by[:-1][same]], o] = True
    out: list[list[int]] = [[] for _ in range(total)]
    for i in np.flatnonzero(repeated.any(axis=1)):
        marks = repeated[i, anchor[i] - starts[i] + 1 : anchor[i] + 1][::-1]  # by start: the first is farthest from the anchor
        out[i] = np.flatnonzero(np.diff(np.r_[False, marks, False].astype(np.int8))).tolist()
    return out


_FETCHED = "gram long, segment long, anchor int, starts int, many boolean, data binary"


def _fetch_batches(length: int):
    """(text, wanted) -> the wanted segments' bytes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tb.as_strings(batch.column(0))
            raw, ends = tb.text_bytes(column)
            raw = raw.tobytes()
            wanted = batch.column(1)
            lists = wanted.flatten()
            owner = np.repeat(np.arange(len(column)), np.diff(wanted.offsets.to_numpy()))
            fields = {lists.type.field(i).name: lists.field(i) for i in range(lists.type.num_fields)}
            first = ends[owner] + fields["start"].to_numpy()
            to = first + fields["starts"].to_numpy() - 1 + length
            data = pa.array([raw[a:b] for a, b in zip(first.tolist(), to.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(fields[n] for n in ("gram", "segment", "anchor", "starts", "many")), data], names=["gram", "segment", "anchor", "starts", "many", "data"])

    return run


_VERDICT = "gram long, segment long, ranges array<int>"


def _class_batches(length: int):
    """Segments, sorted by core -> the ranges of repeated starts of those that have any."""

    def judged(groups: list[list[tuple]]) -> pa.RecordBatch:
        found = repeated_starts([[s[3:6] for s in g] for g in groups], length, [g[0][6:8] for g in groups])
        hit = [(s[1], s[2], ranges) for s, ranges in zip((s for g in groups for s in g), found, strict=True) if ranges]
        grams, hashes, ranges = zip(*hit, strict=True) if hit else ((),) * 3
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(hashes, pa.int64()), pa.array(ranges, pa.list_(pa.int32()))], names=["gram", "segment", "ranges"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("core", "gram", "segment", "data", "anchor", "starts", "low", "high"))
            yield from zip(*columns, strict=True)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held = [], 0
        for _, members in groupby(rows(batches), key=lambda s: (s[0], s[6])):
            group = list({s[1:3]: s for s in members}.values())  # a row that stands twice was fetched twice
            groups.append(group)
            held += len(group)
            if held >= TOGETHER:
                yield judged(groups)
                groups, held = [], 0
        if groups:
            yield judged(groups)

    return run


_CORED = "core long, gram long, segment long, anchor int, starts int, low int, high int, data binary"


def _half_batches(length: int, gram: int):
    """Segments of oversize anchors -> the same under longer cores. Windows that begin in the nearer half before their anchor all
    cover the bytes behind it, the others those before it: these bytes, more than a third of a window, are the core."""
    near = (length - gram) // 2 + 1

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for grams, hashes, anchor, starts, data in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("gram", "segment", "anchor", "starts", "data")), strict=True):
                sides = []
                if anchor - starts + 1 < near:
                    sides.append((0, near, data[anchor : anchor + length - near + 1]))
                if anchor >= near:
                    sides.append((near, length, data[anchor - near : anchor + gram]))
                for low, high, core in sides:
                    digest = hashlib.blake2b(core, digest_size=8, key=b"%d" % low).digest()
                    out.append((int.from_bytes(digest, "little", signed=True), grams, hashes, anchor, starts, low, high, data))
            columns = zip(*out, strict=True) if out else ((),) * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["core", "gram", "segment", "anchor", "starts", "low", "high", "data"])

    return run


def _window_batches(length: int):
    """Segments of oversize cores -> (gram, segment, start, distance, digest) of each of their windows."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = ("gram", "segment", "anchor", "starts", "low", "high", "data")
            for grams, hashes, anchor, starts, low, high, data in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in fields), strict=True):
                at = np.arange(max(0, anchor - high + 1), min(starts, anchor - low + 1))
                digest = tb.substring_hashes(tb.prefix_hashes(np.frombuffer(data, np.uint8), lower=False), at, at + length)
                one = lambda x, n=len(at): pa.array(np.full(n, x, np.int64))
                yield pa.RecordBatch.from_arrays([one(grams), one(hashes), pa.array(at.astype(np.int32)), pa.array((anchor - at).astype(np.int32)), pa.array(digest.view(np.int64))], names=["gram", "segment", "start", "distance", "digest"])

    return run


def _by_window(cored: DataFrame, length: int) -> DataFrame:
    """Verdicts of the cores that are too large for a task: their windows are dealt out and counted one by one."""
    each = cored.dropDuplicates(["gram", "segment", "low"]).mapInArrow(_window_batches(length), "gram long, segment long, start int, distance int, digest long")
    each = written(each, "windows")
    key = ["gram", "distance", "digest"]
    twice = written(each.groupBy(key).count().where("count > 1").select(key), "repeated-windows")
    single = each.join(twice, key).select("gram", "segment", F.struct(F.col("start").alias("a"), (F.col("start") + 1).alias("b")).alias("one"))
    return single.groupBy("gram", "segment").agg(F.flatten(F.transform(F.sort_array(F.collect_list("one")), lambda x: F.array(x["a"], x["b"]))).alias("ranges"))


def _classes(fetched: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """(gram, segment, ranges) of the repeated starts of fetched segments, several rows of a segment where they were split."""
    sort = lambda df: df.repartition("core").sortWithinPartitions("core", "low").mapInArrow(_class_batches(length), _VERDICT)
    whole = fetched.where("not many").select(F.col("gram").alias("core"), "gram", "segment", "anchor", "starts", F.lit(0).alias("low"), F.lit(length).alias("high"), "data")
    if not fetched.where("many").limit(1).count():
        return sort(whole)
    halves = written(fetched.where("many").dropDuplicates(["gram", "segment"]).mapInArrow(_half_batches(length, gram), _CORED), "halves")
    large = written(halves.groupBy("core").count().where(F.col("count") > most).select("core"), "large-cores")
    few = sort(whole.unionByName(halves.join(large, "core", "left_anti").select(*whole.columns)))
    if not large.limit(1).count():
        return few
    return few.unionByName(_by_window(halves.join(large, "core", "left_semi"), length))


# --- the operator ---------------------------------------------------------------------------------------------------------

RESULTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])


def _cut_batches(text_at: int, length: int, keep_bytes: bool):
    """Rows with their text and ``found`` (start, ranges of repeated starts in that segment) -> what is left of them."""

    def spans(found: list[dict] | None) -> np.ndarray:
        pairs = np.array([(s["start"] + a, s["start"] + b) for s in found or () for a, b in zip(s["ranges"][::2], s["ranges"][1::2], strict=True)], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        pairs[:, 1] += length - 1
        to = np.maximum.accumulate(pairs[:, 1]) if len(pairs) else pairs[:, 1]
        head = np.flatnonzero(np.r_[True, pairs[1:, 0] > to[:-1]]) if len(pairs) else np.zeros(0, np.int64)
        return np.stack([pairs[head, 0], to[np.r_[head[1:] - 1, len(pairs) - 1]]], axis=1) if len(pairs) else pairs

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tb.as_strings(batch.column(text_at))
            total, removed, count, digest, left = [], [], [], [], []
            for text, found in zip(column, batch.column(batch.num_columns - 1), strict=True):
                data = text.as_buffer().to_pybytes()
                cut = spans(found.as_py())
                rest = data
                if len(cut):
                    edges = [0, *cut.ravel().tolist(), len(data)]
                    rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                total.append(len(data))
                removed.append(len(data) - len(rest))
                count.append(len(cut))
                digest.append(hashlib.sha256(rest).hexdigest())
                left.append(rest if keep_bytes else None)
            kept = [c for i, c in enumerate(batch.columns[:-1]) if i != text_at]
            names = [c for i, c in enumerate(batch.schema.names[:-1]) if i != text_at]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int64()) for x in (total, removed, count)), pa.array(digest, pa.string()), pa.array(left, pa.binary())], names=[*names, *RESULTS.fieldNames()])

    return run


def _judged(occur: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Segments with their verdicts. Those that very many texts hold, a few by their number, are judged where they are; the others
    meet their verdicts by a shuffle."""
    keys = ["gram", "segment"]
    often = verdicts.where("hot").drop("hot")
    if not often.limit(1).count():
        return occur.join(verdicts.drop("hot"), keys)
    often = small(often)
    rest = occur.join(often.select(*keys), keys, "left_anti").join(verdicts.where("not hot").drop("hot"), keys)
    return occur.join(often, keys).select(*rest.columns).unionByName(rest)


def remove_repeats(df: DataFrame, *, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST, keep_bytes: bool = True, hot: int = HOT) -> DataFrame:
    """``df`` without its text and with n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (the bytes that are left)."""
    df = df.withColumnsRenamed({c: f"{c}_in" for c in df.columns if c in RESULTS.fieldNames() and c != text_col})
    df = with_row_key(df.withColumn(text_col, text_or_empty(df, text_col)), *df.columns)
    texts = df.select("_r1", "_r2", text_col).where(F.octet_length(text_col) >= length)
    occur = written(texts.mapInArrow(_segment_batches(length, gram), _SEGMENT), "segments")
    home = F.min(F.struct("r1", "r2", "start", "starts", "anchor")).alias("home")
    distinct = written(occur.groupBy("gram", "segment").agg(F.count("*").alias("n"), home), "distinct-segments")
    shared = distinct.groupBy("gram").agg(F.count("*").alias("different")).where("different > 1")
    asked = distinct.join(shared, "gram").select("home.*", "gram", "segment", (F.col("different") > most).alias("many"))
    wanted = asked.groupBy("r1", "r2").agg(F.collect_list(F.struct("start", "starts", "anchor", "gram", "segment", "many")).alias("wanted"))
    wanted = written(wanted, "wanted-segments")
    found = texts.join(wanted, (texts["_r1"] == wanted["r1"]) & (texts["_r2"] == wanted["r2"])).select(text_col, "wanted")
    fetched = written(found.mapInArrow(_fetch_batches(length), _FETCHED), "fetched-segments")
    whole = distinct.where("n > 1").select("gram", "segment", F.array(F.lit(0), F.col("home.starts")).alias("ranges"), (F.col("n") > hot).alias("hot"))
    some = _classes(fetched, length, gram, most).join(distinct.where("n = 1").select("gram", "segment"), ["gram", "segment"], "left_semi")
    verdicts = written(whole.unionByName(some.withColumn("hot", F.lit(False))), "verdicts")
    hits = written(_judged(occur, verdicts).select("r1", "r2", "start", "ranges"), "repeats")
    of_rows = hits.groupBy("r1", "r2").agg(F.collect_set(F.struct("start", "ranges")).alias("found"))
    joined = df.join(of_rows, (df["_r1"] == of_rows["r1"]) & (df["_r2"] == of_rows["r2"]), "left").drop("_r1", "_r2", "r1", "r2")
    fields = [f for f in joined.schema.fields if f.name not in (text_col, "found")]
    return joined.mapInArrow(_cut_batches(joined.columns.index(text_col), length, keep_bytes), T.StructType(fields + RESULTS.fields))


def op3_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_bytes=False).drop("kept")


QUERIES = {"op3_repeat_removal": op3_repeat_removal}
SQL: dict[str, str] = {}
