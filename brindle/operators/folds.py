"""Order-dependent state over events, without gathering a key's events anywhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.sources.work import written

BUCKET_SECONDS = 86_400.0
#: Events of a key and bucket beyond which the bucket is cut into shorter ones.
DENSE = 200_000
#: Dense buckets that are broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 200_000


def throttled(df: DataFrame, keys: list[str], ts: str, order: str, seconds: float, inclusive: bool = False, bucket_seconds: float = BUCKET_SECONDS, dense: int = DENSE) -> DataFrame:
    """The events that a rate limit lets through: one is kept if the last *kept* one of its key is longer ago than
    ``seconds`` (with ``inclusive``: at least as long).

    A key's time is cut into buckets, which tasks judge alone: whatever was kept before a bucket, its first kept event is one
    of those in the bucket's first ``seconds`` or the next one, and from each of them the last kept one follows. These short
    tables, a few rows a bucket, are chained key by key; then each bucket knows where it starts. Buckets are sized by counts: one
    with more than ``dense`` events is cut into parts of about as many, though not below 4 * ``seconds``, so a task holds
    ``dense`` events, or what comes in 4 * ``seconds``, and, when chaining, a row."""
    width, span = int(seconds * 1_000_000), int(max(bucket_seconds, 4 * seconds) * 1_000_000)
    timed = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_span", F.floor(F.col("_us") / span))
    counts = timed.groupBy(*keys, "_span").agg(F.count("*").alias("_n")).where(F.col("_n") > dense)
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_n") / dense)))
    size = F.greatest(F.ceil(F.lit(float(span)) / parts).cast("bigint"), F.lit(4 * width), F.lit(1))
    large = written(counts.select(*[F.col(k).alias(f"_{k}_d") for k in keys], F.col("_span").alias("_span_d"), size.alias("_size")), "dense-buckets")
    known = large.limit(BROADCAST_ROWS + 1).count()
    if known:
        same = reduce(Column.__and__, [timed[k].eqNullSafe(large[f"_{k}_d"]) for k in keys], timed["_span"] == large["_span_d"])
        timed = timed.join(F.broadcast(large) if known <= BROADCAST_ROWS else large, same, "left").drop(*[f"_{k}_d" for k in keys], "_span_d")
    else:
        timed = timed.withColumn("_size", F.lit(span).cast("bigint"))
    start, size = F.col("_span") * span, F.coalesce(F.col("_size"), F.lit(span))
    timed = timed.withColumn("_bucket", (start + F.floor((F.col("_us") - start) / size) * size).cast("bigint")).drop("_span", "_size")
    group = [*keys, "_bucket"]
    fields = [timed.schema[k] for k in keys]
    long = lambda name: T.StructField(name, T.LongType())
    exits = timed.select(*group, "_us").repartition(*group).sortWithinPartitions(*group, "_us")
    exits = exits.mapInArrow(_exits(len(keys), width, inclusive), T.StructType([*fields, long("_bucket"), long("_entry"), long("_exit")]))
    starts = exits.repartition(*keys).sortWithinPartitions(*group, "_entry").mapInArrow(_chain(len(keys), width, inclusive), T.StructType([*fields, long("_bucket"), long("_last")]))
    at = starts.select("_last", *[F.col(c).alias(f"_{c}_s") for c in group])
    same = reduce(Column.__and__, [timed[c].eqNullSafe(at[f"_{c}_s"]) for c in group])
    known = timed.join(at, same).drop(*[f"_{c}_s" for c in group])
    dealt = known.repartition(*group).sortWithinPartitions(*group, "_us", order)
    return dealt.mapInArrow(_keep(group, width, inclusive), dealt.schema).drop("_us", "_bucket", "_last")


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Where a row's values differ from those of the row before it; the first row does."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        out[1:] |= differ.to_numpy(zero_copy_only=False)
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], names: Callable[[pa.Table], list[str]]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in pieces that hold whole groups, with the first row of each group. Batches of one group are put together
    once, when it ends; only rows at their edges are compared."""
    held: list[pa.Table] = []

    def starts(rows: pa.Table) -> np.ndarray:
        return np.flatnonzero(_changes([rows[c].combine_chunks() for c in names(rows)]))

    def whole(tables: list[pa.Table]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        rows = pa.concat_tables(tables).combine_chunks()
        if len(rows):
            yield rows, starts(rows)

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not len(rows):
            continue
        first = starts(rows)
        if held and len(starts(pa.concat_tables([held[-1].slice(len(held[-1]) - 1), rows.slice(0, 1)]))) == 1:
            first = first[1:]  # goes on
        if not len(first):
            held.append(rows)
            continue
        yield from whole([*held, rows.slice(0, first[-1])])
        held = [rows.slice(first[-1])]
    if held:
        yield from whole(held)


def _next(us: np.ndarray, first: np.ndarray, width: int, inclusive: bool) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, the next row that passes after each row was kept; the number of rows where its group has none)."""
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(us)]))
    base = us[first][group]
    step = int((us - base).max(initial=0)) + width + 2
    place = group * step + (us - base)
    to = np.searchsorted(place, place + width, side="left" if inclusive else "right")
    inside = np.r_[group, -1][to] == group
    return group, np.where(inside, to, len(us))


def _exits(n_keys: int, width: int, inclusive: bool):
    """Events of buckets -> for each event that may be its bucket's first kept one: the last that is kept then. Neighbours with
    the same last one are one row, that of the later one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first in _whole_groups(batches, lambda t: t.column_names[: n_keys + 1]):
            us, bucket = rows["_us"].to_numpy(), rows["_bucket"].to_numpy()
            group, jump = _next(us, first, width, inclusive)
            last = np.arange(len(us))
            jump = np.r_[jump, len(us)]
            while (jump[:-1] < len(us)).any():  # twice as far each time
                last = np.where(jump[:-1] < len(us), np.r_[last, 0][jump[:-1]], last)
                jump = jump[jump]
            early = us < bucket + width
            after = np.r_[True, group[1:] != group[:-1]] | np.r_[True, early[:-1]]  # the first one, or right behind an early one
            may = np.flatnonzero(early | after)
            same = np.r_[(group[may][1:] == group[may][:-1]) & (last[may][1:] == last[may][:-1]), False]
            kept = may[~same]
            out = rows.select(rows.column_names[: n_keys + 1]).take(pa.array(kept))
            out = out.append_column("_entry", pa.array(us[kept])).append_column("_exit", pa.array(us[last[kept]]))
            yield from out.to_batches()

    return run


def _chain(n_keys: int, width: int, inclusive: bool):
    """The buckets' tables in order -> what was kept last before each bucket that keeps something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        last: int | None = None
        done: tuple | None = None  # the bucket whose first kept event was found
        for batch in batches:
            keep: list[int] = []
            lasts: list[int | None] = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
            rest = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_bucket", "_entry", "_exit")), strict=True)
            for i, (key, (bucket, entry, leaves)) in enumerate(zip(keys, rest, strict=True)):
                if key != before:
                    before, last, done = key, None, None
                if done != (key, bucket) and (last is None or (entry - last >= width if inclusive else entry - last > width)):
                    keep.append(i)
                    lasts.append(last)
                    last, done = leaves, (key, bucket)
            out = batch.select(batch.schema.names[: n_keys + 1]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(lasts, pa.int64())], names=[*out.schema.names, "_last"])

    return run


def _keep(group_by: list[str], width: int, inclusive: bool):
    """Events with what was kept before their bucket -> the kept ones; all groups go on step by step together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first in _whole_groups(batches, lambda t: group_by):
            us = rows["_us"].to_numpy()
            group, jump = _next(us, first, width, inclusive)
            last = rows["_last"].combine_chunks()
            far = us - pc.fill_null(last, 0).to_numpy(zero_copy_only=False)
            passes = (far >= width if inclusive else far > width) | last.is_null().to_numpy(zero_copy_only=False)
            places = np.flatnonzero(passes)
            _, at = np.unique(group[places], return_index=True)
            now = places[at]
            keep = np.zeros(len(us), bool)
            while len(now):
                keep[now] = True
                now = jump[now]
                now = now[now < len(us)]
            yield from rows.filter(pa.array(keep)).to_batches()

    return run


def clamped_counter(df: DataFrame, keys: list[str], order: list[str], delta: str, bucket) -> DataFrame:
    """Per key, the counter x = max(x + delta, 0) after all of its events in order, from 0.

    It equals S - min(0, lowest prefix sum). Prefix sums are taken within (key, bucket) - ``bucket`` is a column that
    grows with the order - and put together from each bucket's total and lowest point, so a key is never in one task.
    """
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = df.withColumn("_b", bucket).withColumn("_s", F.sum(delta).over(inside)).groupBy(*keys, "_b").agg(F.sum(delta).alias("_total"), F.min("_s").alias("_low"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    run = parts.withColumn("_low", F.coalesce(F.sum("_total").over(before), F.lit(0)) + F.col("_low"))
    return run.groupBy(*keys).agg((F.sum("_total") - F.least(F.lit(0), F.min("_low"))).cast("bigint").alias("counter"))
