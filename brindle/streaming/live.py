"""The stateful operators over streams: rate limiting with one timestamp of state a key, and an applied change feed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout


def throttled_stream(df: DataFrame, keys: list[str], ts: str, order: str, seconds: float, inclusive: bool = False, late: str | None = None) -> DataFrame:
    """``operators.folds.throttled`` over a stream: an event passes if its key's last passed one is longer ago than
    ``seconds``. State is one timestamp a key; a trigger's events of a key are judged together in the order of their time,
    so limit what a trigger reads. An event older than the last passed one is late and doesn't pass. With ``late``, a
    watermark's delay, a key's state goes when the watermark has passed what it may still hold back."""
    width, side = int(seconds * 1_000_000), "left" if inclusive else "right"

    def judge(_key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values([ts, order])
        us = rows[ts].astype("datetime64[us]").astype("int64").to_numpy()
        last = state.get[0] if state.exists else None
        keep = np.zeros(len(us), bool)
        at = 0 if last is None else int(np.searchsorted(us, last + width, side=side))
        while at < len(us):  # from one event that passes to the next
            keep[at] = True
            last = int(us[at])
            at = max(at + 1, int(np.searchsorted(us, last + width, side=side)))
        state.update((last,))
        if late is not None:
            ends = (last + width) // 1_000 + 1
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield rows[keep]

    state = T.StructType([T.StructField("last", T.LongType())])
    timed = df.withWatermark(ts, late) if late is not None else df
    timeout = GroupStateTimeout.EventTimeTimeout if late is not None else GroupStateTimeout.NoTimeout
    return timed.groupBy(*keys).applyInPandasWithState(judge, df.schema, state, "append", timeout)


def in_batches(df: DataFrame, handle, checkpoint: str):
    """Runs ``handle(rows, batch_id)`` on every batch of a stream, those that are there now. A batch that failed comes again
    under its number, so ``handle`` can tell what it has done already."""
    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(df: DataFrame, ts: str, by: list[str], window: str, late: str) -> DataFrame:
    """Counts per window and key; windows close when the watermark passes them."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
