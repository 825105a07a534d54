"""Running forms of the change feed and of streamed answers, with keyed state, timers and a sink that may be replayed.

State is kept by RocksDB, which Spark asks for here (``with_state_store``). A trigger's rows of one key are put in order in its
task, so limit what a trigger reads; what is kept between triggers is one row an item, or an answer's chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """The state store that ``transformWithState`` needs, unless the session names one."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, ROCKSDB)


class _Apply(StatefulProcessor):
    """Outcomes of a feed's items. Value state: the last order applied to the key. Map state: item -> its digest."""

    def __init__(self, item: str, digest: str, order: str, sync_deletions: bool) -> None:
        self.item, self.digest, self.order, self.sync_deletions = item, digest, order, sync_deletions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at bigint")
        self.held = handle.getMapState("held", "item string", "digest string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for item, digest in zip(initialState[self.item].astype(str), initialState[self.digest], strict=True):
            self.held.updateValue((item,), (digest,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        fresh = frame[frame[self.order] > last] if last is not None else frame  # what was applied before comes again after a replay at the source
        if fresh.empty:
            return
        out = []
        for item, digest, gone, bad in zip(fresh[self.item].astype(str), fresh[self.digest], fresh["item_gone"], fresh["item_bad"], strict=True):
            known = self.held.containsKey((item,))
            if bad:
                out.append("failed")
            elif gone:
                out.append("deleted" if known and self.sync_deletions else "skipped")
                if out[-1] == "deleted":
                    self.held.removeKey((item,))
            elif known and self.held.getValue((item,))[0] == digest:
                out.append("skipped")
            else:
                out.append("updated" if known else "created")
                self.held.updateValue((item,), (digest,))
        self.last.update((int(fresh[self.order].iloc[-1]),))
        yield fresh.drop(columns=["item_gone", "item_bad"]).assign(outcome=out)

    def close(self) -> None:
        pass


def applied(feed: DataFrame, current: DataFrame | None, *, by: list[str], item: str, digest: str, order: str, deleted: str, failed, sync_deletions: bool) -> DataFrame:
    """``operators.sync.outcomes`` over a stream: each item of the feed with its outcome, in the order of ``order`` (whole numbers
    that grow) within a key ``by``. Deleted items may come again. ``current``, a table, is what is there before the first item. A failed
    item changes nothing; an item that isn't above its key's last order has been applied before and gives nothing."""
    with_state_store(feed.sparkSession)
    kept = T.StructType([*feed.schema.fields, T.StructField("outcome", T.StringType())])
    marked = feed.withColumns({"item_gone": F.coalesce(F.col(deleted), F.lit(False)), "item_bad": F.coalesce(failed, F.lit(False))})
    start = current.select(*dict.fromkeys([*by, item, digest])).groupBy(*by) if current is not None else None
    return marked.groupBy(*by).transformWithStateInPandas(_Apply(item, digest, order, sync_deletions), kept, "append", "none", start)


class _Answers(StatefulProcessor):
    """List state: an answer's chunks. Value state: the last chunk's place, once it came; for answers that are out, a mark."""

    def __init__(self, pos: str, text: str, done: str, first: int, wait_ms: int) -> None:
        self.pos, self.text, self.done, self.first, self.wait = pos, text, done, first, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "pos bigint, text string")
        self.end = handle.getValueState("end", "pos bigint, out boolean")

    def _answer(self, key, held: dict[int, str], finished: bool) -> pd.DataFrame:
        self.chunks.clear()
        self.end.update((-1, True))
        return pd.DataFrame({"key": [list(map(str, key))], "answer": ["".join(held[p] or "" for p in sorted(held))], "finished": [finished]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end, out = self.end.get() if self.end.exists() else (None, False)
        if out:
            return  # repeated chunks of an answer that is out
        new, known = [], self.chunks.exists()
        for frame in rows:
            new += list(zip(frame[self.pos].astype(int), frame[self.text], strict=True))
            if frame[self.done].any():
                end = int(frame.loc[frame[self.done].astype(bool), self.pos].max())
        held = dict(self.chunks.get() if known else ()) | dict(new)
        if end is not None and len(held) == end - self.first + 1:
            for timer in list(self.handle.listTimers()) if self.wait else ():
                self.handle.deleteTimer(timer)
            yield self._answer(key, held, True)
            return
        self.chunks.appendList([(int(p), t) for p, t in new])
        if end is not None:
            self.end.update((end, False))
        if not known and self.wait > 0:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.chunks.exists():
            yield self._answer(key, dict(self.chunks.get()), False)

    def close(self) -> None:
        pass


def answers(chunks: DataFrame, by: list[str], pos: str, text: str, done: str, *, first: int = 0, wait_ms: int = 0) -> DataFrame:
    """``operators.sync.answers`` over a stream: (by, answer, finished). Chunks come in any order and trigger; an answer is out
    once, when its last chunk and all before it are there, or unfinished ``wait_ms`` after its first one (0: it waits on). Chunks
    that come after that give nothing. With ``wait_ms`` the query has to keep running for its timers."""
    with_state_store(chunks.sparkSession)
    made = chunks.groupBy(*by).transformWithStateInPandas(_Answers(pos, text, done, first, wait_ms), "key array<string>, answer string, finished boolean", "append", "processingTime" if wait_ms else "none")
    return made.select(*[F.col("key")[i].cast(chunks.schema[c].dataType).alias(c) for i, c in enumerate(by)], "answer", "finished")


def into_batches(df: DataFrame, path: str, checkpoint: str, **trigger):
    """A stream's rows as a table, a folder ``batch=n`` a trigger. A trigger that runs again - its task or the driver was lost
    before the checkpoint said that it was done - replaces its own folder, so nothing is there twice."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
