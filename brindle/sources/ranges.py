"""A connector's feed read in ranges on the executors, and a place where a feed's items go.

Reading: the driver only asks the connector how far it has come (``head``); a trigger's offsets are cut into ranges that tasks
fetch on their own, so a range that fails is fetched again and the checkpoint moves on when the trigger is done. A range is
asked for as often as the connector returns less than it holds.

Writing: each task stages its items in its job's own place, the driver publishes what the tasks tell it at the end and takes back
the rest of that place, all of it if the job fails: tasks that are killed have staged items that they never tell of. A stream's
trigger is published once, also if it runs again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from brindle.sources.feed import SCHEMA, Fetch


@dataclass
class Range(InputPartition):
    start: int
    end: int


def _ranges(start: int, end: int, page: int) -> list[Range]:
    return [Range(a, min(a + page, end)) for a in range(start, end, page)]


def _fetched(fetch: Fetch, part: Range) -> Iterator[tuple]:
    at = part.start
    while at < part.end:
        rows, to = fetch(at, part.end - at)
        if to <= at:
            raise RuntimeError(f"the connector ends at {at}, before {part.end}, which it has told of")
        yield from rows
        at = to


class _Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, head: Callable[[], int], page: int) -> None:
        self.fetch, self.head, self.page = fetch, head, page

    def partitions(self) -> list[Range]:
        return _ranges(0, self.head(), self.page)

    def read(self, partition: Range) -> Iterator[tuple]:
        return _fetched(self.fetch, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, fetch: Fetch, head: Callable[[], int], page: int, done: Callable[[int], None] | None) -> None:
        self.fetch, self.head, self.page, self.done = fetch, head, page, done

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"cursor": self.head()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges(start["cursor"], end["cursor"], self.page)

    def read(self, partition: Range) -> Iterator[tuple]:
        return _fetched(self.fetch, partition)

    def commit(self, end: dict) -> None:
        """Called when everything before ``end`` has been written: the connector may let go of it."""
        if self.done is not None:
            self.done(end["cursor"])


def register(spark: SparkSession, name: str, fetch: Fetch, head: Callable[[], int], done: Callable[[int], None] | None = None, schema: str = SCHEMA) -> None:
    """``spark.read.format(name)`` and ``spark.readStream.format(name)``; the option ``page`` is the size of a range."""

    class RangedFeed(DataSource):  # made here so that it travels to the workers with its connector
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetch, head, int(self.options.get("page", "1000")))

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
            return _StreamReader(fetch, head, int(self.options.get("page", "1000")), done)

    spark.dataSource.register(RangedFeed)


# --- the write side -------------------------------------------------------------------------------------------------------


class Ingestor(Protocol):
    """Where items go. ``stage`` is called in tasks, the others on the driver."""

    def begin(self, job: str) -> None:
        """Makes the place where a job's tasks stage; again for a job that has it changes nothing."""

    def stage(self, job: str, rows: Iterator[dict]) -> str | None:
        """Puts a task's items where nobody sees them yet; a name for them, None if there were none."""

    def publish(self, job: str, names: list[str], batch: int | None) -> None:
        """Makes these staged items visible, all of a batch or none, and takes back what else the job has staged; a batch that
        was published before changes nothing."""

    def discard(self, job: str) -> None:
        """Takes back all that a job has staged, told of or not."""


class FolderIngestor:
    """Items as lines of JSON in a folder that all machines share (any file system that pyarrow opens), for one stream at most. A
    manifest names the files of a batch: readers take the files that manifests name (``published``). Staged files are moved beside
    the published ones by the driver. A task that is still being killed can't stage anything once its job's folder is gone; on
    stores without real folders it may leave a file under ``staged``, which nothing reads."""

    def __init__(self, uri: str) -> None:
        self.uri = uri

    def _at(self, *parts: str):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.uri)
        return store, "/".join((root.rstrip("/"), *parts))

    def _drop(self, *parts: str) -> None:
        from pyarrow import fs

        store, path = self._at(*parts)
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_file(path)

    def begin(self, job: str) -> None:
        store, path = self._at("staged", job)
        store.create_dir(path)

    def stage(self, job: str, rows: Iterator[dict]) -> str | None:
        first = next(rows, None)
        if first is None:
            return None
        name = f"{uuid.uuid4().hex}.jsonl"
        store, path = self._at("staged", job, name)
        try:
            with store.open_output_stream(path) as out:
                out.write((json.dumps(first, default=str) + "\n").encode())
                for row in rows:
                    out.write((json.dumps(row, default=str) + "\n").encode())
        except BaseException:
            self._drop("staged", job, name)
            raise
        return name

    def publish(self, job: str, names: list[str], batch: int | None) -> None:
        from pyarrow import fs

        label = uuid.uuid4().hex if batch is None else f"batch-{batch}"
        store, path = self._at("manifests", f"{label}.json")
        if store.get_file_info(path).type == fs.FileType.NotFound:
            store.create_dir(path.rpartition("/")[0])
            store.create_dir(self._at("items")[1])
            try:
                for name in names:
                    store.move(self._at("staged", job, name)[1], self._at("items", name)[1])
                with store.open_output_stream(f"{path}.new") as out:
                    out.write(json.dumps(names).encode())
            except BaseException:
                for name in names:
                    self._drop("items", name)
                raise
            store.move(f"{path}.new", path)
        self.discard(job)

    def discard(self, job: str) -> None:
        from pyarrow import fs

        store, path = self._at("staged", job)
        for left in reversed(range(10)):
            if store.get_file_info(path).type == fs.FileType.NotFound:
                return
            try:
                store.delete_dir(path)
            except OSError:  # a task that is being killed has just made a file there
                if not left:
                    raise

    def published(self) -> list[str]:
        """The files of all published batches."""
        from pyarrow import fs

        store, root = self._at("manifests")
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = []
        for info in found:
            if info.path.endswith(".json"):
                with store.open_input_stream(info.path) as f:
                    names += json.loads(f.read())
        return [f"{self.uri.rstrip('/')}/items/{n}" for n in names]


@dataclass
class Staged(WriterCommitMessage):
    name: str | None


def _names(messages) -> list[str]:
    return [m.name for m in messages if m is not None and m.name]


class _Writer(DataSourceWriter):
    def __init__(self, ingestor: Ingestor, job: str) -> None:
        self.ingestor, self.job = ingestor, job
        ingestor.begin(job)

    def write(self, iterator) -> Staged:
        return Staged(self.ingestor.stage(self.job, (row.asDict(recursive=True) for row in iterator)))

    def commit(self, messages) -> None:
        self.ingestor.publish(self.job, _names(messages), None)

    def abort(self, messages) -> None:
        self.ingestor.discard(self.job)


class _StreamWriter(DataSourceStreamWriter):
    """Spark makes one for a trigger's tasks and another one for its end, so both know the job by a fixed name."""

    def __init__(self, ingestor: Ingestor, job: str = "stream") -> None:
        self.ingestor, self.job = ingestor, job
        ingestor.begin(job)

    def write(self, iterator) -> Staged:
        return Staged(self.ingestor.stage(self.job, (row.asDict(recursive=True) for row in iterator)))

    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        self.ingestor.publish(self.job, _names(messages), batchId)

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        self.ingestor.discard(self.job)


def register_sink(spark: SparkSession, name: str, ingestor: Ingestor) -> None:
    """``df.write.format(name)`` (mode append) and ``df.writeStream.format(name)``."""

    class ItemSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            if overwrite:
                raise ValueError("items are only added")
            return _Writer(ingestor, uuid.uuid4().hex)

        def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
            return _StreamWriter(ingestor)

    spark.dataSource.register(ItemSink)
