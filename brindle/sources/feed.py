"""A connector as a Spark data source: full reads in batch, cursor-driven increments as a stream.

``register(spark, name, fetch)`` once, then ``spark.read.format(name)`` or ``spark.readStream.format(name)``; registering a
name again replaces the connector. ``fetch(start, most) -> (rows, next)``; the stream's checkpoint holds the cursor, so a run
goes on where the last one ended and never passes over rows that it did not return.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

SCHEMA = "external_id string, title string, content string, url string, updated_at timestamp, is_deleted boolean"
Fetch = Callable[[int, int], tuple[list[tuple], int]]


class FullReader(DataSourceReader):
    def __init__(self, fetch: Fetch, page: int) -> None:
        self.fetch, self.page = fetch, page

    def read(self, partition) -> Iterator[tuple]:
        at = 0
        while True:
            rows, to = self.fetch(at, self.page)
            yield from rows
            if to == at:
                return
            at = to


class CursorReader(SimpleDataSourceStreamReader):
    def __init__(self, fetch: Fetch, page: int) -> None:
        self.fetch, self.page = fetch, page

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, to = self.fetch(start["cursor"], self.page)
        return iter(rows), {"cursor": to}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        rows, _ = self.fetch(start["cursor"], end["cursor"] - start["cursor"])
        return iter(rows)


def register(spark: SparkSession, name: str, fetch: Fetch) -> None:
    class FeedSource(DataSource):  # made here so that it travels to the workers with its connector
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return FullReader(fetch, int(self.options.get("page", "1000")))

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
            return CursorReader(fetch, int(self.options.get("page", "1000")))

    spark.dataSource.register(FeedSource)
