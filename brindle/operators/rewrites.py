"""Writes into a Parquet table that rewrite the partitions they touch and leave the other files as they are.

The rows of the touched partitions go through one of the pure functions of ``writes``; a dynamic partition overwrite then
replaces just these folders when all of the job's tasks are done, and folders that nothing is left for are deleted. One writer
at a time, like there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import writes
from brindle.sources.work import written

#: Partitions that a write may name in its filter; beyond that the rows are found by a semi join.
NAMED = 10_000


def _values(df: DataFrame, partition: list[str]) -> DataFrame:
    return written(df.select(*partition).distinct(), "touched")


def _within(df: DataFrame, touched: DataFrame, partition: list[str]) -> DataFrame:
    """The rows of the touched partitions; few partitions are named in the filter, so only their folders are listed and read."""
    named = touched.limit(NAMED + 1).collect()
    if len(named) > NAMED:
        return df.join(touched, reduce(Column.__and__, [df[c].eqNullSafe(touched[c]) for c in partition]), "left_semi")
    alike = lambda row: reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(row[c])) for c in partition])
    if len(partition) == 1 and all(row[0] is not None for row in named):
        return df.where(F.col(partition[0]).isin([row[0] for row in named])) if named else df.limit(0)
    return df.where(reduce(Column.__or__, map(alike, named))) if named else df.limit(0)


def rewritten(spark: SparkSession, path: str, partition: list[str], touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
    """Replaces the rows of the touched partitions (a table of their values) by ``change`` of them. What ``change`` gives has to
    stay in touched partitions."""
    current = spark.read.parquet(path)
    touched = _values(touched, partition)
    inside = _within(current, touched, partition)
    folders = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1)
    before = {r[0] for r in inside.select(folders).distinct().collect()}  # a row a touched partition
    out = written(change(inside).select(*current.columns), "rewrite")  # read in full before anything is replaced
    kept = {tuple(r) for r in out.select(*partition).distinct().collect()}
    gone = [r for r in touched.collect() if tuple(r) not in kept]
    empty = _within(current, spark.createDataFrame(gone, touched.schema), partition).select(folders).distinct().collect() if gone and before else []
    out.repartition(*partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)
    for row in empty:
        at = spark._jvm.org.apache.hadoop.fs.Path(row[0])
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _homes(spark: SparkSession, path: str, rows: DataFrame, key: list[str], partition: list[str]) -> DataFrame:
    """The partitions that hold rows with these keys. Only the key's columns are read."""
    return spark.read.parquet(path).select(*dict.fromkeys([*key, *partition])).join(rows.select(*key).distinct(), key, "left_semi").select(*partition)


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: list[str], keep: list[str], partition: list[str]) -> None:
    """``writes.upsert`` in place: rows may come from, and go to, any partition."""
    rows = written(rows, "rows")
    touched = _homes(spark, path, rows, key, partition).unionByName(rows.select(*partition))
    rewritten(spark, path, partition, touched, lambda inside: writes.upsert(inside, rows, key, keep))


def replace(spark: SparkSession, path: str, rows: DataFrame, key: str, fixed: tuple[str, ...], partition: list[str], live: str | None = None) -> None:
    """``writes.replaced`` in place."""
    rows = written(rows, "rows")
    touched = _homes(spark, path, rows, [key], partition)
    if all(c in rows.columns for c in partition):
        touched = touched.unionByName(rows.select(*partition))
    rewritten(spark, path, partition, touched, lambda inside: writes.replaced(inside, rows, key, fixed, live)[0])


def update(spark: SparkSession, path: str, match: Column, values: dict[str, Column], partition: list[str], live: str | None = None) -> None:
    """``writes.update_where`` in place; partition columns can't be set."""
    if set(values) & set(partition):
        raise ValueError(f"partition columns {sorted(set(values) & set(partition))} can't be set")
    hit = F.coalesce(match, F.lit(False))
    touched = spark.read.parquet(path).where(hit).select(*partition)
    rewritten(spark, path, partition, touched, lambda inside: writes.update_where(inside, match, values, live))


def delete(spark: SparkSession, path: str, match: Column, partition: list[str]) -> None:
    """Rows that match go."""
    hit = F.coalesce(match, F.lit(False))
    touched = spark.read.parquet(path).where(hit).select(*partition)
    rewritten(spark, path, partition, touched, lambda inside: inside.where(~hit))
