"""The nearest vectors for a table of queries: an inverted-file index of k-means cells, and the same search over all rows.

Cells are fitted on a bounded sample (``SAMPLE`` rows, the lowest hashes of their ids); every row is assigned to its cell. A
query looks into its nearest cells and gets exact cosines there. Rows of a cell are dealt to shards of about ``SHARD`` rows
and its queries to blocks of about ``QUERIES``, both by counts, so a cell that holds a third of all rows is many tasks; each
task multiplies one shard with one block and passes on k rows a query at most.

With one cell the search is exact over all rows. ``calibrated`` measures the recall on a sample of queries and takes as many
cells as it needs. Null vectors and those of length 0 have no direction: they are never found and find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.work import written

SAMPLE, ROUNDS, MOST_CELLS = 50_000, 12, 4096
SHARD, QUERIES = 20_000, 1_000
DIGITS = 5


@dataclass(frozen=True)
class Index:
    rows: DataFrame  # id, cell, vec
    centres: np.ndarray  # unit length, a row a cell


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _told(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.where(F.exists("vec", lambda x: x != 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))


def fitted(rows: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centres of spherical k-means on at most ``sample`` rows; about the square root of the number of rows, ``MOST_CELLS`` at most."""
    count = rows.count()
    cells = min(cells or int(count**0.5), MOST_CELLS, count)
    if cells <= 1:
        return np.zeros((1, 1))
    share = min(1.0, 0.9 * sample / count)  # hashes are even, so this stays below the limit but for odds that don't count
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("id"), "id").limit(sample)
    x = _matrix(chosen.select("vec").toArrow()["vec"].combine_chunks())
    cells = min(cells, len(x))
    if cells <= 1:
        return np.zeros((1, 1))
    centres = x[:: len(x) // cells][:cells].copy()
    for _ in range(ROUNDS):
        cell = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-300), centres)
    return centres


def _assign(centres: np.ndarray, probes: int):
    """Rows -> a row for each of their nearest ``probes`` cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if len(centres) == 1 or not n:
                near = np.zeros((n, 1), np.int32)
            else:
                score = _matrix(batch.column(1)) @ centres.T
                near = np.argsort(-score, axis=1, kind="stable")[:, :probes].astype(np.int32)
            out = batch.take(pa.array(np.repeat(np.arange(n), near.shape[1])))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(near.ravel())], names=["id", "vec", "cell"])

    return run


def _celled(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    return rows.mapInArrow(_assign(centres, probes), f"id {rows.schema['id'].dataType.simpleString()}, vec array<double>, cell int")


def build(df: DataFrame, id_col: str, vec_col: str, cells: int | None = None, sample: int = SAMPLE) -> Index:
    rows = _told(df, id_col, vec_col)
    centres = fitted(rows, cells, sample)
    return Index(written(_celled(rows, centres, 1), "cells"), centres)


def _best(k: int):
    """One shard's rows and one block's queries -> the best k rows of each query."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, q = _matrix(left["vec"].combine_chunks()), _matrix(right["vec"].combine_chunks())
        ids, names = left["id"].combine_chunks(), right["id"].combine_chunks()
        parts = []
        if len(x) and len(q):
            by_id = np.asarray(pa.compute.sort_indices(ids))
            place = np.empty(len(x), np.int64)
            place[by_id] = np.arange(len(x))
            for at in range(0, len(q), 64):
                score = np.round(q[at : at + 64] @ x.T, DIGITS) + 0.0
                take = min(k, len(x))
                least = -np.partition(-score, take - 1, axis=1)[:, take - 1]
                for i, row in enumerate(score):
                    held = np.flatnonzero(row >= least[i])
                    held = held[np.lexsort((place[held], -row[held]))][:take]
                    parts.append(pa.table({"query": names.slice(at + i, 1).take(pa.array(np.zeros(len(held), np.int64))), "id": ids.take(pa.array(held)), "score": pa.array(row[held])}))
        if parts:
            return pa.concat_tables(parts)
        return pa.table({"query": names.slice(0, 0), "id": ids.slice(0, 0), "score": pa.array([], pa.float64())})

    return run


def _dealt(rows: DataFrame, own: str, size: int, counts: DataFrame, other: str) -> DataFrame:
    """``rows`` in the parts of their cell, ``size`` of them each, once for every part of the cell's other side."""
    n = lambda c, s: F.greatest(F.lit(1), F.ceil(F.col(c) / s))
    known = rows.join(counts, "cell").withColumn(f"{own}_part", F.pmod(F.xxhash64("id"), n(own, size)).cast("int"))
    times = n(other, QUERIES if other == "queries" else SHARD)
    return known.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), (times - 1).cast("int")))).select("cell", "rows_part", "queries_part", "id", "vec")


def search(index: Index, queries: DataFrame, id_col: str, vec_col: str, k: int, probes: int, least: float | None = None) -> DataFrame:
    """(query, rank, id, score): the k largest cosines for each query in its nearest ``probes`` cells, ``least`` at least; ties
    (to ``DIGITS`` digits) go to smaller ids."""
    asked = written(_celled(_told(queries, id_col, vec_col), index.centres, probes), "asked")
    counts = index.rows.groupBy("cell").agg(F.count("*").alias("rows")).join(asked.groupBy("cell").agg(F.count("*").alias("queries")), "cell")
    counts = written(counts, "counts")  # a row a cell, MOST_CELLS at most
    keys = ["cell", "rows_part", "queries_part"]
    left, right = _dealt(index.rows, "rows", SHARD, counts, "queries"), _dealt(asked, "queries", QUERIES, counts, "rows")
    schema = f"query {asked.schema['id'].dataType.simpleString()}, id {index.rows.schema['id'].dataType.simpleString()}, score double"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best(k), schema)
    if least is not None:
        found = found.where(F.col("score") >= least)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def exact(df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int, least: float | None = None) -> DataFrame:
    """The same over all rows."""
    return search(build(df, id_col, vec_col, cells=1), queries, id_col, vec_col, k, 1, least)


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """The share of ``wanted`` that is ``found``."""
    total = wanted.count()
    return found.join(wanted, ["query", "id"], "left_semi").count() / total if total else 1.0


def calibrated(index: Index, queries: DataFrame, id_col: str, vec_col: str, k: int, target: float = 0.95, most: int = 200) -> tuple[int, float]:
    """(probes, recall): as many cells as it takes for ``target`` on a sample of at most ``most`` queries, held against all rows."""
    sample = queries.orderBy(F.xxhash64(id_col), id_col).limit(most)
    wanted = written(search(Index(index.rows.withColumn("cell", F.lit(0)), np.zeros((1, 1))), sample, id_col, vec_col, k, 1), "wanted")
    probes = 1
    while True:
        share = recall(search(index, sample, id_col, vec_col, k, probes), wanted)
        if share >= target or probes >= len(index.centres):
            return probes, share
        probes = min(2 * probes, len(index.centres))
