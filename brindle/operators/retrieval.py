"""Retrieval by published definitions: own designs for capabilities that are only declared upstream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similar(vectors: DataFrame, query: DataFrame, column: str) -> DataFrame:
    """``vectors`` with the cosine of ``column`` to one query vector. ``query`` has one row and one column; it is read by a
    scalar subquery when the plan runs, and without a row every score is NULL."""
    return vectors.withColumn("_q", query.scalar()).withColumn("score", F.round(cosine(F.col(column), F.col("_q")), 5)).drop("_q")


def nearest(vectors: DataFrame, query: DataFrame, k: int, least: float) -> DataFrame:
    """The k vectors with the largest cosine to one query, of those that reach ``least``; a top-k in each task, then one."""
    return similar(vectors, query, "embedding").where(F.col("score") >= least).orderBy(F.desc("score"), "vec_id").limit(k)


def chunks(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` code points, each ``size - overlap`` after the one before; the last may be shorter."""
    step, length = size - overlap, F.length(text_col)
    count = F.greatest(F.lit(1), F.ceil((length - overlap) / step)).cast("int")
    each = df.where(length > 0).select(id_col, F.posexplode(F.sequence(F.lit(0), count - 1)).alias("chunk_index", "_i"), text_col)
    return each.select(id_col, "chunk_index", F.substring(F.col(text_col), F.col("_i") * step + 1, F.lit(size)).alias("chunk"))


def separated_chunks(df: DataFrame, id_col: str, text_col: str, separator: str, size: int) -> DataFrame:
    """Pieces between separators, put together in order as long as a chunk has at most ``size`` code points. A longer piece
    is cut; empty pieces fall out. Each text is one fold over its own pieces."""
    length = lambda x: F.greatest(F.ceil(F.length(x) / size).cast("int"), F.lit(1))
    cut = lambda x: F.transform(F.sequence(F.lit(0), length(x) - 1), lambda i: F.substring(x, i * size + 1, F.lit(size)))
    pieces = F.filter(F.flatten(F.transform(F.split(text_col, separator), cut)), lambda x: x != "")

    def joined(state: Column, x: Column) -> Column:
        fits = (F.length(state["open"]) > 0) & (F.length(state["open"]) + F.length(x) + 1 <= size)
        done = F.when(fits | (state["open"] == ""), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(done.alias("done"), F.when(fits, F.concat(state["open"], F.lit(separator), x)).otherwise(x).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    folded = F.aggregate(pieces, start, joined, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return df.select(id_col, F.posexplode(folded).alias("chunk_index", "chunk"))


def neighbours(df: DataFrame, by: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("pre", F.lag(order).over(w)).withColumn("next", F.lead(order).over(w))


def fused(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (key, rank) lists."""
    every = lists[0]
    for other in lists[1:]:
        every = every.unionByName(other)
    return every.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))
