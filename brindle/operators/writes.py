"""Writes as pure functions from tables to tables; the caller writes the new version. Single-writer batches: no locks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_if_absent(current: DataFrame, rows: DataFrame, key: list[str], order: list[str], only: Column | None = None) -> DataFrame:
    """``current`` and those of ``rows`` whose key it doesn't hold (among its rows that meet ``only``), first of each key."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    fresh = rows.withColumn("_n", first).where("_n = 1").drop("_n")
    held = current.where(only) if only is not None else current
    return current.unionByName(fresh.join(held.select(*key).distinct(), key, "left_anti").select(*current.columns))


def upsert(current: DataFrame, rows: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """Rows of ``rows`` over those of ``current``; the columns ``keep`` survive from the old row. One full outer join."""
    old, new = current.withColumn("_old", F.lit(True)), rows.withColumn("_new", F.lit(True))
    new = new.select(*key, *[F.col(c).alias(f"_{c}_n") for c in rows.columns if c not in key], "_new")
    joined = old.join(new, key, "full")

    def value(c: str) -> Column:
        if c not in rows.columns:
            return F.col(c)
        fresh = F.col("_new") & F.col("_old").isNull() if c in keep else F.col("_new")
        return F.when(fresh, F.col(f"_{c}_n")).otherwise(F.col(c)).alias(c)

    return joined.select(*[F.col(c) if c in key else value(c) for c in current.columns])


def update_where(df: DataFrame, match: Column, values: dict[str, Column], live: str | None = None) -> DataFrame:
    """Columns rewritten where ``match`` holds (NULL counts as no), soft-deleted rows left alone."""
    hit = F.coalesce(match, F.lit(False)) & (F.col(live).isNull() if live else F.lit(True))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def soft_delete(df: DataFrame, match: Column, now: Column, mark: str = "deleted_at") -> DataFrame:
    return update_where(df, match, {mark: now}, live=mark)


def purge(df: DataFrame, ts: str, cutoff: Column | None) -> DataFrame:
    """Rows not older than the cutoff; None keeps everything."""
    return df if cutoff is None else df.where(~(F.col(ts) < cutoff) | F.col(ts).isNull())


# --- writes that also tell what they touched ------------------------------------------------------------------------------
#
# Each returns (new table, affected rows): what RETURNING or a row count is asked for. The caller writes the first.


def inserted(current: DataFrame, rows: DataFrame, id_col: str, order: list[str], bucket: Column) -> tuple[DataFrame, DataFrame]:
    """Rows appended with ids above the largest one, in ``order``. Ids are counted within (bucket) - a column that grows
    with the order - and put together from the buckets' sizes, so the rows are never numbered in one task."""
    top = current.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top")).scalar()
    salted = rows.withColumn("_b", bucket)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    first = salted.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    nth = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    fresh = salted.withColumn("_nth", nth).join(first, "_b").withColumn(id_col, (top + F.col("_first") + F.col("_nth")).cast("bigint")).select(*current.columns)
    return current.unionByName(fresh), fresh


def inserted_if_free(current: DataFrame, rows: DataFrame, unique: list[list[str]], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that clash with no stored row on any of the unique keys. Among each other the first by ``order`` wins, on one
    key after the other, so a row never loses to one that lost itself on an earlier key."""
    fresh = rows
    for key in unique:
        fresh = fresh.join(current.select(*key).distinct(), key, "left_anti")
    for key in unique:
        first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        fresh = fresh.withColumn("_n", first).where("_n = 1").drop("_n")
    fresh = fresh.select(*current.columns)
    return current.unionByName(fresh), fresh


def updated(df: DataFrame, match: Column, values: dict[str, Column], live: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``update_where`` and the rows it touched, as they are afterwards."""
    hit = F.coalesce(match, F.lit(False)) & (F.col(live).isNull() if live else F.lit(True))
    return update_where(df, match, values, live), df.where(hit).withColumns(values)


def replaced(df: DataFrame, rows: DataFrame, key: str, fixed: tuple[str, ...], live: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Whole rows written over those with their key, all columns but the fixed ones; keys that aren't stored do nothing."""
    columns = [c for c in df.columns if c in rows.columns and c not in (key, *fixed)]
    new = rows.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}_n") for c in columns])
    joined = df.join(new, key, "left")
    hit = F.col("_new").isNotNull() & (F.col(live).isNull() if live else F.lit(True))
    out = joined.select(*[F.when(hit, F.col(f"_{c}_n")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns], hit.alias("_hit"))
    return out.drop("_hit"), out.where("_hit").drop("_hit")


def upsert_live(current: DataFrame, rows: DataFrame, key: list[str], order: list[str], mark: str = "deleted_at") -> tuple[DataFrame, DataFrame]:
    """Live rows get the new values, the last of each key by ``order``; a dead row with the key stays dead beside a new one."""
    values = [c for c in current.columns if c not in (*key, mark)]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*key, "_v.*", F.lit(None).cast(current.schema[mark].dataType).alias(mark))
    kept = current.where(F.col(mark).isNotNull()).unionByName(current.where(F.col(mark).isNull()).join(last, key, "left_anti"))
    fresh = last.select(*current.columns)
    return kept.unionByName(fresh), fresh
