"""Lookups, pages, overlays and guards over plain DataFrames. Nothing here acts; every function returns a plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def live(df: DataFrame, mark: str = "deleted_at") -> DataFrame:
    """Rows that aren't soft-deleted; tables without the mark are live as a whole."""
    return df.where(F.col(mark).isNull()) if mark in df.columns else df


def where_equal(df: DataFrame, wanted: dict) -> DataFrame:
    """All of the given values, None meaning NULL; an empty or unknown column list is an error before any plan is made."""
    if not wanted:
        raise ValueError("no column to look up")
    if unknown := set(wanted) - set(df.columns):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    return df.where(reduce(Column.__and__, [F.col(c).isNull() if v is None else F.col(c) == v for c, v in wanted.items()]))


def where_given(df: DataFrame, wanted: dict) -> DataFrame:
    """Like ``where_equal``, but None and '' mean: any value."""
    given = {c: v for c, v in wanted.items() if v not in (None, "")}
    return where_equal(df, given) if given else df


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The live row with this primary key, if there is one; key and mark reach the scan."""
    return live(where_equal(df, {key: value})).limit(1)


def by_keys(df: DataFrame, key: str, values: list) -> DataFrame:
    """The rows with one of these keys; no keys give no rows, without reading any."""
    if not values:
        return df.sparkSession.createDataFrame([], df.schema)
    return df.where(F.col(key).isin(*values))


def first_match(df: DataFrame, wanted: dict, order: list[Column]) -> DataFrame:
    """The first live row, in ``order``, with all of these values."""
    return live(where_equal(df, wanted)).orderBy(*order).limit(1)


def or_fail(rows: DataFrame, code: str) -> DataFrame:
    """One row, or the error ``code`` when the plan runs and there is none: a global aggregate has a row in any case."""
    one = rows.limit(1).agg(F.first(F.struct("*")).alias("_row"))
    return one.select(F.when(F.col("_row").isNull(), F.raise_error(F.lit(code))).otherwise(F.col("_row")).alias("_row")).select("_row.*")


def ordered(*specs: str) -> list[Column]:
    """Sort columns of "name" or "name desc" with NULL as the largest value: last when ascending, first when descending."""
    return [F.col(s.split()[0]).desc_nulls_first() if s.endswith(" desc") else F.col(s.split()[0]).asc_nulls_last() for s in specs]


def allowed_order(spec: str | None, allowed: tuple[str, ...], key: str) -> list[Column]:
    """The order that a caller asked for, from an allow-list, with ``key`` to part ties; unknown names are errors."""
    if spec and spec.split()[0] not in allowed:
        raise ValueError(f"can't order by {spec!r}")
    return ordered(*([spec] if spec else []), key)


def numbered(page: DataFrame, order: list[Column]) -> DataFrame:
    """A page's rows with their places from 1 on; only for rows that a limit bounds."""
    return page.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def page_if_asked(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """A page if both numbers are positive, else all rows."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size) if page > 0 and size > 0 else df.orderBy(*order)


def checked_page(df: DataFrame, order: list[Column], limit: int, offset: int, most: int = 100) -> DataFrame:
    """Like ``offset_page``, but numbers out of range are errors."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit has to be within 1 and {most}, offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def first_items(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` items; 0 means all of them."""
    return df.orderBy(*order).limit(most) if most > 0 else df


def optional_rows(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A table that need not exist yet: no rows of ``schema`` then. Other errors of reading it are not swallowed."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def offset_page(df: DataFrame, order: list[Column], page: int, size: int, most: int = 100) -> DataFrame:
    """Page and size clamped to 1 and 1..most. Only a page's rows leave the top-n sort of each task."""
    page, size = max(1, page), min(max(1, size), most)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def keyset_page(df: DataFrame, key: str, after: int, size: int, most: int = 100) -> DataFrame:
    """The next rows below ``after`` (0: from the top), largest first; the bound reaches the scan."""
    rows = df.where(F.col(key) < after) if after > 0 else df
    return rows.orderBy(F.desc(key)).limit(min(max(1, size), most))


def _ahead(spec: str, value) -> Column:
    """Whether a row comes before a value by one sort column, NULL being the largest (``ordered``)."""
    c = F.col(spec.split()[0])
    if spec.endswith(" desc"):
        return F.lit(False) if value is None else c.isNull() | F.coalesce(c > F.lit(value), F.lit(False))
    return c.isNotNull() if value is None else F.coalesce(c < F.lit(value), F.lit(False))


def _before(specs: list[str], row) -> Column:
    """Whether a row comes before ``row`` by all sort columns."""
    out = F.lit(False)
    for spec in reversed(specs):
        name = spec.split()[0]
        out = _ahead(spec, row[name]) | (F.col(name).eqNullSafe(F.lit(row[name])) & out)
    return out


def deep_page(df: DataFrame, specs: list[str], offset: int, size: int, ranges: int = 32, rows_a_range: int = 1_000_000) -> DataFrame:
    """The rows from ``offset`` on in the order of ``specs`` (as in ``ordered``; together they tell rows apart), at any depth.

    A bounded sample gives the edges of ``ranges`` ranges; their rows are counted in one pass, and the ranges that hold the page are
    cut again in the same way until they have about ``rows_a_range`` rows. Only these are sorted, where offset and limit of all
    rows would send ``offset + size`` of them to one task."""
    names = [s.split()[0] for s in specs]
    inside, skip = df, offset
    count = df.count()
    while count > rows_a_range + size:
        share = min(1.0, 40.0 * ranges / count)
        sample = inside.select(*names).where(F.pmod(F.xxhash64(*names), F.lit(1 << 30)) < int(share * (1 << 30))).distinct().orderBy(*ordered(*specs)).limit(100 * ranges).collect()
        edges = sample[len(sample) // ranges :: max(1, len(sample) // ranges)]
        part = sum((~_before(specs, e)).cast("int") for e in edges) if edges else F.lit(0)
        sizes = dict(inside.groupBy(part.alias("part")).count().collect())  # a row a range
        first = last = None
        upto = 0
        for i in sorted(sizes):
            if first is None and upto + sizes[i] > skip:
                first, before = i, upto
            upto += sizes[i]
            if first is not None and upto >= skip + size:
                last = i
                break
        if first is None:
            return df.limit(0)
        last = max(sizes) if last is None else last
        now = sum(sizes[i] for i in sizes if first <= i <= last)
        if now > 0.9 * count:
            break  # equal rows, or a page of nearly everything
        low = ~_before(specs, edges[first - 1]) if first else F.lit(True)
        inside = inside.where(low & (_before(specs, edges[last]) if last < len(edges) else F.lit(True)))
        skip, count = skip - before, now
    return inside.orderBy(*ordered(*specs)).offset(skip).limit(size)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the last by ``order``: an aggregate that is combined in each task first, so no key's rows meet."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def overlay(registry: DataFrame, stored: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """The registry's rows with the stored value or else the default; rows that are only stored stay out."""
    kept = stored.select(key, F.col(value).alias("_stored"))
    return registry.join(kept, key, "left").withColumn(value, F.coalesce("_stored", default)).drop("_stored")


def merged(local: DataFrame, remote: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Local rows with the remote's non-null columns over their own, then rows that are only remote."""
    over = remote.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    both = local.join(over, key, "left").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns], F.lit("local").alias("origin"))
    return both.unionByName(remote.join(local, key, "left_anti").select(key, *columns, F.lit("remote").alias("origin")))


def in_order(ids: DataFrame, rows: DataFrame, key: str, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Rows by a list of ids (pos, key), sorted by its ``order``: repeats stay, missing ids fall out."""
    return ids.join(rows, key, "inner").orderBy(*order)


def marked(df: DataFrame, others: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with a flag that tells whether the key stands in ``others``."""
    return df.join(others.select(key).distinct().withColumn("_in", F.lit(True)), key, "left").withColumn(name, F.col("_in").isNotNull()).drop("_in")


def unreferenced(df: DataFrame, key: str, *references: DataFrame) -> DataFrame:
    """Rows whose key none of the one-column references holds."""
    for r in references:
        df = df.join(r.toDF(key), key, "left_anti")
    return df
