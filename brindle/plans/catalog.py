"""All queries of the library by name, each with independently written DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.plans import changes, evaluation, feeds, listings, lookups, overview, policies, projections, ranked, search, updates

MODULES = (overview, lookups, listings, projections, policies, changes, updates, feeds, search, evaluation, ranked)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
