"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import conversations, decontam, fim, jaccard, langid, licenses, packing, quality, repeats, secrets, sharding, tokens, toxicity

MODULES = (secrets, packing, repeats, decontam, tokens, licenses, langid, quality, toxicity, jaccard, conversations, sharding, fim)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
