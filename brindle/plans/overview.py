"""Each data source with its latest sync log and the total of items it ever brought in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.tables import table


def source_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the logs: latest log by ``max_by`` and total by ``sum`` in the same (map-side combined) aggregate,
    so neither a window's sort nor a second shuffle of the logs is needed; sources without logs stay."""
    logs = table(spark, sf_dir, "lineitem")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    done = F.when(F.col("l_returnflag").isin("A", "R"), F.col("l_quantity").cast("bigint"))
    by_source = logs.groupBy("l_suppkey").agg(F.max(order).alias("latest"), F.coalesce(F.sum(done), F.lit(0)).cast("bigint").alias("total_items"))
    sources = table(spark, sf_dir, "supplier")
    return sources.join(by_source, sources.s_suppkey == by_source.l_suppkey, "left").select(
        "s_suppkey", "s_name", F.col("latest.l_shipdate").alias("latest_at"), F.col("latest.l_orderkey").alias("latest_order"),
        F.col("latest.l_linenumber").alias("latest_line"), F.coalesce("total_items", F.lit(0)).alias("total_items"),
    )


QUERIES = {"source_overview": source_overview}
SQL = {
    "source_overview": """
with ranked as (select *, row_number() over (partition by l_suppkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) as r from lineitem),
total as (select l_suppkey, sum(case when l_returnflag in ('A', 'R') then cast(l_quantity as bigint) else 0 end)::bigint as total_items from lineitem group by 1)
select s_suppkey, s_name, l_shipdate as latest_at, l_orderkey as latest_order, l_linenumber as latest_line, coalesce(total_items, 0)::bigint as total_items
from supplier left join ranked on ranked.l_suppkey = s_suppkey and r = 1 left join total on total.l_suppkey = s_suppkey
"""
}
