"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import written


def _signature(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, most_rounds: int = 50, rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v, both long, not null): root is the smallest node of its component.

    A node's neighbours are never gathered: each step takes a grouped minimum (combined in each task first) and joins it
    back, so a node with any number of links stays spread. Each round is written to the shared folder. With ``rounds``
    it stops early: nodes with the same root are connected then, but connected ones may have different roots.
    """
    edges = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _signature(edges)
    for done in range(most_rounds if before[0] else 0):
        if done == rounds:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "links")
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if rounds is not None:
        least = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        return least
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
