"""A change feed against a table: what to do with each item, and how a run went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.sources.work import written


def outcomes(current: DataFrame, feed: DataFrame, key: str, digest: str, *, deleted: str, failed: Column, sync_deletions: bool) -> DataFrame:
    """Each item of the feed with an outcome: failed, deleted, created, updated or skipped. One left join by key."""
    known = current.select(key, F.col(digest).alias("_known"), F.lit(True).alias("_held"))
    gone = F.when(F.col("_held") & F.lit(sync_deletions), "deleted").otherwise("skipped")
    kind = F.when(failed, "failed").when(F.col(deleted), gone).when(F.col("_held").isNull(), "created").when(F.col(digest) == F.col("_known"), "skipped").otherwise("updated")
    return feed.join(known, key, "left").withColumn("outcome", kind).drop("_known", "_held")


def tally(done: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each outcome and the run's status: no failures is success, nothing but failures failed, else partial."""
    count = lambda k: F.count(F.when(F.col("outcome") == k, 1)).alias(k)
    out = done.groupBy(*by).agg(F.count("*").alias("total"), *map(count, ("created", "updated", "deleted", "skipped", "failed")))
    status = F.when(F.col("failed") == 0, "success").when(F.col("failed") >= F.col("total"), "failed").otherwise("partial")
    return out.withColumn("status", status)


def error_samples(done: DataFrame, by: list[str], pos: str, text: str, most: int = 20) -> DataFrame:
    """The first ``most`` errors of each run, joined; ranked with a group limit, so at most ``most`` rows a run and task move."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(*by).orderBy(pos))
    first = done.where("outcome = 'failed'").withColumn("_n", nth).where(F.col("_n") <= most)
    return first.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", text))), lambda x: x[text]), "; ").alias("errors"))


def run_plan(*, force_full: Column, mode: Column, cursor: Column) -> Column:
    """Whether a run goes on from its cursor or fetches everything."""
    return F.when(~force_full & (mode != "full") & cursor.isNotNull(), "incremental").otherwise("full")


def source_status(run: Column, before: Column) -> Column:
    """What a source's status is after a run: an error if all failed, else paused if it was, else active."""
    return F.when(run == "failed", "error").when(before == "paused", "paused").otherwise("active")


def stale_children(stored: DataFrame, parents: DataFrame, child: str, parent: str, keep: str, mark: str = "#") -> DataFrame:
    """Stored children (``parent#...``) of the feed's parents that the parent's keep-list doesn't hold; an empty list keeps
    none. The parent is cut out of the child's id, so this is a join by key; a parent's id may hold marks itself, so every
    prefix that ends at a mark is tried."""
    parts = F.split(child, mark)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), mark))
    spread = stored.where(F.col(child).contains(mark)).withColumn(parent, F.explode(prefixes))
    return spread.join(parents, parent).where(~F.coalesce(F.array_contains(keep, F.col(child)), F.lit(False))).select(*stored.columns).distinct()


def merged_by_rule(current: DataFrame, feed: DataFrame, key: str, value: str, rule: str) -> DataFrame:
    """Items of a feed beside stored ones; where both have the key, ``rule`` (a column of the feed) says overwrite or skip."""
    new = feed.select(key, F.col(value).alias("_new"), F.col(rule).alias("_rule"))
    joined = current.join(new, key, "full")
    kept = F.when(F.col(value).isNull() | ((F.col("_rule") == "overwrite") & F.col("_new").isNotNull()), F.col("_new")).otherwise(F.col(value))
    return joined.select(key, kept.alias(value))


def _parents(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    return nodes.select(F.col(node).alias("_n"), F.col(parent).alias("_p")).where("_n is not null and _p is not null").distinct()


def _jump_on(jumps: DataFrame) -> DataFrame:
    """Jumps of twice the length."""
    return jumps.join(jumps.select(F.col("_n").alias("_p"), F.col("_p").alias("_q")), "_p").select("_n", F.col("_q").alias("_p")).distinct()


def tree_ancestors(nodes: DataFrame, asked: DataFrame, node: str, parent: str) -> DataFrame:
    """Distinct ancestors of the asked nodes, each once, in a tree of any depth, by doubled jumps: with jumps of 2**i steps those
    found so far, at most 2**i steps away, give the ones up to 2**(i + 1) away. So there are about log2(depth) rounds, each a
    join by key and written. In a cycle a node is its own ancestor; the rounds end all the same (see ``tree_cycles``). Leaves
    that weren't asked for aren't jumped from."""
    edges = _parents(nodes, node, parent)
    inner = edges.join(edges.select(F.col("_p").alias("_n")).distinct(), "_n", "left_semi")
    jumps = written(inner, "jumps")
    found = written(edges.join(asked.select(F.col(node).alias("_n")).distinct(), "_n", "left_semi").select(F.col("_p").alias("_n")).distinct(), "ancestors")
    count = found.count()
    while True:
        more = found.join(jumps, "_n").select(F.col("_p").alias("_n"))
        found = written(found.union(more).distinct(), "ancestors")
        before, count = count, found.count()
        if count == before:  # nothing one step beyond them is new
            return found.select(F.col("_n").alias(node))
        jumps = written(_jump_on(jumps), "jumps")


def tree_cycles(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """The nodes that stand on a cycle, where a node has one parent at most. Jumps of more steps than there are nodes end on a
    cycle or nowhere, and every node of a cycle is the end of one; leaves need no jumps."""
    edges = _parents(nodes, node, parent)
    jumps = written(edges.join(edges.select(F.col("_p").alias("_n")).distinct(), "_n", "left_semi"), "jumps")
    steps, count = 1, jumps.count()
    most = count
    while count and steps <= most:
        jumps = written(_jump_on(jumps), "jumps")
        steps, count = 2 * steps, jumps.count()
    return jumps.select(F.col("_p").alias(node)).distinct()


def answers(chunks: DataFrame, by: list[str], pos: str, text: str, done: str) -> DataFrame:
    """Streamed answers put together: the chunks of each in order, and whether its last one came. Chunks of one answer
    meet in one task; an answer is bounded by what a model may write."""
    out = chunks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(pos, text))).alias("_c"), F.max(done).alias("finished"))
    return out.select(*by, F.array_join(F.transform("_c", lambda c: c[text]), "").alias("answer"), "finished")
