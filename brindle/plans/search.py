"""Retrieval queries: own designs by published definitions, for capabilities that are only declared upstream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import retrieval as rt
from brindle.sources.tables import table


def vector_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return rt.nearest(vectors, vectors.where("vec_id = 7").select("embedding"), 10, 0.0).select("vec_id", "score")


def chunk_documents(spark, sf_dir):
    return rt.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 512, 50)


def chunk_neighbors(spark, sf_dir):
    return rt.neighbours(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


def history_turns(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").withColumn("nth", nth).where("nth <= 5").select("conv_id", "turn", "role")


def rrf_hybrid(spark, sf_dir):
    """Two rankings of parts - by price and by size - fused."""
    parts = table(spark, sf_dir, "part").where("p_size <= 10")
    price = parts.orderBy(F.desc("p_retailprice"), "p_partkey").limit(50)
    size = parts.orderBy("p_size", "p_partkey").limit(50)
    ranked = [price.select("p_partkey", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("rank")), size.select("p_partkey", F.row_number().over(Window.orderBy("p_size", "p_partkey")).alias("rank"))]
    return rt.fused(ranked, "p_partkey").select("p_partkey", F.round("score", 6).alias("score"))


def retrieval_metrics(spark, sf_dir):
    """Precision, recall, reciprocal rank, average precision and nDCG of each order's lines ranked by price; lines that
    were returned (R) are the relevant ones."""
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    rel = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    ranked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", rel.alias("rel")).withColumn("k", nth)
    upto = Window.partitionBy("l_orderkey").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("hits", F.sum("rel").over(upto))
    top = F.col("k") <= 3
    gain = F.sum(F.when(top, F.col("rel") / F.log2(F.col("k") + 1.0)).otherwise(0.0))
    n = F.sum("rel")
    ideal = F.when(n >= 3, F.lit(1.0) + 1 / F.log2(F.lit(3.0)) + 0.5).when(n == 2, F.lit(1.0) + 1 / F.log2(F.lit(3.0))).otherwise(F.lit(1.0))
    out = ranked.groupBy("l_orderkey").agg(
        F.round(F.sum(F.when(top, F.col("rel"))) / 3.0, 6).alias("precision3"), F.round(F.sum(F.when(top, F.col("rel"))) / F.greatest(n, F.lit(1)), 6).alias("recall3"),
        F.round(F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("k"))), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.sum(F.col("rel") * F.col("hits") / F.col("k")) / F.greatest(n, F.lit(1)), 6).alias("map"), F.round(gain / ideal, 6).alias("ndcg3"),
    )
    return out


def bleu1(spark, sf_dir):
    """Clipped unigram precision of each assistant turn against the turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("ref", F.lag("text").over(w)).where("role = 'assistant' and ref is not null")
    count = lambda c, name: turns.select("conv_id", "turn", F.explode(F.filter(F.split(F.lower(c), r"[ \n]+"), lambda x: x != "")).alias("w")).groupBy("conv_id", "turn", "w").agg(F.count("*").alias(name))
    both = count(F.col("text"), "a").join(count(F.col("ref"), "b"), ["conv_id", "turn", "w"], "left")
    return both.groupBy("conv_id", "turn").agg(F.round(F.sum(F.least("a", F.coalesce("b", F.lit(0)))) / F.sum("a"), 6).alias("bleu1"))


def kb_counts(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("knowledge_count"), F.count_if(F.col("toxic") == 1).alias("flagged_count"), F.count_if(F.col("quality").isNull()).alias("processing_count"))


QUERIES = {f.__name__: f for f in (vector_topk, chunk_documents, chunk_neighbors, history_turns, rrf_hybrid, retrieval_metrics, bleu1, kb_counts)}
SQL = {
    "vector_topk": """
with q as (select embedding::double[] as q from embeddings where vec_id = 7)
select vec_id, round(list_cosine_similarity(embedding::double[], q), 5) as score from embeddings, q where score >= 0 order by score desc, vec_id limit 10
""",
    "chunk_documents": """
select doc_id, i::int as chunk_index, substring(text, i * 462 + 1, 512) as chunk
from (select doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 50) / 462.0))::bigint)) as i from documents where length(text) > 0)
""",
    "chunk_neighbors": "select conv_id, turn, lag(turn) over w as pre, lead(turn) over w as next from conversations window w as (partition by conv_id order by turn)",
    "history_turns": "select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 5",
    "rrf_hybrid": """
with p as (select * from part where p_size <= 10),
l as (select p_partkey, row_number() over (order by p_retailprice desc, p_partkey) as r from p qualify r <= 50
      union all select p_partkey, row_number() over (order by p_size, p_partkey) as r from p qualify r <= 50)
select p_partkey, round(sum(1.0::double / (60 + r)), 6) as score from l group by 1
""",
    "retrieval_metrics": """
with r as (select l_orderkey, (l_returnflag = 'R')::int as rel, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as k from lineitem),
h as (select *, sum(rel) over (partition by l_orderkey order by k) as hits from r),
a as (select l_orderkey, sum(rel) as n, sum(rel) filter (where k <= 3) as top, min(k) filter (where rel = 1) as first, sum(rel * hits::double / k) as ap, coalesce(sum(rel / log2(k + 1)) filter (where k <= 3), 0) as dcg from h group by 1)
select l_orderkey, round(top / 3.0::double, 6) as precision3, round(top::double / greatest(n, 1), 6) as recall3, round(coalesce(1.0::double / first, 0), 6) as mrr,
       round(ap / greatest(n, 1), 6) as map, round(dcg / (case when n >= 3 then 1 + 1 / log2(3) + 0.5 when n = 2 then 1 + 1 / log2(3) else 1 end), 6) as ndcg3 from a
""",
    "bleu1": r"""
with t as (select *, lag(text) over (partition by conv_id order by turn) as ref from conversations),
w as (select conv_id, turn, 1 as side, unnest(regexp_split_to_array(lower(text), '[ \n]+')) as w from t where role = 'assistant' and ref is not null
      union all select conv_id, turn, 0, unnest(regexp_split_to_array(lower(ref), '[ \n]+')) from t where role = 'assistant' and ref is not null),
c as (select conv_id, turn, w, count(*) filter (where side = 1) as a, count(*) filter (where side = 0) as b from w where w <> '' group by 1, 2, 3)
select conv_id, turn, round(sum(least(a, b))::double / sum(a), 6) as bleu1 from c group by 1, 2 having sum(a) > 0
""",
    "kb_counts": "select source, count(*) as knowledge_count, count(*) filter (where toxic = 1) as flagged_count, count(*) filter (where quality is null) as processing_count from documents left join labels using (doc_id) group by 1",
}
