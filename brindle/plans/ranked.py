"""Ranked searches for a table of queries, over indexes: own designs by published definitions, for capabilities that are only
declared upstream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import keyword_index as ki
from brindle.operators import retrieval as rt
from brindle.operators import vector_index as vi
from brindle.sources.tables import table


#: ids that are broadcast; more of them are joined by a shuffle
LABELS = 2_000_000


def keyword_topk(spark, sf_dir):
    """The ten best documents for each benchmark item, by BM25."""
    index = ki.build(table(spark, sf_dir, "documents"), "doc_id", "text")
    return ki.search(index, table(spark, sf_dir, "benchmark"), "item_id", "text", 10).select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def _labelled(spark, sf_dir):
    """Documents of good quality. Their texts stay where they are while the ids are at most ``LABELS``, some 24 bytes each."""
    good = table(spark, sf_dir, "labels").where("quality >= 1").select("doc_id").distinct()
    few = good.limit(LABELS + 1).count() <= LABELS
    return table(spark, sf_dir, "documents").join(F.broadcast(good) if few else good, "doc_id", "left_semi")


def faq_ranked(spark, sf_dir):
    """Recommended documents for each benchmark item: by the priority of their sources, then by boosted BM25; thirty of each."""
    docs = _labelled(spark, sf_dir)
    tier = F.when(F.col("source").isin("src1", "src3"), 1).when(F.col("source").isin("src2", "src4"), 2).otherwise(3)
    found = ki.search(ki.build(docs, "doc_id", "text", group=tier), table(spark, sf_dir, "benchmark"), "item_id", "text", 30)
    pos = F.row_number().over(Window.partitionBy("item_id").orderBy("grp", "rank"))
    boosted = F.round(F.col("score") * 1.2, 5)
    return found.withColumn("pos", pos).where("pos <= 30").select("item_id", "pos", F.col("id").alias("doc_id"), F.col("grp").alias("tier"), boosted.alias("score"))


def message_ranked(spark, sf_dir):
    """The twenty best questions for each benchmark item, by BM25, each with the answer after it."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = table(spark, sf_dir, "conversations").withColumn("answer", after).where("role = 'user'").select(F.struct("conv_id", "turn").alias("id"), "text", F.md5("answer").alias("answer"))
    found = ki.search(ki.build(asked, "id", "text"), table(spark, sf_dir, "benchmark"), "item_id", "text", 20)
    return found.join(asked.select("id", "answer"), "id").select("item_id", "rank", "id.conv_id", "id.turn", "score", "answer")


def _every_hundredth(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors, vectors.where("vec_id % 100 = 0")


def vector_topk_queries(spark, sf_dir):
    """The ten nearest vectors for each id divisible by 100, over all rows."""
    vectors, queries = _every_hundredth(spark, sf_dir)
    return vi.exact(vectors, queries, "vec_id", "embedding", 10).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def vector_topk_index(spark, sf_dir):
    """The same by the index, with as many cells as a recall of 0.95 takes on a sample of the queries."""
    vectors, queries = _every_hundredth(spark, sf_dir)
    index = vi.build(vectors, "vec_id", "embedding")
    probes, _ = vi.calibrated(index, queries, "vec_id", "embedding", 10)
    return vi.search(index, queries, "vec_id", "embedding", 10, probes).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def hybrid_ranked(spark, sf_dir):
    """For each benchmark item the documents best by keywords and nearest to the vector with the item's id, fused by their ranks."""
    items, vectors = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    words = ki.search(ki.build(table(spark, sf_dir, "documents"), "doc_id", "text"), items, "item_id", "text", 50).select(F.col("item_id").alias("query"), "rank", "id")
    near = vi.exact(vectors, vectors.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi"), "vec_id", "embedding", 50, least=0.1).select("query", "rank", "id")
    fused = rt.fused([x.select(F.struct("query", "id").alias("hit"), "rank") for x in (words, near)], "hit").select("hit.*", F.round("score", 6).alias("score"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return fused.withColumn("rank", nth).where("rank <= 20").select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


QUERIES = {f.__name__: f for f in (keyword_topk, faq_ranked, message_ranked, vector_topk_queries, vector_topk_index, hybrid_ranked)}
_BM25 = r"""
words as (select id, grp, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from docs),
size as (select count(*) as n, sum(len(w)) / count(*)::double as mean from words),
tf as (select id, grp, len(w) as l, t, count(*) as f from (select id, grp, w, unnest(w) as t from words) group by all),
idf as (select t, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, size group by t),
q as (select item_id, t, count(*) as m from (select item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as t from benchmark) group by all),
s as (select item_id, id, grp, round(sum(m * idf * (f * 2.2::double / (f + 1.2::double * (0.25::double + 0.75::double * l / mean)))), 6) as score
      from q join tf using (t) join idf using (t), size group by all)
"""
_COSINES = """
v as (select vec_id, embedding::double[] as e from embeddings)
"""
SQL = {
    "keyword_topk": "with docs as (select doc_id as id, 0 as grp, text from documents)," + _BM25 + """
select item_id, row_number() over (partition by item_id order by score desc, id)::int as rank, id as doc_id, score from s
qualify row_number() over (partition by item_id order by score desc, id) <= 10
""",
    "faq_ranked": """
with docs as (select doc_id as id, case when source in ('src1', 'src3') then 1 when source in ('src2', 'src4') then 2 else 3 end as grp, text from documents
              where doc_id in (select doc_id from labels where quality >= 1)),""" + _BM25 + """
select item_id, row_number() over (partition by item_id order by grp, score desc, id)::int as pos, id as doc_id, grp as tier, round(score * 1.2::double, 5) as score from s
qualify row_number() over (partition by item_id order by grp, score desc, id) <= 30
""",
    "message_ranked": """
with docs as (select {'c': conv_id, 't': turn} as id, 0 as grp, text from conversations where role = 'user'),""" + _BM25 + """
, a as (select conv_id, turn, md5(lead(text) over (partition by conv_id order by turn)) as answer from conversations)
select item_id, row_number() over (partition by item_id order by score desc, id)::int as rank, conv_id, turn, score, answer
from s join a on a.conv_id = s.id.c and a.turn = s.id.t qualify row_number() over (partition by item_id order by score desc, id) <= 20
""",
    "vector_topk_queries": "with" + _COSINES + """
, c as (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 5) as score from v q, v where q.vec_id % 100 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from c
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10
""",
    "hybrid_ranked": "with docs as (select doc_id as id, 0 as grp, text from documents)," + _BM25 + "," + _COSINES + """
, c as (select q.vec_id as item_id, v.vec_id as id, round(list_cosine_similarity(q.e, v.e), 5) as score from v q, v where q.vec_id in (select item_id from benchmark)),
l as (select item_id, id, row_number() over (partition by item_id order by score desc, id) as r from s qualify r <= 50
      union all select item_id, id, row_number() over (partition by item_id order by score desc, id) as r from c where score >= 0.1 qualify r <= 50),
f as (select item_id, id, round(sum(1.0::double / (60 + r)), 6) as score from l group by all)
select item_id, row_number() over (partition by item_id order by score desc, id)::int as rank, id as doc_id, score from f
qualify row_number() over (partition by item_id order by score desc, id) <= 20
""",
}
