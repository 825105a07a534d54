"""Search chains and scores: own designs by published definitions, for capabilities that are only declared upstream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import evaluation as ev
from brindle.operators import lookup as lk
from brindle.operators import retrieval as rt
from brindle.sources.tables import table

#: fixed value: the words that are asked for
ASKED = ("the", "and", "of")


def _keyword_scores(spark, sf_dir):
    """Each document's share of the asked words that it holds."""
    held = F.size(F.array_intersect(F.array_distinct(ev.words(F.col("text"))), F.array(*map(F.lit, ASKED))))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (held / len(ASKED)).alias("keyword"))


def _vector_scores(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return rt.similar(vectors, vectors.where("vec_id = 7").select("embedding"), "embedding").select(F.col("vec_id").alias("doc_id"), "score")


def retrieval_chain(spark, sf_dir):
    """The ten nearest vectors above a threshold, scored again by keywords, the best five of those above another one."""
    near = _vector_scores(spark, sf_dir).where("score >= 0.1").orderBy(F.desc("score"), "doc_id").limit(10)
    again = near.join(_keyword_scores(spark, sf_dir), "doc_id", "left").withColumn("rerank", F.round(0.7 * F.col("score") + 0.3 * F.coalesce("keyword", F.lit(0.0)), 5))
    order = [F.desc("rerank"), F.asc("doc_id")]
    return lk.numbered(again.where("rerank >= 0.15").orderBy(*order).limit(5), order).select("pos", "doc_id", "rerank")


def hybrid_search(spark, sf_dir):
    """Vector and keyword hits of documents of some sources, both above their thresholds, fused by rank."""
    ids = table(spark, sf_dir, "documents").where("source in ('src0', 'src1', 'src2', 'src3')").select("doc_id")
    ranked = []
    for hits, score, least in ((_vector_scores(spark, sf_dir), "score", 0.0), (_keyword_scores(spark, sf_dir), "keyword", 0.3)):
        order = [F.desc(score), F.asc("doc_id")]
        top = hits.join(ids, "doc_id", "left_semi").where(F.col(score) >= least).orderBy(*order).limit(50)
        ranked.append(top.select("doc_id", F.row_number().over(Window.orderBy(*order)).alias("rank")))
    fused = rt.fused(ranked, "doc_id").withColumn("score", F.round("score", 6))
    return fused.orderBy(F.desc("score"), "doc_id").limit(20)


def faq_search(spark, sf_dir):
    """Questions by priority of their tags, then by boosted score; recommended ones only."""
    scored = _keyword_scores(spark, sf_dir).join(table(spark, sf_dir, "labels").where("quality >= 1").select("doc_id"), "doc_id", "left_semi")
    tier = F.when(F.col("source").isin("src1", "src3"), 1).when(F.col("source").isin("src2", "src4"), 2).otherwise(3)
    boosted = F.round(F.least(F.col("keyword") * 1.2, F.lit(1.0)), 5)
    rows = scored.select("doc_id", tier.alias("tier"), boosted.alias("score"), (boosted >= 0.9).alias("direct"))
    order = [F.asc("tier"), F.desc("score"), F.asc("doc_id")]
    return lk.numbered(rows.where("score > 0").orderBy(*order).limit(30), order).select("pos", "doc_id", "tier", "score", "direct")


def message_search(spark, sf_dir):
    """Questions that hold a word, each with the answer after it; the twenty best by how often."""
    talks = table(spark, sf_dir, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = talks.withColumn("answer", after).where("role = 'user'")
    times = F.size(F.filter(ev.words(F.col("text")), lambda w: w == "the"))
    order = [F.desc("score"), F.asc("conv_id"), F.asc("turn")]
    hits = asked.select("conv_id", "turn", times.alias("score"), F.md5("answer").alias("answer")).where("score > 0")
    return lk.numbered(hits.orderBy(*order).limit(20), order).select("pos", "conv_id", "turn", "score", "answer")


def load_messages(spark, sf_dir):
    """The last messages before a point in each conversation, oldest first."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = table(spark, sf_dir, "conversations").where("turn < 6").withColumn("nth", nth).where("nth <= 2")
    return rows.select("conv_id", "turn", "role")


def indexed_messages(spark, sf_dir):
    """Messages of each conversation that are long enough to be indexed."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.length("text") >= 100).alias("indexed"), F.count("*").alias("messages"))


def ndcg10(spark, sf_dir):
    """nDCG at 10 of each order's lines ranked by price, graded by their quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", F.floor(F.col("l_quantity") / 10).cast("int").alias("grade"))
    own = Window.partitionBy("l_orderkey")
    ranked = lines.withColumn("k", F.row_number().over(own.orderBy(F.desc("l_extendedprice"), F.desc("grade"))))
    ranked = ranked.withColumn("best", F.row_number().over(own.orderBy(F.desc("grade"))))
    gain = lambda k: F.sum(F.when(F.col(k) <= 10, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(k) + 1.0)).otherwise(0.0))
    return ranked.groupBy("l_orderkey").agg(F.round(F.when(gain("best") > 0, gain("k") / gain("best")).otherwise(0.0), 6).alias("ndcg10"))


def _turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("ref", F.lag("text").over(w)).where("role = 'assistant' and ref is not null")


def bleu(spark, sf_dir):
    turns, keys = _turns(spark, sf_dir), ["conv_id", "turn"]
    return ev.bleu(turns, keys, "text", "ref", [1, 2, 4]).select(*keys, *[F.round(c, 6).alias(c) for c in ("bleu1", "bleu2", "bleu4")])


def rouge(spark, sf_dir):
    turns, keys = _turns(spark, sf_dir), ["conv_id", "turn"]
    return ev.rouge(turns, keys, "text", "ref", [1, 2]).select(*keys, *[F.round(c, 6).alias(c) for c in ("rouge1", "rouge2", "rouge_l")])


def paragraph_chunks(spark, sf_dir):
    """Pieces between line breaks put together into chunks of at most 400 code points; a longer piece is cut."""
    return rt.separated_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", "\n", 400)


def parent_child_chunks(spark, sf_dir):
    """Parents of 1,000 code points, their children of 250."""
    parents = rt.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 1000, 0).withColumnsRenamed({"chunk_index": "parent_index", "chunk": "parent"})
    each = F.posexplode(F.sequence(F.lit(0), F.ceil(F.length("parent") / 250).cast("int") - 1)).alias("child_index", "_i")
    children = parents.select("doc_id", "parent_index", "parent", each)
    return children.select("doc_id", "parent_index", "child_index", F.md5(F.substring(F.col("parent"), F.col("_i") * 250 + 1, F.lit(250))).alias("child"))


QUERIES = {f.__name__: f for f in (
    retrieval_chain, hybrid_search, faq_search, message_search, load_messages, indexed_messages, ndcg10, bleu, rouge, paragraph_chunks, parent_child_chunks,
)}
_SCORES = r"""
with kw as (select doc_id, source, lang, len(list_filter(['the', 'and', 'of'], lambda x: list_contains(regexp_split_to_array(lower(text), '[ \n]+'), x))) / 3.0::double as keyword from documents),
q as (select embedding::double[] as q from embeddings where vec_id = 7),
vs as (select vec_id as doc_id, round(list_cosine_similarity(embedding::double[], q), 5) as score from embeddings, q)
"""
_PAIRS = r"""
with t as (select *, lag(text) over (partition by conv_id order by turn) as ref from conversations),
p as (select conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[ \n]+'), lambda x: x <> '') as a, list_filter(regexp_split_to_array(lower(ref), '[ \n]+'), lambda x: x <> '') as b from t where role = 'assistant' and ref is not null),
g as (select conv_id, turn, k, side, unnest(list_transform(range(1, len(l) - k + 2), lambda i: array_to_string(l[i:i + k - 1], ' '))) as g
      from (select conv_id, turn, 1 as side, a as l from p union all select conv_id, turn, 0, b from p), (values (1), (2), (3), (4)) n(k)),
c as (select conv_id, turn, k, g, count(*) filter (where side = 1) as x, count(*) filter (where side = 0) as y from g group by 1, 2, 3, 4),
s as (select conv_id, turn, k, sum(least(x, y)) as hits, sum(x) as na, sum(y) as nb from c group by 1, 2, 3)
"""
SQL = {
    "retrieval_chain": _SCORES + """
, near as (select * from vs where score >= 0.1 order by score desc, doc_id limit 10),
r as (select doc_id, round(0.7::double * score + 0.3::double * coalesce(keyword, 0), 5) as rerank from near left join kw using (doc_id))
select row_number() over (order by rerank desc, doc_id)::int as pos, doc_id, rerank from r where rerank >= 0.15 order by rerank desc, doc_id limit 5
""",
    "hybrid_search": _SCORES + """
, ids as (select doc_id from documents where source in ('src0', 'src1', 'src2', 'src3')),
l as (select doc_id, row_number() over (order by score desc, doc_id) as r from vs where score >= 0 and doc_id in (select doc_id from ids) qualify r <= 50
      union all select doc_id, row_number() over (order by keyword desc, doc_id) as r from kw where keyword >= 0.3 and doc_id in (select doc_id from ids) qualify r <= 50)
select doc_id, round(sum(1.0::double / (60 + r)), 6) as score from l group by 1 order by score desc, doc_id limit 20
""",
    "faq_search": _SCORES + """
, s as (select doc_id, case when source in ('src1', 'src3') then 1 when source in ('src2', 'src4') then 2 else 3 end as tier, round(least(keyword * 1.2::double, 1), 5) as score
        from kw where doc_id in (select doc_id from labels where quality >= 1))
select row_number() over (order by tier, score desc, doc_id)::int as pos, doc_id, tier, score, score >= 0.9 as direct from s where score > 0 order by tier, score desc, doc_id limit 30
""",
    "message_search": r"""
with t as (select *, lead(text) over (partition by conv_id order by turn) as answer from conversations),
s as (select conv_id, turn, len(list_filter(regexp_split_to_array(lower(text), '[ \n]+'), lambda x: x = 'the'))::int as score, md5(answer) as answer from t where role = 'user')
select row_number() over (order by score desc, conv_id, turn)::int as pos, conv_id, turn, score, answer from s where score > 0 order by score desc, conv_id, turn limit 20
""",
    "load_messages": "select conv_id, turn, role from conversations where turn < 6 qualify row_number() over (partition by conv_id order by turn desc) <= 2",
    "indexed_messages": "select conv_id, count(*) filter (where length(text) >= 100) as indexed, count(*) as messages from conversations group by 1",
    "ndcg10": """
with l as (select l_orderkey, floor(l_quantity / 10)::int as grade, l_extendedprice from lineitem),
r as (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, grade desc) as k, row_number() over (partition by l_orderkey order by grade desc) as b from l),
s as (select l_orderkey, sum((2.0::double ** grade - 1) / log2(k + 1)) filter (where k <= 10) as got, sum((2.0::double ** grade - 1) / log2(b + 1)) filter (where b <= 10) as best from r group by 1)
select l_orderkey, round(case when best > 0 then got / best else 0 end, 6) as ndcg10 from s
""",
    "bleu": _PAIRS + """
, e as (select conv_id, turn, k, case when na > 0 then hits / na::double else 0 end as p, max(na) filter (where k = 1) over w as ca, max(nb) filter (where k = 1) over w as cb from s window w as (partition by conv_id, turn)),
f as (select conv_id, turn, n, case when count(*) filter (where p > 0) = n then exp(sum(ln(case when p > 0 then p end)) / n) * min(case when ca >= cb then 1 else exp(1 - cb / ca::double) end) else 0 end as v
      from e, (values (1), (2), (4)) m(n) where k <= n group by 1, 2, 3)
select conv_id, turn, round(max(v) filter (where n = 1), 6) as bleu1, round(max(v) filter (where n = 2), 6) as bleu2, round(max(v) filter (where n = 4), 6) as bleu4 from f group by 1, 2
""",
    "paragraph_chunks": r"""
with recursive parts as (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where length(text) > 0),
cut as (select doc_id, i, j, substring(s, (j * 400 + 1)::bigint, 400) as s from (select *, unnest(range(0, greatest(1, ceil(length(s) / 400.0)::bigint))) as j from parts) where s <> ''),
o as (select doc_id, s, length(s) as n, row_number() over (partition by doc_id order by i, j) as r from cut),
w as (select doc_id, r, n as used, 0 as chunk from o where r = 1
      union all select o.doc_id, o.r, case when w.used + 1 + o.n <= 400 then w.used + 1 + o.n else o.n end, case when w.used + 1 + o.n <= 400 then w.chunk else w.chunk + 1 end from w join o on o.doc_id = w.doc_id and o.r = w.r + 1)
select doc_id, chunk::int as chunk_index, string_agg(s, chr(10) order by r) as chunk from w join o using (doc_id, r) group by 1, 2
""",
    "parent_child_chunks": """
with p as (select doc_id, i::int as parent_index, substring(text, i * 1000 + 1, 1000) as parent from (select doc_id, text, unnest(range(0, greatest(1, ceil(length(text) / 1000.0))::bigint)) as i from documents where length(text) > 0))
select doc_id, parent_index, j::int as child_index, md5(substring(parent, j * 250 + 1, 250)) as child from (select *, unnest(range(0, ceil(length(parent) / 250.0)::bigint)) as j from p)
""",
}
# the longest common subsequence by the textbook recurrence, one row of the table a step
SQL["rouge"] = _PAIRS.replace("with t as", "with recursive t as") + """
, lcs as (select conv_id, turn, a, b, 1 as i, list_transform(range(0, len(b) + 1), lambda j: 0) as above from p
          union all
          select conv_id, turn, a, b, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [case when a[i] = b[j] then above[j] + 1 else above[j + 1] end]),
                 lambda acc, x: list_append(acc, greatest(x[1], acc[len(acc)])), [0]) from lcs where i <= len(a)),
l as (select conv_id, turn, len(a) as na, len(b) as nb, above[len(b) + 1] as hits from lcs where i = len(a) + 1),
f as (select conv_id, turn, k, case when hits > 0 then 2.0::double * hits / (na + nb) else 0 end as v from s where k <= 2)
select conv_id, turn, round(coalesce(max(v) filter (where k = 1), 0), 6) as rouge1, round(coalesce(max(v) filter (where k = 2), 0), 6) as rouge2,
       round(max(case when hits > 0 then 2.0::double * hits / (na + nb) else 0 end), 6) as rouge_l from l left join f using (conv_id, turn) group by 1, 2
"""
