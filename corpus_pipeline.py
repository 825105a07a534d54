"""From raw documents to packed training sequences: five stages, each an operator of ``brindle.llm`` with its decisions in
effect. A stage works on every row that the one before it kept; between stages the rows are written as Parquet.

1. quality: documents that fail the base rules, or a rule on a rejected host, go.
2. near_duplicates: of each component of documents linked by 5-word shingle similarity of 0.75 or more one stays, that
   with the smallest doc_id.
3. decontamination: documents whose tiles cover half of a benchmark item or more go.
4. secrets: every find, in decoded layers too, is replaced in the text by [ASSIGN], [ACCESS] or [HEX]; other columns,
   n_chars among them, keep what they say about the input.
5. packing: documents are tokenised, cut and packed into sequences of 4096 tokens.

Null and empty texts have no words and go in the first stage. No rows give no rows. Extra columns pass through stages 1
to 4. ``ORACLE_SQL`` is None: SQL has no near-duplicate components at this size, decoding layers or vocabularies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontam, jaccard, packing, quality, secrets
from brindle.llm.common import only_result, restored, table

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return restored(quality.judge(docs, keep_text=True).where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return restored(secrets.scan_secrets(docs, redact=True), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(docs.select("doc_id", "text"), packing.tokenizer_path())
    return packed.select("doc_id", *packing.PIECES.fieldNames(), "sequence_id", F.col("offset"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each stage's rows written to the shared folder and reread; its work tables go."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = only_result(spark, lambda: stage(spark, docs, sf_dir), f"stage-{name}")  # noqa: B023
    return docs
