"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns and no rows."""

import gzip
import base64

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from brindle.llm import decontam, jaccard, langid, licenses, packing, quality, repeats, secrets, tokens, toxicity

BPE = lambda: public_tokenizers.path("byte_bpe_50k.json")
ITEM = "which of these eleven words stands in no other document here"
LONG = "A long text, with a few words. " * 20_000 + ITEM
TEXTS = [None, "", " \n\t", "short", LONG, "é語 \U0001f600 — …", f"before {ITEM} after", "password = hunter2hunter2", "x " + base64.b64encode(gzip.compress(b"token=abcdefgh")).decode(), "no letters 123"]
CLASHES = [
    "findings", "layers", "refused", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept",
    "item_id", "coverage", "covered_tokens", "tiles", "n_tokens", "prefix_steps", "sentence_ids", "licenses", "license_use", "lang_pred", "score", "lang_spans", "n_words",
    "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "host", "host_rate", "severity", "grade", "p_toxic",
]


def learned(spark):
    rows = [(i, text, lang, i % 3) for i, (text, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")] * 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def operators(spark):
    seen = learned(spark)
    model = langid.learn(seen, id_col="doc_id", text_col="text", lang_col="lang")
    ordinal = toxicity.learn(seen.select("doc_id", "text"), seen.select("doc_id", "toxic"), F.col("toxic"))
    bench = spark.createDataFrame([(1, ITEM), (2, None), (2, ""), (3, "too short")], "item_id long, text string")
    return {
        "secrets": lambda df: secrets.scan_secrets(df),
        "packing": lambda df: packing.pack_documents(df, packing.tokenizer_path(), capacity=512),
        "repeats": lambda df: repeats.remove_repeats(df),
        "decontam": lambda df: decontam.contaminated(df, bench),
        "decontam by seeds": lambda df: decontam.contaminated(df, bench, small_seeds=0),
        "decontaminated": lambda df: decontam.decontaminated(df, bench),
        "tokens": lambda df: tokens.prefix_token_counts(df, BPE()),
        "licenses": lambda df: licenses.recognise(df),
        "langid": lambda df: langid.label_languages(df, model),
        "quality": lambda df: quality.judge(df),
        "toxicity": lambda df: toxicity.score(df, ordinal),
        "jaccard": lambda df: jaccard.near_duplicates(df),
        "one of each": lambda df: jaccard.one_of_each(df),
    }


def documents(spark, clash=False):
    rows = [(i, t, f"http://h{i % 3}.org/x") for i, t in enumerate(TEXTS)] + [(None, "null id", None), (3, "short", "http://h0.org/x"), (3, "other text, same id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return df.withColumns({c: F.lit("mine") for c in CLASHES}) if clash else df


PER_ROW = ("secrets", "repeats", "tokens", "licenses", "langid", "quality", "toxicity", "jaccard")


@pytest.mark.parametrize("clash", [False, True])
def test_every_row_has_its_result(spark, clash):
    df = documents(spark, clash)
    for name, operator in operators(spark).items():
        out = operator(df)
        if clash and name not in ("jaccard", "one of each", "decontaminated"):
            assert any(c.endswith("_in") for c in out.columns), name
        assert len(set(out.columns)) == len(out.columns), name
        rows = out.collect()
        if name in PER_ROW:
            assert len(rows) == len(TEXTS) + 3, name
        if name.startswith("decontam") and name != "decontaminated":
            assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(4, 1), (6, 1)], name
        if name == "decontaminated":
            assert 6 not in {r["doc_id"] for r in rows} and len(rows) == len(TEXTS) + 1, name
        if name == "one of each":
            assert sorted(r["text"] for r in rows if r["doc_id"] == 3) == ["other text, same id", "short"], name
        if clash and name in ("one of each", "decontaminated"):
            assert all(r["findings"] == "mine" for r in rows), name


def test_no_rows_give_no_rows(spark):
    for name, operator in operators(spark).items():
        assert operator(documents(spark).limit(0)).collect() == [], name


def test_nothing_to_learn_from(spark):
    seen = learned(spark).limit(0)
    model = langid.learn(seen, id_col="doc_id", text_col="text", lang_col="lang")
    assert {r["lang_pred"] for r in langid.label_languages(documents(spark), model).collect()} == {"und"}
    ordinal = toxicity.learn(seen.select("doc_id", "text"), seen.select("doc_id", "toxic"), F.col("toxic"))
    assert {r["severity"] for r in toxicity.score(documents(spark), ordinal).collect()} == {0.0}


def test_the_fitting_sample_is_bounded_and_the_same_each_time(spark):
    from brindle.llm.common import sampled

    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g")).repartition(5)
    got = [sorted(r["id"] for r in sampled(df, "g", "id", 500).collect()) for _ in range(2)]
    assert got[0] == got[1] and 940 <= len(got[0]) <= 1_000
    assert sampled(df, "g", "id", 10**6).count() == 20_000
    for most in (20, 100, 2_000):  # also where a group is many times as large
        for n in (r["count"] for r in sampled(df, "g", "id", most).groupBy("g").count().collect()):
            assert 0.8 * most <= n <= most
