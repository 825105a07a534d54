"""The pipeline's stages and its run against plain versions, and the SQL of this subpackage against its queries."""

import os
import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from brindle.llm import catalog, packing, quality, secrets
from tests.llm.test_against_brute_force import naive_tiling, plain_counts
from tests.llm.test_jaccard import brute

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORDS = [f"word{i}" for i in range(2_000)]


def corpus():
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    items = [(i, prose(20)) for i in range(6)]
    docs = []
    for i in range(60):
        text, source = prose(rng.randint(60, 120)), f"http://good{i % 4}.org/a"
        if i % 10 == 3:
            text += " " + items[i % 6][1]
        if i % 10 == 4:
            cut = items[i % 6][1].split()
            text = " ".join(cut[10:]) + " " + text + " " + " ".join(cut[:10])
        if i % 10 == 5:
            text += " password = hunter2hunter2 and " + "0123456789abcdef" * 2
        if i % 10 == 6:
            text += " " + " ".join("#$%&#$%&" for _ in range(30))
        docs.append([i, text, "en", source, len(text)])
    docs += [[100 + i, prose(60) + " " + " ".join("#$%&#$%&" for _ in range(30)), "en", "http://bad.org", 1] for i in range(30)]
    docs += [[200 + i, docs[i][1] + " one more", "en", "http://good0.org/a", 1] for i in range(12)]
    docs += [[300, None, "en", "http://good0.org/a", 0], [301, "", None, None, 0], [302, "too few words", "en", "http://good1.org/a", 1], [303, "again " * 80, "en", "http://good1.org/a", 1], list(docs[7])]
    docs += [[304, prose(70), "en", "http://bad.org", 1], [305, prose(6000), "fr", None, 1]]
    return [tuple(d) for d in docs], items


def plain_quality(docs):
    verdicts = []
    for _, text, _, source, _ in docs:
        words, chars, symbols, dup, repeat, lines = plain_counts(text)
        base = words < 50 or 100 * repeat > 50 * words
        failed = base or 100 * symbols > 10 * chars or 100 * dup > 30 * lines or 10 * chars < 25 * words or 10 * chars > 120 * words
        verdicts.append((re.sub("^http://([^/]*).*", r"\1", source or ""), base, failed))
    hosts = {}
    for host, _, failed in verdicts:
        n, k = hosts.get(host, (0, 0))
        hosts[host] = n + 1, k + failed
    rates = {h: k / n for h, (n, k) in hosts.items()}
    a, b = quality.beta_prior(len(hosts), len(docs), sum(k for _, k in hosts.values()), sum(n * rates[h] ** 2 for h, (n, _) in hosts.items()), float(sum(n * n for n, _ in hosts.values())))
    shrunk = {h: (k + a) / (n + a + b) for h, (n, k) in hosts.items()}
    return [d for d, (host, base, failed) in zip(docs, verdicts, strict=True) if not base and not (failed and shrunk[host] > 0.6)]


def plain_near(docs):
    docs = list(dict.fromkeys(docs))
    found = brute([(d[0], d[1]) for d in docs])
    return [d for d in docs if found[d[0]][1] == d[0]]


def plain_decontaminated(docs, items):
    cut = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    bad = lambda text: any(2 * sum(n for *_, n in naive_tiling(cut(item), cut(text), 5)) >= len(cut(item)) for _, item in items)
    return [d for d in docs if len(d[1]) > 20_000 or not bad(d[1])]


def plain_redacted(docs):
    return [(d[0], secrets.redacted(d[1], sorted(secrets.scan(d[1])[1])), *d[2:]) for d in docs]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, items = corpus()
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_and_run(spark, folder):
    from tokenizers import Tokenizer

    docs, items = corpus()
    plain = {"quality_rules": plain_quality, "near_duplicates": plain_near, "decontamination": lambda d: plain_decontaminated(d, items), "secret_scan": plain_redacted}
    now = docs
    at = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = plain[name](now)
        at = stage(spark, at, folder)
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = sorted(map(tuple, at.collect()), key=repr)
        assert got == sorted(now, key=repr), name
        at = spark.createDataFrame(got, at.schema)
    assert 40 < len(now) < len(docs) - 40
    out = corpus_pipeline.run(spark, folder).collect()
    library = Tokenizer.from_file(packing.tokenizer_path())
    lengths = {d[0]: len(library.encode(d[1], add_special_tokens=False).ids) + 1 for d in now}
    got, sequences = {}, {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == lengths
    assert all(sum(n for _, n in s) <= 4096 and [o for o, _ in sorted(s)] == np.cumsum([0, *[n for _, n in sorted(s)][:-1]]).tolist() for s in sequences.values())
    assert len(sequences) == -(-sum(lengths.values()) // 4096)
    left = [f for f in os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) if "stage-" in f]
    assert len(left) >= 5  # the stages' rows stay, other work tables of the run are gone


def test_no_rows(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    df = catalog.queries()[name](spark, DATA)
    found = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    want = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=repr)
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want
