"""Fill-in-middle against a plain cut by a regular expression, and back again."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from brindle.llm import fim

TEXTS = [
    None, "", "a", " ", "ab cd", "été là", "日本語 text 日本", "\U0001f600x\U0001f600", "<P>", "x<S>y", "<<M>", "<P <S", "<", "tail <", "tail <S", "S>M>", "<<<", "\0a\0", "?é?", "a\nb\r\n", "x" * 5000, "." * 5000, "ab1" * 4000,
]


def plain(text, seed, key):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_against_plain_cuts_and_back(spark):
    pick = random.Random(3)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a null id"), (3, "again"), (3, "again")]
    rows += [(1000 + i, "".join(pick.choices("abAB <>PSM.\né語\U0001f600", k=pick.randrange(60)))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("mine")).repartition(5)
    for seed in (1, 2):
        made = fim.fill_in_middle(df, seed=seed).withColumn("back", fim.restored_text(F.col("output"), F.col("form"))).collect()
        assert len(made) == len(rows) and {r["n_in"] for r in made} == {"mine"}
        for r in made:
            assert tuple(r[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) == plain(r["text"], seed, r["doc_id"])
            assert r["back"] == (r["text"] or "")
        assert {"plain", "psm", "spm"} == {r["form"] for r in made}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "word", "two words", " .. a", "é", "a1b22c333"])
def test_every_place(text):
    units, found = re.findall("[A-Za-z]+|[^A-Za-z]", text), fim.Units(text, fim._automaton())
    assert [found.place(k) for k in range(found.count + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]
