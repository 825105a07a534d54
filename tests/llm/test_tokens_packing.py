"""Token counts against the library; packing as an exact round trip."""

import os

import numpy as np
import public_tokenizers
import pytest

from brindle.llm import packing, tokens

TEXTS = [None, "", "Hello, world! It's fine.", "  two  blanks\n\n", "naïve É 語 <|endoftext|> x", "word " * 3000, "a'ß.b, c?!", "Hello, world! It's fine."]


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in tokens.prefix_token_counts(df, path).collect():
        text = TEXTS[r["doc_id"]] or ""
        assert r["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids)
        assert r["n_bytes"] == len(text.encode())


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    library = Tokenizer.from_file(path)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    out = packing.pack_documents(df, path, capacity=64, keep_ids=True).collect()
    docs, sequences = {}, {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["piece"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == len(docs.setdefault(r["doc_id"], [])) and r["length"] == len(ids)
        docs[r["doc_id"]] += ids
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert docs == {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


@pytest.mark.parametrize("kind", ["uniform", "two fifths", "third", "short", "long", "mixed", "few"])
def test_never_more_sequences_than_best_fit(kind):
    draw = np.random.default_rng(4)
    n = 100_000
    lengths = {
        "uniform": lambda: draw.integers(1, 4097, n), "two fifths": lambda: draw.normal(1638, 60, n), "third": lambda: draw.normal(1380, 40, n), "short": lambda: draw.geometric(0.01, n),
        "long": lambda: draw.normal(3000, 500, n), "mixed": lambda: np.r_[draw.geometric(0.002, n), draw.integers(2000, 4097, n // 3)], "few": lambda: draw.choice([1500, 1400, 1300, 900], n),
    }[kind]()
    counts = np.bincount(np.clip(lengths, 1, 4096).astype(int), minlength=4097)
    planned = packing.plan(counts)
    used = np.zeros(4097, int)
    for pattern, times in planned:
        assert sum(pattern) <= 4096
        np.add.at(used, list(pattern), times)
    assert (used == counts).all()
    assert sum(t for _, t in planned) <= sum(t for _, t in packing.best_fit(counts.copy(), 4096))
