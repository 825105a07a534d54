"""What a worker keeps: bounded maps, dropped between operators, with the same results however small they are."""

import os
import random

import numpy as np
import pytest

from brindle.llm import packing, tokens, worker


def test_recent_keeps_what_is_asked_for_again():
    kept = worker.Recent(400, 10)
    for i in range(200):
        kept.turn()
        for key in kept.missing({b"common", b"rare%d" % i}):
            assert key != b"common" or i == 0
            kept.add([key], [b"v" + key])
        assert kept.young[b"common"] == b"vcommon"
        assert kept.held <= 400 and len(kept.young) + len(kept.old) < 40


def test_another_operators_task_drops_what_is_kept():
    made = []
    make = lambda: made.append(1) or object()
    first = worker.kept("a", "x", make)
    worker.begin("a")
    assert worker.kept("a", "x", make) is first
    worker.begin("b")
    assert worker.kept("a", "x", make) is not first and len(made) == 2


@pytest.mark.parametrize("most", [500, 4_000, 64 << 20])
def test_ids_do_not_depend_on_the_bound(monkeypatch, most):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    monkeypatch.setattr(packing, "KEPT_BYTES", most)
    encoder, library = packing.ChunkEncoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeABCé'.,!?1語", k=rng.randint(1, 9))) for _ in range(400)] + ["<|endoftext|>", "<|x", "don't", "a.b", "x."]
    for _ in range(12):
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(20)]
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("most", [0, 20_000, 64 << 20])
def test_tables_do_not_depend_on_the_bounds_and_common_units_are_cut_once(monkeypatch, most):
    import public_tokenizers
    from tokenizers import Tokenizer

    for name in ("TABLE_BYTES", "UNIT_BYTES", "PAIR_BYTES"):
        monkeypatch.setattr(tokens, name, most)
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library = tokens.PrefixCounter(path), Tokenizer.from_file(path)
    cut, prefix_counts = [], counter.prefix_counts
    monkeypatch.setattr(counter, "prefix_counts", lambda data: cut.append(data) or prefix_counts(data))
    rng = random.Random(5)
    parts = ["  ", " ", "\n", "\n\n", "　", "語", "é", "word", "don't", "'re", "'v", "123", ".,", "<|endoftext|>", "😀", "\t"]
    for i in range(400):
        text = "common words again " + "".join(rng.choices(parts, k=rng.randint(0, 12))) + f" rare{rng.randrange(10**6)}"
        steps = np.frombuffer(counter.text_table(text), np.int8)
        assert len(steps) == len(text.encode()) and steps.sum() == len(library.encode(text, add_special_tokens=False).ids)
        if i % 40 == 0:
            at = rng.randint(0, len(text))
            if not any(m[:k] == text[max(0, at - k) : at] for m in counter.special for k in range(1, len(m)) if m in text):
                assert steps[: len(text[:at].encode())].sum() == len(library.encode(text[:at], add_special_tokens=False).ids)
    if most:
        assert cut.count(b" words") == 1  # maps that start anew when they are full cut it again
        assert counter.units.held <= most and counter.tables.held <= most


def test_chunks_before_marks_are_kept_once():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    encoder, library = packing.ChunkEncoder(path), Tokenizer.from_file(path)
    texts = ["", " ", "\n a, b.\t", "a. a, a! A? b; 1: é. x!! y#$%. é&& <|X A, <|endoftext|>. a.\x1f\x85b", "c\x0bd\x0ce\r\nf"]
    for part in (texts, texts[1:2], texts[:0]):
        found = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(part)]
        assert found == [library.encode(t, add_special_tokens=False).ids for t in part]
    assert not {b"a.", b"a,", b"a!", b"b;", b"1:", b"x!!", b"y#$%.", b""} & set(encoder.known.young)
