"""Language identification of mixed-language text.

Each word gets a score for each learned language from its byte n-grams (2 to 4 bytes, with the blanks around it, hashed
to ``BUCKETS`` a length; smoothed log shares). A word ends at blanks and where letters of another script begin. Its script,
told by the ranges of its UTF-8 lead bytes, narrows the languages to those that were learned in that script. Viterbi over a text's words, with a penalty for each switch,
labels spans; the language with most bytes in its spans is the text's, and its share of them the score.

Learning counts n-grams of a bounded sample of labelled rows: at most ``rows_a_language`` of each language, in the order
of a hash of the id (documented bound; everything else covers all rows). Counts reach the driver as at most
3 * BUCKETS numbers a language.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and no spans. With nothing to learn from,
every text is ``und``. Repeated rows repeat; no rows give none; clashing columns come back as ``<name>_in``. Rows with a
null id or null language are never learned from. Memory follows an Arrow batch and the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import textbatch as tb
from brindle.llm.common import sampled, table
from brindle.llm.worker import tidy

BUCKETS = 1 << 15
SIZES = (2, 3, 4)
ROWS_A_LANGUAGE = 4_000
SWITCH = 8.0
_FAR = -1e4
# fixed values: lead bytes of UTF-8 by script
SCRIPTS = ("latin", "greek", "cyrillic", "hebrew", "arabic", "indic_thai", "kana_symbols", "han", "hangul", "other")
_SCRIPT = np.full(256, SCRIPTS.index("other"), np.uint8)
_SCRIPT[65:91] = _SCRIPT[97:123] = _SCRIPT[0xC3:0xCD] = 0
_SCRIPT[0xCE:0xD0] = 1
_SCRIPT[0xD0:0xD4] = 2
_SCRIPT[0xD6:0xD8] = 3
_SCRIPT[0xD8:0xDC] = 4
_SCRIPT[0xE0] = 5
_SCRIPT[0xE3] = 6
_SCRIPT[0xE4:0xEA] = 7
_SCRIPT[0xEB:0xEE] = 8
_LETTERLIKE = np.zeros(256, bool)
_LETTERLIKE[65:91] = _LETTERLIKE[97:123] = True
_LETTERLIKE[0xC3:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def _grams(raw: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each size, the bucket of the window that ends at each byte; ASCII and Latin-1 letters folded."""
    x = _FOLD[raw]
    if len(x) > 1:
        upper = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E)
        x[1:][upper] += 0x20
    padded = np.concatenate([np.full(max(SIZES), 32, np.uint8), x]).astype(np.uint64)
    out, state = [], np.zeros(len(x), np.uint64)
    for k in range(max(SIZES)):
        state = state | padded[max(SIZES) - k : max(SIZES) - k + len(x)] << np.uint64(8 * k)
        if k + 1 in SIZES:
            out.append(((state * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64) + SIZES.index(k + 1) * BUCKETS)
    return out


def _split_at_scripts(w: tb.Words) -> tb.Words:
    """Words cut where letters of another script begin, so texts without blanks can be of several languages."""
    letters = np.flatnonzero(_LETTERLIKE[w.raw] & (_SCRIPT[w.raw] != SCRIPTS.index("other")))
    script = _SCRIPT[w.raw[letters]]
    at = np.flatnonzero(script[1:] != script[:-1]) + 1
    word = np.searchsorted(w.start, letters[at], side="right") - 1
    cuts = letters[at][letters[at - 1] >= w.start[word]]
    if not len(cuts):
        return w
    start, end = np.sort(np.concatenate([w.start, cuts])), np.sort(np.concatenate([w.end, cuts]))
    row = np.searchsorted(w.ends_of_rows, start, side="right") - 1
    return replace(w, start=start, end=end, row=row, first=np.searchsorted(row, np.arange(len(w.ends_of_rows))))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # (3 * BUCKETS, languages), log shares
    allowed: np.ndarray  # (scripts, languages): learned in that script

    def word_scores(self, column: pa.Array) -> tuple[np.ndarray, tb.Words]:
        w = _split_at_scripts(tb.words(column))
        n = len(self.languages)
        scores = np.zeros((len(w.start), n), np.float32)
        if not len(w.start):
            return scores, w
        total = np.zeros((len(w.raw) + 1, n))
        for grams in _grams(w.raw, w.ends_of_rows):
            total[1:] += self.weights[grams]
        np.cumsum(total, axis=0, out=total)
        scores = ((total[w.end] - total[w.start]) / len(SIZES)).astype(np.float32)
        letters = np.concatenate([[0], np.cumsum(_LETTERLIKE[w.raw])])
        has = letters[w.end] > letters[w.start]
        first = np.minimum(np.searchsorted(letters, letters[w.start] + 1) - 1, len(w.raw) - 1)  # a word's first letter
        allowed = self.allowed[_SCRIPT[w.raw[first]]]
        scores = np.where(allowed | ~allowed.any(axis=1, keepdims=True), scores, _FAR)
        scores[~has] = 0
        return scores.astype(np.float32), w


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word, all texts in step; ``first`` holds each text's first word (n + 1 entries)."""
    kind = np.min_scalar_type(max(scores.shape[1] - 1, 0))  # holds every label
    labels = np.zeros(len(scores), kind)
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    if not len(scores):
        return labels
    start, lengths = first[:-1][order], lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # texts with a word t
    came = np.zeros(scores.shape, kind)  # label before, for each label
    same = np.arange(scores.shape[1], dtype=kind)
    best = scores[start[: alive[0]]].astype(float)
    final = np.zeros(len(order), np.int64)
    for t in range(1, lengths[0] + 1):
        now = alive[t] if t < lengths[0] else 0
        if now < len(best):
            final[now : len(best)] = best[now:].argmax(axis=1)
            best = best[:now]
        if not now:
            break
        top = best.argmax(axis=1)
        moved = best[np.arange(now), top][:, None] - switch
        at = start[:now] + t
        came[at] = np.where(best >= moved, same, top[:, None].astype(kind))
        best = np.maximum(best, moved) + scores[at]
    state = final
    for t in range(lengths[0] - 1, -1, -1):
        now = alive[t]
        at = start[:now] + t
        labels[at] = state[:now]
        if t:
            state[:now] = came[at, state[:now]]
    return labels


RESULTS = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("lang_spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def _ascii_lettered(w: tb.Words) -> np.ndarray:
    """Whether each row has an ASCII letter."""
    count = np.concatenate([[0], np.cumsum((w.raw | 32) - np.uint8(97) < 26)])
    return count[w.ends_of_rows[1:]] > count[w.ends_of_rows[:-1]]


def _label_batch(model: Model, column: pa.Array) -> tuple[list[str], list[float], pa.Array]:
    parts = [model.word_scores(column.slice(a, b - a)) for a, b in tb.slices(column)]
    n, texts = len(model.languages), len(column)
    item = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    if not parts or not n:
        return ["und"] * texts, [0.0] * texts, pa.array([[]] * texts, pa.list_(item))
    scores = np.concatenate([s for s, _ in parts])
    counts = np.concatenate([np.diff(w.first) for _, w in parts])
    first = np.concatenate([[0], np.cumsum(counts)])
    # byte positions within the text
    start = np.concatenate([w.start - w.ends_of_rows[w.row] for _, w in parts])
    end = np.concatenate([w.end - w.ends_of_rows[w.row] for _, w in parts])
    labels = viterbi(scores, first)
    row = np.repeat(np.arange(texts), counts)
    neutral = ~scores.any(axis=1)
    weight = np.zeros((texts, n))
    np.add.at(weight, (row[~neutral], labels[~neutral]), (end - start)[~neutral])
    total = weight.sum(axis=1)
    best = weight.argmax(axis=1)
    lettered = np.concatenate([_ascii_lettered(w) for _, w in parts])
    for i in np.flatnonzero(~lettered & (counts > 0)):
        lettered[i] = any(map(str.isalpha, column[i].as_py()))  # stops at the first letter
    names = [model.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
    share = np.where(lettered, weight[np.arange(texts), best] / np.maximum(total, 1), 0.0)
    head = np.zeros(len(row), bool)
    if len(row):
        head = np.r_[True, (row[1:] != row[:-1]) | (labels[1:] != labels[:-1])] & lettered[row]
    at = np.flatnonzero(head)
    ended = np.r_[np.flatnonzero(np.r_[(row[1:] != row[:-1]) | (labels[1:] != labels[:-1]), True])] if len(row) else at
    ended = ended[lettered[row[ended]]] if len(row) else ended
    offsets = np.searchsorted(row[at], np.arange(texts + 1)) if len(row) else np.zeros(texts + 1, np.int64)
    spans = pa.StructArray.from_arrays([pa.array(np.array(model.languages, object)[labels[at]], pa.string()), pa.array(start[at]), pa.array(end[ended])], fields=list(item))
    return names, share.tolist(), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)


def _label_batches(text_at: int, model: Model):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, share, spans = _label_batch(model, tb.as_strings(batch.column(text_at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(share, pa.float64()), spans], names=[*batch.schema.names, *RESULTS.fieldNames()])

    return run


@tidy
def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams and, as features from 3 * BUCKETS on, of the letters by script; one batch a task."""
    total: dict[str, np.ndarray] = {}
    base = len(SIZES) * BUCKETS
    for batch in batches:
        langs = batch.column(0).to_pylist()
        column = tb.as_strings(batch.column(1))
        for i, lang in enumerate(langs):
            raw, ends = tb.text_bytes(column.slice(i, 1))
            mine = total.setdefault(lang, np.zeros(base + len(SCRIPTS), np.int64))
            for grams in _grams(raw, ends):
                mine += np.bincount(grams, minlength=base + len(SCRIPTS))
            mine[base:] += np.bincount(_SCRIPT[raw[_LETTERLIKE[raw]]], minlength=len(SCRIPTS))
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "feature", "n"])


def learn(df: DataFrame, *, id_col: str, text_col: str, lang_col: str, rows_a_language: int = ROWS_A_LANGUAGE) -> Model:
    """The model of the labelled rows of ``df``, at most about ``rows_a_language`` of each language (see ``common.sampled``)."""
    columns = {"_id": F.col(id_col), "_lang": F.col(lang_col).cast("string"), "_text": F.col(text_col).cast("string")}
    labelled = df.select(*[c.alias(name) for name, c in columns.items()]).where("_id is not null and _lang is not null")  # texts are only read for the sample
    counted = sampled(labelled, "_lang", "_id", rows_a_language).select("_lang", "_text").mapInArrow(_gram_batches, "lang string, feature long, n long")
    found = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((len(SIZES) * BUCKETS + len(SCRIPTS), len(names)))
    place = {name: i for i, name in enumerate(names)}
    counts[found["feature"].to_numpy(), [place[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    grams, scripts = counts[: len(SIZES) * BUCKETS].reshape(len(SIZES), BUCKETS, -1), counts[len(SIZES) * BUCKETS :]
    logs = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    return Model(tuple(names), logs.reshape(len(SIZES) * BUCKETS, -1).astype(np.float32), scripts >= 0.01 * scripts.sum(axis=0, keepdims=True))


def label_languages(df: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score and lang_spans (byte ranges from a span's first word to the end of its last)."""
    df = df.withColumnsRenamed({c: f"{c}_in" for c in df.columns if c in RESULTS.fieldNames()})
    df = df.withColumn(text_col, df[text_col].cast("string"))
    return df.mapInArrow(_label_batches(df.columns.index(text_col), model), T.StructType([*df.schema.fields, *RESULTS.fields]))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = learn(docs.where(~held_out), id_col="doc_id", text_col="text", lang_col="lang")
    return label_languages(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


QUERIES = {"op7_language_id": op7_language_id}
SQL: dict[str, str] = {}
