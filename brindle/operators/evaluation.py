"""Scores of generated texts by their published definitions: BLEU (Papineni et al., 2002) and ROUGE (Lin, 2004)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \n]+"), lambda w: w != "")


def clipped_matches(sizes: list[int]):
    """A function of two lists of words: the clipped matches of their n-grams of each size. Both lists are in the row, so they
    are counted there and nothing moves."""

    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        grams = lambda words, n: Counter(zip(*(words[i:] for i in range(n)), strict=False))
        none: list[str] = []
        for a, b in batches:
            yield pd.Series([[(grams(x, n) & grams(y, n)).total() for n in sizes] for x, y in ((none if x is None else list(x), none if y is None else list(y)) for x, y in zip(a, b, strict=True))])

    return F.pandas_udf(count, T.ArrayType(T.IntegerType()))


def _counted(pairs: DataFrame, keys: list[str], text: str, reference: str, sizes: list[int]) -> DataFrame:
    """(keys, _t, _r: words, _h: matches)."""
    cut = pairs.select(*keys, words(F.col(text)).alias("_t"), words(F.col(reference)).alias("_r"))
    return cut.withColumn("_h", clipped_matches(sizes)("_t", "_r"))


def _grams(c: str, n: int) -> Column:
    return F.greatest(F.size(c) - (n - 1), F.lit(0))


def bleu(pairs: DataFrame, keys: list[str], text: str, reference: str, mosts: list[int]) -> DataFrame:
    """BLEU-n for each n of ``mosts``: geometric mean of the clipped precisions of 1- to n-grams times the brevity penalty; 0
    where one of the precisions is. Pairs without a word on either side have no score and no row."""
    every = _counted(pairs, keys, text, reference, list(range(1, max(mosts) + 1))).where((F.size("_t") > 0) | (F.size("_r") > 0))
    brevity = F.when(F.size("_t") >= F.size("_r"), 1.0).otherwise(F.exp(1.0 - F.size("_r") / F.size("_t")))
    hits = lambda n: F.get("_h", F.lit(n - 1))
    scores = []
    for n in mosts:
        logs = sum((F.log(hits(k) / _grams("_t", k)) for k in range(1, n + 1)), F.lit(0.0))
        held = reduce(Column.__and__, [hits(k) > 0 for k in range(1, n + 1)])
        scores.append(F.when(held, brevity * F.exp(logs / n)).otherwise(0.0).alias(f"bleu{n}"))
    return every.select(*keys, *scores)


def f_score(hits: Column, n_text: Column, n_reference: Column) -> Column:
    """Harmonic mean of precision and recall, 0 without a hit."""
    return F.when(hits > 0, 2.0 * hits / (n_text + n_reference)).otherwise(0.0)


def rouge(pairs: DataFrame, keys: list[str], text: str, reference: str, sizes: list[int]) -> DataFrame:
    """ROUGE-n for each size, the f-score of clipped n-gram matches, and ROUGE-L, that of the longest common subsequence."""
    every = _counted(pairs, keys, text, reference, sizes)
    of_size = lambda i, n: f_score(F.get("_h", F.lit(i)), _grams("_t", n), _grams("_r", n)).alias(f"rouge{n}")
    longest = f_score(common_subsequence("_t", "_r"), F.size("_t"), F.size("_r")).alias("rouge_l")
    return every.select(*keys, *[of_size(i, n) for i, n in enumerate(sizes)], longest)


@F.pandas_udf(T.IntegerType())
def common_subsequence(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Length of the longest common subsequence of two lists of words, by bit vectors: one step a word of the second."""
    for a, b in batches:
        out = []
        for x, y in zip(a, b, strict=True):
            places: dict[str, int] = {}
            for i, w in enumerate(x if x is not None else ()):
                places[w] = places.get(w, 0) | 1 << i
            length = len(x) if x is not None else 0
            full = (1 << length) - 1
            state = full
            for w in y if y is not None else ():
                both = state & places.get(w, 0)
                state = ((state + both) | (state - both)) & full
            out.append(length - state.bit_count())
        yield pd.Series(out, dtype="int32")


def rouge_l(text: Column, reference: Column) -> Column:
    a, b = words(text), words(reference)
    return f_score(common_subsequence(a, b), F.size(a), F.size(b))
