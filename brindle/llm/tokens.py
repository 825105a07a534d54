"""Exact token counts of every prefix of a text, by dynamic programming over its bytes.

A byte-pair encoding of a prefix ends in exactly one token, the one whose predecessor - the last token of what is left
of the prefix - may stand before it; two tokens may stand side by side when encoding their joined bytes gives just
these two. So count[i] = count[i - len(t)] + 1 for the last token t of prefix i, and one pass over a piece of text
gives the count at each of its prefixes. Pieces are runs of blanks with the non-blanks after them; the encoder never
joins bytes across two pieces, so a text's table is its pieces' tables end to end, and a piece's table those of the
splitting pattern's units but where blanks stand side by side. Pieces and units repeat, so each Python worker keeps
their tables in bounded maps, from which rare ones go first.

A table is stored as one signed byte a text byte: the change of the count when that byte completes a character (0
inside a character). Its running sum is the exact count of encode(text[:k]) for every k, so truncation to a budget and
the cost of any cut are answered from the table without encoding anything again.

Defined results: a null text is empty; an empty text has 0 tokens and an empty table. Rows are judged alone: repeated
rows repeat, no rows give none. Input columns that clash with results come back as ``<name>_in``. The vocabulary's
special string counts as one token where it stands in a text, as the library's default has it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import textbatch as tb
from brindle.llm.common import table, text_or_empty
from brindle.llm.worker import Recent, kept, tidy

# fixed values: Unicode's white space, and the splitting pattern of this family of byte-level vocabularies
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE_SPACE + r"\p{L}\p{N}]+|[" + WHITE_SPACE + r"]+(?![^" + WHITE_SPACE + r"])|[" + WHITE_SPACE + r"]+"
_SPLIT = regex.compile(SPLIT)
_PIECES = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_LEADING = re.compile(f"[{WHITE_SPACE}]*")
_BLANKS = frozenset(WHITE_SPACE)
#: Bytes of pieces' tables, of units' tables and of pairs of tokens that a Python worker keeps, about; pairs start anew beyond
#: their share. What an entry takes beside its own values: two objects' heads and a place in a map;
#: a pair is one number and its place.
TABLE_BYTES, UNIT_BYTES, PAIR_BYTES = 64 << 20, 64 << 20, 32 << 20
ENTRY_BYTES, PAIR_ENTRY_BYTES = 220, 80
NO_MERGE = (1 << 62, -1)  # behind every rank


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Tables of prefix counts for one byte-level vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        added = set(self.special)
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in added}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.ends = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.ends.add_word(token.decode("latin-1"), (i, len(token)))
        self.ends.make_automaton()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.merges.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left + right]))
        self.beside: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}  # no more than the vocabulary has
        self.units, self.tables = Recent(UNIT_BYTES, ENTRY_BYTES), Recent(TABLE_BYTES, ENTRY_BYTES)

    def merged(self, data: bytes) -> list[int]:
        """Plain byte-pair merging, lowest rank first; used on the bytes of one or two tokens only."""
        ids = [self.ids[data[i : i + 1]] for i in range(len(data))]
        merge = self.merges.get
        ranks = [merge(pair, NO_MERGE) for pair in pairwise(ids)]  # of each id and the next
        while ranks:
            best = min(ranks)
            if best is NO_MERGE:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [best[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = merge((ids[at - 1], ids[at]), NO_MERGE)
            if at < len(ranks):
                ranks[at] = merge((ids[at], ids[at + 1]), NO_MERGE)
        return ids

    def may_stand(self, left: int, right: int) -> bool:
        """Whether encoding the joined bytes of two tokens gives these two (asked once for each pair)."""
        if len(self.beside) * PAIR_ENTRY_BYTES > PAIR_BYTES:
            self.beside.clear()
        known = self.beside[left << 20 | right] = self.merged(self.bytes[left] + self.bytes[right]) == [left, right]
        return known

    def is_whole(self, token: int) -> bool:
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.merged(self.bytes[token]) == [token]
        return known

    def prefix_counts(self, data: bytes) -> list[int]:
        """count[i] for every byte prefix of one unit of the splitting pattern. An automaton over the vocabulary names the tokens
        that end at each byte; just one of them may stand last."""
        beside, may_stand = self.beside.get, self.may_stand
        size = len(data)
        last, count = [-1] * (size + 1), [0] * (size + 1)
        for at, (token, length) in self.ends.iter(data.decode("latin-1")):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                fits = beside(before << 20 | token)
                if fits is None:
                    fits = may_stand(before, token)
            else:
                fits = self.is_whole(token)
            if fits:
                last[end] = token
                count[end] = count[start] + 1
        return count

    def unit_table(self, unit: str) -> bytes:
        """The table of one unit of the splitting pattern."""
        found = self.units.get(unit)
        if found is None:
            data = unit.encode()
            counts = self.prefix_counts(data)
            if unit in ("'re", "'ve", "'ll"):  # cut inside, it is a quote and a letter
                counts[2] = counts[1] + self.prefix_counts(data[1:2])[1]
            found = self.steps(data, len(unit), counts)
            if len(unit) <= 64:
                self.units.put(unit, found)
        return found

    @staticmethod
    def steps(data: bytes, characters: int, counts: list[int]) -> bytes:
        """The changes of ``counts`` (from 0 on, by bytes) as a table."""
        if len(data) == characters:
            return bytes([after - value & 255 for value, after in pairwise(counts)])
        before, out = 0, []
        for i, value in enumerate(counts[1:], 1):
            if i < len(data) and data[i] & 0xC0 == 0x80:  # inside a character
                out.append(0)
            else:
                out.append(value - before & 255)
                before = value
        return bytes(out)

    def unit_counts(self, unit: str) -> list[int]:
        """The running sum of a unit's table, from 0 on."""
        return [0, *accumulate(x - 256 if x > 127 else x for x in self.unit_table(unit))]

    def build(self, piece: str) -> bytes:
        """The table of one piece."""
        if piece[1:2] not in _BLANKS:  # one blank or none in front: the units' tables end to end
            return b"".join(map(self.unit_table, _SPLIT.findall(piece)))
        blanks = _LEADING.match(piece)[0]
        counts = self.unit_counts(blanks)
        if len(blanks) < len(piece):  # the last blank goes with what follows
            head = self.unit_counts(blanks[:-1])
            base, skip = head[-1], len(counts) - len(head)
            for unit in _SPLIT.findall(piece, len(blanks) - 1):
                one = self.unit_counts(unit)
                counts += [base + x for x in one[1 + skip :]]
                skip = max(0, skip - len(one) + 1)
                base += one[-1]
        return self.steps(piece.encode(), len(piece), counts)

    def table_of(self, piece: str) -> bytes:
        found = self.tables.get(piece)
        if found is None:
            found = self.build(piece)
            if len(piece) <= 64:
                self.tables.put(piece, found)
        return found

    def plain(self, text: str) -> bytes:
        """The table of a text without special strings."""
        pieces = _PIECES.findall(text)
        found = list(map(self.tables.young.get, pieces))
        if None in found:
            found = [t if t is not None else self.table_of(p) for p, t in zip(pieces, found, strict=True)]
        return b"".join(found)

    def text_table(self, text: str) -> bytes:
        for mark in self.special:
            if mark in text:
                out = []
                *before, last = text.split(mark)
                for part in before:  # up to its last letter a special string is ordinary text
                    done = self.plain(part)
                    ordinary = np.frombuffer(self.plain(part + mark)[: len(done) + len(mark.encode()) - 1], np.int8)
                    step = int(np.frombuffer(done, np.int8).sum(dtype=np.int64)) + 1 - int(ordinary.sum(dtype=np.int64))
                    out += [ordinary.tobytes(), np.int8(step).tobytes()]
                return b"".join([*out, self.plain(last)])
        return self.plain(text)


def counter(path: str) -> PrefixCounter:
    """One counter a worker and vocabulary."""
    return kept(__name__, path, lambda: PrefixCounter(path))


RESULTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("prefix_steps", T.BinaryType())])


def _count_batches(text_at: int, path: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = counter(path)
        for batch in batches:
            column = tb.as_strings(batch.column(text_at))
            for a, b in tb.slices(column, 8 << 20):
                part = column.slice(a, b - a)
                steps = [tables.text_table(t) for t in part.to_pylist()]
                totals = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps]
                rest = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, pa.array(np.diff(tb.text_bytes(part)[1])), pa.array(totals, pa.int64()), pa.array(steps, pa.binary())],
                    names=[*batch.schema.names, *RESULTS.fieldNames()],
                )

    return run


def prefix_token_counts(df: DataFrame, tokenizer_path: str, *, text_col: str = "text") -> DataFrame:
    """``df`` with n_bytes, n_tokens and ``prefix_steps`` (the table). One narrow pass, every row alone."""
    df = df.withColumnsRenamed({c: f"{c}_in" for c in df.columns if c in RESULTS.fieldNames()})
    df = df.withColumn(text_col, df[text_col].cast("string"))
    return df.mapInArrow(_count_batches(df.columns.index(text_col), tokenizer_path), T.StructType([*df.schema.fields, *RESULTS.fields]))


@F.pandas_udf(T.LongType())
def tokens_before(steps, n_bytes):
    """Exact tokens of the prefix of ``n_bytes`` bytes (inside a character: of the characters before it)."""
    import pandas as pd

    return pd.Series([int(np.frombuffer(s, np.int8)[:n].sum(dtype=np.int64)) for s, n in zip(steps, n_bytes, strict=True)], dtype="int64")


@F.pandas_udf(T.LongType())
def bytes_within(steps, budget):
    """Bytes of the longest prefix of whole characters that encodes to at most ``budget`` tokens."""
    import pandas as pd

    out = []
    for s, limit in zip(steps, budget, strict=True):
        counts = np.concatenate([[0], np.cumsum(np.frombuffer(s, np.int8), dtype=np.int64)])
        out.append(int(np.flatnonzero(counts <= limit)[-1]) if limit >= 0 else 0)
    return pd.Series(out, dtype="int64")


def op5_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    counted = prefix_token_counts(docs.select("doc_id", text_or_empty(docs, "text").alias("text")), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


QUERIES = {"op5_token_counts": op5_token_counts}
SQL: dict[str, str] = {}
