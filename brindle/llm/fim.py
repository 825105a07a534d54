"""Fill-in-middle transformation: whole texts cut at two random units into prefix, middle and suffix, and put together anew.

A unit is a run of ASCII letters or any other code point. Units aren't cut out. A text's code points beyond ASCII become one
stand-in character each (they are units of their own, like any character that is no letter), and one Aho-Corasick automaton
finds the places where ASCII letters begin or end and the sentinels. Between two such events there are either letters only,
one unit, or none, as many units as code points; so running totals over the events give the number of units, and the place
after the k-th unit is looked up among them (``Units.place``).

Defined results: a null text is empty; an empty text, and one that holds a sentinel, is plain; a null id counts as an empty
one. Every row is judged alone: repeated rows repeat, no rows give none, and a column that clashes with a result comes back
as ``<name>_in``. Memory follows an Arrow batch and the longest text's events. One narrow pass without a shuffle.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import textbatch as tb
from brindle.llm.common import table
from brindle.llm.worker import kept, tidy

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100: plain from the first on; suffix first below the second
_CHANGE, _SENTINEL = 1, 0


def _automaton() -> ahocorasick.Automaton:
    """Matches a letter beside any other ASCII character, in both orders, and the sentinels."""
    out = ahocorasick.Automaton()
    others = [c for c in map(chr, range(128)) if c not in string.ascii_letters]
    for letter in string.ascii_letters:
        for other in others:
            out.add_word(letter + other, _CHANGE)
            out.add_word(other + letter, _CHANGE)
    for s in SENTINELS:
        out.add_word(s, _SENTINEL)
    out.make_automaton()
    return out


class Units:
    """Units of a text: ``at`` are the bounds of its stretches of letters and of other characters, ``upto`` the units before
    each of them."""

    __slots__ = ("at", "held", "letters", "upto")

    def __init__(self, text: str, automaton: ahocorasick.Automaton) -> None:
        plain = text.encode("ascii", "replace").decode("ascii")  # one character for each code point
        events = np.fromiter((end if kind == _CHANGE else -1 for end, kind in automaton.iter(plain)), np.int64)
        changes = events[events >= 0]
        self.held = len(changes) < len(events)  # a sentinel
        self.at = np.concatenate([[0], changes, [len(text)]])
        self.letters = np.arange(len(self.at) - 1) % 2 == (0 if plain[:1] in string.ascii_letters else 1)
        self.upto = np.concatenate([[0], np.cumsum(np.where(self.letters, np.minimum(np.diff(self.at), 1), np.diff(self.at)))])

    @property
    def count(self) -> int:
        return int(self.upto[-1])

    def place(self, k: int) -> int:
        """The code points in the first ``k`` units."""
        if k == 0:
            return 0
        i = int(np.searchsorted(self.upto, k)) - 1  # the stretch that holds the k-th unit
        return int(self.at[i + 1] if self.letters[i] else self.at[i] + k - self.upto[i])


RESULTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
_DRAWS = ("_h1", "_h2", "_h3", "_h4")


def transformed(text: str, draws: tuple[int, int, int, int], automaton: ahocorasick.Automaton) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix's and middle's code points, output) of a text for four random numbers."""
    units = Units(text, automaton)
    n = units.count
    if not text or units.held or draws[2] % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    first, second = sorted((units.place(draws[0] % (n + 1)), units.place(draws[1] % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if draws[3] % 100 < SPM_BELOW:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _transform_batches(text_at: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = kept(__name__, "events", _automaton)
        for batch in batches:
            column = tb.as_strings(batch.column(text_at))
            draws = [batch.column(batch.schema.get_field_index(c)) for c in _DRAWS]
            for a, b in tb.slices(column):
                made = [transformed(t, d, automaton) for t, *d in zip(column.slice(a, b - a).to_pylist(), *(d.slice(a, b - a).to_pylist() for d in draws), strict=True)]
                parts = [pa.array(values, kind) for values, kind in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns, *parts], names=[*rows.schema.names, *RESULTS.fieldNames()])

    return run


def fill_in_middle(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """``df`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output. The cuts and the form follow
    from the sha256 of ``seed:id`` alone."""
    df = df.withColumnsRenamed({c: f"{c}_in" for c in df.columns if c in RESULTS.fieldNames()})
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = {name: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i, name in enumerate(_DRAWS)}
    given = df.withColumn(text_col, F.col(text_col).cast("string")).withColumns(draws)
    return given.mapInArrow(_transform_batches(given.columns.index(text_col)), T.StructType([*given.schema.fields, *RESULTS.fields])).drop(*_DRAWS)


def restored_text(output: Column, form: Column) -> Column:
    """The text that an output was made from. The parts hold no sentinel, and none can arise where a part meets one, since
    only a sentinel's first character is ``<``."""
    parts = F.split(output, "<[PSM]>", -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored_text(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = """
with cut as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
    sha256('1:' || coalesce(doc_id::varchar, '')) as h
  from documents),
drawn as (
  select *, len(u) as n, ('0x' || h[1:8])::bigint % (len(u) + 1) as a, ('0x' || h[9:16])::bigint % (len(u) + 1) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 90 then 'plain'
         when ('0x' || h[25:32])::bigint % 100 < 20 then 'spm' else 'psm' end as form
  from cut),
parts as (
  select *, coalesce(array_to_string(u[1:least(a, b)], ''), '') as p, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') as m,
    coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') as s
  from drawn)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from parts
"""

QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
SQL = {"op13_fill_in_middle": OP13_SQL}
