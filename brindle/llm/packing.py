"""Packing of tokenised documents into sequences of a fixed length, by patterns fitted to the length histogram.

Only the histogram (at most ``capacity`` bins, whatever the corpus) reaches the driver. There, patterns of few lengths that
nearly fill a sequence are enumerated, their repeat counts fitted to the histogram by non-negative least squares and rounded
to what the histogram holds; ``ROUNDS`` says how many pieces and how much waste. Best fit packs the residual, a whole count
of equal lengths at a time. The outcome is a list of patterns with repeats that uses every bin up. Pieces then take their
places in parallel: a piece's rank among the pieces of its length - counted within hashed buckets, so that a length
that a third of all pieces share is still spread - selects the slot, and the slot names sequence and offset.

Defined results: a null or empty text is a document of its end token alone. Repeated rows are documents of their own.
No rows give no sequences. Extra columns pass through (renamed ``<name>_in`` where they clash with results). A document
longer than the capacity is cut into pieces of exactly that length and a last one. Memory follows the longest text.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import textbatch as tb
from brindle.llm.common import small, table, written
from brindle.llm.worker import Recent, kept, tidy

CAPACITY = 4096
#: Lengths by which a pattern's middle pieces stand off from equal shares.
SHIFTS = (0, 1, -1, 3)
#: Pieces of a pattern and tokens that it may leave free, at most, round after round; each is tried again on what it leaves.
ROUNDS = ((2, 1), (2, 8), (3, 1), (3, 8), (6, 1), (6, 8), (12, 8))
REPEATS = 2
#: Bytes of encoded chunks that a worker keeps.
KEPT_BYTES = 48 << 20
#: What a chunk and its ids take beside their own bytes: two objects' heads and a place in a map.
CHUNK_BYTES = 200
LETTERS_TOGETHER = 2_000
_MARKS = b".,;:!?#$%&*"


# --- tokens -----------------------------------------------------------------------------------------------------------


class ChunkEncoder:
    """Ids of texts by a vocabulary whose pre-tokens never span a blank: each blank-separated chunk is encoded by the
    library once and kept. Lower-cased ASCII first, as the vocabulary's normaliser does, unless a special string may
    stand in the text."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Recent(KEPT_BYTES, CHUNK_BYTES)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, chunks: list[bytes]) -> None:
        """Encodes chunks and keeps them. Those of letters only are one pre-token each, which ends in the one token that
        ends a word: they are encoded many to a text and cut apart there."""
        letters, others = [], []
        for c in chunks:
            (letters if c.decode().isalpha() else others).append(c)
        groups = [letters[i : i + LETTERS_TOGETHER] for i in range(0, len(letters), LETTERS_TOGETHER)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(found.ids, "<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(group):
                others += group
                continue
            data, edges = ids.tobytes(), (4 * ends).tolist()
            self.known.add(group, [data[a:b] for a, b in zip([0, *edges[:-1]], edges, strict=True)])
        found = self.tokenizer.encode_batch_fast([c.decode() for c in others], add_special_tokens=False)
        self.known.add(others, [np.asarray(e.ids, "<u4").tobytes() for e in found])

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Texts are split, their distinct chunks numbered and the chunks' ids put
        end to end by Arrow; only distinct chunks become Python objects."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column)))
        numbered = split.flatten().dictionary_encode()
        if not len(numbered):
            return [b""] * len(column)
        chunks = numbered.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        self.known.turn()
        wanted = set(chunks)
        wanted.discard(b"")  # before a first blank and behind a last one
        # marks after a letter or digit are a pre-token of their own, so only the word before them and they are looked up and kept
        marked = [(c, word, c[len(word) :]) for c in wanted if c[-1] in _MARKS and (word := c.rstrip(_MARKS))[-1:].isalnum()]
        wanted.difference_update([c for c, _, _ in marked])
        missing = self.known.missing(wanted.union([word for _, word, _ in marked], [marks for _, _, marks in marked]))
        if missing:
            self._learn(list(missing))
        known = self.known.young
        ids = {c: known[c] for c in wanted}
        ids.update([(c, known[word] + known[marks]) for c, word, marks in marked])
        ids[b""] = b""
        whole = pa.array([ids[c] for c in chunks], pa.large_binary()).take(numbered.indices)
        _, offsets, data = whole.buffers()
        ends = np.frombuffer(offsets, np.int64)[whole.offset :][split.offsets.to_numpy()].tolist()
        data = memoryview(data)
        return [data[a:b].tobytes() for a, b in pairwise(ends)]


def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker and vocabulary."""
    return kept(__name__, path, lambda: ChunkEncoder(path))


PIECES = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def _piece_batches(text_at: int, path: str, end_id: int, capacity: int, keep_ids: bool):
    end = np.asarray([end_id], "<u4").tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tb.as_strings(batch.column(text_at))
            for a, b in tb.slices(column):
                rows, piece, start, length, crc, data = [], [], [], [], [], []
                for i, ids in enumerate(encoder(path).encode(column.slice(a, b - a)), a):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            data.append(part)
                kept = pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != text_at], names=[c for i, c in enumerate(batch.schema.names) if i != text_at]).take(pa.array(rows, pa.int64()))
                columns = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = PIECES.fieldNames()
                if keep_ids:
                    columns, names = [*columns, pa.array(data, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*kept.schema.names, *names])

    return run


def token_pieces(df: DataFrame, tokenizer_path: str, *, text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: the other columns of ``df``, piece, start, length, ids_crc32 and, if asked for, ``ids``."""
    results = {*PIECES.fieldNames(), "ids", "sequence_id", "offset"}
    df = df.withColumnsRenamed({c: f"{c}_in" for c in df.columns if c in results and c != text_col})
    df = df.withColumn(text_col, df[text_col].cast("string"))
    fields = [f for f in df.schema.fields if f.name != text_col] + PIECES.fields + ([T.StructField("ids", T.BinaryType())] if keep_ids else [])
    return df.mapInArrow(_piece_batches(df.columns.index(text_col), tokenizer_path, end_id, capacity, keep_ids), T.StructType(fields))


# --- the plan, on the histogram -----------------------------------------------------------------------------------------


def patterns_of(left: np.ndarray, capacity: int, waste: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of at most ``most`` lengths of the histogram that leave at most ``waste`` tokens of a sequence free: a row
    each, longest piece first and 0 behind the last, and their waste.

    Each length leads patterns of one to ``most`` pieces: those between its first and its last are of about equal shares
    of the room, ``SHIFTS`` lengths above or below; the last is the longest that still fits. Whole columns at a time, so the
    work is bounded by the capacity and not by what is packed."""
    lengths = np.flatnonzero(left)
    if not len(lengths):
        return np.zeros((0, most), np.int64), np.zeros(0, np.int64)
    out = [np.zeros((0, most), np.int64)]
    for pieces in range(1, most + 1):
        for shift in SHIFTS if pieces > 2 else (0,):
            rows = np.zeros((len(lengths), most), np.int64)
            rows[:, 0] = lengths
            room = capacity - lengths
            alive = np.ones(len(lengths), bool)
            for k in range(1, pieces):
                share = room // (pieces - k) if k < pieces - 1 else room
                at = np.searchsorted(lengths, share, side="right") - 1
                if k < pieces - 1:
                    at = at + shift * (1 if k % 2 else -1)
                alive &= (at >= 0) & (at < len(lengths))
                chosen = lengths[np.clip(at, 0, len(lengths) - 1)]
                alive &= chosen <= room
                rows[:, k] = chosen
                room = room - chosen
            out.append(rows[alive & (room >= 0) & (room <= waste)])
    rows = np.unique(-np.sort(-np.concatenate(out), axis=1), axis=0)
    return rows, capacity - rows.sum(axis=1)


def fit_repeats(rows: np.ndarray, counts: np.ndarray, steps: int = 60) -> np.ndarray:
    """Non-negative least squares: x >= 0 that brings sum_j x_j * (uses of pattern j) near the counts. Projected gradient
    steps, scaled by how many patterns a length is in and how many pieces a pattern has."""
    pattern, place = np.nonzero(rows)
    length = rows[pattern, place]
    x = np.zeros(len(rows))
    if not len(rows):
        return x
    of_length = np.maximum(np.bincount(length, minlength=len(counts)), 1)
    of_pattern = np.bincount(pattern, minlength=len(rows))
    for _ in range(steps):
        residual = (counts - np.bincount(length, weights=x[pattern], minlength=len(counts))) / of_length
        x = np.maximum(x + np.bincount(pattern, weights=residual[length], minlength=len(rows)) / of_pattern, 0.0)
    return x


def rounded(rows: np.ndarray, fitted: np.ndarray, spare: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeats that the histogram ``left`` holds; it is reduced by them. First the whole parts, then one more for the
    patterns with the largest remainders, long first pieces and little waste before others."""
    out: dict[int, int] = {}
    uses = [[(int(a), int(m)) for a, m in zip(*np.unique(r[r > 0], return_counts=True), strict=True)] for r in rows]

    def take(j: int, times: int) -> None:
        times = min(times, *(int(left[a]) // m for a, m in uses[j]))
        if times > 0:
            out[j] = out.get(j, 0) + times
            for a, m in uses[j]:
                left[a] -= times * m

    for j in np.argsort(-fitted, kind="stable"):
        if fitted[j] < 1:
            break
        take(int(j), int(fitted[j] + 1e-9))
    for j in np.lexsort((spare, -(fitted - np.floor(fitted)), -rows[:, 0])):
        take(int(j), 1)
    return [(tuple(a for a in rows[j].tolist() if a), times) for j, times in out.items()]


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in order, repeats): sequences that together hold exactly ``counts[n]`` pieces of each length n.

    Patterns of few pieces come first, so that short pieces stay for where one of them completes a sequence; what they leave is
    enumerated, fitted and rounded again with more pieces and more waste allowed. Best fit packs the residual. It is tried on
    what each round leaves, and the rounds stop where patterns and residual make the fewest sequences, so there are never more
    than best fit alone would make."""
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    rounds = [(0, left.copy())]  # patterns so far and what they leave
    for most, waste in ROUNDS:
        for _ in range(REPEATS):
            before = int(left.sum())
            rows, spare = patterns_of(left, capacity, waste, most)
            out += rounded(rows, fit_repeats(rows, left), spare, left)
            if before - int(left.sum()) <= before // 20:
                break
        rounds.append((len(out), left.copy()))
    best: list[tuple[tuple[int, ...], int]] | None = None
    for used, rest in reversed(rounds):
        planned = out[:used] + best_fit(rest, capacity)
        if best is None or sum(times for _, times in planned) < sum(times for _, times in best):
            best = planned
    return best


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing over counts: equal lengths go together into groups of equally filled sequences."""
    groups: dict[int, list[list]] = {}  # room left -> [lengths, repeats]
    rooms: list[int] = []

    def add(room: int, lengths: tuple[int, ...], times: int) -> None:
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append([lengths, times])

    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = min(capacity // length, count)
                times = count // each
                add(capacity - each * length, (length,) * each, times)
                count -= each * times
                continue
            room = rooms[at]
            lengths, times = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = min(room // length, max(1, count // times))
            used = min(times, count // each)
            if used < times:
                add(room, lengths, times - used)
            add(room - each * length, lengths + (length,) * each, used)
            count -= each * used
    return [(tuple(lengths), times) for room in groups.values() for lengths, times in room]


def slots(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: rank r of a length uses the last row with first rank
    <= r and stands in sequence ``first sequence + r - first rank``."""
    rows, taken, sequence = [], {}, 0
    for lengths, times in planned:
        offset = 0
        for a in lengths:
            rows.append((a, taken.get(a, 0), sequence, offset))
            taken[a] = taken.get(a, 0) + times
            offset += a
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


# --- places -------------------------------------------------------------------------------------------------------------


def _place_batches(rows: np.ndarray):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = rows[:, 0].astype(np.float64) * 2.0**40 + rows[:, 1]  # exact below 2**53: lengths < 2**13, ranks < 2**40
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            at = np.searchsorted(keys, length.astype(np.float64) * 2.0**40 + rank, side="right") - 1
            keep = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])],
                names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, *, order_by: list[str], capacity: int = CAPACITY, rows_a_bucket: int = 200_000) -> DataFrame:
    """``pieces`` (with ``length``) and each one's sequence_id and offset. ``order_by`` names columns that tell rows
    apart; ties are rows that may swap places."""
    pieces = written(pieces, "pieces")
    found = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in found:
        counts[row["length"]] = row["count"]
    rows = slots(plan(counts))
    buckets = max(16, -(-int(counts.sum()) // rows_a_bucket))
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64(*order_by), F.lit(buckets)).cast("int"))
    sizes = salted.groupBy("length", "bucket").agg(F.count("*").alias("in_bucket"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("first"))
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order_by)))
    placed = ranked.join(small(firsts), ["length", "bucket"]).withColumn("rank", (F.col("first") + F.col("nth") - 1).cast("long"))
    placed = placed.select(*pieces.columns, "rank")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return placed.mapInArrow(_place_batches(rows), schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(df: DataFrame, path: str, *, text_col: str = "text", id_col: str = "doc_id", end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack the documents of ``df``; see the module's text."""
    pieces = token_pieces(df, path, text_col=text_col, end_id=end_id, capacity=capacity, keep_ids=keep_ids)
    return pack(pieces, order_by=[id_col, "piece", "ids_crc32"], capacity=capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, tokenizer_path()).select("doc_id", *PIECES.fieldNames(), "sequence_id", "offset")


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
SQL: dict[str, str] = {}
