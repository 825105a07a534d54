"""N-gram Jaccard join: the connected components of all pairs of shingle sets at or above a similarity.

Components are the result. Links inside a component that was found already are not enumerated, so there is no list of pairs.

Equal sets are one class from the start, however many rows hold it. For the rest:

1. Prefixes. Of a set of n shingles, ordered rarest first, the first n - ceil(t n) + 1 must share a shingle with any set
   at similarity t. Order: all shingles by hash, the ``FREQUENT`` commonest ones (counted over all documents, so the table
   is bounded) behind them by count. Any order is exact; this one keeps what many documents share out of prefixes.
2. Tiles. A tile holds the sets with one prefix shingle; sets that stand alone or that no other member's size and place
   allow fall out at once.
3. First links. Each set meets up to two members of its tiles' middle; hashed bitmap signatures - as wide as the
   set's size band asks for - bound the overlap from above, the best survivors are checked by exact intersection of
   sorted arrays, and links give components.
4. All other pairs. Tiles whose members are of one component are done. In the others every pair of different
   components is held against size, place and bitmap bound, and the survivors are intersected exactly. Large ones hold
   sets that share much and link with few: their members' shingles are all counted and new tiles are formed by that
   order, in which the shared shingles come last. What is large still is dealt out in blocks; only members outside a tile's
   main component visit the other blocks, so a family of near copies costs its size, not its square.

Both texts of a pair never travel: pairs move as identifiers, and only pairs that pass the bound bring their arrays.

Defined results: a null text, or one without words, has no shingles and links with nothing; its component is its own
id. Fewer words than ``size`` make one shingle of the whole sequence. Repeated rows are one class and repeat in the result.
No rows give none. Extra columns are ignored. Null ids are allowed; a component's id is its smallest id that isn't null.
Shingles and sets are compared by 64-bit hashes. Memory follows a slice of an Arrow batch and the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import textbatch as tb
from brindle.llm.common import small, table, text_or_empty, written
from brindle.llm.components import components
from brindle.llm.worker import tidy

SIZE = 5
PERCENT = 75
FREQUENT = 1 << 16
#: A shingle in this many prefixes is dealt over several tasks when tiles are formed.
HOT = 100_000
#: Members of a tile that stand in one block.
BLOCK = 2_048
ENTRIES_A_PART = 250_000
#: Members of tiles with the same main component that one task takes.
FAMILY = 16_000
#: Members outside its main component from which on a tile is formed anew, by the counts of all shingles of its members.
DENSE = 256


# --- sets ---------------------------------------------------------------------------------------------------------------


def sets_of(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    found, rows = tb.shingles(tb.words(column), size)
    return tb.distinct_by_row(found, rows, len(column))


def set_id(values: np.ndarray) -> int:
    """A 64-bit hash of a set (signed); equal sets only, up to hash collisions."""
    total = np.array([tb.mix(values).sum(dtype=np.uint64)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total += np.array([tb.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)], np.uint64) + np.uint64(len(values))
    return int(tb.mix(total).view(np.int64)[0])


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that links sets of these sizes: ceil(percent * (a + b) / (100 + percent))."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefix_length(n, percent: int):
    return np.where(n > 0, n + (-percent * n) // 100 + 1, 0)


def width_of(n: int) -> int:
    """Bits of a signature: the power of two from four times the size, 256 at least."""
    return max(256, 1 << int(4 * n - 1).bit_length())


def signature(values: np.ndarray) -> bytes:
    bits = np.zeros(width_of(len(values)), np.uint8)
    bits[(values % np.uint64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _sketch_batches(size: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tb.as_strings(batch.column(1))
            n, ids, marks = [], [], []
            for a, b in tb.slices(column):
                for values in sets_of(column.slice(a, b - a), size):
                    n.append(len(values))
                    ids.append(set_id(values) if len(values) else None)
                    marks.append(signature(values) if len(values) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(marks, pa.binary())], names=["id", "th", "n", "sid", "bits"])

    return run


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, th): a row is found again by its id and a hash of its text, since ids may be null or stand in many rows."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(df, text_col).alias("text"))
    return rows.withColumn("th", F.xxhash64("text"))


def sketches(texts: DataFrame, size: int) -> DataFrame:
    """(id, th, n, sid, bits) of every row."""
    return texts.mapInArrow(_sketch_batches(size), "id long, th long, n long, sid long, bits binary")


def _same_row(texts: DataFrame, at: DataFrame) -> Column:
    return texts["id"].eqNullSafe(at["home"]) & (texts["th"] == at["home_th"])


def _once(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``texts`` with rows that agree in id and text once; only those move, counted in each task first."""
    twice = written(rows.groupBy("id", "th").count().where("count > 1").select(F.col("id").alias("home"), F.col("th").alias("home_th")), "repeated-rows")
    if not twice.limit(1).count():
        return texts
    at = small(twice)
    return texts.join(at, _same_row(texts, at), "left_anti").unionByName(texts.join(at, _same_row(texts, at), "left_semi").dropDuplicates(["id", "th", "text"]))


# --- prefixes and tiles ---------------------------------------------------------------------------------------------------

_ENTRY = np.dtype([("hash", "<u8"), ("sid", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def _dealt(parts: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
    """One row per part with its entries' bytes."""
    order = np.argsort(parts, kind="stable")
    parts, entries = parts[order], entries[order]
    head = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else np.zeros(0, np.int64)
    ends = np.r_[head[1:], len(parts)]
    return pa.RecordBatch.from_arrays([pa.array(parts[head], pa.int32()), pa.array([entries[a:b].tobytes() for a, b in zip(head, ends, strict=True)], pa.binary())], names=["part", "entries"])


def _each_set(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The distinct sets of a task, slice by slice."""
    seen: set[int] = set()
    for batch in batches:
        column = tb.as_strings(batch.column(0))
        for a, b in tb.slices(column):
            out = []
            for values in sets_of(column.slice(a, b - a), size):
                if len(values) and (sid := set_id(values)) not in seen:
                    seen.add(sid)
                    out.append((sid, values))
            yield out


def _hash_batches(size: int, percent: int | None, parts: int):
    """The shingles of each set's prefix by hash order, or with no ``percent`` all of them."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _each_set(batches, size):
            if found:
                hashes = np.concatenate([v if percent is None else v[: prefix_length(len(v), percent)] for _, v in found])
                yield _dealt((hashes % np.uint64(parts)).astype(np.int32), hashes)

    return run


def _count_batches(keep: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for batch in batches for x in batch.column(1).to_pylist()]
        found, count = np.unique(np.frombuffer(b"".join(blobs), "<u8"), return_counts=True)
        top = np.argsort(-count, kind="stable")[:keep]
        top = top[count[top] >= 8]
        yield pa.RecordBatch.from_arrays([pa.array(found[top].view(np.int64)), pa.array(count[top], pa.int64())], names=["hash", "count"])

    return run


class Frequent:
    """The commonest shingles (sorted by hash) with their counts; orders a set rarest first."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.counts, self.hot = hashes[order], counts[order], HOT

    def prefix(self, values: np.ndarray, percent: int) -> np.ndarray:
        keep = int(prefix_length(len(values), percent))
        if not len(self.hashes):
            return values[:keep]
        at = np.minimum(np.searchsorted(self.hashes, values), len(self.hashes) - 1)
        common = self.hashes[at] == values
        rare = values[~common]
        if len(rare) >= keep:
            return rare[:keep]
        last = values[common][np.argsort(self.counts[at[common]], kind="stable")]
        return np.concatenate([rare, last])[:keep]

    def spread(self, hashes: np.ndarray, sids: np.ndarray) -> np.ndarray:
        """The share of a hot shingle's sets that each entry belongs to; 0 for the others."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        shares = np.where(self.hashes[at] == hashes, self.counts[at] // self.hot + 1, 1)
        return np.where(shares > 1, sids.astype(np.uint64) % shares.astype(np.uint64), 0).astype(np.int64)


def _entry_batches(size: int, percent: int, parts: int, frequent: Frequent):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _each_set(batches, size):
            if not found:
                continue
            prefixes = [frequent.prefix(v, percent) for _, v in found]
            lengths = np.array([len(p) for p in prefixes])
            entries = np.zeros(lengths.sum(), _ENTRY)
            entries["hash"] = np.concatenate(prefixes)
            entries["sid"] = np.repeat([s for s, _ in found], lengths)
            entries["n"] = np.repeat([len(v) for _, v in found], lengths)
            entries["pos"] = np.arange(len(entries)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at = entries["hash"] + frequent.spread(entries["hash"], entries["sid"]).astype(np.uint64)
            yield _dealt((at % np.uint64(parts)).astype(np.int32), entries)

    return run


def tile_pairs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) inside runs that start at ``first`` with ``count`` members each."""
    each = count * (count - 1) // 2
    total = int(each.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.arange(total) - np.repeat(np.cumsum(each) - each, each)  # 0, 1, ... within a run: (0,1) (0,2) (1,2) (0,3) ...
    j = ((1 + np.sqrt(8.0 * k + 1)) / 2).astype(np.int64)
    j -= j * (j - 1) // 2 > k
    j += (j + 1) * j // 2 <= k
    base = np.repeat(first, each)
    return base + k - j * (j - 1) // 2, base + j


def feasible(n_a, pos_a, n_b, pos_b, percent: int) -> np.ndarray:
    """Whether sizes, and the places of a shared shingle taken as the first shared one, leave room for the overlap."""
    low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (100 * low >= percent * high) & (np.minimum(n_a - pos_a, n_b - pos_b) >= needed(n_a, n_b, percent))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(keys)])


def _tile_batches(percent: int, small_tile: int, frequent: Frequent):
    """Entries of a part -> members of tiles with a partner in reach, each with up to two members of the middle."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for batch in batches for x in batch.column(1).to_pylist()]
        entries = np.frombuffer(b"".join(blobs), _ENTRY)
        order = np.lexsort((entries["sid"], entries["hash"]))
        entries = entries[order]
        if len(entries):
            entries = entries[np.r_[True, (entries["hash"][1:] != entries["hash"][:-1]) | (entries["sid"][1:] != entries["sid"][:-1])]]
        first, count = _runs(entries["hash"])
        often = np.zeros(len(first), bool)
        if len(frequent.hashes) and len(first):
            at = np.minimum(np.searchsorted(frequent.hashes, entries["hash"][first]), len(frequent.hashes) - 1)
            often = (frequent.hashes[at] == entries["hash"][first]) & (frequent.counts[at] >= frequent.hot)
        entries = entries[np.repeat((count > 1) | often, count)]
        often = often[(count > 1) | often]
        entries = entries[np.lexsort((entries["n"], entries["hash"]))]
        first, count = _runs(entries["hash"])
        n, pos = entries["n"].astype(np.int64), entries["pos"].astype(np.int64)
        # pairs of large tiles are looked at later, in blocks; of a hot shingle's tile only a share is here
        keep = np.repeat((count > small_tile) | often, count)
        some = count <= small_tile
        i, j = tile_pairs(first[some], count[some])
        ok = feasible(n[i], pos[i], n[j], pos[j], percent)
        keep[i[ok]] = keep[j[ok]] = True
        middle, quarter = np.repeat(first + count // 2, count), np.repeat(first + count // 4, count)
        member = np.arange(len(entries))

        def partner(at: np.ndarray) -> pa.Array:
            good = (member != at) & (100 * np.minimum(n, n[at]) >= percent * np.maximum(n, n[at]))
            return pa.array(entries["sid"][at][keep], pa.int64(), mask=~good[keep])

        if len(entries):
            columns = [entries["hash"][keep].view(np.int64), entries["sid"][keep], n[keep], pos[keep]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), partner(middle), partner(quarter)], names=["hash", "sid", "n", "pos", "middle", "quarter"])

    return run


# --- bounds and checks ------------------------------------------------------------------------------------------------------


def overlap_bound(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> int:
    """An upper bound of the overlap: differing bits each stand for a shingle of one set only."""
    a, b = int.from_bytes(bits_a, "little"), int.from_bytes(bits_b, "little")
    wide_a, wide_b = 8 * len(bits_a), 8 * len(bits_b)
    while wide_a > wide_b:
        wide_a //= 2
        a = (a >> wide_a) | (a & (1 << wide_a) - 1)
    while wide_b > wide_a:
        wide_b //= 2
        b = (b >> wide_b) | (b & (1 << wide_b) - 1)
    return (n_a + n_b - (a ^ b).bit_count()) // 2


def _bound_batches(percent: int):
    """(a, b, n_a, bits_a, n_b, bits_b) -> (a, b, slack) of the pairs whose bound reaches what is needed."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, bits_a, n_b, bits_b = (batch.column(i).to_pylist() for i in range(2, 6))
            slack = np.array([overlap_bound(*x) - -(-(percent * (x[0] + x[2])) // (100 + percent)) for x in zip(n_a, bits_a, n_b, bits_b, strict=True)], np.int64)
            ok = pa.array(slack >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(slack[slack >= 0])], names=["a", "b", "slack"])

    return run


def _array_batches(size: int):
    """(text, key, side, sid) -> (key, side, sid, set): the set again, from the whole text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, expected = tb.as_strings(batch.column(0)), batch.column(2).to_pylist()
            for a, b in tb.slices(column):
                sets = sets_of(column.slice(a, b - a), size)
                same = [len(v) > 0 and set_id(v) == e for v, e in zip(sets, expected[a:b], strict=True)]  # ids may repeat
                rows = batch.slice(a, b - a).filter(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), pa.array([v.tobytes() for v, ok in zip(sets, same, strict=True) if ok], pa.binary())], names=["key", "sid", "values"])

    return run


def _exact_batches(percent: int):
    """(a, b, values_a, values_b) -> (u, v) of the linked pairs, by intersection of the sorted arrays."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            ok = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["u", "v"])

    return run


def exact_links(pairs: DataFrame, texts: DataFrame, homes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. ``texts`` (id, text, th), ``homes`` (sid, home, home_th: a row that holds the set)."""
    wanted = pairs.select(F.col("a").alias("sid"), F.col("b").alias("key"))
    asked = pairs.select(F.col("b").alias("sid"), F.col("b").alias("key")).distinct()

    def arrays(of: DataFrame) -> DataFrame:
        at = small(written(of.join(homes, "sid"), "homes"))
        rows = texts.join(at, _same_row(texts, at)).select("text", "key", "sid")
        return rows.mapInArrow(_array_batches(size), "key long, sid long, values binary")

    left, right = arrays(wanted), arrays(asked)
    joined = left.withColumnsRenamed({"sid": "a", "values": "values_a"}).join(right.select("key", F.col("values").alias("values_b")), "key")
    return joined.select("a", F.col("key").alias("b"), "values_a", "values_b").mapInArrow(_exact_batches(percent), "u long, v long")


class Signatures:
    """Signatures of a task's sets by number, as rows of 64-bit words for each width; bounds many pairs at once."""

    def __init__(self, bits: pa.Array, n: np.ndarray) -> None:
        raw, ends = tb.text_bytes(bits.cast(pa.large_binary()))
        self.n, self.width = n, np.diff(ends)
        self.row = np.zeros(len(n), np.int64)
        self.words: dict[int, np.ndarray] = {}
        for width in np.unique(self.width):
            own = np.flatnonzero(self.width == width)
            self.row[own] = np.arange(len(own))
            self.words[int(width)] = raw[(ends[own][:, None] + np.arange(width)).ravel()].view(np.uint64).reshape(len(own), -1)

    def _folded(self, numbers: np.ndarray, width: int, to: int) -> np.ndarray:
        out = self.words[width][self.row[numbers]]
        while width > to:
            width //= 2
            out = out[:, : width // 8] | out[:, width // 8 :]
        return out

    def slack(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """The most that each pair's overlap can be, less what it needs to link."""
        differing = np.zeros(len(a), np.int64)
        shape = self.width[a] << 32 | self.width[b]
        for both in np.unique(shape):
            at = np.flatnonzero(shape == both)
            wide_a, wide_b = int(both) >> 32, int(both) & 0xFFFFFFFF
            to = min(wide_a, wide_b)
            for part in np.array_split(at, len(at) * to // (16 << 20) + 1):
                x = self._folded(a[part], wide_a, to) ^ self._folded(b[part], wide_b, to)
                differing[part] = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        return (self.n[a] + self.n[b] - differing) // 2 - needed(self.n[a], self.n[b], percent)


def _cross_batches(percent: int):
    """Members of blocks -> (a, b) of different components that size, place and bitmap allow.

    Rows: family, share, hash, block, sid, n, pos, root, home, bits; a set's bits come once a task, in a row without a
    tile. A pair is looked at where one member is at home, and once a task.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        rows = pa.Table.from_batches(got).combine_chunks()
        del got
        is_mark = np.asarray(rows["bits"].is_valid())
        marks = rows.filter(pa.array(is_mark))
        known, first = np.unique(marks["sid"].to_numpy(), return_index=True)
        if not len(known):
            return
        signatures = Signatures(marks["bits"].combine_chunks().take(pa.array(first)), marks["n"].to_numpy()[first])
        members = rows.filter(pa.array(~is_mark))
        del rows, marks
        number = np.searchsorted(known, members["sid"].to_numpy())
        tile, block, n, pos, root, home = (members[c].to_numpy() for c in ("hash", "block", "n", "pos", "root", "home"))
        # in each block of a tile its commonest component goes last: its members need not meet each other
        by = np.lexsort((root, block, tile))
        head = np.r_[True, (tile[by][1:] != tile[by][:-1]) | (block[by][1:] != block[by][:-1]) | (root[by][1:] != root[by][:-1])]
        size = np.zeros(len(by), np.int64)
        size[by] = np.diff(np.r_[np.flatnonzero(head), len(by)])[np.cumsum(head) - 1]
        order = np.lexsort((n, root, size, block, tile))
        tile, block, n, pos, root, home, number = (x[order] for x in (tile, block, n, pos, root, home, number))
        start = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (block[1:] != block[:-1])]) if len(tile) else np.zeros(0, np.int64)
        count = np.diff(np.r_[start, len(tile)])
        codes: list[np.ndarray] = []
        held = 0

        def check(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal held
            ok = (root[i] != root[j]) & (home[i] | home[j])
            i, j = i[ok], j[ok]
            ok = feasible(n[i], pos[i], n[j], pos[j], percent)
            low, high = np.minimum(number[i[ok]], number[j[ok]]), np.maximum(number[i[ok]], number[j[ok]])
            if len(low):
                codes.append(np.unique(low * len(known) + high))
                held += len(codes[-1])
                if held > 2_000_000:
                    codes[:] = [np.unique(np.concatenate(codes))]
                    held = -len(codes[0])

        few = count <= 64
        for lo in range(0, few.sum(), 5_000):
            check(*tile_pairs(start[few][lo : lo + 5_000], count[few][lo : lo + 5_000]))
        for f, c in zip(start[~few], count[~few], strict=True):
            last = c - int((root[f : f + c] == root[f + c - 1]).sum())  # from here on all are of one component
            for lo in range(f, f + last, 256):
                up = min(lo + 256, f + last)
                i, j = np.meshgrid(np.arange(lo, up), np.arange(lo, f + c), indexing="ij")
                i, j = i.ravel(), j.ravel()
                check(i[i < j], j[i < j])
        pairs = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        a, b = pairs // len(known), pairs % len(known)
        slack = np.concatenate([signatures.slack(a[k : k + 200_000], b[k : k + 200_000], percent) for k in range(0, len(a), 200_000)] or [np.zeros(0, np.int64)])
        a, b = a[slack >= 0], b[slack >= 0]
        yield pa.RecordBatch.from_arrays([pa.array(known[a]), pa.array(known[b])], names=["a", "b"])

    return run


def _opened(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with their components, tiles that join two components: hash, members, main component), the latter written."""
    tagged = members.select("hash", "sid", "n", "pos").join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    of_tile = tagged.groupBy("hash", "root").agg(F.count("*").alias("k")).groupBy("hash")
    opened = of_tile.agg(F.count("*").alias("roots"), F.sum("k").alias("members"), F.max("k").alias("in_main"), F.max_by("root", F.struct("k", "root")).alias("main")).where("roots > 1")
    return tagged, written(opened.drop("roots"), "open-tiles")


def _crossing(tagged: DataFrame, opened: DataFrame, marks: DataFrame, percent: int, tasks: int, hot: int) -> DataFrame:
    """(a, b) of the pairs in open tiles that may link.

    Tiles with the same main component hold much the same sets, so they go to the same tasks, a set's bits once to each;
    a component with many such tiles is dealt over tasks in proportion.
    """
    families = opened.groupBy("main").agg(F.ceil(F.sum("members") / FAMILY).cast("int").alias("shares"))
    placed = tagged.join(opened.join(families, "main"), "hash").withColumn("blocks", F.ceil(F.col("members") / hot).cast("int"))
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    stays = (F.col("blocks") == 1) | (F.col("root") == F.col("main"))
    block = F.explode(F.when(stays, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spots = placed.withColumn("own", own).withColumn("block", block).withColumn("share", F.pmod(F.xxhash64("hash", "block"), F.col("shares")).cast("int"))
    spots = written(spots.select(F.col("main").alias("family"), "share", "hash", "block", "sid", "n", "pos", "root", (F.col("own") == F.col("block")).alias("home")), "spots")
    empty = lambda name, kind: F.lit(None).cast(kind).alias(name)
    once = spots.select("family", "share", "sid").distinct().join(marks, "sid")
    once = once.select("family", "share", empty("hash", "long"), empty("block", "int"), "sid", "n", empty("pos", "long"), empty("root", "long"), empty("home", "boolean"), "bits")
    rows = spots.withColumn("bits", F.lit(None).cast("binary")).unionByName(once)
    found = rows.repartition(tasks, "family", "share").mapInArrow(_cross_batches(percent), "a long, b long")
    return found.distinct()


# --- the join -------------------------------------------------------------------------------------------------------------


def _tiles(texts: DataFrame, size: int, percent: int, total: int, whole: bool, name: str) -> DataFrame:
    """Members of the tiles of ``texts``; ``total`` shingles say how far they are dealt out. With ``whole`` the order is by the
    counts of all shingles and not only of those in prefixes by hash."""
    shuffles = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(8 * shuffles, total // (4 * ENTRIES_A_PART))
    tasks = max(shuffles, parts // 8)
    dealt = texts.select("text").mapInArrow(_hash_batches(size, None if whole else percent, parts), "part int, entries binary").repartition(tasks, "part")
    common = dealt.mapInArrow(_count_batches(FREQUENT), "hash long, count long").orderBy(F.desc("count"), "hash").limit(FREQUENT).toArrow()
    frequent = Frequent(common["hash"].to_numpy().view(np.uint64), common["count"].to_numpy())
    dealt = texts.select("text").mapInArrow(_entry_batches(size, percent, parts, frequent), "part int, entries binary").repartition(tasks, "part")
    return written(dealt.mapInArrow(_tile_batches(percent, 64, frequent), "hash long, sid long, n long, pos long, middle long, quarter long"), name)


def _dense(tagged: DataFrame, opened: DataFrame, texts: DataFrame, homes: DataFrame, dense: int) -> tuple[DataFrame, DataFrame] | None:
    """(open tiles with many members outside their main component, texts of their members), or None if there are none."""
    large = written(opened.where(F.col("members") - F.col("in_main") > dense).select("hash"), "dense-tiles")
    if not large.limit(1).count():
        return None
    sids = tagged.join(large, "hash", "left_semi").select("sid").distinct()
    at = small(written(sids.join(homes, "sid").select("home", "home_th").distinct(), "dense-homes"))
    return large, texts.join(at, _same_row(texts, at), "left_semi")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT, hot: int = BLOCK, dense: int = DENSE) -> DataFrame:
    """(id, n_shingles, set_id, component_id) of every row of ``df``."""
    texts = _texts(df, id_col, text_col)
    rows = written(sketches(texts, size), "sketches")
    texts = _once(texts, rows)
    home = F.min(F.struct("id", "th")).alias("home")
    classes = rows.where("sid is not null").groupBy("sid").agg(F.min("id").alias("id"), home, F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = written(classes.select("sid", "id", F.col("home.id").alias("home"), F.col("home.th").alias("home_th"), "n", "bits"), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = _tiles(texts, size, percent, total, False, "tiles")

    starts = members.select("sid", F.explode(F.array("middle", "quarter")).alias("b")).where("b is not null").withColumnRenamed("sid", "a").distinct()
    marks = classes.select("sid", "n", "bits")
    of_a, of_b = (marks.withColumnsRenamed({"sid": x, "n": f"n_{x}", "bits": f"bits_{x}"}) for x in "ab")
    bounded = starts.join(of_a, "a").join(of_b, "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(_bound_batches(percent), "a long, b long, slack long")
    best = bounded.groupBy("a").agg(F.max(F.struct("slack", "b")).alias("one"), F.min(F.struct("slack", "b")).alias("two"))
    chosen = written(best.select("a", F.explode(F.array_distinct(F.array("one.b", "two.b"))).alias("b")), "first-pairs")
    homes = classes.select("sid", "home", "home_th")
    links = written(exact_links(chosen, texts, homes, size, percent), "first-links")
    roots = written(components(links, rounds=4), "first-roots")

    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (32 * ENTRIES_A_PART))
    tagged, opened = _opened(members, roots)
    # large open tiles hold many sets that share much and link with few: among these sets, tiles by the counts of all their
    # shingles take their place. A pair of sets is in both or has a smaller tile
    again = _dense(tagged, opened, texts, homes, dense)
    if again is not None:
        large, of_members = again
        opened = opened.join(large, "hash", "left_anti")
    crossing = _crossing(tagged, opened, marks, percent, tasks, hot)
    if again is not None:
        inner = _opened(_tiles(of_members, size, percent, total, True, "dense-entries"), roots)
        crossing = crossing.unionByName(_crossing(*inner, marks, percent, tasks, hot))
    crossing = written(crossing, "other-pairs")
    more = written(exact_links(crossing, texts, homes, size, percent), "other-links")
    # links between the first components only: few, however many links a family has
    root_of = {x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "uv"}
    between = links.unionByName(more).join(root_of["u"], "u", "left").join(root_of["v"], "v", "left")
    top = components(between.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")).where("u != v").distinct())

    first = classes.select("sid", "id").join(roots.select(F.col("node").alias("sid"), F.col("root").alias("low")), "sid", "left").withColumn("low", F.coalesce("low", "sid"))
    placed = first.join(top.select(F.col("node").alias("low"), "root"), "low", "left").select("sid", "id", F.coalesce("root", "low").alias("root"))
    placed = written(placed, "placed")
    of_sets = placed.join(placed.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("sid", "component_id")
    out = rows.select("id", "n", "sid").join(of_sets, "sid", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.col("sid").alias("set_id"), F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` that stay when one document of each component does: the one with the smallest id.

    Rows that share an id and a text are one document; rows without an id can't be named and stay."""
    found = written(near_duplicates(df, id_col=id_col, text_col=text_col, size=size, percent=percent).select("id", "set_id", "component_id"), "near")
    gone = written(found.where("id != component_id").select("id", "set_id").distinct(), "gone")
    again = written(found.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "again")
    own, ids = df[id_col].cast("long"), gone.select("id").distinct()
    if not again.limit(1).count():
        return df.join(small(ids), own == ids["id"], "left_anti")
    once = df.join(small(again), own == again["id"], "left_anti").join(small(ids), own == ids["id"], "left_anti")
    # rows that share an id may be different documents: these go by id and set
    repeated = df.join(small(again), own == again["id"], "left_semi").dropDuplicates([id_col, text_col])
    repeated = repeated.withColumn("_text", text_or_empty(repeated, text_col))
    fields = T.StructType([*df.schema.fields, T.StructField("_set", T.LongType())])
    repeated = repeated.mapInArrow(_with_set_batches(size), fields)
    sets = gone.select(F.col("id").alias("_id"), F.col("set_id").alias("_gone"))
    stays = repeated.join(small(sets), (F.col(id_col).cast("long") == F.col("_id")) & (F.col("_set") == F.col("_gone")), "left_anti")
    return once.unionByName(stays.drop("_set"))


def _with_set_batches(size: int):
    """Rows with the text last -> the rows with its set's id in the place of it."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tb.as_strings(batch.column(batch.num_columns - 1))
            ids = [set_id(v) if len(v) else None for a, b in tb.slices(column) for v in sets_of(column.slice(a, b - a), size)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.int64())], names=[*batch.schema.names[:-1], "_set"])

    return run


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP10_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
sh as (select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 4], ' ') end as s
       from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from sh group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
sym as (select a, b from links union all select b, a from links),
reach(src, node) as (select a, b from sym union select src, b from reach join sym on node = a),
comp as (select src as doc_id, least(src, min(node)) as c from reach group by src)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(c, d.doc_id) as component_id
from documents d left join n using (doc_id) left join comp using (doc_id)
"""
QUERIES = {"op10_jaccard_join": op10_jaccard_join}
SQL = {"op10_jaccard_join": OP10_SQL}
