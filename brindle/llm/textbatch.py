"""Word and shingle hashes of an Arrow column of texts, computed with numpy over the raw UTF-8 bytes.

A word is a maximal run of bytes other than the six ASCII blanks (0x20, 0x09-0x0D). Hashes are 64-bit polynomial
hashes of the bytes; ``lower=True`` folds A-Z only. Every function works on a bounded slice of a batch, so memory
follows the slice and not the batch (see ``slices``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED_CODES = _BYTE_CODES.copy()
_FOLDED_CODES[65:91] = _BYTE_CODES[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Breaks words at every ASCII character but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_SHINGLE_CODES = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i in 0..n, modulo 2**64; kept, since every slice needs them."""
    if len(_POWERS.get("up", ())) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][: n + 1], _POWERS["down"][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous array of large strings; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and the n + 1 offsets that divide them."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each (a longer text stands alone)."""
    _, ends = text_bytes(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield at, to
        at = to


def prefix_hashes(raw: np.ndarray, lower: bool) -> np.ndarray:
    """h with h[i] = hash state after i bytes; see ``substring_hashes``."""
    up, _ = _powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_FOLDED_CODES if lower else _BYTE_CODES)[raw] * up[:-1], out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end), equal for equal bytes wherever they stand."""
    _, down = _powers(len(prefix) - 1)
    return mix((prefix[end] - prefix[start]) * down[start])


@dataclass
class Words:
    """Words of a slice: byte positions, owning row, hash; ``first`` holds each row's first word (n + 1 entries)."""

    raw: np.ndarray
    ends_of_rows: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(column: pa.Array, lower: bool = True, breaks: np.ndarray = _BLANK) -> Words:
    """``breaks`` marks the bytes that no word holds; by default the six blanks."""
    raw, ends = text_bytes(column)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~breaks[raw]
    starts = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    cut = ends[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    starts[cut] = inside[1:-1][cut]  # a word never spans two texts
    stops[cut - 1] = inside[1:-1][cut - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    row = np.searchsorted(ends, start, side="right") - 1
    return Words(raw, ends, start, end, row, substring_hashes(prefix_hashes(raw, lower), start, end), np.searchsorted(row, np.arange(len(column) + 1)))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every window of ``size`` words; a row of 1 to size - 1 words has its whole sequence as one."""
    n = len(w.hash)
    count = np.diff(w.first)
    parts, rows = [], []
    if n >= size:
        whole = w.row[: n - size + 1] == w.row[size - 1 :]
        acc = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            acc += w.hash[k : n - size + 1 + k] * _SHINGLE_CODES[k]
        parts.append(mix(acc[whole]))
        rows.append(w.row[: n - size + 1][whole])
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        acc = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            acc[has] += w.hash[w.first[short[has]] + k] * _SHINGLE_CODES[k]
        parts.append(mix(acc + _SHINGLE_CODES[32 + count[short]]))
        rows.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(rows)


def distinct_by_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> list[np.ndarray]:
    """The sorted distinct values of each row."""
    by_row = np.argsort(rows, kind="stable")
    values, bounds = values[by_row], np.searchsorted(rows[by_row], np.arange(n_rows + 1))
    return [np.unique(values[bounds[i] : bounds[i + 1]]) for i in range(n_rows)]
