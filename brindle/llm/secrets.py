"""Secret scan with a recursive decoding worklist.

Three kinds are found in the text itself (the base findings) and in every layer that can be unwrapped from it. A
layer is a text with, for each of its characters, the range of the original text that it came from. Unwrapping:
percent-encoding and backslash escapes decode a layer as a whole (the characters between them stay, so a secret may
be half encoded); base64 runs, joined across line breaks, decode to layers of their own at each of the four alignments,
and so does every zlib, gzip, zip, bzip2, xz, lzma or zstd frame in them or in another frame, and raw deflate that fills a
payload. What a frame only repeats of the bytes around it (stored blocks) is looked at there, once, however many frames
overlap in it. Text of two bytes a character is folded to one. Bytes that are no UTF-8 spoil nothing but
themselves; bytes in which neither a secret nor a further encoding has room are not entered. Each new layer goes on the worklist and is scanned and unwrapped in turn until nothing new appears; a layer
seen before at the same place is not entered again, which ends cycles. A find in a layer is reported at the range of
the original text that it came from.

Defined results: a null text is empty; an empty text has no findings. Every row is judged alone, so repeated rows give
repeated results and no rows give none. Columns of the input pass through; one that clashes with a result is renamed
``<name>_in``. A frame that expands beyond ``MAX_LAYER`` bytes is scanned in overlapping windows; counted in ``refused``
is what a window's end may cut: a run of over half a window, and a frame inside such a frame. Also counted there are frames
beyond ``_CROSSING`` in a text that begin in bytes which another frame only repeats and end behind them: each differs from
one that was opened by its end alone. Memory follows the longest text and ``MAX_LAYER``.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html.entities import html5
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import textbatch as tb
from brindle.llm.common import table, text_or_empty
from brindle.llm.worker import tidy

KINDS = ("assign", "access", "hex")
MAX_LAYER = 64 << 20
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"%u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_OCTAL = re.compile(r"\\([0-3]?[0-7]{1,2})")
_CSS = re.compile(r"\\([0-9A-Fa-f]{1,6})[ \t\n]?")
_ENTITY = re.compile(r"&([A-Za-z][A-Za-z0-9]{1,31};)")
_WIDE = re.compile(r"(?:[\t\n\r\x20-\x7e]\x00){6,}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*|[A-Za-z0-9+/_-]+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+)")
#: Heads of zlib for each window: two bytes that make a multiple of 31, without a dictionary.
_ZLIB = b"|".join(re.escape(bytes([8 + 16 * w, f])) for w in range(8) for f in range(256) if (256 * (8 + 16 * w) + f) % 31 == 0 and not f & 32)
_FRAME = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|PK\x03\x04.{4}\x08\x00|\x5d\x00\x00..(?:\xff{8}|.{5}\x00{3})|" + _ZLIB, re.DOTALL)
_ZIP_HEAD = 30
_PROBE, _LEAST_STRETCH = 64, 1024  # of what a frame's output repeats of the frame's own bytes
_EDGE = 4096  # of a repeated stretch, looked at with what stands beside it
_CROSSING = 1_000
_SHORTEST = 12  # token=abcdef
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{%d}" % _SHORTEST)
_STEP = 1 << 20
_OVERLAP = 1 << 20
_RUN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=.:%\\&#;{}\"' \t\r\n"
_TO_STANDARD = str.maketrans("-_", "+/")

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, without those that are too short."""
    found: list[Span] = []
    low = text.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


class Layer:
    """A decoded text and where its characters came from: ``at[i]`` starts a piece, mapped by ``to[i]``.

    A piece is (start, end, literal): literal pieces map character by character, others as a whole.
    """

    __slots__ = ("at", "depth", "text", "to")

    def __init__(self, text: str, at: list[int], to: list[tuple[int, int, bool]], depth: int) -> None:
        self.text, self.at, self.to, self.depth = text, at, to, depth

    def origin(self, start: int, end: int) -> tuple[int, int]:
        first, last = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        s, e = self.to[first][0], self.to[last][1]
        if self.to[first][2]:
            s += start - self.at[first]
        if self.to[last][2]:
            e = self.to[last][0] + end - self.at[last]
        return s, e


def _substituted(layer: Layer, pattern: re.Pattern, decode: Callable[[re.Match], list[tuple[str, int, int]] | None]) -> Layer | None:
    """The layer with each match replaced by its decoded characters (text, start, end in the layer); None if none decodes."""
    pieces: list[str] = []
    at: list[int] = []
    to: list[tuple[int, int, bool]] = []
    length = done = 0

    def literal(start: int, end: int) -> None:
        nonlocal length
        i = bisect_right(layer.at, start) - 1
        while start < end:  # a literal stretch keeps the pieces of its parent
            stop = min(end, layer.at[i + 1] if i + 1 < len(layer.at) else end)
            s, e, exact = layer.to[i]
            if exact:
                s, e = s + start - layer.at[i], s + stop - layer.at[i]
            at.append(length)
            to.append((s, e, exact))
            pieces.append(layer.text[start:stop])
            length += stop - start
            start, i = stop, i + 1

    for m in pattern.finditer(layer.text):
        decoded = decode(m)
        if decoded is None:
            continue
        literal(done, m.start())
        for text, start, end in decoded:
            at.append(length)
            to.append((*layer.origin(start, end), False))
            pieces.append(text)
            length += len(text)
        done = m.end()
    if not done:
        return None
    literal(done, len(layer.text))
    return Layer("".join(pieces), at, to, layer.depth + 1)


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    text = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
    out, at = [], m.start()
    for c in text:
        size = 3 * len(c.encode("utf-8", "surrogateescape"))
        out.append((c, at, at + size))
        at += size
    return out


def _character(code: int, m: re.Match) -> list[tuple[str, int, int]] | None:
    return [(chr(code), m.start(), m.end())] if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _escape(m: re.Match) -> list[tuple[str, int, int]] | None:
    return _character(int(m[7]) if m[7] else int(next(g for g in m.groups()[:6] if g), 16), m)


def _octal(m: re.Match) -> list[tuple[str, int, int]] | None:
    return _character(int(m[1], 8), m)


def _css(m: re.Match) -> list[tuple[str, int, int]] | None:
    return _character(int(m[1], 16), m)


def _entity(m: re.Match) -> list[tuple[str, int, int]] | None:
    return [(html5[m[1]], m.start(), m.end())] if m[1] in html5 else None


def _wide(m: re.Match) -> list[tuple[str, int, int]]:
    return [(c, m.start() + 2 * i, m.start() + 2 * i + 2) for i, c in enumerate(m[0][::2])]


class _Input:
    """Bytes that come in pieces: ``peek`` looks ahead, ``take`` counts what goes, ``back`` returns what wasn't needed."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.have, self.taken, self.whole = pieces, b"", 0, True

    def peek(self, n: int) -> bytes:
        while len(self.have) < n and (piece := next(self.pieces, None)) is not None:
            self.have += piece
        return self.have[:n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.have = self.have[len(out) :]
        self.taken += len(out)
        return out

    def back(self, data: bytes) -> None:
        self.have = data + self.have
        self.taken -= len(data)


def _decompressor(source: _Input, raw: bool):
    """The decompressor for the frame that ``source`` stands at, and its name; None where none begins. A zip entry's head is taken."""
    head = source.peek(_ZIP_HEAD)
    if raw:
        return zlib.decompressobj(-15), "zlib"
    if not _FRAME.match(head):
        return None
    if head[:2] == b"PK":
        source.take(_ZIP_HEAD + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
        return zlib.decompressobj(-15), "zlib"
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj(), "zstd"
    if head[:1] == b"B":
        return bz2.BZ2Decompressor(), "bz2"
    if head[:1] in b"\xfd\x5d":
        return lzma.LZMADecompressor(), "lzma"
    return zlib.decompressobj(47), "zlib"


def _inflated(source: _Input, raw: bool = False) -> Iterator[bytes]:
    """Output of the compressed frames that follow one another from here on, in bounded pieces; ``raw``: the first is deflate
    without a head. A damaged or cut frame gives what comes before the damage, and ``source.whole`` is then false."""
    while (found := _decompressor(source, raw)) is not None:
        d, name = found
        raw = False
        zstd, packed = name == "zstd", name == "zlib"
        try:
            while not d.eof and (piece := source.take(512 if zstd else 4096)):  # 512 bytes of zstd expand to 16 MB at most
                yield d.decompress(piece) if zstd else d.decompress(piece, _STEP)
                while not d.eof and not zstd and (d.unconsumed_tail if packed else not d.needs_input):
                    yield d.decompress(d.unconsumed_tail if packed else b"", _STEP)
            if packed:
                yield d.flush()
        except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
            source.whole = False
            return
        if not d.eof:
            source.whole = False
            return
        source.back(d.unused_data)


def _windows(pieces: Iterator[bytes], refused: list[int]) -> Iterator[tuple[bytes, bool]]:
    """The output joined, with a flag whether there is more of it. Beyond ``MAX_LAYER`` bytes it comes in windows. The next
    one starts before the run of characters that the last one ends in, so nothing that can be found is cut; a run of more
    than half a window is cut and counted in ``refused``."""
    parts: list[bytes] = []
    size, over, counted = 0, False, False
    for piece in pieces:
        parts.append(piece)
        size += len(piece)
        if size >= MAX_LAYER:
            window, over = b"".join(parts), True
            yield window, True
            back = max(len(window) - len(window.rstrip(_RUN)), min(_OVERLAP, MAX_LAYER // 4))
            if back > MAX_LAYER // 2:
                back = min(_OVERLAP, MAX_LAYER // 4)
                refused[0] += not counted
                counted = True
            parts, size = [window[-back:]], back
    if size:
        yield b"".join(parts), over


def _outputs(make: Callable[[], Iterator[bytes]], refused: list[int]) -> Iterator[tuple[bytes, bool]]:
    """Windows of what ``make`` gives; where it is larger than one and a frame itself, of that frame's output too, and so on. A
    level that begins as an earlier one did ends it; so does the depth of Python's stack, which counts in ``refused``."""
    met: set[bytes] = set()
    while True:
        deep = None
        try:
            for window, part in _windows(make(), refused):
                yield window, part
                if deep is None:
                    start = hashlib.blake2b(window).digest()
                    deep = part and _FRAME.match(window) is not None and start not in met
                    met.add(start)
        except RecursionError:
            refused[0] += 1
            return
        if not deep:
            return
        make = lambda make=make: _inflated(_Input(make()))


def _repeated(out: bytes, data: bytes, start: int, end: int) -> tuple[int, int, int]:
    """(a, b, shift) of the longest stretch found such that ``out[a:b]`` repeats ``data[a + shift:b + shift]`` of the frame
    itself, data[start:end]. Windows at growing distances from both ends are looked up, so the work follows the bytes."""
    best, size = (0, 0, 0), len(out)
    source, made = np.frombuffer(data, np.uint8), np.frombuffer(out, np.uint8)
    places = [0, *(4**k for k in range(3, 14))]
    for at in [p for p in places if p + _PROBE <= size] + [size - _PROBE - p for p in places if p + _PROBE <= size]:
        if best[0] <= at < best[1]:
            continue
        found = data.find(out[at : at + _PROBE], start, end)
        if found < 0:
            continue
        right = min(size - at, end - found)
        differ = np.flatnonzero(made[at : at + right] != source[found : found + right])
        b = at + (int(differ[0]) if len(differ) else right)
        left = min(at, found - start)
        differ = np.flatnonzero(made[at - left : at] != source[found - left : found])
        a = at - left + (int(differ[-1]) + 1 if len(differ) else 0)
        best = max(best, (a, b, found - at), key=lambda x: x[1] - x[0])
    return best if best[1] - best[0] >= _LEAST_STRETCH else (size, size, 0)


class _Bytes:
    """Bytes that frames are sought in. ``stretch`` (a, b, shift) repeats the bytes of ``around``."""

    __slots__ = ("around", "data", "ends", "part", "place", "stretch")

    def __init__(self, data: bytes, place: tuple[int, int] | None = None, part: bool = False, stretch: tuple[int, int, int] | None = None, around: _Bytes | None = None) -> None:
        self.data, self.place, self.part, self.around = data, place, part, around
        self.stretch = stretch or (len(data), len(data), 0)
        self.ends: dict[int, int] = {}  # of the frames that were measured

    def pieces(self, start: int) -> Iterator[bytes]:
        return (self.data[i : i + 65_536] for i in range(start, len(self.data), 65_536))

    def end(self, start: int) -> int:
        """What the frame at ``start`` may have read when it ended."""
        if start not in self.ends:
            source = _Input(self.pieces(start))
            for _ in _inflated(source):
                pass
            self.ends[start] = start + source.taken
        return self.ends[start]

    def known(self, start: int, refused: list[int]) -> bool:
        """Whether the frame at ``start`` is the same as one in ``around``, or that one cut off. Frames that go on behind a
        repeated stretch differ from it; ``_CROSSING`` of them are opened for a text, further ones count in ``refused``."""
        a, b, shift = self.stretch
        if not a <= start < b:
            return False
        if b == len(self.data) or self.around.end(start + shift) <= b + shift:
            return True
        refused[1] += 1
        if refused[1] > _CROSSING:
            refused[0] += 1
            return True
        return False

    def own(self) -> list[bytes]:
        """What isn't repeated, with a little of what is."""
        a, b, _ = self.stretch
        return [self.data] if b - a <= 2 * _EDGE else [x for x in (self.data[: a + _EDGE] if a else b"", self.data[b - _EDGE :] if b < len(self.data) else b"") if x]


def _opened(inside: _Bytes, refused: list[int], cuts: list[tuple[int, int]]) -> Iterator[_Bytes]:
    """The outputs of the frames in some bytes; ranges of undamaged frames that repeat nothing go to ``cuts``."""
    at = 0
    while m := _FRAME.search(inside.data, at):
        start = m.start()
        at = start + 1
        if inside.known(start, refused):
            continue
        source = _Input(inside.pieces(start))
        windows = _windows(_inflated(source), [0])
        first, over = next(windows, (b"", False))
        if over:
            for _ in windows:
                pass  # to the end of the frame
        end = inside.ends[start] = start + source.taken
        whole = source.whole and source.taken > 0
        where = inside.place or (start, end)
        repeats = False
        if over:
            for window, _ in _outputs(lambda start=start: _inflated(_Input(inside.pieces(start))), refused):
                yield _Bytes(window, where, True)
        elif first:
            stretch = _repeated(first, inside.data, start, end)
            repeats = stretch[0] < stretch[1]
            if stretch[:2] != (0, len(first)):  # else it is looked at where it stands
                yield _Bytes(first, where, inside.part, stretch, inside)
        if inside.part and first and not whole:
            refused[0] += 1  # a frame across the end of a window
        if whole and not repeats:
            cuts.append((start, end))
            at = end


def _without(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    """The data with NUL in place of each range."""
    if not cuts:
        return data
    out = bytearray(data)
    for start, end in cuts:
        out[start:end] = bytes(len(out[start:end]))
    return bytes(out)


def _digest(data: bytes) -> bytes:
    return data if len(data) < 64 else hashlib.blake2b(data, digest_size=32).digest()


def _unpacked(data: bytes, refused: list[int], cuts: list[tuple[int, int]]) -> Iterator[tuple[bytes, int, int]]:
    """Outputs of the frames in the data and of the frames in these, each without the frames in it and what it only repeats,
    and with the range of ``data`` it came from. The ranges of undamaged frames go to ``cuts``."""
    met: set[tuple[bytes, tuple[int, int]]] = set()
    root = _Bytes(data)
    work = [(_opened(root, refused, cuts), root, cuts)]
    while work:
        got = next(work[-1][0], None)
        if got is None:
            _, done, inner = work.pop()
            if work:
                done.data = _without(done.data, inner)
                for x in done.own():
                    yield x, *done.place
            continue
        key = (_digest(got.data), got.place)
        if key not in met:
            met.add(key)
            work.append((_opened(got, refused, inner := []), got, inner))


def _deflated(data: bytes, refused: list[int]) -> Iterator[tuple[bytes, int, int]]:
    """Like ``_unpacked``, for deflate without a head that begins at the first byte and comes to its end."""
    source = _Input(data[i : i + 65_536] for i in range(0, len(data), 65_536))
    size = sum(map(len, _inflated(source, raw=True)))
    if source.whole and size >= _SHORTEST:
        make = lambda: _inflated(_Input(data[i : i + 65_536] for i in range(0, len(data), 65_536)), raw=True)
        for window, _ in _outputs(make, refused):
            for out, _, _ in _unpacked(window, refused, cuts := []):
                yield out, 0, source.taken
            yield _without(window, cuts), 0, source.taken


def _readable(data: bytes) -> str | None:
    """The text of the bytes, bytes that are no UTF-8 as lone surrogates. None where no secret and no further encoding can
    stand in it: the shortest of them is a stretch of ``_SHORTEST`` printable ASCII characters."""
    if not _STRETCH.search(data) and not _WIDE_BYTES.search(data):
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            return None
        return text if text.translate(_PLAIN_BLANKS).isprintable() and text else None
    return data.decode("utf-8", "surrogateescape")


_WIDE_BYTES = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){%d}" % (_SHORTEST - 1))
_PLAIN_BLANKS = {9: 32, 10: 32, 13: 32}


def _base64_layers(layer: Layer, refused: list[int]) -> Iterator[Layer]:
    """Runs are joined across line breaks. A payload may begin and end anywhere in its run: decoded at each of the four
    alignments it stands whole in one of the results, with other bytes around it."""
    for m in _BASE64.finditer(layer.text):
        run = m[0]
        heads, places = [0], [m.start()]  # the lines of the run, in the joined run and in the layer
        if "\n" in run:
            lines = [(x[0], m.start() + x.start()) for x in _LINE.finditer(run)]
            run = "".join(line for line, _ in lines)
            places = [place for _, place in lines]
            heads = list(accumulate([0, *(len(line) for line, _ in lines[:-1])]))
        if len(run) < 16:
            continue
        standard = run.translate(_TO_STANDARD) if "-" in run or "_" in run else run

        def origin(first: int, end: int, heads=heads, places=places, length=len(run)) -> tuple[int, int]:
            end = min(end, length)
            i, j = bisect_right(heads, first) - 1, bisect_right(heads, end - 1) - 1
            return layer.origin(places[i] + first - heads[i], places[j] + end - heads[j])

        decoded, packed = [], []
        for skip in range(4):
            body = standard[skip:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            data = binascii.a2b_base64(body + "=" * (-len(body) % 4))
            decoded.append(data)
            cuts: list[tuple[int, int]] = []
            for out, start, end in _unpacked(data, refused, cuts):
                if (text := _readable(out)) is not None:
                    yield Layer(text, [0], [(*origin(skip + start * 8 // 6, skip + (end * 8 + 5) // 6), False)], layer.depth + 1)
            if not cuts:
                for out, start, end in _deflated(data, refused):
                    if (text := _readable(out)) is not None:
                        yield Layer(text, [0], [(*origin(skip + start * 8 // 6, skip + (end * 8 + 5) // 6), False)], layer.depth + 1)
            packed += [(skip + start * 8 // 6, skip + (end * 8 + 5) // 6) for start, end in cuts]
        for skip, data in enumerate(decoded):  # compressed bytes are no text at any alignment
            text = _readable(_without(data, [(max(start - skip, 0) * 6 // 8, max(end - skip, 0) * 6 // 8) for start, end in packed]))
            if text is None:
                continue
            at, to, n = [], [], 0  # three bytes come from four characters
            sizes = [1] * len(text) if text.isascii() else [len(c.encode("utf-8", "surrogateescape")) for c in text]
            for i, size in enumerate(sizes):
                at.append(i)
                to.append((*origin(skip + n * 8 // 6, skip + ((n + size) * 8 + 5) // 6), False))
                n += size
            yield Layer(text, at, to, layer.depth + 1)


def _children(layer: Layer, refused: list[int]) -> Iterator[Layer | None]:
    if "%" in layer.text:
        yield _substituted(layer, _PERCENT, _percent)
    if "\\" in layer.text or "&#" in layer.text or "%u" in layer.text:
        yield _substituted(layer, _ESCAPE, _escape)
    if "\\" in layer.text:
        yield _substituted(layer, _OCTAL, _octal)
        yield _substituted(layer, _CSS, _css)
    if "&" in layer.text:
        yield _substituted(layer, _ENTITY, _entity)
    if "\0" in layer.text:
        yield _substituted(layer, _WIDE, _wide)
    yield from _base64_layers(layer, refused)


def scan(text: str) -> tuple[list[Span], set[Span], int, int]:
    """(base findings, all findings, layers entered, frames refused) of one text."""
    base = base_spans(text)
    found, refused, layers = set(base), [0, 0], 0  # refused, frames that cross the end of a repeated stretch
    root = Layer(text, [0], [(0, len(text), True)], 0)
    seen = {(text, 0, len(text))}
    work = [_children(root, refused)]  # one layer a level is held
    while work:
        layer = next(work[-1], root)
        if layer is root:
            work.pop()
        elif layer is not None and layer.text:
            key = (layer.text if len(layer.text) < 4096 else _digest(layer.text.encode("utf-8", "surrogatepass")), layer.to[0][0], layer.to[-1][1])
            if key not in seen:
                seen.add(key)
                layers += 1
                found.update((o[0], kind, o[1]) for start, kind, end in base_spans(layer.text) for o in (layer.origin(start, end),))
                work.append(_children(layer, refused))
    return base, found, layers, refused[0]


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each find (overlapping ones as one) replaced by [KIND]."""
    out, done = [], 0
    for start, kind, end in sorted(spans):
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
_RESULTS = T.StructType([T.StructField("findings", FINDINGS), T.StructField("layers", T.LongType()), T.StructField("refused", T.LongType())])


def _scan_batches(text_at: int, redact: bool):
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tb.as_strings(batch.column(text_at))
            findings, layers, refused, texts = [], [], [], []
            for text in column.to_pylist():
                base, found, n, over = scan(text)
                mine = set(base)
                findings.append([{"kind": KINDS[k], "start": s, "end": e, "base": (s, k, e) in mine} for s, k, e in sorted(found)])
                layers.append(n)
                refused.append(over)
                if redact:
                    texts.append(redacted(text, list(found)) if found else text)
            keep = list(batch.columns)
            if redact:
                keep[text_at] = pa.array([t if v else None for t, v in zip(texts, batch.column(text_at).is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(findings, pa.list_(item)), pa.array(layers, pa.int64()), pa.array(refused, pa.int64())],
                names=[*batch.schema.names, *_RESULTS.fieldNames()],
            )

    return run


def scan_secrets(df: DataFrame, *, text_col: str = "text", redact: bool = False) -> DataFrame:
    """``df`` with ``findings`` (array of kind, start, end in code points, base), ``layers`` and ``refused``; with
    ``redact`` the text has each find replaced. One narrow pass: no shuffle, every row alone."""
    df = df.withColumnsRenamed({c: f"{c}_in" for c in df.columns if c in _RESULTS.fieldNames()})
    df = df.withColumn(text_col, df[text_col].cast("string"))
    return df.mapInArrow(_scan_batches(df.columns.index(text_col), redact), T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields] + _RESULTS.fields))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scan_secrets(docs.select("doc_id", text_or_empty(docs, "text").alias("text")))
    line = lambda f: f"concat_ws(',', transform({f}, f -> concat_ws(':', f.kind, f.start, f.end)))"
    count = lambda k: F.expr(f"cast(size(filter(findings, f -> f.base and f.kind = '{k}')) as bigint)").alias(f"n_{k}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(F.expr(line("filter(findings, f -> f.base)")), 256).alias("base_sha256"), F.expr(line("findings")).alias("spans"), "layers", "refused")


QUERIES = {"op1_secret_scan": op1_secret_scan}
SQL: dict[str, str] = {}
