"""Memory of Python workers. A worker lives on from task to task and from stage to stage, so what one operator keeps there
is still held while the next one's tasks run. Each operator's map is bounded in bytes and dropped as soon as the worker
gets a task of another operator, and memory that a task has freed is given back when it ends."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

_KEPT: dict[str, dict] = {}


def kept(owner: str, name: str, make: Callable[[], object]):
    """The object that this worker keeps for a module under a name; made when it is first asked for."""
    mine = _KEPT.setdefault(owner, {})
    if name not in mine:
        mine[name] = make()
    return mine[name]


def begin(owner: str) -> None:
    for other in [o for o in _KEPT if o != owner]:
        del _KEPT[other]


def end() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """Wraps what ``mapInArrow`` runs: other operators' objects go before it, freed memory after it."""
    owner = run.__module__

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        try:
            yield from run(batches)
        finally:
            end()

    return wrapped


class Recent:
    """A map bounded in bytes, in two halves: a full young half becomes the old one, and what is asked for again moves
    back, so common keys stay while rare ones go."""

    def __init__(self, most_bytes: int, each: int) -> None:
        self.half, self.each, self.held = most_bytes // 2, each, 0
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> set:
        """The keys that aren't held; the others are in ``young`` from here on."""
        keys = keys.difference(self.young)
        if self.old and keys:
            back = [k for k in keys if k in self.old]  # an intersection would go through the whole map
            self.add(back, list(map(self.old.__getitem__, back)))
            keys.difference_update(back)
        return keys

    def add(self, keys: list, values: list) -> None:
        self.young.update(zip(keys, values, strict=True))
        self.held += self.each * len(keys) + sum(map(len, keys)) + sum(map(len, values))

    def get(self, key):
        """What is held for a key, None if nothing is; it is in ``young`` from here on."""
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        """Adds one entry and turns at once."""
        self.young[key] = value
        self.held += self.each + len(key) + len(value)
        self.turn()

    def turn(self) -> None:
        """Between batches: starts a new half where the young one is full."""
        if self.held > self.half:
            self.old, self.young, self.held = self.young, {}, 0
