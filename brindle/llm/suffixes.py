"""Deep-shallow sorting of byte strings: multikey quicksort down to a shallow depth, blind tries below it.

``sort_suffixes`` orders strings and tells the length of the common prefix of each with the one before it, the two
arrays that repeats are read from. Strings that still agree after ``SHALLOW`` bytes go into a blind trie: it keeps, at
each inner node, only the depth at which its strings part and the byte on which they do, so a string is placed with one
blind walk, one comparison with the leaf found, and a second walk to the place where the two part.
"""

from __future__ import annotations

#: Depth at which the quicksort hands a group over to a blind trie. Suffixes at one anchor share its gram, so it has to be
#: well beyond that for the quicksort to order them.
SHALLOW = 96
_STEP = 16


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Bytes that ``a`` and ``b`` share from their beginnings; the first ``start`` are known to be equal."""
    n = min(len(a), len(b))
    x, y = a[start:n], b[start:n]
    if x == y:
        return n
    differing = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (differing.bit_length() + 7) // 8


class BlindTrie:
    """Order of strings that share their first ``depth`` bytes. A node is [depth, {byte: child}]; -1 is a string's end;
    a leaf is the list of the equal strings' numbers."""

    def __init__(self, strings: list[bytes], depth: int) -> None:
        self.strings, self.depth = strings, depth
        self.root: list | None = None

    @staticmethod
    def _at(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, number: int) -> None:
        s = self.strings[number]
        if self.root is None:
            self.root = [None, [number]]
            return
        node = self.root
        while node[0] is not None:  # blind: bytes between the depths aren't looked at
            children = node[1]
            node = children.get(self._at(s, node[0])) or next(iter(children.values()))
        t = self.strings[node[1][0]]
        if s == t:
            node[1].append(number)
            return
        part = common_prefix(s, t, self.depth)
        above, step, node = None, 0, self.root
        while node[0] is not None and node[0] < part:
            above, step = node, self._at(s, node[0])
            node = node[1][step]
        if node[0] == part:
            node[1][self._at(s, part)] = [None, [number]]
            return
        split = [part, {self._at(t, part): node, self._at(s, part): [None, [number]]}]
        if above is None:
            self.root = split
        else:
            above[1][step] = split

    def walk(self, lcp: int) -> tuple[list[int], list[int]]:
        """(numbers in order, each one's common prefix with the one before; the first has ``lcp``)."""
        order: list[int] = []
        shared: list[int] = []
        stack = [(self.root, lcp)]
        while stack:
            node, with_before = stack.pop()
            if node[0] is None:
                order += node[1]
                shared += [with_before, *[len(self.strings[node[1][0]])] * (len(node[1]) - 1)]
                continue
            keys = sorted(node[1])
            stack += [(node[1][k], node[0]) for k in keys[:0:-1]]
            stack.append((node[1][keys[0]], with_before))
        return order, shared


def sort_suffixes(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """(numbers in the order of their strings, shared): shared[i] is the common prefix of the i-th with the one before,
    -1 for the first. Equal strings stand in the order of their numbers."""
    order: list[int] = []
    shared: list[int] = []

    def boundary(number: int) -> int:
        return common_prefix(strings[order[-1]], strings[number]) if order else -1

    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            shared.append(boundary(group[0]))
            order.append(group[0])
            continue
        if depth >= shallow:
            trie = BlindTrie(strings, depth)
            for number in group:
                trie.add(number)
            own, depths = trie.walk(-1)
            depths[0] = boundary(own[0])
            order += own
            shared += depths
            continue
        # the multikey step, on sixteen bytes at a time: below, equal to and above a pivot
        keys = [strings[i][depth : depth + _STEP] for i in group]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        low, same, high = [], [], []
        for number, key in zip(group, keys, strict=True):
            (same if key == pivot else low if key < pivot else high).append(number)
        if high:
            stack.append((high, depth))
        if len(pivot) < _STEP:  # these strings end here and are equal
            stack += [([i], shallow) for i in reversed(same)]
        else:
            stack.append((same, depth + _STEP))
        if low:
            stack.append((low, depth))
    return order, shared
