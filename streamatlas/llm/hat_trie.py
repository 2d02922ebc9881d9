"""A counting trie for phrases of word ids, after the HAT-trie: hash containers at the leaves, which burst into trie nodes when they grow.

A key is 63 bits: three word ids of 21 bits, the first word uppermost, 0 where a phrase is shorter. The trie branches on seven bits at a time, so three
levels spell a word id; ids are dealt so that their upper bits spread. A container counts all keys below its path; past BURST keys it is replaced by
a node whose children hold them. When the trie holds too many keys, whole subtrees of the root are taken out, largest first, as runs sorted by key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np

ID_BITS, DIGIT_BITS, WORDS = 21, 7, 3
KEY_BITS = ID_BITS * WORDS
FANOUT = 1 << DIGIT_BITS
MAX_IDS = (1 << ID_BITS) - 1
BURST = 1 << 15
_SPREAD = 0x9E3779B1


class WordIds(dict):
    """Ids of words (bytes) in order of first sight, spread over 21 bits; 0 stays free."""

    def __missing__(self, word: bytes) -> int:
        own = (len(self) + 1) * _SPREAD & MAX_IDS
        self[word] = own
        return own


class Node:
    __slots__ = ("shift", "children")

    def __init__(self, shift: int) -> None:
        self.shift = shift  # of the digit that this node branches on
        self.children: list[Node | Counter | None] = [None] * FANOUT

    def add(self, keys: np.ndarray, lo: int, hi: int) -> int:
        """Counts keys[lo:hi], which are sorted and share this node's path. Returns how many keys are new."""
        base = int(keys[lo]) >> self.shift + DIGIT_BITS << self.shift + DIGIT_BITS
        edges = lo + np.searchsorted(keys[lo:hi], base + (np.arange(1, FANOUT, dtype=np.int64) << self.shift))
        edges = [lo, *edges.tolist(), hi]
        fresh = 0
        for digit in range(FANOUT):
            a, b = edges[digit], edges[digit + 1]
            if a == b:
                continue
            child = self.children[digit]
            if isinstance(child, Node):
                fresh += child.add(keys, a, b)
                continue
            if child is None:
                child = self.children[digit] = Counter()
            before = len(child)
            child.update(keys[a:b].tolist())
            fresh += len(child) - before
            if len(child) > BURST and self.shift:
                self.children[digit] = burst(child, self.shift - DIGIT_BITS)
        return fresh

    def size(self) -> int:
        return sum(child.size() if isinstance(child, Node) else len(child) for child in self.children if child is not None)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys and counts in the order of the keys, container by container."""
        for child in self.children:
            yield from runs_of(child)


def burst(container: Counter, shift: int) -> Node:
    node = Node(shift)
    for key, n in container.items():
        digit = key >> shift & FANOUT - 1
        child = node.children[digit]
        if child is None:
            child = node.children[digit] = Counter()
        child[key] = n
    return node


def runs_of(child: Node | Counter | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if isinstance(child, Node):
        yield from child.runs()
    elif child:
        keys = np.fromiter(child.keys(), np.int64, len(child))
        counts = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)
        yield keys[order], counts[order]


class Trie:
    """Counts of keys in at most `limit` entries, beyond which subtrees are handed out."""

    def __init__(self, limit: int) -> None:
        self.root, self.limit, self.held = Node(KEY_BITS - DIGIT_BITS), limit, 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self.held += self.root.add(np.sort(keys), 0, len(keys))

    def spill(self, down_to: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes out whole subtrees, largest first, until `down_to` keys are left."""
        sizes = [(child.size() if isinstance(child, Node) else len(child), digit) for digit, child in enumerate(self.root.children) if child is not None]
        for size, digit in sorted(sizes, reverse=True):
            if self.held <= down_to:
                return
            child, self.root.children[digit] = self.root.children[digit], None
            self.held -= size
            yield from runs_of(child)
