"""Hashes of substrings over numpy arrays: one pass of prefix sums gives every word's and every window's 64-bit hash."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n (an odd base has an inverse)."""
    held = _TABLES.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        held = (np.cumprod(up), np.cumprod(down))
        if size <= 4_000_000:
            _TABLES[base] = held
    return held


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word (finaliser of a 64-bit generator)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Prefix:
    """Hashes of any range of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int = 0) -> None:
        n = len(values)
        up, self.down = _powers(BASES[base], n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end]; equal ranges have equal hashes wherever they stand."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Hash of values[i:i + size] for every i."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + U64(size))


def byte_prefix(data: np.ndarray) -> Prefix:
    return Prefix(BYTE_VALUE[data])


def word_spans(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every word (`[^\\x20\\x09-\\x0D]+`) of the concatenated texts. Separators are single bytes, so UTF-8
    characters are never cut; words never cross a document's end. `letters`: a table of 256 for another alphabet."""
    n = len(data)
    letter = letters[data] if letters is not None else ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], letter[:-1])) if n else letter
    after = np.concatenate((letter[1:], [False])) if n else letter
    starts = np.flatnonzero(letter & (~before | edge[:n]))
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, doc


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys as bytes."""
    return np.ascontiguousarray(keys, dtype="<u8").tobytes()
