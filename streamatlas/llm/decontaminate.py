"""Operator 8: passages of benchmark items in documents, by CGK embedding and bit sampling.

The CGK random walk writes a string out while repeating characters at random, so that strings of small edit distance get embeddings of small Hamming distance.
Windows of a document as long as an item, one from each byte on, are embedded by several walks; places sampled from each embedding make a key, and a window whose
key equals an item's is a candidate. Candidates are decided by their exact edit distance. Windows that can hold no item are left out beforehand: an edit
changes at most Q of a string's Q-grams, so a window within the distance of an item holds at least a known share of Q-grams of items.

Characters are bytes of the text with A-Z lowered and white space as blanks. The benchmark is worked through in blocks of a proven size; documents are
never shuffled.

Defined results: a null document or item text is empty; items shorter than SHORTEST bytes have no windows and are found by their pieces, with the same edits per byte; empty
items match nothing; repeated rows are reported once per id; a null id is reported as null; other columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import SMALL_SLICE_BYTES, batches_of, id_and_text, materialise, text_buffers
from .hashing import Prefix

RATIO = 0.08  # edits per byte of an item
Q = 8
SHORTEST = 48
WALKS, KEYS, BITS = 8, 10, 7  # walks, keys of each, places sampled for a key
TABLE_BITS = 21
WINDOWS = 4_000  # walked over at once
MEET = 16  # steps after which walks that have met are taken as one
KNOWN = 10_000  # distances that a task keeps
STEP = 16  # windows of items are cut to a multiple of this length
BLOCK_BYTES = 4 << 20  # of item texts at once on the driver and in tasks
PAIRS = "doc_id long, item_id long, start long, end long, distance int"
U64 = np.uint64

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[9:14] = 32
_RNG = np.random.Generator(np.random.PCG64(8))
_GRAM = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_KEY_OFFSET = _RNG.integers(0, 2**63, WALKS * KEYS, dtype=np.uint64)


def _most(length: int) -> int:
    """Edits that an item of this length may have."""
    return int(RATIO * length)


def _least(n: int) -> int:
    """Q-grams of an item that a window of n bytes has at least: each of the most edits that an item of such windows may have changes Q at most."""
    return max(1, n - Q + 1 - Q * _most(n + STEP - 1))


def _plain(text: bytes) -> np.ndarray:
    return _PLAIN[np.frombuffer(text, np.uint8)]


def _hashes(data: np.ndarray) -> Prefix:
    return Prefix(_GRAM[data], 2)


def _slots(hashes: Prefix) -> np.ndarray:
    """Place of each Q-gram in a table of Q-grams."""
    return (hashes.windows(Q) >> U64(64 - TABLE_BITS)).astype(np.int32)


def _ranges(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each low on, count of them, one after the other."""
    return np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())


class _Walk:
    """One random walk for windows of one length, and the places of its output that keys are sampled from."""

    def __init__(self, seed: int, length: int) -> None:
        rng = np.random.Generator(np.random.PCG64(1000 * length + seed))
        self.steps = length  # about half the window is walked over, so edits behind that leave the keys as they are
        self.moves = rng.integers(0, 2, (self.steps, 256), dtype=np.int8)
        # a walk over a short window has fewer steps than places are sampled: some are then sampled for two keys
        self.places = np.sort(rng.choice(self.steps, KEYS * BITS, replace=self.steps < KEYS * BITS))
        self.owner = rng.permutation(KEYS * BITS) // BITS
        self.factor = rng.integers(1, 2**62, KEYS * BITS, dtype=np.uint64) * U64(2) + U64(1)


class _Walks:
    """All walks for windows of one length, taken step by step side by side."""

    def __init__(self, length: int) -> None:
        walks = [_Walk(w, length) for w in range(WALKS)]
        self.moves = np.concatenate([w.moves for w in walks], axis=1)
        self.factor = np.zeros((BITS, WALKS * KEYS), U64)
        self.steps = max(int(w.places[-1]) for w in walks) + 1
        rows: list[list[tuple[int, int, int]]] = [[] for _ in range(0, self.steps, MEET)]
        for k, walk in enumerate(walks):
            had = [0] * KEYS
            for place, owner, factor in zip(walk.places.tolist(), walk.owner.tolist(), walk.factor):
                row = had[owner] * WALKS * KEYS + k * KEYS + owner
                had[owner] += 1
                self.factor.flat[row] = factor
                rows[place // MEET].append((row, place % MEET, k))
        # of every MEET steps: which factor a sampled character has, the step, and the walk
        self.sampled = [np.array(own, np.int64).reshape(-1, 3).T for own in rows]
        # characters count from 1; each key has an offset of its own, so that all of them can stand in one table
        self.offset = self.factor.sum(axis=0) + _KEY_OFFSET

    def keys(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(WALKS * KEYS, windows) for the windows of `data` from each of the ascending starts on. A step moves on by one place at most, so no walk leaves its
        window and none overtakes another: those that meet go on together, and are taken as one from then on."""
        m = len(starts)
        chars = np.empty((BITS * WALKS * KEYS, m), np.uint8)
        at, row = np.tile(starts.astype(np.int64), WALKS), np.repeat(np.arange(WALKS) * 256, m)
        state = np.arange(WALKS * m).reshape(WALKS, m)  # where the walks of each window are among those still apart
        for t, (rows, step, walk) in zip(range(0, self.steps, MEET), self.sampled):
            seen = np.empty((MEET, len(at)), np.uint8)
            for char, moves in zip(seen, self.moves[t : min(t + MEET, self.steps)]):
                data.take(at, out=char, mode="clip")
                at += moves.take(row + char)
            chars[rows] = seen.ravel().take(state[walk] + step[:, None] * len(at))
            apart = np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])))
            at, row, state = at[apart], row[apart], (np.cumsum(apart) - 1).take(state)
        chars = chars.reshape(BITS, WALKS * KEYS, m)
        out = np.repeat(self.offset[:, None], m, axis=1)
        for own, factor in zip(chars, self.factor):
            out += own * factor[:, None]
        return out


def _distance(item: bytes, text: bytes, most: int) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text, and where that ends (bit-parallel columns)."""
    n = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, end = full, 0, n, n, 0
    for j, c in enumerate(text):
        match = masks.get(c, 0)
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & full
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal
        if score < best:
            best, end = score, j + 1
    return best, end


class _Items:
    """A block of items by the length of their windows, with their keys and Q-grams."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.items = [(i, _plain(t).tobytes()) for i, t in items if t]
        pieces: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, (_, t) in enumerate(self.items):
            if len(t) < SHORTEST:
                cuts = [len(t) * i // (self.most(k) + 1) for i in range(self.most(k) + 2)]
                for a, b in zip(cuts, cuts[1:]):
                    key = int(_hashes(np.frombuffer(t, np.uint8)[a:b]).windows(b - a)[0])
                    pieces.setdefault(b - a, {}).setdefault(key, []).append((k, a))
        # of a short item with e edits one of e + 1 pieces is left as it was: by length of the piece the sorted hashes, and the items and offsets behind each
        self.pieces = {n: (np.array(sorted(own), U64), [own[key] for key in sorted(own)]) for n, own in pieces.items()}
        self.by_length: dict[int, list[int]] = {}
        for k, (_, t) in enumerate(self.items):
            if len(t) >= SHORTEST:
                self.by_length.setdefault(len(t) // STEP * STEP, []).append(k)
        self.grams = np.zeros(1 << TABLE_BITS, bool)
        self.own_grams = {n: np.zeros(1 << TABLE_BITS, bool) for n in self.by_length}
        for n, own in self.by_length.items():
            for k in own:
                self.own_grams[n][_slots(_hashes(np.frombuffer(self.items[k][1], np.uint8)))] = True
            self.grams |= self.own_grams[n]
        self.walks = {n: _Walks(n) for n in self.by_length}
        # by length the sorted keys, the items behind them, and a table over the leading bits of the keys
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, own in self.by_length.items():
            windows = np.concatenate([np.frombuffer(self.items[k][1], np.uint8, n) for k in own])
            keys = self.walks[n].keys(windows, np.arange(len(own)) * n).ravel()
            order = np.argsort(keys, kind="stable")
            slot = np.zeros(1 << min(22, max(16, len(keys).bit_length() + 3)), bool)
            slot[self._slot(keys, slot)] = True
            self.keys[n] = keys[order], np.tile(own, WALKS * KEYS)[order], slot

    @staticmethod
    def _slot(keys: np.ndarray, slot: np.ndarray) -> np.ndarray:
        return (keys >> U64(65 - len(slot).bit_length())).view(np.int64)

    def most(self, k: int) -> int:
        return _most(len(self.items[k][1]))

    def short(self, hashes: Prefix) -> list[tuple[int, int, int]]:
        """(place, start, item) where a piece of a short item stands; the item's start, counted back from the piece, may lie before the text."""
        found: set[tuple[int, int, int]] = set()
        for n, (keys, owners) in self.pieces.items():
            own = hashes.windows(n)
            slot = np.zeros(1 << 16, bool)
            slot[(keys >> U64(48)).astype(np.int64)] = True
            places = np.flatnonzero(slot[(own >> U64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(keys, own[places]), len(keys) - 1)
            same = keys[at] == own[places]
            for place, which in zip(places[same].tolist(), at[same].tolist()):
                found.update((place, place - offset, k) for k, offset in owners[which])
        return sorted(found)

    def _matches(self, n: int, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items of which a key is equal, each pair once."""
        table, items, slot = self.keys[n]
        keys = self.walks[n].keys(data, starts).ravel()
        maybe = np.flatnonzero(slot[self._slot(keys, slot)])
        low = np.searchsorted(table, keys[maybe])
        count = np.searchsorted(table, keys[maybe], "right") - low
        pairs = np.unique(np.repeat(maybe % len(starts), count) * len(self.items) + items[_ranges(low, count)])
        return pairs // len(self.items), pairs % len(self.items)

    def candidates(self, data: np.ndarray, hashes: Prefix, ends: np.ndarray) -> list[tuple[int, int]]:
        """(start, item), ascending, for windows of which a key equals an item's; `ends`: for each byte the end of the text that it lies in."""
        slots = _slots(hashes)
        if not len(slots) or not self.walks:
            return []
        found = [np.zeros(0, np.int64)]
        places = np.flatnonzero(self.grams[slots])
        held = slots[places]
        for n in self.walks:
            least, width = _least(n), n - Q + 1
            # starts of windows with enough Q-grams of items of this length: from behind the one Q-gram up to the next, if the last that is needed is still inside
            own = places[self.own_grams[n][held]]
            if len(own) < least:
                continue
            first = own[: len(own) - least + 1]
            low = np.maximum(np.concatenate(([0], first[:-1] + 1)), own[least - 1 :] - width + 1)
            count = np.maximum(first - low + 1, 0)
            inside = _ranges(low, count)
            # a passage at the end of its text lacks what was deleted; each deletion also takes Q Q-grams of the bound, so that stays as it is
            inside = inside[inside + n - _most(n + STEP - 1) <= ends[inside]]
            cut = inside + n > ends[inside]
            whole = inside[~cut]
            # equal windows are walked over once
            _, first, same = np.unique(hashes.ranges(whole, whole + n), return_index=True, return_inverse=True)
            order, bounds = np.argsort(same, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(same, minlength=len(first)))))
            ascending = np.argsort(first)
            for lo in range(0, len(first), WINDOWS):
                few = ascending[lo : lo + WINDOWS]
                w, k = self._matches(n, data, whole[first[few]])
                low, count = bounds[few[w]], bounds[few[w] + 1] - bounds[few[w]]
                found.append(whole[order[_ranges(low, count)]] * len(self.items) + np.repeat(k, count))
            # windows that the end of their text cuts are filled up with blanks
            for lo in range(0, int(cut.sum()), WINDOWS):
                starts = inside[cut][lo : lo + WINDOWS]
                at = starts[:, None] + np.arange(n)
                filled = np.where(at < ends[starts][:, None], data[np.minimum(at, len(data) - 1)], np.uint8(32)).ravel()
                w, k = self._matches(n, filled, np.arange(len(starts)) * n)
                found.append(starts[w] * len(self.items) + k)
        pairs = np.unique(np.concatenate(found))
        return list(zip((pairs // len(self.items)).tolist(), (pairs % len(self.items)).tolist()))


_HELD: dict[str, _Items] = {}


def _search(block: str, items: list[tuple[int, bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if block not in _HELD:
            _HELD.clear()
            _HELD[block] = _Items(items)
        held = _HELD[block]
        known: dict[tuple[int, bytes], tuple[int, int]] = {}  # distances of this task: copies of a passage share theirs
        for batch in batches_of(batches, limit=SMALL_SLICE_BYTES):
            raw, offsets = text_buffers(batch.column("text"))
            data = _PLAIN[raw]
            hashes = _hashes(data)
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            texts = data.tobytes()
            if len(known) > KNOWN:
                known = {}

            def note(doc: int, k: int, start: int, end: int, distance: int) -> None:
                lo = int(offsets[doc])
                best[doc, k] = min(best.get((doc, k), (1 << 30, 0, 0)), (distance, start - lo, end - lo))

            windows = ((start, start, k) for start, k in held.candidates(data, hashes, np.repeat(offsets[1:], np.diff(offsets))))
            for place, start, k in chain(windows, held.short(hashes)):
                doc, item, most = int(np.searchsorted(offsets, place, "right") - 1), held.items[k][1], held.most(k)
                if best.get((doc, k), (1,))[0] == 0:
                    continue
                lo = max(int(offsets[doc]), start - most)
                hi = min(int(offsets[doc + 1]), start + len(item) + most)
                at = texts.find(item, lo, hi)
                if at >= 0:
                    distance, end = 0, at + len(item) - lo
                else:
                    stretch = texts[lo:hi]
                    if (k, stretch) not in known:
                        known[k, stretch] = _distance(item, stretch, most)
                    distance, end = known[k, stretch]
                if distance <= most:
                    note(doc, k, max(lo, lo + end - len(item)), lo + end, distance)
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[doc], held.items[k][0], a, b, d) for (doc, k), (d, a, b) in best.items()]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in PAIRS.split(", ")])

    return run


def benchmark_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, distance): for each document and item the best place (bytes), if within the distance."""
    rows = id_and_text(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    # each text is searched once, under a number of its own; the ids that share it are joined to what was found
    texts = materialise(items.select("text").distinct().withColumn("text_id", F.monotonically_increasing_id()), "benchmark-texts")
    size = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks = size // BLOCK_BYTES + 1
    found = None
    for k in range(blocks):
        # about BLOCK_BYTES of distinct texts, whatever the benchmark's size
        block = sorted((r["text_id"], r["text"].encode()) for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect())
        own = rows.mapInArrow(_search(_digest(block), block), PAIRS)
        found = own if found is None else found.unionByName(own)
    # the pairs found are written once, so that planning the join never runs the search again
    best = materialise(found.groupBy("doc_id", F.col("item_id").alias("text_id")).agg(F.min(F.struct("distance", "start", "end")).alias("b")), "benchmark-pairs")
    known = items.join(texts, "text").select("text_id", "item_id")
    return best.join(known, "text_id").select("doc_id", "item_id", "b.start", "b.end", "b.distance")


def _digest(block: list[tuple[int, bytes]]) -> str:
    """Names a block by what it holds, so that workers never answer one with another."""
    whole = sha256()
    for text_id, text in block:
        whole.update(b"%d %d " % (text_id, len(text)))
        whole.update(text)
    return whole.hexdigest()
