"""Operator 3: removal of repeated word passages by fixed-block anchors.

Every document is cut into consecutive blocks of half a window; these are the index. Every rolling block of every document is probed against it. A passage
of a whole window holds at least one complete index block of the document it repeats, so a window without a hit cannot be a repeat. Hits are extended:
the windows around them are compared over their whole length, and consecutive equal windows make up the maximal repeats. A word goes if such a window also
starts in a document with a smaller id.

Parts follow the order of ids, so "a smaller id" is "an earlier part, or an earlier document of the same part", and hashes need no id beside them.

Defined results: a null or blank text has no words (n_words 0, the hash of no bytes); a null id counts as smaller than all others; rows that share an id never
make each other's words go; columns other than id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import batches_of, text_buffers
from .hashing import Prefix, byte_prefix, word_spans
from .parts import MESSAGES, MULTIPLE, SINGLE, Members, Sender, answer, buckets_for, message_batch, messages, per_part, received, runs_of, write_parts

WINDOW = 50
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
PROBE_BITS = 40  # leading bits of a probe's hash; a chance hit only costs a comparison of whole windows
PROBE_BITS_LARGE = 56  # from LARGE bytes on
LARGE = 10**12


class _Words:
    """The words of a slice of texts and the hashes of their windows."""

    def __init__(self, texts: pa.Array) -> None:
        data, offsets = text_buffers(texts)
        starts, ends, self.doc = word_spans(data, offsets)
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.prefix = Prefix(byte_prefix(data).ranges(starts, ends), 1) if len(starts) else None

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every window inside one document."""
        if self.prefix is None or len(self.doc) < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[size - 1 :] == self.doc[: len(self.doc) - size + 1])
        return self.prefix.windows(size)[at], at


def _probe(window: int, buckets: int, bits: int):
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets, bits)
        for batch in batches_of(batches):
            own = np.asarray(batch.column("part"))
            for part in np.unique(own):
                words = _Words(batch.filter(pa.array(own == part)).column("text"))
                hashes, at = words.windows(block)
                indexed = hashes[(at - words.first[words.doc[at]]) % block == 0] if len(at) else hashes
                yield from sender.add(int(part), hashes, indexed)
        yield from sender.flush()

    return run


def _hit(keys: np.ndarray, kinds: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block counts if it stands in the index and occurs more than once."""
    run = runs_of(keys)
    many = np.bincount(run, 1 + (kinds & 1)) > 1
    indexed = np.bincount(run, kinds >= 2) > 0
    return (many & indexed)[run], np.zeros(len(keys), bool)


def _earlier(keys: np.ndarray, kinds: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of whole windows: SINGLE to parts after the first that has it; MULTIPLE to the first part if it has it more than once."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    run = runs_of(keys)
    first = np.minimum.reduceat(parts, np.flatnonzero(np.diff(run, prepend=-1)))[run]
    own = (parts == first) & (np.bincount(run, (parts == first) * (1 + (kinds & 1)))[run] > 1)
    return (parts > first) | own, own


def _table(rows: dict[str, list], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table([pa.array(rows[n], t) for n, t in schema], names=[n for n, _ in schema])


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), and with `keep_text` the kept words joined by spaces as `text`."""
    spark = docs.sparkSession
    parts, size = write_parts(docs)
    block = window // 2
    buckets, bits = buckets_for(spark, size // 6), PROBE_BITS if size < LARGE else PROBE_BITS_LARGE
    drop = np.uint64(64 - bits)
    hits = answer(parts.mapInArrow(_probe(window, buckets, bits), MESSAGES), _hit)

    def extend(texts: pa.Table, sent: pa.Table) -> pa.Table:
        live = Members(received(sent, SINGLE) << drop)
        held: list[pa.RecordBatch] = []
        if len(live.keys) and texts.num_rows:
            part = texts.column("part")[0].as_py()
            sender = Sender(buckets, 64)
            for batch in batches_of(iter(texts.select(["text"]).combine_chunks().to_batches())):
                words = _Words(batch.column("text"))
                hashes, at = words.windows(block)
                found = np.zeros(len(words.doc) + 1, np.int64)
                found[at[live((hashes >> drop) << drop)] + 1] = 1
                before = np.cumsum(found)  # hits that start before a word
                whole, start = words.windows(window)
                near = before[start + window - block + 1] > before[start]
                held += sender.add(part, whole[near])
            held += sender.flush()
        return pa.Table.from_batches(held or [message_batch([])])

    repeats = answer(per_part(parts, hits, extend, MESSAGES), _earlier)

    def remove(texts: pa.Table, sent: pa.Table) -> pa.Table:
        earlier, shared = Members(received(sent, SINGLE)), Members(received(sent, MULTIPLE))
        ids = texts.column("doc_id").to_pylist()
        order = {d: k for k, d in enumerate(sorted({x for x in ids if x is not None}), 1)}
        rank = np.array([order.get(d, 0) for d in ids], np.int64)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        slices, base = [], 0
        for batch in batches_of(iter(texts.select(["text"]).combine_chunks().to_batches())):
            words = _Words(batch.column("text"))
            whole, start = words.windows(window)
            gone = earlier(whole)
            own = shared(whole)
            slices.append((batch.column("text"), words.first, start, gone, own))
            pairs.append((whole[own], rank[base + words.doc[start[own]]]))
            base += len(batch)
        # windows that first occur in this part: they go in all but the smallest of its ids
        keys = np.concatenate([k for k, _ in pairs]) if pairs else np.zeros(0, np.uint64)
        ranks = np.concatenate([r for _, r in pairs]) if pairs else np.zeros(0, np.int64)
        unique, inverse = np.unique(keys, return_inverse=True)
        least = np.full(len(unique), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, ranks)
        later = ranks > least[inverse] if len(keys) else np.zeros(0, bool)
        rows: dict[str, list] = {"doc_id": ids, "n_words": [], "n_removed": [], "kept_sha256": [], "text": []}
        seen = 0
        for column, first, start, gone, own in slices:
            n = int(own.sum())
            gone[own] |= later[seen : seen + n]
            seen += n
            edge = np.zeros(first[-1] + 1, np.int64)
            np.add.at(edge, start[gone], 1)
            np.add.at(edge, start[gone] + window, -1)
            covered = np.cumsum(edge)[:-1] > 0
            for k in range(len(column)):
                words, mask = column[k].as_py().encode().split(), covered[first[k] : first[k + 1]]
                removed = int(mask.sum())
                kept = b" ".join([w for w, m in zip(words, mask.tolist()) if not m] if removed else words)
                rows["n_words"].append(len(words))
                rows["n_removed"].append(removed)
                rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    rows["text"].append(kept.decode())
        kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
        return _table(rows, kinds + [("text", pa.string())] * keep_text)

    return per_part(parts, repeats, remove, SCHEMA + ", text string" * keep_text)
