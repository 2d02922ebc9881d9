"""Operator 10: removal of byte strings that occur more than once, by blockwise suffix sorting with a difference cover.

Only suffixes that can agree with another one over the whole length have to be sorted. The cover sample finds them: positions whose remainder modulo 133 lies in a
perfect difference set, so any two positions have a common distance below 133 at which both are in the sample. Sample positions are ranked first, by the hash of the
268 bytes from there on; two suffixes that agree over 400 bytes have a sample of equal rank at that distance. The other suffixes are then dealt into
buckets by the leading bits of the hash of their 400 bytes and each bucket is sorted on its own, whole ties included; that hash stands for the order
(only equality over 400 bytes is asked for) and settles long ties without comparing bytes. No task holds more than one bucket or one part.

Defined results: a null text has no bytes; every row is a place of its own, so a repeated row of at least 400 bytes goes whole; a null id is an id like others;
columns other than id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import batches_of, materialise, text_buffers
from .hashing import byte_prefix
from .parts import MESSAGES, Members, Sender, answer, answer_bits, buckets_for, decode_keys, message_batch, messages, per_part, received, runs_of, write_parts

LENGTH = 400
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
ORDER = 11  # of the projective plane behind the difference set: 133 = 11^2 + 11 + 1
RANK = 10  # the kind of ranks among what a part is sent
SAMPLE_BITS = 40
SAMPLE_BITS_LARGE = 60
LARGE = 10**12


@cache
def difference_cover(q: int = ORDER) -> tuple[int, np.ndarray]:
    """Period and members of a perfect difference set of prime order q (Singer's construction: the powers of a generator of the field of q^3
    elements that lie in a plane)."""
    period = q * q + q + 1
    for a, b, c in product(range(q), range(q), range(1, q)):
        x, members = (1, 0, 0), []
        for i in range(period):
            if x[2] == 0:
                members.append(i)
            x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
        if len(members) == q + 1 and len({(m - n) % period for m in members for n in members}) == period:
            return period, np.array(members)
    raise ValueError(f"no difference set of order {q}")


class _Bytes:
    """The bytes of a slice of texts, with the hashes of their windows."""

    def __init__(self, texts: pa.Array) -> None:
        self.data, self.offsets = text_buffers(texts)
        self.prefix = byte_prefix(self.data)
        sizes = np.diff(self.offsets)
        self.ends = np.repeat(self.offsets[1:], sizes)  # of the document each byte belongs to
        self.place = np.arange(len(self.data)) - np.repeat(self.offsets[:-1], sizes)

    def sample(self, period: int, members: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and position of the cover sample's windows."""
        inside = np.zeros(period, bool)
        inside[members] = True
        at = np.flatnonzero(inside[self.place % period])
        at = at[at + size <= self.ends[at]]
        return self.prefix.ranges(at, at + size), at


def _sample(buckets: int, bits: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        period, members = difference_cover()
        sender = Sender(buckets, bits)
        for batch in batches_of(batches):
            own = np.asarray(batch.column("part"))
            for part in np.unique(own):
                yield from sender.add(int(part), _Bytes(batch.filter(pa.array(own == part)).column("text")).sample(period, members, size)[0])
        yield from sender.flush()

    return run


def _repeated(keys: np.ndarray, kinds: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    run = runs_of(keys)
    return (np.bincount(run, 1 + (kinds & 1)) > 1)[run] if len(keys) else np.zeros(0, bool), np.zeros(len(keys), bool)


def spread(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of the positions that lie in any of the ranges."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and with `keep_bytes` what is left as `kept`."""
    spark = docs.sparkSession
    period, members = difference_cover()
    if length < 2 * period:
        raise ValueError(f"strings must have at least {2 * period} bytes")
    size = length - period + 1
    parts, total = write_parts(docs, by_id=False)
    bits = SAMPLE_BITS if total < LARGE else SAMPLE_BITS_LARGE
    drop = np.uint64(64 - bits)
    ranked = materialise(answer(parts.mapInArrow(_sample(buckets_for(spark, total // 11), bits, size), MESSAGES), _repeated), "ranks")
    ranked = ranked.select(F.lit(-1).alias("bucket"), "part", F.lit(RANK).alias("kind"), "keys")
    buckets = buckets_for(spark, total // 4)

    def suffixes_of(texts: pa.Table, sent: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        """Of each slice of a part: its bytes and offsets, the starts of the suffixes to be sorted, and the hashes of their first bytes."""
        live = Members(received(sent, RANK) << drop)
        for batch in batches_of(iter(texts.select(["text"]).combine_chunks().to_batches())):
            text = _Bytes(batch.column("text"))
            hashes, at = text.sample(period, members, size)
            at = at[live((hashes >> drop) << drop)]
            # a suffix is sorted if a ranked sample lies less than a period after its start
            first = text.offsets[np.searchsorted(text.offsets, at, "right") - 1]
            start = np.flatnonzero(spread(len(text.data), np.maximum(at - period + 1, first), at + 1))
            start = start[start + length <= text.ends[start]]
            yield text.data, text.offsets, start, text.prefix.ranges(start, start + length)

    def suffixes(texts: pa.Table, sent: pa.Table) -> pa.Table:
        held = [h for *_, h in suffixes_of(texts, sent)] if texts.num_rows and sent.num_rows else []
        rows = messages(texts.column("part")[0].as_py(), np.concatenate(held), None, buckets) if held else []
        return pa.Table.from_batches([message_batch(rows)])

    told = answer_bits(per_part(parts, ranked, suffixes, MESSAGES))

    def remove(texts: pa.Table, sent: pa.Table) -> pa.Table:
        slices = list(suffixes_of(texts, sent))
        # the answers' bits belong to the keys that were sent, which are made again from the same suffixes
        bits = {(b, k): m for b, k, m in zip(*(sent.column(c).to_pylist() for c in ("bucket", "kind", "keys"))) if k != RANK}
        sorted_keys = [(b, k, decode_keys(m)) for b, _, k, m in messages(0, np.concatenate([h for *_, h in slices]), None, buckets)] if bits else []
        many = [keys[np.unpackbits(np.frombuffer(bits[b, k], np.uint8), count=len(keys)).astype(bool)] for b, k, keys in sorted_keys]
        repeated = Members(np.concatenate(many) if many else np.zeros(0, np.uint64))
        rows: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for data, offsets, start, hashes in slices:
            gone = start[repeated(hashes)]
            covered = spread(len(data), gone, gone + length)
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                mask = covered[lo:hi]
                removed = int(mask.sum())
                kept = (data[lo:hi][~mask] if removed else data[lo:hi]).tobytes()
                rows["n_bytes"].append(hi - lo)
                rows["n_removed"].append(removed)
                rows["n_spans"].append(int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if removed else 0)
                rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if keep_bytes:
                    rows["kept"].append(kept)
        kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.binary()} if keep_bytes else {})
        own = [texts.column("doc_id").combine_chunks(), *[pa.array(rows[n], t) for n, t in kinds.items()]]
        return pa.table(own, names=["doc_id", *kinds])

    return per_part(parts, ranked.unionByName(told), remove, SCHEMA + ", kept binary" * keep_bytes)
