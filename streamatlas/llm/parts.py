"""Exchange of window hashes between the parts of a corpus.

A corpus is cut into parts by ranges of its ids and written once as a table that is bucketed by part, so later steps join what other parts have found without
moving a text again. Between the steps only sets of hashes travel, as sorted differences of a few bytes each: a part sends each hash once, however often
it occurs, so a passage that fills a third of the corpus is one entry per part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import ensure_checkpoint_dir, id_and_text

PART_BYTES = 24_000_000
BUCKET_KEYS = 2_000_000
FLUSH_KEYS = 2_000_000
MESSAGES = "bucket int, part int, kind int, keys binary"
SINGLE, MULTIPLE, INDEXED = 0, 1, 2  # kinds of a hash within one part; MULTIPLE and INDEXED add up
U64 = np.uint64


def write_parts(docs: DataFrame, by_id: bool = True) -> tuple[DataFrame, int]:
    """The documents as a table (doc_id, text, part), and their bytes. With `by_id` parts are in ascending order of ids (null first; rows of one id
    share a part); otherwise what a task reads is a part, and no text is shuffled unless tasks read too much."""
    spark = docs.sparkSession
    rows = id_and_text(docs)
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    # at least as many parts as shuffles have, or else the join with them would deal the texts again
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    part = F.spark_partition_id()
    if by_id:
        rows = rows.repartitionByRange(n, "doc_id")
    else:
        tasks = max(1, rows.rdd.getNumPartitions())
        if size > 4 * PART_BYTES * tasks:
            rows, tasks = rows.repartition(n), n
        split = -(-2 * size // (tasks * PART_BYTES)) or 1
        part = F.spark_partition_id() * split + F.pmod(F.xxhash64("doc_id"), F.lit(split)).cast("int")
        n = max(n, tasks * split)
    name = f"parts_{uuid.uuid4().hex}"
    (
        rows.withColumn("part", part)
        .write.bucketBy(n, "part")
        .option("compression", "zstd")
        .option("path", f"{ensure_checkpoint_dir(spark)}/{name}")
        .saveAsTable(name)
    )
    return spark.table(name), size


def encode_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences of as many bytes as the largest needs."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=U64(0)).astype("<u8")
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def decode_keys(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U64)
    width = blob[0]
    wide = np.zeros((len(blob) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


class Members:
    """Membership in a set of hashes: a table over their leading bits first, then a search among the few that pass it."""

    BITS = 22

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[(self.keys >> U64(64 - self.BITS)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        if len(self.keys):
            maybe = np.flatnonzero(self.table[(hashes >> U64(64 - self.BITS)).astype(np.int64)])
            own = hashes[maybe]
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            found[maybe] = self.keys[at] == own
        return found


def messages(part: int, hashes: np.ndarray, indexed: np.ndarray | None, buckets: int, bits: int = 64) -> list[tuple[int, int, int, bytes]]:
    """(bucket, part, kind, keys) for the distinct hashes of (a piece of) a part, cut to their leading bits."""
    if not len(hashes):
        return []
    drop = U64(64 - bits)
    ordered = np.sort(hashes >> drop)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    keys = ordered[first]
    kind = np.where(np.diff(np.append(first, len(ordered))) > 1, MULTIPLE, SINGLE)
    if indexed is not None and len(indexed):
        kind[np.searchsorted(keys, np.unique(indexed >> drop))] |= INDEXED
    # bucket = leading 20 bits scaled to the number of buckets
    bucket = ((keys >> U64(bits - 20)) * U64(buckets)) >> U64(20)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    out = []
    for b in range(buckets):
        own, kinds = keys[cuts[b] : cuts[b + 1]], kind[cuts[b] : cuts[b + 1]]
        for k in range(4):
            chosen = own[kinds == k]
            if len(chosen):
                out.append((b, part, k, encode_keys(chosen)))
    return out


def message_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["bucket", "part", "kind", "keys"])


class Sender:
    """Gathers the hashes of a part and hands them out as messages before they get too many."""

    def __init__(self, buckets: int, bits: int) -> None:
        self.buckets, self.bits, self.part = buckets, bits, -1
        self.held: list[np.ndarray] = []
        self.indexed: list[np.ndarray] = []
        self.n = 0

    def add(self, part: int, hashes: np.ndarray, indexed: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if part != self.part or self.n + len(hashes) > FLUSH_KEYS:
            yield from self.flush()
        self.part = part
        self.held.append(hashes)
        self.n += len(hashes)
        if indexed is not None:
            self.indexed.append(indexed)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield message_batch(messages(self.part, np.concatenate(self.held), np.concatenate(self.indexed) if self.indexed else None, self.buckets, self.bits))
        self.held, self.indexed, self.n = [], [], 0


def buckets_for(spark, keys: int) -> int:
    """As many buckets as keep one of them small, whatever the corpus' size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys // BUCKET_KEYS + 1)


def answer(sent: DataFrame, judge: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Decides each bucket on its own and sends every part those of its own hashes that count.

    `judge(keys, kinds, parts)` sees a bucket's entries sorted by key and returns two masks: entries to send back, and which of these carry kind MULTIPLE.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lists = [decode_keys(b) for b in frame["keys"]]
        lengths = [len(x) for x in lists]
        keys = np.concatenate(lists)
        kinds = np.repeat(frame["kind"].to_numpy(np.int8), lengths)
        parts = np.repeat(frame["part"].to_numpy(np.int32), lengths)
        order = np.argsort(keys)
        keys, kinds, parts = keys[order], kinds[order], parts[order]
        back, marked = judge(keys, kinds, parts)
        keys, parts, marked = keys[back], parts[back], marked[back]
        rows = []
        order = np.argsort(parts, kind="stable")
        keys, parts, marked = keys[order], parts[order], marked[order]
        cuts = np.flatnonzero(np.diff(parts, prepend=-1)) if len(parts) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(parts)]):
            for k, mask in ((SINGLE, ~marked[lo:hi]), (MULTIPLE, marked[lo:hi])):
                own = np.unique(keys[lo:hi][mask])
                if len(own):
                    rows.append((int(parts[lo]), k, encode_keys(own)))
        return pd.DataFrame(rows, columns=["part", "kind", "keys"])

    return sent.groupBy("bucket").applyInPandas(run, "part int, kind int, keys binary")


def answer_bits(sent: DataFrame) -> DataFrame:
    """Tells for each key of each message whether it occurs more than once in all: one bit per key, in the message's order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lists = [decode_keys(b) for b in frame["keys"]]
        lengths = np.array([len(x) for x in lists])
        keys = np.concatenate(lists)
        order = np.argsort(keys)
        run = runs_of(keys[order])
        many = np.empty(len(keys), bool)
        many[order] = (np.bincount(run, 1 + np.repeat(frame["kind"].to_numpy(np.int8) & 1, lengths)[order]) > 1)[run]
        cuts = np.cumsum(lengths)
        bits = [np.packbits(many[b - n : b]).tobytes() for n, b in zip(lengths, cuts)]
        return pd.DataFrame({"bucket": frame["bucket"], "part": frame["part"], "kind": frame["kind"], "keys": bits})

    return sent.groupBy("bucket").applyInPandas(run, MESSAGES)


def runs_of(keys: np.ndarray) -> np.ndarray:
    """Index of the run of equal keys that each of the sorted keys belongs to."""
    return np.cumsum(np.concatenate(([False], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def received(table: pa.Table, kind: int) -> np.ndarray:
    """All keys of one kind that a part was sent."""
    lists = [decode_keys(b) for k, b in zip(table.column("kind").to_pylist(), table.column("keys").to_pylist()) if k == kind]
    return np.concatenate(lists) if lists else np.zeros(0, U64)


def per_part(parts: DataFrame, sent: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each part with what it was sent; the parts' table is bucketed, so only the messages are shuffled."""
    return parts.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(run, schema)
