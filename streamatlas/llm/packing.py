"""Operator 2: best-fit packing of token sequences by matching of large items.

Only lengths decide how pieces share a sequence, and there are at most `capacity` of them. The plan is therefore made on the histogram of lengths,
whose size doesn't depend on the data: items above a third of the capacity, of which at most two share a sequence, are matched greedily (the longest open
one with the longest that fits beside it); shorter ones then go, longest first, where they leave the smallest gap. The plan says which ranks of each
length go to which range of sequences; every task looks its own pieces up in it.

Defined results: a null text is empty (one piece with the end id alone); every row of a repeated document is packed; columns other than id and text are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .frames import batches_of, id_and_text, materialise
from .tokens import KEPT, encoder, with_end

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches_of(batches, keep=KEPT):
            ids = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            coded, offsets = with_end(*encoder(path).encode(batch.column("text")), end_id)
            for doc, first, last in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist()):
                for k, lo in enumerate(range(first, last, capacity)):
                    n = min(capacity, last - lo)
                    rows.append((doc, k, k * capacity, n, zlib.crc32(coded[lo : lo + n]), part, int(seen[n])))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in PIECES.split(", ")])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a document's ids (cut only where they are longer than the capacity), with its rank among the pieces of its length in its
    task. Written once: ranks of a task that runs again are those of its own file."""
    return materialise(id_and_text(docs).mapInArrow(_cut(tokenizer, end_id, capacity), PIECES), "pieces")


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset) for each range of pieces of one length; counts: pieces by length."""
    left = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        left[n] = k
    taken = np.zeros(capacity + 1, np.int64)
    plan: list[tuple[int, int, int, int, int]] = []
    open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: ranges (first sequence, number)
    sequences = 0

    def put(n: int, k: int, first: int, offset: int) -> None:
        plan.append((n, int(taken[n]), k, first, offset))
        taken[n] += k
        left[n] -= k

    def leave(gap: int, first: int, k: int) -> None:
        if gap:
            open_[gap].append((first, k))

    large = capacity // 3 + 1
    for n in range(capacity, large - 1, -1):
        while left[n]:
            partner = min(n, capacity - n)
            while partner >= large and not left[partner]:
                partner -= 1
            if partner < large:
                k = int(left[n])
                put(n, k, sequences, 0)
                leave(capacity - n, sequences, k)
            else:
                k = int(min(left[n], left[partner])) if partner != n else int(left[n]) // 2
                if k == 0:  # the last one of its length has no twin: look for a shorter one
                    partner -= 1
                    while partner >= large and not left[partner]:
                        partner -= 1
                    k = 1
                put(n, k, sequences, 0)
                if partner >= large:
                    put(partner, k, sequences, n)
                    leave(capacity - n - partner, sequences, k)
                else:
                    leave(capacity - n, sequences, k)
            sequences += k
    for n in range(large - 1, 0, -1):
        gap = n
        while left[n]:
            while gap <= capacity and not open_[gap]:
                gap += 1
            if gap > capacity:
                each = capacity // n
                k = max(1, int(left[n]) // each)
                fit = min(each, int(left[n]))
                for i in range(fit):
                    put(n, k, sequences, i * n)
                leave(capacity - fit * n, sequences, k)
                sequences += k
                gap = n
                continue
            first, k = open_[gap].pop()
            use = int(min(k, left[n]))
            put(n, use, first, capacity - gap)
            leave(gap - n, first, use)
            if use < k:
                open_[gap].append((first + use, k - use))
            if gap - n >= n:  # what is left of it may be the best fit now
                gap = n
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to every piece."""
    by_task = materialise(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {int(r["length"]): int(r["n"]) for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = sorted(packing_plan(counts, capacity))
    table = pieces.sparkSession.sparkContext.broadcast(np.array(plan, np.int64).reshape(-1, 5).T)  # as many rows as the histogram's size allows
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = by_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, rank, _, first, offset = table.value
        starts = {int(n): (np.searchsorted(length, n, "left"), np.searchsorted(length, n, "right")) for n in np.unique(length)}
        for frame in frames:
            at = np.zeros(len(frame), np.int64)
            own = frame["rank"].to_numpy() + frame["base"].to_numpy()
            sizes = frame["length"].to_numpy()
            for n in np.unique(sizes):
                lo, hi = starts[int(n)]
                mask = sizes == n
                at[mask] = lo + np.searchsorted(rank[lo:hi], own[mask], "right") - 1
            frame["sequence_id"] = first[at] + own - rank[at]
            frame["offset"] = offset[at]
            yield frame[names]

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.join(bases, ["length", "part"]).mapInPandas(look_up, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity), capacity)
