"""Shared frame helpers: the columns an operator needs under names of its own, and tables written between steps."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.keyed import materialise
from ..session import ensure_checkpoint_dir, share_package

__all__ = ["materialise", "ensure_checkpoint_dir", "id_and_text", "batches_of", "text_buffers", "kept_by_worker", "SLICE_BYTES", "SMALL_SLICE_BYTES"]

# Texts are handled in slices of about this many bytes: numpy holds a few 8-byte arrays per byte of a slice, so this bounds a task's memory
# whatever the batch size. A single longer text is one slice.
SLICE_BYTES = 2_000_000
# Workers outlive their stage and keep what they once took. Where nothing is shared within a slice, a small one costs no time and spares each worker about 100 MB.
SMALL_SLICE_BYTES = 500_000
SLICE_ROWS = 4096  # the index of a text in its slice has 12 bits


_KEPT: dict[str, Callable[[], None]] = {}


def kept_by_worker(name: str, forget: Callable[[], None]) -> None:
    """Names what an operator keeps in a Python worker from task to task; a worker that goes on to another operator's texts forgets it."""
    _KEPT[name] = forget


def _give_back() -> None:
    """Returns free memory to the system: workers outlive their stage, and allocators keep the most that a task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not the GNU library
        pass


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that other columns of the input, whatever their names, are neither read nor in the way."""
    share_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def batches_of(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices whose texts have about `limit` bytes, at most SLICE_ROWS of them. Before and after them the worker gives back what it
    doesn't use; of what operators keep only `keep` stays."""
    for name, forget in _KEPT.items():
        if name != keep:
            forget()
    _give_back()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(sizes) // limit
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(np.arange(batch.num_rows) // SLICE_ROWS) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(lo, hi - lo)
    _give_back()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and the n + 1 offsets of its texts, without copying the bytes."""
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
