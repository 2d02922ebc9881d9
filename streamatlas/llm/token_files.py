"""Operator 1: token ids as ORC files.

Documents are dealt by ranges of their id and sorted inside, so files and stripes hold disjoint id ranges: row-group statistics prune by range, Bloom
filters by single id, and stripes are read in parallel. Ids of a document are one integer list, which ORC stores run-length encoded.

Defined results: a null text is empty (it has the end id alone); a null id sorts first; repeated rows are documents of their own, in the order of the file;
columns other than id and text are ignored; an empty table gives an empty folder of files with the schema.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .frames import batches_of, ensure_checkpoint_dir, id_and_text, materialise
from .tokens import KEPT, encoder, with_end

END_ID = 2
FILE_SCHEMA = "doc_id long, block int, pos long, ids array<int>"
STRIPE_BYTES = 64 << 20
ROW_INDEX_STRIDE = 1000
BLOOM_FPP = 0.01


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, pos = TaskContext.get().partitionId(), 0
        for batch in batches_of(batches, keep=KEPT):
            coded, offsets = with_end(*encoder(path).encode(batch.column("text")), end_id)
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(coded.view("<i4")))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(n, block, np.int32)), pa.array(np.arange(pos, pos + n)), ids], ["doc_id", "block", "pos", "ids"]
            )
            pos += n

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, files: int | None = None) -> None:
    """Encodes every text and writes (doc_id, block, pos, ids) as ORC in ascending doc_id order; `block` numbers the files, `pos` the rows of one.

    The texts are shuffled, not the ids (which are larger), and encoded where they are written.
    """
    rows = id_and_text(docs)
    ordered = (rows.repartitionByRange(files, "doc_id") if files else rows.repartitionByRange("doc_id")).sortWithinPartitions("doc_id")
    (
        ordered.mapInArrow(_encode(tokenizer, end_id), FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; a filter on doc_id reaches the stripes' statistics and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy().astype(np.int64)
        values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("block"), batch.column("pos"), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())],
            ["doc_id", "block", "pos", "n_tokens", "ids_crc32"],
        )


def token_index(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it in the files' order), n_tokens and ids_crc32 of every row of the files.

    Starts are summed inside each file; only one total per file goes through the window over all of them.
    """
    # the files are read once: the totals and the starts both use the few numbers of each row
    sizes = materialise(files.mapInArrow(_digest, "doc_id long, block int, pos long, n_tokens long, ids_crc32 long"), "token-sizes")
    inside = W.partitionBy("block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    totals = sizes.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return (
        sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(before, "block")
        .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def encode_to_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> tuple[str, DataFrame]:
    """Writes the token files (into the shared folder of the session unless a path is given) and returns their folder and their index."""
    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer)
    return path, token_index(read_token_files(spark, path))
