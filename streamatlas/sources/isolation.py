"""Failures of sources, told apart: what a document does to its source is a row, what a cluster does to a job stays an exception.

A source given as a function of one document runs over Arrow batches, and a document on which it fails becomes a row that carries the error. A source given
as a frame transformation fails as a whole job; its documents are then halved until the one that makes it fail is alone. A lost executor, a lost
shuffle file or a full disk says nothing about a source and is raised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from ..functions import urls
from ..operators.extract import usable
from ..operators.keyed import materialise
from ..operators.resolve import error_detail

# What a document's function may give; the rest of a candidate follows from these.
GIVEN = ("title", "angle_key", "category", "source_page_url", "target_url")
ERROR_SCHEMA = "source string, url string, part int, error string, detail string"
_ROW = "k1 string, k2 long, k3 long, " + ", ".join(f"{c} string" for c in GIVEN) + ", error_url string, error_part int, error string, detail string"

_OF_THE_CLUSTER = (
    "ExecutorLostFailure", "FetchFailed", "MetadataFetchFailedException", "TaskResultLost", "SparkContext was shut down", "Stage cancelled",
    "No space left on device", "OutOfMemoryError", "TaskKilled", "Connection refused",
)


def blames_cluster(exc: BaseException) -> bool:
    """Whether an exception speaks of machines and not of data."""
    text = str(exc)
    return isinstance(exc, (OSError, MemoryError)) or any(sign in text for sign in _OF_THE_CLUSTER)


def label(exc: BaseException) -> str:
    """A short name of a failure: Spark's error condition where there is one, else the exception's type."""
    condition = exc.getCondition() if isinstance(exc, PySparkException) else None
    return condition or type(exc).__name__


def document_source(extract: Callable[[str, int, str], Iterable[dict]]) -> Callable[[DataFrame], DataFrame]:
    """An adapter out of a function of one document (url, part, body) that yields candidates as dicts (GIVEN). A document on which it fails gives no
    candidate but one row with `error_url`, `error_part`, `error` and `detail`."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in _ROW.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for url, part, body in zip(*[batch.column(c).to_pylist() for c in ("url", "part", "body")]):
                try:
                    rows = [{"k1": url, "k2": part, "k3": pos, **{c: row.get(c) for c in GIVEN}} for pos, row in enumerate(extract(url, part, body))]
                except Exception as exc:  # whatever a site's function does to a document belongs to that document
                    rows = [{"error_url": url, "error_part": part, "error": label(exc), "detail": str(exc)}]
                out += rows
            yield pa.RecordBatch.from_pylist(out, schema)

    def adapter(pages: DataFrame) -> DataFrame:
        found = usable(pages).select("url", "part", "body").mapInArrow(run, _ROW)
        return found.withColumn("predisc_key", urls.merge_key(F.col("target_url")))

    return adapter


def error_rows(rows: DataFrame, source: str) -> DataFrame | None:
    """The rows of a source that carry an error; None if its rows can't."""
    if "error" not in rows.columns:
        return None
    return rows.where(F.col("error").isNotNull()).select(
        F.lit(source).alias("source"), F.col("error_url").alias("url"), F.col("error_part").alias("part"), "error", _told(F.col("detail")).alias("detail")
    )


def _told(detail):
    """Credentials out, query strings cut, as in every other message."""
    return error_detail(urls.scrub_credentials(detail))


def _failure(adapter: Callable[[DataFrame], DataFrame], pages: DataFrame) -> Exception | None:
    try:
        adapter(pages).write.format("noop").mode("overwrite").save()
    except Exception as exc:
        if blames_cluster(exc):
            raise
        return exc
    return None


def isolate(pages: DataFrame, adapter: Callable[[DataFrame], DataFrame], source: str, exc: Exception) -> DataFrame:
    """One row (ERROR_SCHEMA): a document on which the adapter fails by itself, with a null url if it takes several to fail, or none.

    Each round writes the half that is looked at next, so all rounds together read and write about as much as the source has.
    """
    spark = pages.sparkSession
    suspects = materialise(usable(pages), "suspects")
    place, low, high = F.xxhash64("url", "part"), -(2**63), 2**63 - 1
    while low < high and suspects.limit(2).count() > 1:
        middle = (low + high) // 2
        first = materialise(suspects.where(place <= middle), "suspects")
        failure = _failure(adapter, first)
        if failure is not None:
            suspects, high, exc = first, middle, failure
        else:
            suspects, low = materialise(suspects.where(place > middle), "suspects"), middle + 1
    alone = _failure(adapter, suspects)
    row = suspects.select("url", "part").first() if alone is not None else None
    told = spark.createDataFrame([(source, row and row["url"], row and row["part"], label(alone or exc), str(alone or exc))], ERROR_SCHEMA)
    return told.withColumn("detail", _told(F.col("detail")))
