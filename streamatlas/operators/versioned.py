"""Keyed tables on shared storage that change from cycle to cycle, one committed version after the other.

A table is cut into buckets by a hash of its key. A change writes the buckets that it touches into a folder of its own and then commits a version: one small
file that names the folder of every bucket, the step that made it, and a few numbers that belong to the state. Readers follow the last committed version, so they see
the table before or after a change and never between. A step that was committed is not taken again: a cycle that runs twice leaves the same state. What a failed
change has written is never named, so it changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from .keyed import last_by

_LOG = "step long, bucket int, folder string, rows long, values map<string,long>"
_UNSEEN = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class VersionConflict(RuntimeError):
    """Someone else committed the version that was about to be written."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    step: int = -1
    buckets: dict[int, tuple[str, int]] = field(default_factory=dict)  # folder and rows of each bucket that has any
    values: dict[str, int] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.buckets.values())


class VersionedTable:
    """A table with the columns of `schema` (DDL) under `root`, one row per `key`."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, buckets: int = 16) -> None:
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root, schema, key, buckets
        self.columns = [c.split()[0] for c in schema.split(", ")]
        self._version: Version | None = None

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{_LOG}, version long").parquet(f"{self.root}/log")
        except AnalysisException as exc:
            if exc.getCondition() in _UNSEEN:
                return None
            raise

    def _read_version(self, number: int | None = None) -> Version:
        log = self._log()
        if log is None:
            return Version()
        if number is None:
            number = log.agg(F.max("version")).first()[0]
        rows = [] if number is None else log.where(F.col("version") == number).collect()  # one row per bucket
        if not rows:
            return Version()
        return Version(number, rows[0]["step"], {r["bucket"]: (r["folder"], r["rows"]) for r in rows if r["bucket"] >= 0}, dict(rows[0]["values"]))

    def current(self, refresh: bool = False) -> Version:
        """The last committed version, read from storage once and after that known from this object's own commits."""
        if self._version is None or refresh:
            self._version = self._read_version()
        return self._version

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version (the last one), or of some of its buckets."""
        own = self.current() if version is None else self._read_version(version)
        wanted = own.buckets if buckets is None else [b for b in buckets if b in own.buckets]
        paths = [f"{self.root}/data/{own.buckets[b][0]}/bucket={b}" for b in sorted(wanted)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def commit(self, step: int, rows: DataFrame | None, touched: Iterable[int], values: dict[str, int] | None = None) -> Version:
        """`rows` take the place of what the touched buckets held; the others stay where they are. Does nothing if the step was committed before."""
        base = self.current()
        if base.step >= step:
            return base
        held = {b: place for b, place in base.buckets.items() if b not in set(touched)}
        if rows is not None:
            folder = uuid.uuid4().hex
            placed = rows.select(*self.columns).withColumn("bucket", self.bucket_of())
            # A bucket grows with the table: rebalanced, a large one is written by several tasks and small ones share one. The tasks count the rows as they write them.
            counted = Observation()
            each = [F.count_if(F.col("bucket") == b).alias(f"b{b}") for b in range(self.buckets)]
            placed.hint("rebalance", "bucket").observe(counted, *each).write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
            held |= {b: (folder, n) for b in range(self.buckets) if (n := counted.get[f"b{b}"])}
        made = Version(base.number + 1, step, held, {**base.values, **(values or {})})
        self._write_log(made)
        self._version = made
        return made

    def _write_log(self, made: Version) -> None:
        """One file of one row per bucket; it appears as a whole, and only once under its number."""
        # a version without rows still has a line of its own
        lines = [(made.step, b, folder, n, made.values) for b, (folder, n) in made.buckets.items()] or [(made.step, -1, None, 0, made.values)]
        frame = self.spark.createDataFrame(lines, _LOG).coalesce(1)
        path = f"{self.root}/log/version={made.number}"
        try:
            frame.write.parquet(path)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            if self._read_version(made.number).number:
                raise VersionConflict(f"version {made.number} of {self.root} was committed by another run") from exc
            frame.write.mode("overwrite").parquet(path)  # left by a commit that ended before its file appeared

    def touched_by(self, rows: DataFrame) -> list[int]:
        return sorted(r["bucket"] for r in rows.select(self.bucket_of().alias("bucket")).distinct().collect())  # at most `buckets`

    def upsert(self, step: int, rows: DataFrame, order: Sequence[str], values: dict[str, int] | None = None) -> Version:
        """Rows of the table's columns; of each key the last one in `order` (columns of the table) stays, rows already in the table included. A row that
        is as late as the one in the table replaces it."""
        if self.current().step >= step:
            return self.current()
        touched = self.touched_by(rows)
        both = self.read(buckets=touched).withColumn("_new", F.lit(0)).unionByName(rows.select(*self.columns).withColumn("_new", F.lit(1)))
        rest = [c for c in self.columns if c != self.key]
        return self.commit(step, last_by(both, [self.key], [*order, "_new"], rest), touched, values)
