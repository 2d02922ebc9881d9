"""As-of lookups and episodes over long histories.

As-of lookups run over even ranges of the history. Episodes are cut into blocks of their time line: windows run per (key, block) and a second step joins
the runs over block borders, so a key that owns most rows is still spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from .scan import running


def asof_last(
    requests: DataFrame, log: DataFrame, on: str, request_time: str, log_time: str, log_order: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Every request with the columns `cols` of the latest log row of its key at or before it (null where there is none).

    `log_order` breaks ties between log rows of one time; it must make the order total. Requests and log rows lie in one order of key and time that is cut
    into even ranges, so a key with most of the rows within an hour is spread like all others. A range takes over the last log row before it, which
    counts for the requests of the same key.
    """
    stamp = lambda c: F.col(c).cast("timestamp")
    hit = F.struct(F.col(on).alias("on"), stamp(log_time).alias("t"), *[F.col(c).alias(f"v_{c}") for c in cols])
    none = F.lit(None)
    ties = [f"_k{i}" for i in range(len(log_order))]
    left = requests.select(
        F.col(on).alias("_on"), stamp(request_time).alias("_time"), F.lit(2).alias("_kind"),
        *[none.cast(log.schema[c].dataType).alias(k) for c, k in zip(log_order, ties)], F.struct(*requests.columns).alias("_req"),
    )
    right = log.select(
        F.col(on).alias("_on"), stamp(log_time).alias("_time"), F.lit(1).alias("_kind"), *[F.col(c).alias(k) for c, k in zip(log_order, ties)], hit.alias("_hit"),
    )
    rows = left.unionByName(right, allowMissingColumns=True).withColumn("_no", F.xxhash64("_req"))
    found = running(rows, ["_on", "_time", "_kind", *ties, "_no"], {"_found": ("last", "_hit")}).where(F.col("_kind") == 2)
    own = F.when(F.col("_found")["on"].eqNullSafe(F.col("_on")), F.col("_found"))
    return found.withColumn("_found", own).select(
        *[F.col("_req")[c].alias(c) for c in requests.columns], F.col("_found")["t"].alias("found_at"), *[F.col("_found")[f"v_{c}"].alias(f"found_{c}") for c in cols]
    )


def episodes(
    events: DataFrame, key: str, time: str, gap_seconds: float, maxima: Sequence[str] = (), block_seconds: int = 3600
) -> DataFrame:
    """Runs of events of a key without a pause longer than the gap: (key, start, end, n, and the maximum of each column named).

    Runs are built inside blocks first and joined over block borders afterwards; the second step sees at most one run per gap
    of the time line and key, however many events there are.
    """
    gap = int(gap_seconds * 1_000_000)
    rows = events.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    rows = rows.withColumn("_block", F.floor(F.col("_t") / (block_seconds * 1_000_000)))
    in_block = W.partitionBy(key, "_block").orderBy("_t")
    rows = rows.withColumn("_s", F.when(F.col("_t") - F.lag("_t").over(in_block) <= gap, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_s").over(in_block.rowsBetween(W.unboundedPreceding, 0)))
    pieces = rows.groupBy(key, "_block", "_run").agg(
        F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.count(F.lit(1)).alias("_n"), *[F.max(m).alias(m) for m in maxima]
    )
    over_key = W.partitionBy(key).orderBy("_a")
    pieces = pieces.withColumn("_s", F.when(F.col("_a") - F.lag("_b").over(over_key) <= gap, 0).otherwise(1))
    pieces = pieces.withColumn("_id", F.sum("_s").over(over_key.rowsBetween(W.unboundedPreceding, 0)))
    return (
        pieces.groupBy(key, "_id")
        .agg(
            F.timestamp_micros(F.min("_a")).alias("start"),
            F.timestamp_micros(F.max("_b")).alias("end"),
            F.sum("_n").alias("n"),
            *[F.max(m).alias(m) for m in maxima],
        )
        .drop("_id")
    )
