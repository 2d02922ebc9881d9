"""The per-source guard over build cycles.

A source whose result collapses below half of its last good count is answered once with its last good set; the second
collapse in a row is accepted. A crash never counts as a result. As a recurrence this looks sequential, but it has a closed
form: a crash changes nothing, and after a held cycle the next result is always accepted, so in a run of results each below
half of the one before, the first is held, the second accepted, the third held, and so on. The position in the run decides.
All of it is window expressions over one small row per source and cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .keyed import lookup_by_key


def source_rollup(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Discovered and kept counts of checked candidates (column `reason`, null = live) per key columns."""
    return candidates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("reason").isNull()).alias("kept")
    )


def guard_cycles(rollups: DataFrame) -> DataFrame:
    """(source, cycle, discovered, kept, crashed) -> the same plus status, decision, served_cycle and the state after it.

    decision: `accept` serves this cycle's set, `hold` and `reuse` serve the set of `served_cycle`.
    """
    w = W.partitionBy("source").orderBy("cycle")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    kept, crashed = F.col("kept"), F.col("crashed")
    result = ~crashed

    def last_before(value: Column) -> Column:
        return F.last(value, ignorenulls=True).over(before)

    df = rollups.withColumn("_prev", last_before(F.when(result, kept)))
    fell = result & (F.col("_prev") > 0) & (kept * 2 < F.col("_prev"))
    df = df.withColumn("_fell", F.coalesce(fell, F.lit(False)))
    df = df.withColumn("_no", F.count_if(result).over(upto))
    df = df.withColumn("_base", F.max(F.when(result & ~F.col("_fell"), F.col("_no"))).over(upto))
    df = df.withColumn("_held", F.col("_fell") & ((F.col("_no") - F.col("_base")) % 2 == 1))
    good = result & ~F.col("_held")
    df = df.withColumn("_good_count", last_before(F.when(good, kept)))
    df = df.withColumn("_good_cycle", last_before(F.when(good, F.col("cycle"))))
    df = df.withColumn("_crash_before", F.coalesce(F.max(crashed).over(before), F.lit(False)))
    known = F.coalesce(F.col("_good_count"), F.when(F.col("_crash_before"), F.lit(0)))
    df = df.withColumn("_known", known.cast("long"))
    reuse = crashed & (F.coalesce(F.col("_known"), F.lit(0)) > 0)
    df = df.withColumn("decision", F.when(reuse, "reuse").when(F.col("_held"), "hold").otherwise("accept"))
    streak = F.when(reuse, F.coalesce(last_before(F.when(result, F.col("_held").cast("int"))), F.lit(0)))
    df = df.withColumn("shrink_streak", streak.when(F.col("_held"), F.lit(1)).otherwise(F.lit(0)))
    status = (
        F.when(crashed | (kept == 0), "dead")
        .when((F.col("_known") > 0) & (kept * 2 < F.col("_known")), "degraded")
        .otherwise("ok")
    )
    accept = F.col("decision") == "accept"
    return df.select(
        "source", "cycle", "discovered", "kept", "crashed",
        status.alias("status"),
        "decision",
        F.when(accept, F.col("cycle")).otherwise(F.col("_good_cycle")).alias("served_cycle"),
        F.when(accept, kept).otherwise(F.col("_known")).cast("long").alias("last_count"),
        "shrink_streak",
        F.col("_known").alias("previous_count"),
    )


def status_transitions(guarded: DataFrame) -> DataFrame:
    """Rows where a source changed its status (the first cycle is compared with `ok`) or is still dead."""
    w = W.partitionBy("source").orderBy("cycle")
    df = guarded.withColumn("previous_status", F.lag("status", 1, "ok").over(w))
    kind = F.when(F.col("status") != F.col("previous_status"), "transition").when(F.col("status") == "dead", "still-dead")
    return df.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "source", "cycle", "previous_status", "status", "kind", "kept", "previous_count"
    )


def served_rows(kept_rows: DataFrame, guarded: DataFrame, cycle: int, salt_on: str = "ord") -> DataFrame:
    """The rows to publish in a cycle: per source the kept rows of the cycle its guard serves. Safe against one huge source."""
    serve = guarded.where(F.col("cycle") == cycle).select("source", F.col("served_cycle").alias("_served"))
    rows = lookup_by_key(kept_rows, serve, "source", F.xxhash64(salt_on), ["_served"], how="inner")
    return rows.where(F.col("cycle") == F.col("_served")).drop("_served")
