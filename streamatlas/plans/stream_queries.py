"""The streaming operators, driven over a table that lands slice by slice and is read as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.keyed import materialise
from ..session import ensure_checkpoint_dir
from ..streaming import streams
from .catalogue_queries import GUARD_RESULT, WINDOWS_SQL, _LOG, fetch_log, rollups
from .registry import query, table


def replay(rows: DataFrame, operator, order: Column, slices: int = 4, closing: DataFrame | None = None) -> DataFrame:
    """Lands rows in slices of ascending `order` (a number), lets the stream take up each slice before the next one lands, and returns all it wrote.
    `closing` lands last: rows that are late enough to close every window before them."""
    spark = rows.sparkSession
    ordered = materialise(rows.withColumn("_at", order), "stream-rows")
    cuts = ordered.agg(F.percentile_approx("_at", [k / slices for k in range(1, slices)])).first()[0] if slices > 1 else None
    number = F.lit(0)
    for cut in cuts or []:
        number = number + F.coalesce((F.col("_at") > cut).cast("int"), F.lit(0))
    landing = [ordered.where(number == k).drop("_at") for k in range(slices)]
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    for part in [*landing, closing] if closing is not None else landing:
        part.write.mode("append").parquet(f"{folder}/in")
        result = operator(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        writer = result.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append")
        writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")


def _closing(log: DataFrame) -> DataFrame:
    """One row a day after the last one: it closes what came before and is itself never closed."""
    last = log.agg(*[F.max(c).alias(c) for c in log.columns])
    return last.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))


@query("guard_stream_t1", GUARD_RESULT)
def guard_stream(spark, sf):
    return replay(rollups(spark, sf), streams.guard_stream, F.col("cycle"))


@query("outcome_windows_stream_t6", WINDOWS_SQL)
def outcome_windows_stream(spark, sf):
    log = fetch_log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = replay(log, streams.outcome_windows_stream, F.unix_micros("ts"), closing=_closing(log))
    return out.select(F.unix_timestamp("window_start").alias("hour_start"), "source", "outcome", "n")


@query("shedding_stream_t5", f"""WITH {_LOG},
x AS (SELECT host, ts, event_id % 97 AS retry, lag(ts) OVER (PARTITION BY host ORDER BY ts) AS prev FROM f WHERE outcome = 'http-503'),
y AS (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(prev) <= 30000000 THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT host, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n, max(retry) AS retry_after_s FROM y GROUP BY host, g""")
def shedding_stream(spark, sf):
    log = fetch_log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("retry_after_s", F.col("event_id") % 97)
    out = replay(log, streams.shedding_episodes_stream, F.unix_micros("ts"), closing=_closing(log.where("outcome = 'http-503'")))
    return out.select("host", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", "retry_after_s")


@query("first_seen_stream_t7", """
SELECT 'k' || user_id AS predisc_key, CAST(NULL AS BIGINT) AS ord FROM events WHERE event_id % 10 <> 0 GROUP BY user_id
UNION ALL SELECT NULL, event_id FROM events WHERE event_id % 10 = 0""")
def first_seen_stream(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("event_id").alias("ord"), F.col("ts").cast("timestamp").alias("seen_at"),
        F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("k"), F.col("user_id"))).alias("predisc_key"),
    )
    out = replay(ev, streams.first_seen_stream, F.unix_micros("seen_at"))
    return out.select("predisc_key", F.when(F.col("predisc_key").isNull(), F.col("ord")).alias("ord"))


@query("live_set_stream_t2", """
WITH t AS (SELECT user_id AS id, event_type = 'view' AS live, event_id AS seq FROM events WHERE event_type IN ('view', 'error')),
c AS (SELECT *, lag(live, 1, false) OVER (PARTITION BY id ORDER BY seq) AS was FROM t)
SELECT id, live, seq FROM c WHERE live <> was""")
def live_set_stream(spark, sf):
    t = F.col("event_type")
    verdicts = table(spark, sf, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(t.isin("view", "error"), t == "view").alias("live")
    )
    return replay(verdicts, streams.live_set_stream, F.col("seq"))

