"""Liveness: one verdict per distinct target over all sources, joined back to the candidates; as-of lookups of resolves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed import catalogue as fc
from .asof import asof_last
from .keyed import attach_by_key, lookup_by_key
from .resolve import error_detail, resolve


def is_playable(text: Column) -> Column:
    """A manifest that points at something: the header and a segment or a variant. No text is not playable."""
    has = lambda needle: F.contains(text, F.lit(needle))
    return F.coalesce(has("#EXTM3U") & (has("#EXTINF") | has("#EXT-X-STREAM-INF")), F.lit(False))


def verdict(resolver: Column, error: Column, stream_type: Column, playable: Column) -> Column:
    """Null for a live stream, else the label it is dropped under."""
    return (
        F.when(resolver.isNull(), F.lit(fc.NO_EXTRACTOR))
        .when(error.isNotNull(), F.concat(F.lit(fc.RESOLVE_FAILED + ":"), error_detail(error)))
        .when((stream_type == "hls") & ~F.coalesce(playable, F.lit(False)), F.lit(fc.DEAD_MANIFEST))
    )


def target_verdicts(targets: DataFrame, bodies: DataFrame, manifests: DataFrame, tool_output=None, now=0) -> DataFrame:
    """(target_url, reason) for distinct targets. Only a flag of each manifest takes part in the join, not its text."""
    playable = manifests.select("url", is_playable(F.col("text")).alias("playable"))
    resolved = resolve(targets, bodies, tool_output, now).join(playable, "url", "left")
    reason = verdict(F.col("resolver"), F.col("error"), F.col("stream_type"), F.col("playable"))
    return resolved.select("target_url", reason.alias("reason"))


def check_candidates(
    candidates: DataFrame, yt_live: DataFrame, bodies: DataFrame, manifests: DataFrame, tool_output=None, now=0
) -> DataFrame:
    """Candidates with `reason` (null = live). Rows with a video key are live iff the id is in `yt_live`; of all others one
    probe runs per distinct target. Rows of the official source take their category from the live table."""
    is_video = F.coalesce(F.col("predisc_key").startswith("yt:"), F.lit(False))
    live = yt_live.select(
        F.concat(F.lit("yt:"), F.col("video_id")).alias("predisc_key"),
        F.col("category_name").alias("_cat"), F.lit(True).alias("_live"),
    )
    videos = lookup_by_key(candidates.where(is_video), live, "predisc_key", F.col("ord"), ["_cat", "_live"])
    fill = (F.col("source") == fc.OFFICIAL_TITLE_SOURCE) & (F.col("_cat") != "")
    videos = (
        videos.withColumn("category", F.when(fill, F.col("_cat")).otherwise(F.col("category")))
        .withColumn("reason", F.when(F.col("_live").isNull(), F.lit(fc.YT_OFFLINE)))
        .drop("_cat", "_live")
    )
    others = candidates.where(~is_video)
    counts = others.groupBy("target_url").agg(F.count(F.lit(1)).alias("_n"))
    verdicts = target_verdicts(counts, bodies, manifests, tool_output, now).join(counts, "target_url")
    checked = attach_by_key(others, verdicts, ["target_url"], "_n", F.col("ord")).drop("_n")
    return videos.unionByName(checked)


def resolve_lookup(requests: DataFrame, resolve_log: DataFrame) -> DataFrame:
    """Requests (entry_id, target_url, at) answered from a resolve log (entry_id, seq, resolved_at, target_url, url, ttl_seconds).

    The latest log row of the entry at or before the request counts, and only if it was for the asked target and has not
    expired; an older row never steps in. `answer` is hit, failed (a remembered failure) or miss.
    """
    log = resolve_log.withColumn("target", F.col("target_url"))
    df = asof_last(requests, log, "entry_id", "at", "resolved_at", ["seq"], ["target", "url", "ttl_seconds"])
    ttl = F.col("found_ttl_seconds").cast("double")
    lifetime = (
        F.when(F.col("found_url").isNull(), F.lit(fc.NEGATIVE_TTL))
        .when(ttl.isNull(), F.lit(fc.DEFAULT_TTL * fc.TTL_FACTOR))
        .when(ttl > 0, ttl * fc.TTL_FACTOR)
        .otherwise(F.lit(0.0))
    )
    micros = F.unix_micros("found_at") + F.round(lifetime * 1_000_000).cast("long")
    fresh = (F.col("found_target") == F.col("target_url")) & (F.unix_micros(F.col("at").cast("timestamp")) < micros)
    answer = F.when(F.coalesce(fresh, F.lit(False)), F.when(F.col("found_url").isNull(), "failed").otherwise("hit"))
    return df.withColumn("answer", answer.otherwise("miss")).withColumn(
        "resolved_url", F.when(F.col("answer") == "hit", F.col("found_url"))
    ).drop("found_target", "found_url", "found_ttl_seconds")
