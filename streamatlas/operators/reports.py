"""Reports of a build: drop reasons, fetch outcomes, diagnosis, health and pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..fixed import catalogue as fc
from ..functions import urls
from .keyed import top_counts


def reason_label(reason: Column) -> Column:
    return F.substring_index(reason, ":", 1)


def reason_detail(reason: Column) -> Column:
    return F.when(F.contains(reason, F.lit(":")), F.regexp_replace(reason, r"(?s)^[^:]*:", "")).otherwise(F.lit(""))


def drop_reasons(checked: DataFrame) -> DataFrame:
    """(source, label, n) of dropped candidates."""
    return (
        checked.where(F.col("reason").isNotNull())
        .groupBy("source", reason_label(F.col("reason")).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def missing_extractor_hosts(checked: DataFrame) -> DataFrame:
    """(source, host, n): hosts that no routing rule covers."""
    host = F.coalesce(F.nullif(urls.host(F.col("target_url")), F.lit("")), F.lit("?"))
    return (
        checked.where(reason_label(F.col("reason")) == fc.NO_EXTRACTOR)
        .groupBy("source", host.alias("host"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def failure_details(checked: DataFrame) -> DataFrame:
    """(source, detail, n): what the failed resolvers said."""
    detail = reason_detail(F.col("reason"))
    return (
        checked.where((reason_label(F.col("reason")) != fc.NO_EXTRACTOR) & (detail != ""))
        .groupBy("source", detail.alias("detail"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def outcome_label(status: Column, error: Column) -> Column:
    """Outcome label of one fetch from its HTTP status and error class (a timeout is told before a connection error)."""
    return (
        F.when(error.isNull() & (status < 400), F.lit(fc.OK))
        .when(F.contains(F.lower(error), F.lit("timeout")), F.lit(fc.TIMEOUT))
        .when(F.contains(F.lower(error), F.lit("redirects")), F.lit(fc.TOO_MANY_REDIRECTS))
        .when(status.isNotNull() & (status >= 400), F.concat(F.lit("http-"), status.cast("string")))
        .otherwise(F.lit(fc.CONN_ERROR))
    )


def attributed_host(hop_url: Column, url: Column) -> Column:
    """The host an outcome belongs to: the hop that failed, else the host asked for, else `?`."""
    none = F.lit("")
    return F.coalesce(F.nullif(urls.host(hop_url), none), F.nullif(urls.host(url), none), F.lit("?"))


def fetch_outcomes(fetch_log: DataFrame, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """(keys, host, outcome, n) of a fetch log."""
    host = F.coalesce(F.nullif("host", F.lit("")), F.lit("?"))
    return (
        fetch_log.withColumn("host", host).groupBy(*keys, "host", "outcome").agg(F.count(F.lit(1)).alias("n"))
    )


def cap_hosts(outcomes: DataFrame, max_pairs: int) -> DataFrame:
    """A shorter report: per source the biggest (host, outcome) pairs; all others are summed into the host `other` of their outcome.

    The kept pairs are found with a rank filter (applied before the shuffle), so a source with very many hosts never gathers
    in one task; the rest is told apart by a join with that bounded set and summed with partial aggregation.
    """
    order = W.partitionBy("source").orderBy(F.col("n").desc(), "host", "outcome")
    kept = (
        outcomes.withColumn("_rk", F.row_number().over(order)).where(F.col("_rk") <= max_pairs)
        .select("source", "host", "outcome", F.lit(True).alias("_kept"))
    )
    named = outcomes.join(kept, ["source", "host", "outcome"], "left")
    host = F.when(F.col("_kept"), F.col("host")).otherwise(F.lit("other"))
    return named.groupBy("source", host.alias("host"), "outcome").agg(F.sum("n").alias("n"))


def outcome_maps(outcomes: DataFrame) -> DataFrame:
    """(source, host map): nested counts {host: {outcome: n}}. Run it on capped outcomes: a map is one value in one row."""
    per_host = outcomes.groupBy("source", "host").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("m")
    )
    return per_host.groupBy("source").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("host", F.to_json("m").alias("m"))))).alias("fetches")
    )


def failure_counts(outcomes: DataFrame) -> DataFrame:
    """(source, failure, n): counts under "<outcome> <host>", successes left out."""
    return outcomes.where(F.col("outcome") != fc.OK).groupBy(
        "source", F.concat_ws(" ", "outcome", "host").alias("failure")
    ).agg(F.sum("n").alias("n"))


def fetch_totals(outcomes: DataFrame, key: str = "source") -> DataFrame:
    """(key, fetched, ok, failed)."""
    ok = F.sum(F.when(F.col("outcome") == fc.OK, F.col("n")).otherwise(0))
    return outcomes.groupBy(key).agg(F.sum("n").alias("fetched"), ok.alias("ok")).withColumn(
        "failed", F.col("fetched") - F.col("ok")
    )


def diagnose(rollup: DataFrame, totals: DataFrame, failures: DataFrame, drops: DataFrame) -> DataFrame:
    """One line per source that says why it is empty or what it lost.

    rollup: (source, discovered, kept); totals: fetch_totals; failures: failure_counts; drops: drop_reasons.
    """
    group = ["source"]
    df = (
        rollup.join(totals, group, "left")
        .join(top_counts(failures, group, "failure", "n", 5, "top5"), group, "left")
        .join(top_counts(failures, group, "failure", "n", 3, "top3"), group, "left")
        .join(top_counts(drops, group, "label", "n", 4, "reasons"), group, "left")
        .join(drops.groupBy("source").agg(F.sum("n").alias("dropped")), group, "left")
        .fillna(0, ["fetched", "ok", "failed", "dropped"])
    )
    text = lambda c: F.col(c).cast("string")
    blocked = (F.col("discovered") == 0) & (F.col("fetched") > 0) & (F.col("ok") == 0)
    empty = (F.col("discovered") == 0) & (F.col("fetched") > 0) & (F.col("ok") > 0)
    head = F.concat(F.col("source"), F.lit(": "), text("kept"), F.lit(" kept / "), text("discovered"), F.lit(" discovered"))
    failed_part = F.when(
        F.col("failed") > 0,
        F.concat(text("fetched"), F.lit(" fetched, "), text("failed"), F.lit(" failed: "), F.col("top3")),
    )
    drop_part = F.when(F.col("dropped") > 0, F.concat(F.lit("dropped "), text("dropped"), F.lit(" ("), F.col("reasons"), F.lit(")")))
    parts = F.concat_ws("; ", failed_part, drop_part)
    line = (
        F.when(blocked, F.concat(F.col("source"), F.lit(": 0 kept / 0 discovered — "), text("fetched"),
                                 F.lit(" fetched, 0 ok ("), F.coalesce("top5", F.lit("")), F.lit(")")))
        .when(empty, F.concat(F.col("source"), F.lit(": 0 kept / 0 discovered — "), text("ok"),
                              F.lit(" fetched ok but extracted 0 URLs (site layout changed, or a soft block returning 200?)")))
        .when(parts != "", F.concat(head, F.lit(" — "), parts))
        .otherwise(head)
    )
    verdict = F.when(blocked, "blocked").when(empty, "soft-block-or-layout").otherwise("normal")
    return df.select("source", verdict.alias("verdict"), (blocked | empty).alias("warned"), line.alias("line"))


def drop_detail_lines(checked: DataFrame) -> DataFrame:
    """(source, missing, hosts, failures): how many rows have no extractor, their top hosts and the top failure details."""
    hosts, details = missing_extractor_hosts(checked), failure_details(checked)
    return (
        hosts.groupBy("source").agg(F.sum("n").alias("missing"))
        .join(top_counts(hosts, ["source"], "host", "n", 5, "hosts"), "source", "full")
        .join(top_counts(details, ["source"], "detail", "n", 3, "failures"), "source", "full")
        .fillna(0, ["missing"])
    )


def health_sources(expected: DataFrame, latest: DataFrame) -> DataFrame:
    """(source, rank, kept, discovered, crashed, status, unhealthy) of every expected source; one not tried yet is `unknown`.

    expected: (source, rank). latest: the last guarded row per source.
    """
    raw = latest.select("source", "kept", "discovered", "crashed", "status")
    seen = F.col("status").isNotNull()
    return expected.join(raw, "source", "left").select(
        "source",
        "rank",
        F.coalesce("kept", F.lit(0)).cast("long").alias("kept"),
        F.coalesce("discovered", F.lit(0)).cast("long").alias("discovered"),
        F.coalesce("crashed", F.lit(False)).alias("crashed"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
        (seen & (F.col("crashed") | (F.col("kept") == 0))).alias("unhealthy"),
    )


def health(sources: DataFrame, streams: int | Column, ready: bool, last_build_seconds: float | None) -> DataFrame:
    """One row with the health payload and its JSON text. The source list is the fixed list of the build, so it is small."""
    bad = F.when(F.col("unhealthy"), F.struct("rank", "source"))
    item = F.struct("kept", "discovered", "crashed", "status")
    named = F.struct("rank", F.col("source").alias("k"), item.alias("v"))
    agg = sources.agg(
        F.transform(F.array_sort(F.collect_list(bad)), lambda s: s["source"]).alias("unhealthy_sources"),
        F.map_from_entries(
            F.transform(F.array_sort(F.collect_list(named)), lambda s: F.struct(s["k"], s["v"]))
        ).alias("sources"),
    )
    payload = agg.select(
        F.lit(ready).alias("ready"),
        (F.lit(ready) & (F.size("unhealthy_sources") == 0)).alias("healthy"),
        (streams if isinstance(streams, Column) else F.lit(streams)).cast("long").alias("streams"),
        "unhealthy_sources",
        "sources",
        F.lit(last_build_seconds).cast("double").alias("last_build_seconds"),
    )
    return payload.withColumn("json", F.to_json(F.struct(*payload.columns)))


def pressure(fetch_log: DataFrame) -> DataFrame:
    """(host, penalties, backoff_seconds): how often a host shed load, and how long the fetchers waited for it."""
    return (
        fetch_log.groupBy("host")
        .agg(
            F.count_if(F.col("outcome").isin(*fc.SHEDDING_OUTCOMES)).alias("penalties"),
            F.round(F.sum(F.coalesce("backoff_s", F.lit(0.0))), 1).alias("backoff_seconds"),
        )
        .where((F.col("penalties") > 0) | (F.col("backoff_seconds") > 0))
    )


def top_pressure(pressures: DataFrame, k: int = 3) -> DataFrame:
    """The k hosts under most pressure, most penalties first, then by name."""
    return pressures.orderBy(F.col("penalties").desc(), "host").limit(k)


def catalogue_totals(entries: DataFrame) -> DataFrame:
    """(category, source, n) with the totals per category, per source and overall as further rows (null = all)."""
    return entries.cube("category", "source").agg(F.count(F.lit(1)).alias("n"))
