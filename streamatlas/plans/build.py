"""One build cycle of the catalogue, from landed documents to the published snapshot and its reports.

    documents -> candidates per source -> liveness -> per-source guard -> merge -> categories -> exclusion -> snapshot
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..fixed import catalogue as fc
from ..operators import categorise, guard, liveness, merge, reports
from ..operators.keyed import last_by, materialise
from ..sources import adapters, isolation, sinks

log = logging.getLogger(__name__)

KEPT_COLUMNS = (*merge.CANDIDATE_COLUMNS, "cycle")


@dataclass
class Cycle:
    """The frames of one build cycle."""

    candidates: DataFrame
    checked: DataFrame
    rollup: DataFrame
    guarded: DataFrame
    kept: DataFrame
    entries: DataFrame
    crashed: tuple[str, ...]
    quarantine: DataFrame


def discover(
    pages: DataFrame, names: Iterable[str] | None = None, table: Mapping[str, adapters.Adapter] | None = None, parallel: int = 4
) -> tuple[DataFrame, tuple[str, ...], DataFrame]:
    """Candidates of all sources, the names of those that crashed, and the documents that made them crash (`isolation.ERROR_SCHEMA`).

    pages: (source, url, part, body), best partitioned by source. Every source is a job of its own that writes its rows, so a
    failure costs that source one cycle and not the build. A source with one failing document counts as crashed: a part of a
    site's streams is not a result. Failures of the cluster are raised.
    """
    table = dict(table or adapters.ADAPTERS)
    names = [n for n in (names or fc.SOURCE_ORDER) if n in table]
    spark = pages.sparkSession

    def one(name: str) -> tuple[DataFrame | None, DataFrame | None]:
        own = pages.where(F.col("source") == name).drop("source")
        try:
            rows = materialise(table[name](own), f"rows-{name}")
        except Exception as exc:
            if isolation.blames_cluster(exc):
                raise
            log.exception("source %s failed", name)
            return None, isolation.isolate(own, table[name], name, exc)
        return rows, isolation.error_rows(rows, name)

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        found = dict(zip(names, pool.map(one, names)))
    quarantine = spark.createDataFrame([], isolation.ERROR_SCHEMA)
    for _, errors in found.values():
        if errors is not None:
            quarantine = quarantine.unionByName(errors)
    quarantine = materialise(quarantine, "quarantine")
    failed = {r["source"] for r in quarantine.select("source").distinct().collect()}
    crashed = tuple(n for n in names if n in failed)
    rows = {n: df for n, (df, _) in found.items() if df is not None and n not in failed}
    if not rows:
        schema = ", ".join(f"{c} {'long' if c == 'ord' else 'string'}" for c in merge.CANDIDATE_COLUMNS)
        return spark.createDataFrame([], schema), crashed, quarantine
    return materialise(adapters.number_candidates(rows), "candidates"), crashed, quarantine


def renumber(rows: DataFrame) -> DataFrame:
    """`ord` anew over rows that may come from different cycles: sources in their fixed order, rows in theirs."""
    order = F.array(*[F.lit(s) for s in fc.SOURCE_ORDER])
    ordered = rows.withColumn("_rank", F.array_position(order, F.col("source"))).orderBy("_rank", "ord")
    return ordered.withColumn("ord", F.monotonically_increasing_id()).drop("_rank")


def run_cycle(
    pages: DataFrame,
    manifests: DataFrame,
    bodies: DataFrame,
    cycle: int,
    history: DataFrame | None = None,
    kept_before: DataFrame | None = None,
    tool_output: DataFrame | None = None,
    now: int = 0,
    exclude: Iterable[str] = (),
    names: Iterable[str] | None = None,
    table: Mapping[str, adapters.Adapter] | None = None,
) -> Cycle:
    """Run one cycle.

    history: roll-ups (source, cycle, discovered, kept, crashed) of earlier cycles. kept_before: kept candidates with their cycle;
    only the cycle that each guard last accepted is read again.
    """
    names = tuple(names or fc.SOURCE_ORDER)
    spark = pages.sparkSession
    candidates, crashed, quarantine = discover(pages, names, table)
    live = adapters.live_videos(pages.where(F.col("source") == fc.OFFICIAL_TITLE_SOURCE).drop("source"))
    checked = materialise(liveness.check_candidates(candidates, live, bodies, manifests, tool_output, now), "checked")
    expected = spark.createDataFrame([(n, n in crashed) for n in names], "source string, crashed boolean")
    counted = guard.source_rollup(checked, ["source"])
    rollup = expected.join(counted, "source", "left").select(
        "source", F.lit(cycle).cast("long").alias("cycle"), F.coalesce("discovered", F.lit(0)).cast("long").alias("discovered"),
        F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), "crashed",
    )
    rollup = materialise(rollup, "rollup")
    past = rollup if history is None else history.select(*rollup.columns).where(F.col("cycle") < cycle).unionByName(rollup)
    guarded = materialise(guard.guard_cycles(past), "guarded")
    kept = checked.where(F.col("reason").isNull()).withColumn("cycle", F.lit(cycle).cast("long")).select(*KEPT_COLUMNS)
    pool = kept if kept_before is None else kept_before.select(*KEPT_COLUMNS).where(F.col("cycle") < cycle).unionByName(kept)
    served = materialise(renumber(guard.served_rows(pool, guarded, cycle).drop("cycle")), "served")
    entries = categorise.exclude_categories(categorise.to_entries(merge.merge_candidates(served)), exclude)
    return Cycle(candidates, checked, rollup, guarded, kept, entries, crashed, quarantine)


def report(cycle: Cycle, number: int, fetch_log: DataFrame | None = None, names: Iterable[str] | None = None, seconds: float | None = None) -> dict[str, DataFrame]:
    """Health, transitions and the lines that explain each source, of one cycle."""
    names = tuple(names or fc.SOURCE_ORDER)
    spark = cycle.checked.sparkSession
    expected = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "source string, rank long")
    latest = last_by(cycle.guarded, ["source"], ["cycle"], ["kept", "discovered", "crashed", "status"])
    if fetch_log is None:
        fetch_log = spark.createDataFrame([], "source string, host string, outcome string")
    outcomes = reports.fetch_outcomes(fetch_log)
    sources = reports.health_sources(expected, latest)
    return {
        "health": reports.health(sources, sinks.snapshot_rows(cycle.entries).count(), True, seconds),
        "sources": sources,
        "transitions": guard.status_transitions(cycle.guarded).where(F.col("cycle") == number),
        "lines": reports.diagnose(
            cycle.rollup.select("source", "discovered", "kept"), reports.fetch_totals(outcomes), reports.failure_counts(outcomes),
            reports.drop_reasons(cycle.checked),
        ),
        "details": reports.drop_detail_lines(cycle.checked),
        "totals": reports.catalogue_totals(cycle.entries),
    }


def publish(cycle: Cycle, root: str, base_url: str) -> int:
    """Write the snapshot and the playlist of a cycle; returns the snapshot version."""
    version = sinks.write_snapshot(cycle.entries, f"{root}/catalogue")
    snapshot = sinks.read_snapshot(cycle.entries.sparkSession, f"{root}/catalogue")
    sinks.write_playlist(snapshot, base_url, f"{root}/playlist={version}")
    return version
