"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..fixed import catalogue as fc

GUARD_SCHEMA = (
    "source string, cycle long, discovered long, kept long, crashed boolean, status string, decision string, "
    "served_cycle long, last_count long, shrink_streak int"
)
_GUARD_STATE = "last_cycle long, last_count long, served_cycle long, streak int"
_UNSET = -1


def _guard_step(state: tuple[int, int, int, int], cycle: int, kept: int, crashed: bool):
    """One cycle of the guard: (new state, status, decision, served cycle)."""
    _, known, served, streak = state
    has_good = known > 0
    collapsed = has_good and kept < known * (1 - fc.DROP_THRESHOLD)
    status = "dead" if crashed or kept == 0 else ("degraded" if collapsed else "ok")
    if crashed and has_good:
        return (cycle, known, served, streak), status, "reuse", served
    if collapsed and streak + 1 < fc.AGREE_TO_ACCEPT:
        return (cycle, known, served, streak + 1), status, "hold", served
    return (cycle, kept, cycle, 0), status, "accept", cycle


def _guard_group(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    current = tuple(state.get) if state.exists else (_UNSET, _UNSET, _UNSET, 0)
    cycles = pd.concat(list(batches)).sort_values("cycle")
    out = []
    for row in cycles.itertuples():
        if row.cycle <= current[0]:  # a cycle that comes late changes nothing, and is told as such
            out.append((key[0], row.cycle, row.discovered, row.kept, row.crashed, "late", "late", current[2], current[1], current[3]))
            continue
        kept = 0 if row.crashed else int(row.kept)
        current, status, decision, served = _guard_step(current, int(row.cycle), kept, bool(row.crashed))
        out.append((key[0], row.cycle, row.discovered, row.kept, row.crashed, status, decision, served, current[1], current[3]))
    state.update(current)
    columns = [c.split()[0] for c in GUARD_SCHEMA.split(", ")]
    yield pd.DataFrame(out, columns=columns)


def guard_stream(rollups: DataFrame) -> DataFrame:
    """The per-source guard as keyed state over a stream of (source, cycle, discovered, kept, crashed).

    One row per source and cycle arrives here, never the candidates themselves; the state is four numbers per source.
    """
    return rollups.groupBy("source").applyInPandasWithState(
        _guard_group, GUARD_SCHEMA, _GUARD_STATE, "append", GroupStateTimeout.NoTimeout
    )


def shedding_episodes_stream(fetch_log: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Runs of shedding answers per host, closed after the quiet gap."""
    return (
        fetch_log.where(F.col("outcome").isin(*fc.SHEDDING_OUTCOMES))
        .withWatermark("ts", lateness)
        .groupBy("host", F.session_window("ts", fc.QUIET_GAP).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("end"), F.max("retry_after_s").alias("retry_after_s"))
        .select("host", F.col("w.start").alias("start"), "end", "n", "retry_after_s")
    )


def outcome_windows_stream(fetch_log: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Outcome counts per time window and source of a running fetch log."""
    return (
        fetch_log.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("w"), "source", "outcome")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "source", "outcome", "n")
    )


def first_seen_stream(candidates: DataFrame) -> DataFrame:
    """Newly discovered rows, one per merge key for as long as the stream lives; rows without a key always pass and leave no state.

    The state is one entry per key ever seen, like the catalogue itself; with an expiry, a key that comes back later would count as new.
    """
    has_key = F.coalesce("predisc_key", F.lit("")) != ""
    return candidates.where(has_key).dropDuplicates(["predisc_key"]).unionByName(candidates.where(~has_key))


def live_set_stream(verdicts: DataFrame) -> DataFrame:
    """(id, live, seq) changes of the live set from a stream of verdicts (id, seq, live), each at the verdict that made it, however the stream is
    cut into batches; null verdicts, and verdicts older than one already taken up, change nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was, last = state.get if state.exists else (False, -1)
        rows = pd.concat(list(batches))
        rows = rows[rows["live"].notna() & (rows["seq"] > last)].sort_values("seq")
        if len(rows):
            live = rows["live"].astype(bool)
            state.update((bool(live.iloc[-1]), int(rows["seq"].iloc[-1])))
            changed = live != live.shift(fill_value=bool(was))
            yield pd.DataFrame({"id": key[0], "live": live[changed], "seq": rows["seq"][changed]})

    return verdicts.groupBy("id").applyInPandasWithState(
        step, "id long, live boolean, seq long", "live boolean, seq long", "append", GroupStateTimeout.NoTimeout
    )
