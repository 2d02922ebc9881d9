"""A source whose corpus is too large to be probed in one cycle, with the state that it carries from cycle to cycle.

Every cycle probes all ids that are known to be live and a slice of the others, which moves on by a cursor. The corpus is enumerated anew when a countdown
ends, at once while it is empty, and again in the next cycle if the enumeration was cut short. Corpus and live set are versioned tables; cursor and
countdown are committed together with the live set, after the corpus. A cycle that is run again, from its start or after a failure between the two
commits, ends in the same state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixed import catalogue as fc
from .probe import builds_after_enumeration, enumeration_due, probe_batch, update_live
from .versioned import VersionedTable

CORPUS = "id long, title string, city string, country string, seq long"


@dataclass(frozen=True)
class Turn:
    """What a cycle did, and the state after it."""

    cycle: int
    probed: int
    cursor: int
    builds_left: int
    live: int
    enumerated: bool


class Rotation:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, every: int = fc.ENUM_EVERY) -> None:
        self.every = every  # cycles from one whole enumeration to the next
        self.corpus = VersionedTable(spark, f"{root}/corpus", CORPUS, "id", buckets)
        self.live = VersionedTable(spark, f"{root}/live", "id long", "id", buckets)

    def due(self) -> bool:
        return enumeration_due(self.corpus.current().rows == 0, self.live.current().values.get("builds_left", 0))

    def run(
        self, cycle: int, enumerate_: Callable[[], tuple[DataFrame, bool]], probe: Callable[[DataFrame], DataFrame], budget: int | None = None
    ) -> Turn:
        """One cycle. enumerate_: gives the corpus rows found (CORPUS) and whether the scan was cut short; it is asked only when due.
        probe: gives a verdict (id, live) for each id of a batch (id, kind, seq); null for none. budget: ids per cycle, all if not given."""
        state = self.live.current()
        if state.step >= cycle:
            return self._told(cycle)
        due = self.due() or self.corpus.current().step >= cycle
        left = state.values.get("builds_left", 0)
        if due:
            if self.corpus.current().step < cycle:
                found, truncated = enumerate_()
                self.corpus.upsert(cycle, found, ["seq"], {"truncated": int(truncated)})
            left = builds_after_enumeration(bool(self.corpus.current().values["truncated"]), self.every)
        values = {"builds_left": left - 1, "enumerated": int(due), "probed": 0, "cursor": state.values.get("cursor", 0)}
        if self.corpus.current().rows == 0:
            self.live.commit(cycle, None, (), values)
            return self._told(cycle)
        ids, live = self.corpus.read().select("id"), self.live.read()
        batch, values["cursor"], values["probed"] = probe_batch(ids, live, values["cursor"], budget, state.rows)
        told = probe(batch).select("id", F.lit(0).alias("seq"), "live")
        # a batch reaches into every bucket: ids are dealt by their hash
        self.live.commit(cycle, update_live(live, told), range(self.live.buckets), values)
        return self._told(cycle)

    def _told(self, cycle: int) -> Turn:
        state = self.live.current()
        v = state.values
        return Turn(cycle, v["probed"], v["cursor"], v["builds_left"], state.rows, bool(v["enumerated"]))
