"""Operator 11: how five filters interact, audited over every order in which they could run.

A document only matters through the set of filters that it fails, a mask of five bits. Counts per part and mask (32 cells) are all that is needed: a
Gray-code walk visits the 32 sets of active filters, toggling one filter at a time; every cell keeps the number of its failures that are active, and the
survivors change by those cells whose number leaves or reaches zero. The 32 states are stored; a step of an order is the difference of two of them.

Defined results: a null text is empty; a null part is the empty string; each row of a repeated document counts; a null doc_id has no label and is never a copy
(rows that share the smallest id of a text aren't copies of each other either); a document with several labels has quality or toxic 1 if one of them says so;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.keyed import attach_by_key
from .frames import materialise

FILTERS = "ABCDE"
STATES = 1 << len(FILTERS)
WEIGHTS = ("n", "good", "toxic")
COPY = 1 << FILTERS.index("E")
_WORD = r"[^\x20\x09-\x0D]+"


def own_failures(text: Column) -> Column:
    """The mask of the filters that a text fails by itself (A to D)."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < 50, 100 * distinct < 65 * n, 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]"))
    total = F.lit(0)
    for k, failed in enumerate(fails):
        total = total + F.when(failed, F.lit(1 << k)).otherwise(F.lit(0))
    return total


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask), one row per document, written once. Texts are read in one pass and travel as digests; of those only the ones that occur
    twice are joined back, with hot texts spread."""
    text = F.coalesce(F.col("text"), F.lit(""))
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    measured = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), own_failures(text).alias("mask"), digest.alias("digest")), "audit-measured")
    texts = measured.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    known = attach_by_key(measured, texts, ["digest"], "copies", F.monotonically_increasing_id(), "left")
    mask = F.col("mask") + F.when(F.col("doc_id") > F.col("first"), F.lit(COPY)).otherwise(F.lit(0))
    return materialise(known.select("doc_id", "part", mask.alias("mask")), "audit-masks")


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, at most 32 rows per part."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    one = lambda c: F.max(F.when(F.col(c) == 1, F.lit(1)).otherwise(F.lit(0)))
    marks = known.where("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic")).where("good + toxic > 0")
    everything = masks.select("part", "mask", F.lit(1).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    labelled = masks.join(marks, "doc_id").select("part", "mask", F.lit(0).alias("n"), "good", "toxic")
    return everything.unionByName(labelled).groupBy("part", "mask").agg(*[F.sum(w).alias(w) for w in WEIGHTS])


def gray_walk(counts: np.ndarray) -> np.ndarray:
    """Survivors of every set of active filters. counts: (..., 32 cells); the result has the 32 sets in place of the cells."""
    survivors = np.zeros_like(counts)
    running = counts.sum(axis=-1)
    survivors[..., 0] = running
    cell = np.arange(STATES)
    active = np.zeros(STATES, np.int64)  # per cell: how many of its failures are active
    state = 0
    for step in range(1, STATES):
        toggled = (step & -step).bit_length() - 1
        state ^= 1 << toggled
        own = (cell >> toggled & 1).astype(bool)
        if state >> toggled & 1:
            running = running - counts[..., own & (active == 0)].sum(axis=-1)
            active[own] += 1
        else:
            active[own] -= 1
            running = running + counts[..., own & (active == 0)].sum(axis=-1)
        survivors[..., state] = running
    return survivors


def shapley_values(survivors: np.ndarray) -> np.ndarray:
    """Per filter, documents removed by it summed over all orders, from the survivors of the 32 sets."""
    k = len(FILTERS)
    out = np.zeros((*survivors.shape[:-1], k), np.int64)
    for f in range(k):
        for state in range(STATES):
            if not state >> f & 1:
                before = state.bit_count()
                out[..., f] += factorial(before) * factorial(k - 1 - before) * (survivors[..., state] - survivors[..., state | 1 << f])
    return out


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            counts = np.zeros((len(frame), len(WEIGHTS), STATES), np.int64)
            for row, own in enumerate(frame["own"]):
                for c in own:
                    counts[row, :, c["mask"]] = [c[w] for w in WEIGHTS]
            states = gray_walk(counts)
            out = {"part": frame["part"]} | {w: list(states[:, k]) for k, w in enumerate(WEIGHTS)} | {"shapley": list(shapley_values(states[:, 0]))}
            yield pd.DataFrame(out)


def states(found: DataFrame) -> DataFrame:
    """(part, n, good, toxic, shapley): per part the survivors of the 32 sets of active filters, and the filters' Shapley sums. Parts are walked
    side by side in batches; a part is one row of at most 32 cells."""
    own = found.groupBy("part").agg(F.collect_list(F.struct("mask", *WEIGHTS)).alias("own"))
    return own.mapInPandas(_walk, "part string, n array<long>, good array<long>, toxic array<long>, shapley array<long>")


def steps(walked: DataFrame) -> DataFrame:
    """One row per part, order and step, as differences of stored states. The 600 steps are constants."""
    plan = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            plan.append(("".join(FILTERS[x] for x in order), step + 1, f, before))
            before |= 1 << f
    names = ("filter_order", "step", "filter", "before")
    listed = F.arrays_zip(*[F.array(*[F.lit(row[k]) for row in plan]).alias(name) for k, name in enumerate(names)])
    rows = walked.select("*", F.explode(listed).alias("s")).select("part", *WEIGHTS, "shapley", *[F.col(f"s.{name}").alias(name) for name in names])
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    at = lambda states, set_: F.element_at(F.col(states), (set_ + 1).cast("int"))
    after = F.col("before").bitwiseOR(bit)
    everything = F.lit(STATES - 1)
    lost = lambda w: at(w, F.col("before")) - at(w, after)
    return rows.select(
        "part", "filter_order", "step", at("n", after).alias("kept"), lost("n").alias("removed"),
        (at("n", F.lit(0)) - at("n", bit) - lost("n")).alias("redundant"), (at("n", everything - bit) - at("n", everything)).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.element_at("shapley", F.col("filter") + 1).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of all documents: part, filter_order, step and the counts of that step."""
    return steps(states(cells(failure_masks(docs), labels)))


# The same rows, by sending the cells of every part through every order.
ORACLE = r"""
WITH doc AS (
  SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM doc
), failed AS (
  SELECT doc_id, part,
    (CASE WHEN len(words) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END) ||
    (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END) ||
    (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS fails
  FROM worded
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), cell AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM failed LEFT JOIN marks USING (doc_id) GROUP BY ALL
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), sent AS (
  SELECT part, filter_order, fails, n, good, toxic,
    coalesce(list_min(list_transform(string_split(fails, ''), lambda f: CASE WHEN f = '' THEN 6 ELSE instr(filter_order, f) END)), 6) AS out_at
  FROM cell, orders
), step AS (SELECT unnest([1, 2, 3, 4, 5]) AS step
), counted AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f,
    sum(CASE WHEN out_at > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN out_at = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN out_at < step AND contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN out_at = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN out_at = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM sent, step GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
