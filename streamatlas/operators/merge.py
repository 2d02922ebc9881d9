"""Merge of candidate rows that carry the same merge key, over all sources.

The merge is defined as a fold in row order: the higher-ranked source keeps the row, a category is taken from whichever side
has one, and the title is the official one or the longest. That fold is not associative, so a plain "best row per key" is
wrong. Its outcome is nevertheless fixed by a handful of row positions per key, because the rank of the running row only
grows and each of its changes happens at a first occurrence. So the merge runs as two hash aggregations and one join, and no
key is ever collected:

1. per key, the positions: first row per source rank, first row with a category (also per rank), last official title;
2. those positions are attached to the rows, and a second aggregation picks the winning row, category and title by position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed import catalogue as fc
from .keyed import attach_by_key

_RANKS = (-1, 0, 1, 2)
# Set in `ord` of rows without a key: they follow all keyed rows and keep their order.
TAIL_BIT = 1 << 61

CANDIDATE_COLUMNS = (
    "ord", "title", "angle_key", "category", "source", "source_page_url", "target_url", "predisc_key",
)


def source_rank(source: Column) -> Column:
    out = F.lit(-1)
    for name, rank in fc.MERGE_RANK.items():
        out = F.when(source == name, F.lit(rank)).otherwise(out)
    return out


def _tag(rank: int) -> str:
    return "m" if rank < 0 else str(rank)


def merge_positions(keyed: DataFrame) -> DataFrame:
    """One row per key with the positions that decide the merge. Only numeric buffers: hash aggregation, map-side combined."""
    rank, has_cat = F.col("_rank"), F.col("category") != ""
    official = (F.col("source") == fc.OFFICIAL_TITLE_SOURCE) & (F.col("title") != "")
    aggs = [F.count(F.lit(1)).alias("_n"), F.min("ord").alias("_first"), F.max(F.when(official, F.col("ord"))).alias("_lasty")]
    for r in _RANKS:
        aggs.append(F.min(F.when(rank == r, F.col("ord"))).alias(f"_f{_tag(r)}"))
        aggs.append(F.min(F.when((rank == r) & has_cat, F.col("ord"))).alias(f"_c{_tag(r)}"))
    pos = keyed.groupBy("predisc_key").agg(*aggs)
    f = {r: F.col(f"_f{_tag(r)}") for r in _RANKS}
    c = {r: F.col(f"_c{_tag(r)}") for r in _RANKS}
    end = F.lit(2**63 - 1)
    # Highest rank present: its first row wins, unless the first category of the whole key arrives later in a row of that rank.
    lead = F.coalesce(f[2], f[1], f[0], f[-1])
    lead_cat = F.when(f[2].isNotNull(), c[2]).when(f[1].isNotNull(), c[1]).when(f[0].isNotNull(), c[0]).otherwise(c[-1])
    first_cat = F.least(*[c[r] for r in _RANKS])
    winner = F.when((first_cat > lead) & (lead_cat == first_cat), first_cat).otherwise(lead)
    # The category comes from the first row that has one, or from a later row that raised the rank and has one.
    raised = []
    for r in _RANKS[1:]:
        higher = [F.coalesce(f[w], end) for w in _RANKS if w > r]
        is_raise = reduce(lambda a, b: a & b, [f[r] < h for h in higher], F.lit(True))
        raised.append(F.when(is_raise & (c[r] == f[r]), f[r]))
    cat_pos = F.greatest(first_cat, *raised) if raised else first_cat
    # Title phases: before any ranked source, while the official source leads, after a higher source took over.
    p = F.least(f[1], f[2])
    q = F.when(f[0] < F.coalesce(p, end), f[0])
    y = F.when(F.col("_lasty") > p, F.col("_lasty"))
    return pos.select(
        "predisc_key", "_n", "_first", winner.alias("_win"), cat_pos.alias("_cat"), p.alias("_p"), q.alias("_q"), y.alias("_y")
    )


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """Merged candidates. `ord` of a keyed row is its first-seen position; rows without a key come after all of them."""
    has_key = F.col("predisc_key") != ""
    keyed = candidates.where(has_key).withColumn("_rank", source_rank(F.col("source")))
    unkeyed = candidates.where(~F.coalesce(has_key, F.lit(False)))
    rows = attach_by_key(keyed.drop("_rank"), merge_positions(keyed), ["predisc_key"], "_n", F.col("ord"))
    o, p, q, y = F.col("ord"), F.col("_p"), F.col("_q"), F.col("_y")
    end = F.lit(2**63 - 1)
    lead_in = F.least(F.coalesce(p, end), F.coalesce(q, end))
    longest = F.struct(F.length("title"), -o)

    def best(cond: Column) -> Column:
        return F.max(F.when(cond, F.struct(longest.alias("k"), F.col("title").alias("t"))))["t"]

    def at(pos: Column, col: str) -> Column:
        return F.max(F.when(o == pos, F.col(col)))

    row = F.struct("source", "source_page_url", "target_url", "angle_key")
    picked = rows.groupBy("predisc_key").agg(
        F.min("_first").alias("ord"),
        F.max(F.when(o == F.col("_win"), row)).alias("_row"),
        at(F.col("_cat"), "category").alias("category"),
        best(o < lead_in).alias("_lead_in"),
        at(q, "title").alias("_at_q"),
        F.min(F.when((o > q) & (o < F.coalesce(p, end)) & (F.col("title") != ""), F.struct("ord", "title")))["title"].alias("_mid"),
        at(p, "title").alias("_at_p"),
        best(o > p).alias("_after_p"),
        best(o >= y).alias("_from_y"),
        F.min("_p").alias("_p"),
        F.min("_q").alias("_q"),
        F.min("_y").alias("_y"),
    )

    def longer(a: Column, b: Column) -> Column:
        return F.when(F.length(b) > F.length(a), b).otherwise(a)

    # Step by step, so that no step repeats the expression of the one before.
    none = F.lit("")
    has_q = F.col("_q").isNotNull()
    official = F.coalesce(F.nullif("_at_q", none), F.nullif("_lead_in", none), F.col("_mid"), none)
    picked = picked.withColumn("_lead_in", F.coalesce("_lead_in", none)).withColumn(
        "_before", F.when(has_q, official).otherwise(F.col("_lead_in"))
    )
    picked = picked.withColumn(
        "_upto_p", F.when(has_q & (F.col("_before") != ""), F.col("_before")).otherwise(longer(F.col("_before"), F.col("_at_p")))
    )
    title = (
        F.when(F.col("_p").isNull(), F.col("_before"))
        .when(F.col("_y").isNotNull(), F.col("_from_y"))
        .otherwise(longer(F.col("_upto_p"), F.coalesce(F.col("_after_p"), none)))
    )
    merged = picked.select(
        "ord",
        title.alias("title"),
        F.col("_row")["angle_key"].alias("angle_key"),
        F.col("category"),
        F.col("_row")["source"].alias("source"),
        F.col("_row")["source_page_url"].alias("source_page_url"),
        F.col("_row")["target_url"].alias("target_url"),
        "predisc_key",
    )
    tail = unkeyed.select(*CANDIDATE_COLUMNS).withColumn("ord", F.col("ord").bitwiseOR(F.lit(TAIL_BIT)))
    return merged.unionByName(tail)
