"""Operator 6: conversations from logs that hold the same conversation again at every turn, with DataFrame functions alone.

A log writes a conversation again whenever a turn is added. Every turn is hashed with its place, and the exclusive or of a conversation's turn hashes up to
a place names that prefix. A conversation whose whole hash is a strict prefix of a longer one is dropped by an anti-join; of equal ones the smallest
id stays. What is left is rendered. Running hashes are taken inside blocks of turns and carried over by one row per block, so no conversation,
however long, is ordered in one task.

Defined results: turns are ordered by turn (null first), role and text; rows that repeat a whole turn count once; nothing tells which rows without a conv_id belong
together, so each is a conversation of its own with one turn and a null id, kept once unless a conversation with an id begins with that turn; a null role is rendered as "unknown" and a null text as empty, though both differ from these when turns are compared; other columns are
ignored; an empty table gives no rows. A rendered conversation is one value of a row, so it has to fit into Spark's 2 GB for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .frames import materialise

TURNS_PER_BLOCK = 256


def _sealed(seed: int, *columns: Column) -> Column:
    """64-bit hash that tells null from empty."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (c.isNull(), F.coalesce(c, F.lit("")))])


def _turn_hashes() -> list[Column]:
    """Two hashes of a turn and its place `pos`."""
    place = F.col("pos").cast("string")
    return [_sealed(1, place, F.col("role"), F.col("text")).alias("h1"), _sealed(2, F.col("text"), place, F.col("role")).alias("h2")]


def _placed(turns: DataFrame) -> DataFrame:
    """Distinct turns of conversations with an id, with their place in the conversation and the running hashes `p1`, `p2` up to them; whole hashes in `w1`, `w2`, length in `n_turns`."""
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", "role", "text").distinct()
    rows = rows.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / TURNS_PER_BLOCK))
    inside = W.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    before = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = rows.withColumn("inner", F.row_number().over(inside)).join(sizes, ["conv", "block"])
    rows = rows.withColumn("pos", F.col("base") + F.col("inner")).drop("base", "inner")
    rows = rows.select("*", *_turn_hashes())
    upto = W.partitionBy("conv", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = rows.groupBy("conv", "block").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"), F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy("conv")
    carried = totals.select(
        "conv", "block",
        *[F.coalesce(F.bit_xor(f"t{k}").over(before), F.lit(0)).alias(f"c{k}") for k in (1, 2)],
        *[F.bit_xor(f"t{k}").over(whole).alias(f"w{k}") for k in (1, 2)],
        F.sum("n").over(whole).alias("n_turns"),
    )
    rows = rows.withColumn("x1", F.bit_xor("h1").over(upto)).withColumn("x2", F.bit_xor("h2").over(upto)).join(carried, ["conv", "block"])
    return rows.select(
        "conv", "pos", "role", "text", "n_turns", "w1", "w2", F.col("x1").bitwiseXOR(F.col("c1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("c2")).alias("p2")
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of conversations that aren't a prefix of a longer one, the smallest id of equal ones."""
    rows = materialise(_placed(turns), "turns")
    logged = rows.where("pos = n_turns").groupBy("n_turns", "w1", "w2").agg(F.min("conv").alias("conv"))
    prefixes = rows.where("pos < n_turns").select(F.col("pos").alias("n_turns"), F.col("p1").alias("w1"), F.col("p2").alias("w2")).distinct()
    kept = logged.join(prefixes, ["n_turns", "w1", "w2"], "left_anti").select("conv")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>"))
    lines = rows.join(kept, "conv", "left_semi").groupBy("conv", "n_turns").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    rendered = lines.select(
        F.col("conv").alias("conv_id"), "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("rendered")
    )
    # rows without an id meet only their equals, and those are counted once before the shuffle
    single = turns.where("conv_id is null").select("role", "text").distinct().withColumn("pos", F.lit(1).cast("long")).select("*", *_turn_hashes())
    first = rows.where("pos = 1").select(F.col("p1").alias("h1"), F.col("p2").alias("h2")).distinct()
    single = single.join(first, ["h1", "h2"], "left_anti")
    return rendered.unionByName(single.select(F.lit(None).cast("long").alias("conv_id"), F.col("pos").alias("n_turns"), line.alias("rendered")))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
             count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
p AS (SELECT *, string_agg(md5(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n')), ',') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM o),
w AS (SELECT n_turns, prefix, min(conv_id) AS conv_id FROM p WHERE pos = n_turns GROUP BY ALL),
k AS (SELECT conv_id FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n_turns AND p.prefix = w.prefix))
SELECT conv_id, n_turns,
       string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>', chr(10) ORDER BY pos) AS rendered
FROM o JOIN k USING (conv_id) GROUP BY conv_id, n_turns
UNION ALL
SELECT NULL, 1, '<|' || coalesce(s.role, 'unknown') || '|>' || chr(10) || coalesce(s.text, '') || chr(10) || '<|end|>'
FROM (SELECT DISTINCT role, text FROM conversations WHERE conv_id IS NULL) s
WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.pos = 1 AND o.role IS NOT DISTINCT FROM s.role AND o.text IS NOT DISTINCT FROM s.text)
"""
