"""Keyed building blocks that hold up when one key owns a large share of the rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import ensure_checkpoint_dir

# A key is hot when it owns more than 1/HOT_SHARE of the rows. Fewer than HOT_SHARE keys can be hot, whatever the data,
# which is the size bound of the one broadcast below.
HOT_SHARE = 1000
HOT_MIN_ROWS = 200_000
SALTS = 64


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], keep: Sequence[str]) -> DataFrame:
    """Distinct on `keys`, first row in `order` wins. A partial aggregate reduces every task's rows before the shuffle."""
    order_cols = [o if isinstance(o, Column) else F.col(o) for o in order]
    row = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order_cols)], *[F.col(c) for c in keep])
    out = df.groupBy(*keys).agg(F.min(row).alias("_row"))
    return out.select(*keys, *[F.col("_row")[c].alias(c) for c in keep])


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], keep: Sequence[str]) -> DataFrame:
    """Distinct on `keys`, last row in `order` wins."""
    order_cols = [o if isinstance(o, Column) else F.col(o) for o in order]
    row = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order_cols)], *[F.col(c) for c in keep])
    out = df.groupBy(*keys).agg(F.max(row).alias("_row"))
    return out.select(*keys, *[F.col("_row")[c].alias(c) for c in keep])


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once into the checkpoint folder and read it back: it is computed once, its size is known to the planner,
    and a lost executor costs a re-read instead of a re-computation."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach_by_key(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], n_col: str, salt_on: Column, how: str = "inner"
) -> DataFrame:
    """Join rows with one-row-per-key facts, splitting hot keys.

    `per_key` holds the row count of each key in `n_col`; it is written once, so its size is known: the planner broadcasts it
    only below its own size threshold, and otherwise both sides are shuffled. Where a hot key exists, its rows are spread over
    SALTS partitions and only the facts of hot keys are repeated per salt, so no task gets more than a part of that key.
    """
    keys = list(keys)
    facts = materialise(per_key, "facts")
    sizes = facts.agg(F.max(n_col).alias("top"), F.sum(n_col).alias("total")).first()
    floor = max(HOT_MIN_ROWS, (sizes["total"] or 0) // HOT_SHARE + 1)
    if (sizes["top"] or 0) < floor:
        return rows.join(facts, keys, how)
    is_hot = F.col(n_col) >= floor
    hot = facts.where(is_hot).select(*keys, F.lit(True).alias("_hot"))
    salted_rows = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(salt_on), F.lit(SALTS)).cast("int")).otherwise(0))
        .drop("_hot")
    )
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted_rows.join(facts.withColumn("_salt", F.explode(salts)), [*keys, "_salt"], how).drop("_salt")


def lookup_by_key(
    rows: DataFrame, table: DataFrame, key: str, salt_on: Column, keep_columns: Sequence[str], how: str = "left"
) -> DataFrame:
    """Left join with a table that has one row per key, safe against keys that own many rows: the keys of the rows are counted
    first (map-side combined), the table is joined to those counts, and the result is attached to the rows."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    facts = counts.join(table.select(key, *keep_columns), key, "inner")
    return attach_by_key(rows, facts, [key], "_n", salt_on, how).drop("_n")


def top_counts(counts: DataFrame, group: Sequence[str], label: str, n_col: str, k: int, out: str) -> DataFrame:
    """Per group the k biggest counts as text "3x a, 2x b": count descending, then label ascending.

    The text only ever holds k items per group; the rank filter is applied inside the window operator (a group limit runs
    before the shuffle), so a group with many labels never gathers in one place.
    """
    group = list(group)
    order = [F.col(n_col).desc(), F.col(label).asc()]
    ranked = counts.withColumn("_rk", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_rk") <= k)
    item = F.struct("_rk", F.concat(F.col(n_col).cast("string"), F.lit("x "), F.col(label)).alias("t"))
    texts = F.transform(F.array_sort(F.collect_list(item)), lambda s: s["t"])
    return ranked.groupBy(*group).agg(F.array_join(texts, ", ").alias(out))
