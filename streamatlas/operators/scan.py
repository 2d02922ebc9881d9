"""Running values over a total order, without a window that one task or one key would have to hold.

Rows are dealt by ranges of their order, as evenly as their number allows: a key with most of the rows is cut like any other. Each range runs its own
window; what it takes over from the ranges before it is one row per range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .keyed import materialise

_FOLDS = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def _joined(kind: str, earlier: Column, own: Column) -> Column:
    if kind == "sum":
        return F.coalesce(earlier, F.lit(0)) + F.coalesce(own, F.lit(0))
    if kind == "last":
        return F.coalesce(own, earlier)
    return F.least(earlier, own) if kind == "min" else F.greatest(earlier, own)


def running(df: DataFrame, order: Sequence[str], values: Mapping[str, tuple[str, str]], inclusive: bool = False) -> DataFrame:
    """Rows with one more column per entry of `values` (name: (fold, column)): the fold over all rows before the row in `order`, itself included if asked for.
    Folds are sum (0 where there is nothing), min, max and last (the last value that isn't null). `order` must be total."""
    rows = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order)))
    whole = rows.groupBy("_range").agg(*[(last(c) if kind == "last" else _FOLDS[kind](c)).alias(f"_{name}") for name, (kind, c) in values.items()])
    # one row per range
    over = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = whole.select("_range", *[_FOLDS[kind](F.col(f"_{name}")).over(over).alias(f"_{name}") for name, (kind, _) in values.items()])
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    out = rows.join(F.broadcast(carried), "_range")
    folded = [_joined(kind, F.col(f"_{name}"), _FOLDS[kind](F.col(c)).over(inside)).alias(name) for name, (kind, c) in values.items()]
    return out.select(*df.columns, *folded)
