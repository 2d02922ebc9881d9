"""Planning of enumeration and probes over a large corpus: the grid, the page plan, the rotating probe batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..fixed import catalogue as fc
from .keyed import last_by, materialise
from .scan import running


def with_position(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with their dense position (0, 1, 2, ...) in a total order, without a global window."""
    return with_position_and_count(df, order)[0]


def with_position_and_count(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """The same, and the number of rows.

    The rows are range-partitioned and sorted once and written; the only thing that is put in sequence is the row count of each
    partition, which the driver adds up.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id()
    rows = rows.withColumn("_p", F.spark_partition_id()).withColumn("_i", inside.bitwiseAND(F.lit((1 << 33) - 1)))
    rows = materialise(rows, "positions")
    counts = sorted((r["_p"], r["n"]) for r in rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
    starts, total = [], 0
    for p, n in counts:
        starts += [total] * (p + 1 - len(starts))  # partitions without rows come up with the next one that has some
        total += n
    if not counts:
        return rows.select(*df.columns, F.lit(0).cast("long").alias("position")), 0
    first = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("_p"))
    return rows.withColumn("position", first + F.col("_i")).drop("_p", "_i"), total


def grid(spark: SparkSession) -> DataFrame:
    """(ord, lat, lon): circle centres in scan order; rows of latitude, the longitude step widened towards the poles."""
    rows = int((fc.GRID_LAT_MAX - fc.GRID_LAT_MIN) / fc.GRID_STEP) + 1
    lat = fc.GRID_LAT_MIN + F.col("id") * fc.GRID_STEP
    step = fc.GRID_STEP / F.greatest(F.lit(0.2), F.cos(F.radians(lat)))
    df = spark.range(rows).select(F.col("id").alias("row"), lat.alias("_lat"), step.alias("_step"))
    points = F.sequence(F.lit(0), (F.ceil(360.0 / F.col("_step")) - 1).cast("int"))
    df = df.select("row", "_lat", "_step", F.explode(points).alias("col"))
    return df.select(
        (F.col("row") * 1000 + F.col("col")).alias("ord"),
        F.bround("_lat", 2).alias("lat"),
        F.bround(F.lit(-180.0) + F.col("col") * F.col("_step"), 2).alias("lon"),
    )


def page_plan(circles: DataFrame, ceiling: int | None = None, circle_cap: int | None = None) -> DataFrame:
    """(ord, offset, truncated): further list pages of every circle (ord, total), in scan order. A ceiling bounds the requests of all circles, first
    pages included; a circle cap the rows that are listed of one. Without them every page is planned.

    Requests are counted per circle first, so the running total only sees one row per grid point, and it runs by ranges of them.
    """
    listed = F.coalesce("total", F.lit(0))
    listed = listed if circle_cap is None else F.least(listed, F.lit(circle_cap))
    sized = circles.select("ord", F.greatest(F.lit(0), F.ceil(listed / fc.PAGE_SIZE) - 1).cast("long").alias("pages"))
    if ceiling is None:
        sized = sized.withColumn("_allowed", F.col("pages").cast("int"))
    else:
        sized = running(sized, ["ord"], {"_before": ("sum", "pages")})
        left = F.lit(ceiling - circles.count()) - F.col("_before")
        sized = sized.withColumn("_allowed", F.greatest(F.lit(0), F.least("pages", left)).cast("int"))
    plan = sized.where(F.col("_allowed") > 0).select(
        "ord", F.explode(F.sequence(F.lit(1), F.col("_allowed"))).alias("page"), (F.col("_allowed") < F.col("pages")).alias("truncated")
    )
    return plan.select("ord", (F.col("page") * fc.PAGE_SIZE).cast("long").alias("offset"), "truncated")


def remember(corpus: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """Upsert: rows of `found` (with `seq`) replace those of the corpus, the last one wins."""
    cols = [c for c in corpus.columns if c != key]
    both = corpus.withColumn("seq", F.lit(-1).cast("long")).unionByName(found.select(*corpus.columns, F.col("seq").cast("long")))
    return last_by(both, [key], ["seq"], cols)


def update_live(live: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Live ids after a probe: a live verdict adds, a dead one removes, no verdict (null) keeps. verdicts: (id, seq, live)."""
    told = last_by(verdicts.where(F.col("live").isNotNull()), ["id"], ["seq"], ["live"])
    return (
        live.select("id", F.lit(True).alias("_was"))
        .join(told, "id", "full")
        .where(F.coalesce("live", "_was"))
        .select("id")
    )


def live_page(body, has_frame):
    """unknown (not fetched), dead (a stub or no frame) or live."""
    return F.when(body.isNull(), "unknown").when((F.length(body) < fc.MIN_STREAM_PAGE) | ~has_frame, "dead").otherwise("live")


def probe_batch(corpus: DataFrame, live: DataFrame, cursor: int, budget: int | None = None, n_live: int | None = None) -> tuple[DataFrame, int, int]:
    """The ids to probe (id, kind, seq), the next cursor, and how many they are: all live ids, then a slice of the others that starts at the cursor
    and wraps around. Without a budget the slice is all of them. Both tables have one row per id. n_live: the size of the live set, where it is known."""
    rest, n_rest = with_position_and_count(corpus.select("id").join(live.select("id"), "id", "left_anti"), ["id"])
    n_live = live.count() if n_live is None else n_live
    size = n_rest if budget is None else min(n_rest, max(0, budget - n_live))
    start = cursor % n_rest if n_rest else 0
    batch = live.select("id", F.lit("live").alias("kind"), F.lit(None).cast("long").alias("seq"))
    if size:
        turn = F.pmod(F.col("position") - start, F.lit(n_rest))
        batch = batch.unionByName(
            rest.withColumn("seq", turn).where(F.col("seq") < size).select("id", F.lit("rotation").alias("kind"), "seq")
        )
    return batch, ((start + size) % n_rest if n_rest else 0), n_live + size


def enumeration_due(corpus_is_empty: bool, builds_left: int) -> bool:
    return corpus_is_empty or builds_left <= 0


def builds_after_enumeration(truncated: bool, every: int = fc.ENUM_EVERY) -> int:
    return 0 if truncated else every


def search_windows(hits: DataFrame, max_ids: int | None = None) -> DataFrame:
    """Distinct ids of a backwards search: hits (window_no, pos, video_id, ...) in the order the windows were read.

    A window counts while no earlier window brought nothing new and, with a limit, fewer than `max_ids` ids were seen before it. Each id is given to its
    first window first, so the running totals see one row per window; they run by ranges of windows, of which there may be any number.
    """
    rest = [c for c in hits.columns if c not in ("video_id", "window_no", "pos")]
    row = F.struct("window_no", "pos", *rest)
    firsts = hits.groupBy("video_id").agg(F.min(row).alias("_r")).select("video_id", "_r.*")
    fresh = firsts.groupBy("window_no").agg(F.count(F.lit(1)).alias("_new"))
    windows = hits.select("window_no").distinct().join(fresh, "window_no", "left").fillna(0, ["_new"])
    seen = running(windows, ["window_no"], {"seen_before": ("sum", "_new"), "_least": ("min", "_new")})
    ok = F.coalesce(F.col("_least"), F.lit(1)) > 0
    if max_ids is not None:
        ok = ok & (F.col("seen_before") < max_ids)
    return firsts.join(seen.where(ok).select("window_no", "seen_before"), "window_no")


def contiguous_pages(pages_with_links: DataFrame, col: str = "page_no", last: int | None = None) -> DataFrame:
    """Page numbers 1, 2, ... up to the first one that is missing, or up to `last`: a number counts if as many numbers lie below it as it says."""
    numbers = pages_with_links.where(F.col(col) >= 1).select(col).distinct()
    found = with_position(numbers, [col]).where(F.col("position") + 1 == F.col(col)).select(col)
    return found if last is None else found.where(F.col(col) <= last)
