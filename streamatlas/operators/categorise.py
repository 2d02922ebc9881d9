"""Categories: the map, the title rules, exclusion and the coverage reports; and the projection to catalogue entries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed import catalogue as fc
from ..fixed import taxonomy as ft
from ..functions import urls
from ..functions.regex import let, rx
from .keyed import lookup_by_key


def map_category(raw: Column) -> Column:
    """Published category of a source's raw one: none -> Other, known -> its target, native -> itself, else unmapped."""
    table = {**{n: n for n in ft.PASS_THROUGH}, **ft.CATEGORY_MAP}
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(ft.OTHER))
        .otherwise(F.coalesce(F.try_element_at(F.create_map(*pairs), raw), F.lit(ft.UNMAPPED)))
    )


def category_from_title(title: Column) -> Column:
    """Category of a title by the ordered rules, or by a place hint, or null."""

    def pick(head: Column) -> Column:
        out = F.when(title.rlike(rx(ft.GEO_HINT)), F.lit(ft.GEO_CATEGORY))
        for category, pattern in reversed(ft.TITLE_RULES):
            out = F.when(head.rlike(rx(pattern, ignore_case=True)), F.lit(category)).otherwise(out)
        return out

    return let(F.substring_index(title, " — ", 1), pick)


def final_category(raw: Column, title: Column) -> Column:
    return let(
        map_category(raw),
        lambda mapped: F.when(mapped == ft.OTHER, F.coalesce(category_from_title(title), F.lit(ft.OTHER))).otherwise(mapped),
    )


def to_entries(candidates: DataFrame) -> DataFrame:
    """Catalogue entries of merged candidates."""
    return candidates.select(
        "ord",
        urls.stable_id(F.col("source"), F.col("source_page_url"), F.col("angle_key")).alias("id"),
        F.when(F.col("title") == "", F.lit(fc.UNTITLED)).otherwise(F.col("title")).alias("title"),
        final_category(F.col("category"), F.col("title")).alias("category"),
        "source",
        "source_page_url",
        "target_url",
    )


def exclude_categories(entries: DataFrame, names: Iterable[str]) -> DataFrame:
    """Entries outside the named categories, whatever the case of the names."""
    folded = sorted({n.strip().casefold() for n in names if n.strip()})
    return entries.where(~F.lower("category").isin(folded)) if folded else entries


def unknown_categories(names: DataFrame, col: str = "name") -> DataFrame:
    """Names that are no category of the taxonomy, i.e. likely typing errors."""
    return names.where(~F.lower(col).isin([c.lower() for c in ft.TAXONOMY]))


def unmapped_report(rows: DataFrame, col: str = "category") -> DataFrame:
    """Raw categories that the map does not know, with how many rows carry them."""
    known = [*ft.CATEGORY_MAP, *ft.PASS_THROUGH]
    raw = F.col(col)
    return (
        rows.where(raw.isNotNull() & (raw != "") & ~raw.isin(known))
        .groupBy(raw.alias("raw"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fill_video_category(candidates: DataFrame, live: DataFrame) -> DataFrame:
    """Category of video-platform rows from the live table (video_id, category_name); other sources keep their own."""
    named = live.where(F.col("category_name") != "").select(
        F.concat(F.lit("yt:"), F.col("video_id")).alias("predisc_key"), F.col("category_name").alias("_cat")
    )
    fill = (F.col("source") == fc.OFFICIAL_TITLE_SOURCE) & F.col("_cat").isNotNull()
    return (
        lookup_by_key(candidates, named, "predisc_key", F.col("ord"), ["_cat"])
        .withColumn("category", F.when(fill, F.col("_cat")).otherwise(F.col("category")))
        .drop("_cat")
    )
