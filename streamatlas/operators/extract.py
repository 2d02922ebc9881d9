"""Extraction: documents in, links, metadata and stream candidates out.

Everything that needs a document body is one projection over the documents; only the short rows cut out of them are ever
shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed import embeds as fe
from ..functions import urls
from ..functions.regex import find_all, first, first_once, sub
from .keyed import first_by

_PAIR = "array<struct<angle:string,raw:string>>"


def usable(pages: DataFrame) -> DataFrame:
    """Documents that were fetched and are not empty."""
    return pages.where(F.col("body").isNotNull() & (F.col("body") != ""))


def documents(pages: DataFrame, *page_urls: str) -> DataFrame:
    return usable(pages).where(F.col("url").isin(*page_urls))


def matches(docs: DataFrame, body: Column, pattern: str, group: int = 1, name: str = "m", keep: Sequence[str] = (), **flags) -> DataFrame:
    """One row per match: the kept columns, `part` and `pos` of the match in its document, and the group."""
    return docs.select(*keep, "part", F.posexplode(find_all(body, pattern, group, **flags)).alias("pos", name))


def matches2(docs: DataFrame, body: Column, pattern: str, names: tuple[str, str], keep: Sequence[str] = (), **flags) -> DataFrame:
    """One row per match with its first two groups."""
    pairs = F.arrays_zip(find_all(body, pattern, 1, **flags).alias("a"), find_all(body, pattern, 2, **flags).alias("b"))
    df = docs.select(*keep, "part", F.posexplode(pairs).alias("pos", "_m"))
    return df.select(*keep, "part", "pos", F.col("_m")["a"].alias(names[0]), F.col("_m")["b"].alias(names[1]))


def section(body: Column, start: str, end: str) -> Column:
    """Text between two markers: null without the start marker, up to the end of the document without the end marker."""
    at = F.locate(start, body)
    rest = F.substr(body, at + len(start))
    stop = F.locate(end, rest)
    return F.when(at > 0, F.when(stop > 0, F.substr(rest, F.lit(1), stop - 1)).otherwise(rest))


def before(body: Column, marker: str) -> Column:
    """Text before a marker; the whole text when it does not occur."""
    return F.substring_index(body, marker, 1)


def from_marker(body: Column, marker: str, opening: str) -> Column:
    """Text from the first opening bracket after a marker on, or null. JSON readers ignore what follows the value."""
    at = F.locate(marker, body)
    rest = F.substr(body, at)
    stop = F.locate(opening, rest)
    return F.when((at > 0) & (stop > 0), F.substr(rest, stop))


def strip_attribution(body: Column) -> Column:
    return sub(body, fe.ATTRIBUTION, "", ignore_case=True, dot_all=True)


def stream_array_pairs(body: Column) -> Column:
    """Embeds kept per stream id in a script array: (id, frame source)."""
    zipped = F.arrays_zip(
        find_all(body, fe.STREAM_ARRAY, 1).alias("sid"), find_all(body, fe.STREAM_ARRAY, 3).alias("frame")
    )
    pairs = F.transform(zipped, lambda z: F.struct(z["sid"].alias("angle"), first_once(z["frame"], fe.IFRAME_SRC).alias("raw")))
    return F.when(
        F.contains(body, F.lit("streams[")), F.filter(pairs, lambda p: p["raw"].isNotNull())
    ).otherwise(F.array().cast(_PAIR))


def ladder_targets(body: Column) -> Column:
    """Embeds of a page without such an array: videos, playlists, wrapped players, manifests, the first channel; and if there is
    none of them, the first frame."""
    none = F.array().cast("array<string>")

    def rung(guard: str, pattern: str, group: int, prefix: str = "", suffix: str = "", only_first: bool = False) -> Column:
        found = find_all(body, pattern, group)
        found = F.slice(found, 1, 1) if only_first else found
        made = F.transform(found, lambda x: F.concat(F.lit(prefix), x, F.lit(suffix)))
        return F.when(F.contains(body, F.lit(guard)), made).otherwise(none)

    plain = F.concat(
        rung("youtube", fe.YT_VIDEO, 1, fe.WATCH_URL),
        rung("youtube", fe.YT_PLAYLIST, 1, fe.PLAYLIST_URL),
        rung("worldcams.tv", fe.WRAPPED_PLAYER, 1, fe.WRAPPED_URL),
        rung(".m3u8", fe.M3U8, 0),
        rung("youtube.com/", fe.YT_CHANNEL, 1, fe.CHANNEL_URL, "/live", only_first=True),
    )
    frame = first(body, fe.IFRAME_TAG, ignore_case=True)
    return F.when(F.size(plain) > 0, plain).when(frame.isNotNull(), F.array(frame)).otherwise(none)


def extract_candidates(pages: DataFrame, keep: Sequence[str] = (), page_url: str = "url") -> DataFrame:
    """Candidates of pages (page_url, body, keep...): (page_url, keep..., pos, angle_key, target_url, predisc_key).

    A target that occurs twice on a page keeps its first place; still images and frames that can never carry a stream are left
    out. The angle key is the stream id, or the index where a page has several embeds.
    """
    df = pages.select(page_url, *keep, strip_attribution(F.col("body")).alias("_body"))
    df = df.select(page_url, *keep, stream_array_pairs(F.col("_body")).alias("_pairs"), F.col("_body"))
    df = df.withColumn("_plain", F.when(F.size("_pairs") == 0, ladder_targets(F.col("_body"))))
    several = F.size("_plain") > 1
    indexed = F.transform(
        F.col("_plain"), lambda t, i: F.struct(F.when(several, i.cast("string")).alias("angle"), t.alias("raw"))
    )
    pairs = F.when(F.size("_pairs") > 0, F.col("_pairs")).otherwise(indexed)
    df = df.select(page_url, *keep, urls.join_base(F.col(page_url)).alias("_base"), pairs.alias("_pairs"))
    # Targets are made absolute before the rows are exploded, so that the filters below do not compute them again.
    made = F.transform(
        F.col("_pairs"), lambda p: F.struct(p["angle"].alias("angle"), urls.join_with(F.col("_base"), p["raw"]).alias("target"))
    )
    df = df.select(page_url, *keep, F.posexplode(made).alias("pos", "_p"))
    df = df.select(page_url, *keep, "pos", F.col("_p.angle").alias("angle_key"), F.col("_p.target").alias("target_url"))
    df = df.where(~urls.is_still_image(F.col("target_url")) & ~urls.is_never_a_stream(F.col("target_url")))
    df = first_by(df, [page_url, "target_url"], ["pos"], [*keep, "pos", "angle_key"])
    return df.withColumn("predisc_key", urls.merge_key(F.col("target_url")))


def lookup(table: dict[str, str | None], key: Column) -> Column:
    """Value of a small fixed table, null for keys that are not in it or have none."""
    pairs = [F.lit(x) for k, v in table.items() if v is not None for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), key)


def first_mapped(table: dict[str, str | None], keys: Column) -> Column:
    """Value of the first key of an array that the table gives a value for."""
    return F.get(F.filter(F.transform(keys, lambda k: lookup(table, k)), lambda v: v.isNotNull()), F.lit(0))


def first_unknown(table: dict[str, str | None], keys: Column) -> Column:
    return F.get(F.filter(keys, lambda k: ~k.isin(list(table))), F.lit(0))
