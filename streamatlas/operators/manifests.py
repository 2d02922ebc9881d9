"""HLS manifests as tables: lines, segments, the live-edge trim, and the rewriting of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..fixed import catalogue as fc
from ..functions import urls
from ..functions.regex import has, let, sub
from .liveness import is_playable

_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_SHORT_ENDS = r"[\r\x0b\x0c\x1c\x1d\x1e\x85]"
_LONG_ENDS = r"[\u2028\u2029]"
DISCONTINUITY = "#EXT-X-DISCONTINUITY"
_INK = r"[^\s\x1c-\x1f]"
MEDIA_SEQUENCE = "#EXT-X-MEDIA-SEQUENCE"
DISCONTINUITY_SEQUENCE = "#EXT-X-DISCONTINUITY-SEQUENCE"


def manifest_lines(manifests: DataFrame) -> DataFrame:
    """(manifest_id, pos, line, kind, seg_no) of every line that is not blank.

    kind is `header` for playlist tags before any other line, `tag` or `url`. A tag belongs to the next URL, so seg_no is the
    number of URLs before it; tags after the last URL get a number no URL has.
    """
    lines = manifests.select("manifest_id", F.posexplode(F.split("text", _LINE_ENDS)).alias("pos", "line"))
    line = F.col("line")
    lines = lines.where(has(line, _INK))
    is_url = ~line.startswith("#")
    leading = ~is_url & F.substring_index(line, ":", 1).isin(*fc.PLAYLIST_TAGS)
    w = W.partitionBy("manifest_id").orderBy("pos")
    in_header = F.bool_and(leading).over(w.rowsBetween(W.unboundedPreceding, 0))
    kind = F.when(in_header, "header").when(is_url, "url").otherwise("tag")
    seg_no = F.coalesce(F.count_if(is_url).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lines.select("manifest_id", "pos", "line", kind.alias("kind"), seg_no.cast("long").alias("seg_no"))


def segments(lines: DataFrame) -> DataFrame:
    """(manifest_id, seg_no, url, duration, discontinuities) of the lines of manifests."""
    line = F.col("line")
    extinf = F.when(line.startswith("#EXTINF:"), F.struct("pos", "line"))
    seg = lines.where(F.col("kind") != "header").groupBy("manifest_id", "seg_no").agg(
        F.max(F.when(F.col("kind") == "url", line)).alias("url"),
        F.min(extinf)["line"].alias("_inf"),
        F.count_if(line == DISCONTINUITY).alias("discontinuities"),
    )
    text = F.substring_index(F.regexp_replace("_inf", "^#EXTINF:", ""), ",", 1)
    return seg.where(F.col("url").isNotNull()).select(
        "manifest_id", "seg_no", "url", F.coalesce(text.try_cast("double"), F.lit(0.0)).alias("duration"), "discontinuities"
    )


def parse_segments(manifests: DataFrame) -> DataFrame:
    """What `segments` makes of `manifest_lines`, parsed inside each row: one regular expression cuts the playlist into segments (tags and the URL
    behind them) and each is read by itself. A manifest is one document of limited size, so nothing is shuffled or sorted."""
    body = F.regexp_replace(_clean_lines(F.col("text")), _HEADER, "")
    found = manifests.select("manifest_id", F.posexplode(F.regexp_extract_all(body, F.lit(_SEGMENT), F.lit(0))).alias("seg_no", "_seg"))
    # plain searches for what stands at the start of a line: a segment is short, and a regular expression per segment costs more than its parse
    inf = F.locate("\n#EXTINF:", F.col("_lines"))
    said = F.substr("_lines", inf + len("\n#EXTINF:"), F.length("_lines"))
    seconds = F.when(inf > 0, F.substring_index(F.substring_index(said, "\n", 1), ",", 1).try_cast("double"))
    breaks = F.regexp_count("_lines", F.lit(rf"(?dm)^{DISCONTINUITY}$"))
    return found.withColumn("_lines", F.concat(F.lit("\n"), F.col("_seg"))).select(
        "manifest_id", F.col("seg_no").cast("long").alias("seg_no"), F.substring_index("_seg", "\n", -1).alias("url"),
        F.coalesce(seconds, F.lit(0.0)).alias("duration"),
        F.when(F.contains("_lines", F.lit(f"\n{DISCONTINUITY}\n")), breaks).otherwise(0).cast("long").alias("discontinuities"),
    )


def mark_live_edge(
    segs: DataFrame, key: str, order: list[str], block: Column, window: float = fc.LIVE_WINDOW_SECONDS,
    min_keep: int = fc.MIN_KEEP, above: int = fc.TRIM_ABOVE,
) -> DataFrame:
    """Segments with `keep`: counted from the end until the durations reach the window and enough segments are kept.

    Lists of at most `above` segments are kept whole. `block` cuts a list into pieces in list order: pieces are summed first
    (map-side combined), a window over the pieces carries the sums of the later ones in, and the windows over segments run per
    piece, so one very long list is spread over its pieces.
    """
    df = segs.withColumn("_block", block)
    pieces = df.groupBy(key, "_block").agg(F.sum("duration").alias("_d"), F.count(F.lit(1)).alias("_c"))
    later = W.partitionBy(key).orderBy(F.col("_block").desc()).rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(
        key, "_block",
        F.coalesce(F.sum("_d").over(later), F.lit(0.0)).alias("_later_d"),
        F.coalesce(F.sum("_c").over(later), F.lit(0)).alias("_later_c"),
        F.sum("_c").over(W.partitionBy(key)).alias("_total"),
    )
    w = W.partitionBy(key, "_block").orderBy(*[F.col(o).desc() for o in order])
    after = w.rowsBetween(W.unboundedPreceding, -1)
    df = df.join(pieces, [key, "_block"])
    d = F.coalesce(F.sum("duration").over(after), F.lit(0.0)) + F.col("_later_d")
    c = F.row_number().over(w) - 1 + F.col("_later_c")
    keep = (F.col("_total") <= above) | (d < window) | (c < min_keep)
    return df.withColumn("keep", keep).drop("_block", "_later_d", "_later_c")


def _one_end(text: Column) -> Column:
    """The text with plain line ends. A class with signs beyond one byte is slow to search, and only a text that holds longer signs can match it."""
    other = lambda t: t.rlike(_SHORT_ENDS) | ((F.octet_length(t) > F.length(t)) & t.rlike(_LONG_ENDS))
    return let(text, lambda t: F.when(other(t), F.regexp_replace(t, _LINE_ENDS, "\n")).otherwise(t))


def _without_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"(?dUm)^[\s\x1c-\x1f&&[^\n]]*(?:\n|\z)", "")


def _clean_lines(text: Column) -> Column:
    """The text with plain line ends and without blank lines."""
    return _without_blank(_one_end(text))


_HEADER = "^(?:(?:" + "|".join(fc.PLAYLIST_TAGS) + r")(?::[^\n]*)?(?:\n|\z))*+"
_SEGMENT = r"(?dm)^((?:#[^\n]*\n)*+)([^#\n][^\n]*)"


def _trim(clean: Column) -> Column:
    """struct(dropped, text) of a clean media playlist; `text` only where something is dropped."""
    head = F.regexp_extract(clean, _HEADER, 0)
    body = F.substr(clean, F.length(head) + 1)
    parts = let(
        F.struct(head.alias("head"), body.alias("body")),
        lambda p: F.struct(p["head"].alias("head"), F.regexp_extract_all(p["body"], F.lit(_SEGMENT), F.lit(0)).alias("segs")),
    )

    def seconds(seg: Column) -> Column:
        return F.coalesce(F.regexp_extract(seg, r"(?dm)^#EXTINF:([^,\n]*)", 1).try_cast("double"), F.lit(0.0))

    def kept(p: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("c"))
        more = lambda a: (a["s"] < fc.LIVE_WINDOW_SECONDS) | (a["c"] < fc.MIN_KEEP)
        # durations are read only as far as the window goes back
        step = lambda a, seg: F.when(more(a), F.struct((a["s"] + seconds(seg)).alias("s"), (a["c"] + 1).alias("c"))).otherwise(a)
        end = F.aggregate(F.reverse(p["segs"]), start, step)
        return F.when(F.size(p["segs"]) <= fc.TRIM_ABOVE, F.size(p["segs"])).otherwise(end["c"])

    def rebuild(p: Column) -> Column:
        return F.when(p["dropped"] > 0, F.concat(_fixed_header(p), _tail(p))).otherwise(F.lit(None).cast("string"))

    counted = let(
        parts, lambda p: F.struct(p["head"].alias("head"), p["segs"].alias("segs"), (F.size(p["segs"]) - kept(p)).alias("dropped"))
    )
    return let(counted, lambda p: F.struct(p["dropped"].cast("long").alias("dropped"), rebuild(p).alias("text")))


def _header_number(head: Column, tag: str) -> Column:
    return F.coalesce(F.trim(F.regexp_extract(head, f"(?dm)^{tag}:(.*)$", 1)).try_cast("long"), F.lit(0))


def _fixed_header(p: Column) -> Column:
    """Header with the sequence numbers moved on by what was dropped; a missing number is added."""
    gone = F.aggregate(
        F.slice(p["segs"], F.lit(1), p["dropped"]), F.lit(0).cast("long"),
        lambda n, seg: n + F.when(F.contains(seg, F.lit(DISCONTINUITY)), F.regexp_count(seg, F.lit(rf"(?dm)^{DISCONTINUITY}$"))).otherwise(0),
    )

    def fix(head: Column, tag: str, value: Column, needed: Column) -> Column:
        line = F.concat(F.lit(tag + ":"), value.cast("string"))
        present = head.rlike(f"(?dm)^{tag}:")
        swapped = F.regexp_replace(head, F.lit(f"(?dm)^{tag}:.*$"), line)
        return F.when(present, swapped).when(needed, F.concat(head, line, F.lit("\n"))).otherwise(head)

    media = let(p["head"], lambda h: fix(h, MEDIA_SEQUENCE, _header_number(h, MEDIA_SEQUENCE) + p["dropped"], F.lit(True)))
    numbers = let(gone, lambda g: g + _header_number(p["head"], DISCONTINUITY_SEQUENCE))
    both = F.struct(media.alias("h"), numbers.alias("d"))
    return let(both, lambda x: fix(x["h"], DISCONTINUITY_SEQUENCE, x["d"], x["d"] != 0))


def _tail(p: Column) -> Column:
    rest = F.size(p["segs"]) - p["dropped"]
    return F.concat(F.array_join(F.slice(p["segs"], p["dropped"] + 1, rest), "\n"), F.lit("\n"))


def trim_to_live_edge(manifests: DataFrame) -> DataFrame:
    """(manifest_id, text, dropped): long media playlists cut to their live edge with fixed sequence tags, others verbatim.

    A playlist is one document of limited size, so the cut is worked out inside its row and nothing is shuffled. Short and master
    playlists are recognised by a count of line starts and are not parsed.
    """
    text = F.col("text")

    def parse(t: Column) -> Column:
        # Line starts that are no tag, and one more for the first line; an upper bound of the number of segments.
        lines = F.regexp_count(t, F.lit(r"\n(?!#)")) + 1
        return F.coalesce((lines > fc.TRIM_ABOVE) & ~t.rlike("#EXT-X-STREAM-INF"), F.lit(False))

    cut = let(_one_end(text), lambda t: F.when(parse(t), let(_without_blank(t), _trim)))
    df = manifests.select("manifest_id", "text", cut.alias("_cut"))
    return df.select("manifest_id", F.coalesce(F.col("_cut.text"), text).alias("text"), F.coalesce(F.col("_cut.dropped"), F.lit(0)).cast("long").alias("dropped"))


def _is_reference(line: Column) -> Column:
    return line.rlike(r"^(?!#)\S+\z")


def _tidy(text: Column) -> Column:
    # A reference line loses the white space and the blank lines behind it.
    return sub(text, r"^(?!#)(\S++)\s+$", "$1", multiline=True)


def reference_kind(absolute: Column, site: Column, up_site: Column, relay: Column) -> Column:
    """offsite (left to the player), child (a further playlist), relay (bytes must be relayed) or direct."""
    return (
        F.when((site != up_site) | (site == "") | (up_site == ""), "offsite")
        .when(F.substring_index(absolute, "?", 1).endswith(".m3u8"), "child")
        .when(relay, "relay")
        .otherwise("direct")
    )


def _site_of(ref: Column, absolute: Column, up_site: Column) -> Column:
    # A reference without a host of its own stays on the upstream's site.
    may_own = F.contains(ref, F.lit(":")) | ref.startswith("//")
    own_host = may_own & ref.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:|//)")
    return F.when(own_host, urls.registrable_domain(urls.host(absolute))).otherwise(up_site)


def _with_upstream(manifests: DataFrame) -> DataFrame:
    """What all references of a manifest share, once per manifest."""
    up = F.col("upstream_url")
    df = manifests.select("entry_id", F.split(_tidy(F.col("text")), "\n").alias("_lines"), urls.join_base(up).alias("_base"),
                          urls.host(up).alias("_host"))
    return df.withColumn("_site", urls.registrable_domain(F.col("_host"))).withColumn(
        "_relay", urls.host_in(F.col("_host"), fc.RELAY_SEGMENT_HOSTS)
    )


def classify_references(manifests: DataFrame) -> DataFrame:
    """(entry_id, pos, ref, absolute_url, kind) of every reference line. manifests: (entry_id, upstream_url, text)."""
    # Tags are left out before the rest becomes rows: each row repeats what its manifest shares.
    lines = F.transform("_lines", lambda line, i: F.struct(i.alias("pos"), line.alias("ref")))
    lines = F.filter(lines, lambda x: ~x["ref"].startswith("#"))
    refs = _with_upstream(manifests).select("entry_id", "_base", "_site", "_relay", F.inline(lines)).where(_is_reference(F.col("ref")))
    refs = refs.withColumn("absolute_url", urls.join_with(F.col("_base"), F.col("ref")))
    refs = refs.withColumn("_of", _site_of(F.col("ref"), F.col("absolute_url"), F.col("_site")))
    kind = reference_kind(F.col("absolute_url"), F.col("_of"), F.col("_site"), F.col("_relay"))
    return refs.select("entry_id", "pos", "ref", "absolute_url", kind.alias("kind"))


def rewrite_manifests(manifests: DataFrame, base_url: str) -> DataFrame:
    """(entry_id, body): references turned into links of this service where needed. Works inside each row, without a shuffle.

    The links carry no signature; whoever serves them adds one.
    """
    base, site, relay = F.col("_base"), F.col("_site"), F.col("_relay")
    link = lambda marker: F.concat(F.lit(f"{base_url}/stream/"), F.col("entry_id"), F.lit(f"/{marker}?u="))
    is_child = lambda ref: F.substring_index(ref, "?", 1).endswith(".m3u8")

    def general(line: Column) -> Column:
        return let(
            urls.join_with(base, line),
            lambda a: let(
                reference_kind(a, _site_of(line, a, site), site, relay),
                lambda kind: F.when(kind == "child", F.concat(F.col("_child"), urls.percent_encode(a)))
                .when(kind == "relay", F.concat(F.col("_segment"), urls.percent_encode(a)))
                .otherwise(a),
            ),
        )

    def one(line: Column) -> Column:
        # A bare file name lies beside its playlist: same site, and its encoded form is the encoded folder and the encoded name.
        beside = (
            F.when(is_child(line), F.concat(F.col("_child"), F.col("_folder"), urls.percent_encode(line)))
            .when(relay, F.concat(F.col("_segment"), F.col("_folder"), urls.percent_encode(line)))
            .otherwise(F.concat(base["prefix"], line))
        )
        simple = base["plain"] & (site != "") & line.rlike(urls.FILE_NAME)
        return F.when(line.startswith("#"), line).when(simple, beside).when(_is_reference(line), general(line)).otherwise(line)

    df = _with_upstream(manifests).withColumn("_child", link("m")).withColumn("_segment", link("s"))
    df = df.withColumn("_folder", urls.percent_encode(base["prefix"]))
    return df.select("entry_id", F.array_join(F.transform("_lines", one), "\n").alias("body"))


def is_direct_playback(url: Column) -> Column:
    return urls.host_in(urls.host(url), fc.DIRECT_PLAYBACK_HOSTS)


def is_video_cdn(url: Column) -> Column:
    return urls.host_in(urls.host(url), (fc.VIDEO_CDN_HOST,))


def serving_action(known: Column, url: Column, stream_type: Column, fetched: Column, playable: Column, proxy_video: bool) -> Column:
    """What a request for a stream gets: a struct of status and action."""

    def act(status: int, action: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(action).alias("action"))

    return (
        F.when(~F.coalesce(known, F.lit(False)), act(404, "unknown stream"))
        .when(url.isNull(), act(502, "resolve failed"))
        .when(~urls.is_safe_redirect(url), act(502, "unsafe upstream URL"))
        .when((stream_type == "mp4") | is_direct_playback(url), act(302, "redirect"))
        .when(is_video_cdn(url) & F.lit(not proxy_video), act(302, "redirect"))
        .when(~F.coalesce(fetched, F.lit(False)), act(502, "upstream manifest fetch failed"))
        .when(~F.coalesce(playable, F.lit(False)), act(502, "not a playable HLS stream"))
        .otherwise(act(200, "manifest"))
    )


def serving_view(
    catalogue: DataFrame, resolved: DataFrame, manifests: DataFrame, base_url: str, proxy_video: bool = False
) -> DataFrame:
    """(id, status, action, location, body) for every entry: catalogue with its resolve and its manifest.

    resolved: (target_url, url, stream_type); manifests: (url, text). The text of a manifest is joined only for the entries
    that are served from it.
    """
    flags = manifests.select(
        F.col("url"), F.lit(True).alias("fetched"), is_playable(F.col("text")).alias("playable")
    )
    view = (
        catalogue.select("id", "target_url")
        .join(resolved.select("target_url", "url", "stream_type"), "target_url", "left")
        .join(flags, "url", "left")
        .withColumn("_a", serving_action(F.lit(True), F.col("url"), F.col("stream_type"), F.col("fetched"), F.col("playable"),
                                         proxy_video))
        .select("id", "url", F.col("_a.status").alias("status"), F.col("_a.action").alias("action"))
    )
    needed = view.where(F.col("status") == 200).select(F.col("id").alias("entry_id"), F.col("url").alias("upstream_url"))
    used = manifests.join(needed.select(F.col("upstream_url").alias("url")).distinct(), "url", "left_semi")
    trimmed = trim_to_live_edge(used.select(F.col("url").alias("manifest_id"), "text")).select(
        F.col("manifest_id").alias("upstream_url"), "text"
    )
    bodies = rewrite_manifests(needed.join(trimmed, "upstream_url"), base_url)
    return view.join(bodies.withColumnRenamed("entry_id", "id"), "id", "left").select(
        "id", "status", "action", F.when(F.col("status") == 302, F.col("url")).alias("location"), "body"
    )

