"""The sources: each one turns the landed documents of its site into candidate rows.

An adapter is a function from pages(url, part, body) to rows with ROW_COLUMNS. `url` is the address a document was fetched from,
`part` numbers the pieces of a document that was landed in several rows (0 otherwise). The order columns k1, k2, k3 carry the
order in which the source lists its streams; `number_candidates` turns them into one `ord` over all sources.

Bodies are read once per adapter, projected to short strings, and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed import catalogue as fc
from ..fixed import embeds as fe
from ..fixed import sites as fs
from ..fixed import taxonomy as ft
from ..functions import urls
from ..functions.regex import find_all, first, first_or_empty, has, let, sub
from ..functions.text import (
    html_unescape, last_segment, location_parts, rot13, slug_title, split_camel, squeeze, strip, strip_tags, title_case,
    with_location,
)
from ..operators.extract import (
    before, documents, extract_candidates, first_mapped, first_unknown, from_marker, lookup, matches, matches2, section, usable,
)
from ..operators.graph import leaves, reachable
from ..operators.keyed import first_by, last_by
from ..operators.probe import contiguous_pages, live_page, search_windows
from ..operators.rotation import Rotation, Turn
from ..operators.resolve import embedded_stream

ROW_COLUMNS = (
    "k1", "k2", "k3", "title", "angle_key", "category", "source_page_url", "target_url", "predisc_key",
)
Adapter = Callable[[DataFrame], DataFrame]
ADAPTERS: dict[str, Adapter] = {}



def source(name: str) -> Callable[[Adapter], Adapter]:
    def register(fn: Adapter) -> Adapter:
        ADAPTERS[name] = fn
        return fn

    return register


def _null() -> Column:
    return F.lit(None).cast("string")


def _rows(df: DataFrame, **cols: Column) -> DataFrame:
    """Candidate rows; columns not given are taken from the frame, or are empty."""
    empty = {"k1": F.lit(""), "k2": F.lit(0), "k3": F.lit(0), "title": F.lit(""), "angle_key": _null(), "category": _null()}
    out = []
    for name in ROW_COLUMNS:
        col = cols.get(name)
        if col is None:
            col = F.col(name) if name in df.columns else empty[name]
        kind = "long" if name in ("k2", "k3") else "string"
        out.append(col.cast(kind).alias(name))
    return df.select(*out)


def _title_or_slug(title: Column, url: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) == "", slug_title(last_segment(url))).otherwise(title)


def _decoded(df: DataFrame, *cols: str) -> DataFrame:
    """Decode the entities of short text columns; a step of its own, because Python cannot run inside a lambda."""
    for c in cols:
        df = df.withColumn(c, html_unescape(c))
    return df


def _first_links(links: DataFrame, key: str = "m", keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct links in the order of their first occurrence."""
    return first_by(links, [key], ["part", "pos"], ["part", "pos", *keep])


def number_candidates(rows_by_source: dict[str, DataFrame]) -> DataFrame:
    """Candidates of all sources with `ord`: sources in their fixed order, inside a source its own order.

    One range-partitioned sort over short rows; the position comes from the partition and the place in it, so no single task sees
    everything and a big source is spread over many partitions.
    """
    union = None
    for rank, name in enumerate(fc.SOURCE_ORDER):
        if name not in rows_by_source:
            continue
        part = rows_by_source[name].select(F.lit(rank).alias("_rank"), F.lit(name).alias("source"), *ROW_COLUMNS)
        union = part if union is None else union.unionByName(part)
    if union is None:
        raise ValueError("no source given")
    ordered = union.orderBy("_rank", "k1", "k2", "k3", "source_page_url", "target_url")
    return ordered.select(
        F.monotonically_increasing_id().alias("ord"),
        "title", "angle_key", "category", "source", "source_page_url", "target_url", "predisc_key",
    )


@source("airportwebcams")
def airportwebcams(pages: DataFrame) -> DataFrame:
    index = documents(pages, fs.AIRPORT_INDEX)
    links = matches(index, section(F.col("body"), fs.AIRPORT_SECTION, fs.AIRPORT_SECTION_END), fs.AIRPORT_LINK)
    listed = _first_links(links).select(F.col("m").alias("url"), F.col("part").alias("k2"), F.col("pos").alias("k3"))
    body = F.col("body")
    regular = find_all(before(body, fs.AIRPORT_OCCASIONAL), fs.AIRPORT_CHANNEL)
    channels = F.when(F.size(regular) > 0, regular).otherwise(find_all(body, fs.AIRPORT_CHANNEL))
    details = usable(pages).where(F.col("url").startswith("https://airportwebcams.net/")).select(
        "url", "body", F.array_distinct(channels).alias("channels"), first(body, fs.AIRPORT_TITLE).alias("raw_title")
    )
    by_channel = details.where(F.size("channels") > 0).select(
        "url", "raw_title", F.size("channels").alias("n"), F.posexplode("channels").alias("pos", "ch")
    ).select(
        "url", "raw_title", "pos", F.when(F.col("n") > 1, F.col("ch")).alias("angle_key"),
        F.concat(F.lit(fe.CHANNEL_URL), F.col("ch"), F.lit("/live")).alias("target_url"),
    ).withColumn("predisc_key", urls.merge_key(F.col("target_url")))
    by_ladder = extract_candidates(details.where(F.size("channels") == 0), ["raw_title"])
    df = by_channel.unionByName(by_ladder.select(*by_channel.columns)).join(listed, "url")
    title = strip(sub(_title_or_slug(strip(html_unescape("raw_title")), F.col("url")), fs.AIRPORT_TAIL, ignore_case=True))
    return _rows(df, k2=F.col("k2") * 1_000_000 + F.col("k3"), k3=F.col("pos"), title=title, category=F.lit("Airports"),
                 source_page_url=F.col("url"))


@source("beachcam")
def beachcam(pages: DataFrame) -> DataFrame:
    links = matches(documents(pages, fs.BEACH_INDEX), F.col("body"), fs.BEACH_LINK).select("m").distinct()
    listed = links.select(F.concat(F.lit(fs.BEACH_INDEX), F.col("m"), F.lit("/")).alias("url"), F.col("m").alias("k1"))
    text = strip(F.col("body"))
    # One token per build, in one document.
    token = documents(pages, fs.BEACH_TOKEN_API).agg(F.max(F.when(has(text, fs.BEACH_TOKEN_SHAPE), text)).alias("t")).scalar()
    body = F.col("body")
    df = usable(pages).where(F.col("url").startswith(fs.BEACH_INDEX)).select(
        "url", first(body, fs.BEACH_TITLE).alias("t"), first(body, fs.BEACH_REGION).alias("r"),
        F.array_distinct(find_all(body, fs.BEACH_VIDEO)).alias("v"),
    )
    df = df.select("url", "t", "r", F.size("v").alias("n"), F.posexplode("v").alias("pos", "bare")).join(listed, "url")
    df = _decoded(df, "t", "r")
    title = _title_or_slug(strip(F.col("t")), F.col("url"))
    region = F.nullif(strip(F.col("r")), F.lit(""))
    signed = F.concat(F.col("bare"), F.lit(fs.BEACH_TOKEN_PARAM), urls.percent_encode(token, "="))
    return _rows(
        df,
        k3=F.col("pos"),
        title=with_location(title, F.array_compact(F.array(F.lit("Portugal"), region))),
        angle_key=F.when(F.col("n") > 1, F.col("pos")),
        category=F.lit("Beaches"),
        source_page_url=F.col("url"),
        target_url=F.coalesce(signed, F.col("bare")),
        predisc_key=urls.merge_key(F.col("bare")),
    )


def _camsecure_facts(pages: DataFrame) -> DataFrame:
    """(url, hls, player) of player and cam pages: the manifest they name, absolute, and the player frame they embed."""
    body = F.col("body")
    hls = first(body, fs.CAMSECURE_HLS, ignore_case=True)
    return usable(pages).where(has(F.col("url"), fs.CAMSECURE_EMBED, ignore_case=True)).select(
        "url", hls.alias("_hls"), first(body, fs.CAMSECURE_PLAYER, ignore_case=True).alias("player")
    ).select("url", F.when(F.col("_hls").isNotNull(), urls.url_join(F.col("url"), F.col("_hls"))).alias("hls"), "player")


@source("camscape")
def camscape(pages: DataFrame) -> DataFrame:
    starts = matches(documents(pages, fs.CAMSCAPE_INDEX), F.col("body"), fs.CAMSCAPE_CATEGORY_PAGE, name="node")
    listing = usable(pages).where(F.col("url").startswith(fs.CAMSCAPE_INDEX)).withColumnRenamed("url", "src")
    links = matches(listing, F.col("body"), fs.CAMSCAPE_PAGE, name="dst", keep=["src"])
    cams = matches(listing, F.col("body"), fs.CAMSCAPE_CAM, name="leaf", keep=["src"])
    listed = leaves(reachable(starts.select("node"), links), cams).withColumnRenamed("leaf", "url")
    body = F.col("body")
    tags = find_all(body, fs.CAMSCAPE_TAG)
    streams = F.from_json(from_marker(body, '"streams":', "["), "array<struct<url:string,name:string>>")
    df = usable(pages).where(F.col("url").startswith("https://www.camscape.com/webcam/")).select(
        "url",
        F.coalesce(first_mapped(fs.CAMSCAPE_CATEGORY, tags), first_unknown(fs.CAMSCAPE_CATEGORY, tags)).alias("category"),
        F.transform(F.reverse(F.array_distinct(find_all(body, fs.CAMSCAPE_PLACE))), slug_title).alias("places"),
        streams.alias("streams"),
    )
    df = df.select("url", "category", "places", F.posexplode("streams").alias("pos", "s")).join(listed, "url")
    embed = F.coalesce(F.col("s.url"), F.lit(""))
    channel = F.when(F.contains(embed, F.lit(fs.TWITCH_PLAYER)), first(embed, fs.TWITCH_CHANNEL))
    df = df.where(embed != "").withColumn("t0", F.coalesce(F.concat(F.lit(fs.TWITCH_URL), channel), embed))
    facts = _camsecure_facts(pages)
    nested = has(F.col("t0"), fs.CAMSECURE_EMBED, ignore_case=True) & ~F.contains(F.col("t0"), F.lit(".m3u8"))
    df = df.withColumn("_hop", F.when(nested, F.col("t0")))
    df = df.join(facts.select(F.col("url").alias("_hop"), F.col("hls").alias("hls1"), F.col("player").alias("_hop2")), "_hop", "left")
    df = df.join(facts.select(F.col("url").alias("_hop2"), F.col("hls").alias("hls2")), "_hop2", "left")
    df = df.withColumn("target_url", F.coalesce("hls1", "hls2", "t0"))
    name = F.coalesce(F.col("s.name"), F.lit(""))
    return _rows(
        df, k1=F.col("url"), k3=F.col("pos"), title=with_location(name, F.col("places"), F.col("category")),
        angle_key=F.col("pos"), source_page_url=F.col("url"), predisc_key=urls.merge_key(F.col("target_url")),
    )


def _camsecure_name(url: Column) -> Column:
    slug = urls.percent_decode(last_segment(url))
    slug = sub(sub(slug, r"\.html?$", ignore_case=True), fs.CAMSECURE_SLUG_TAIL, ignore_case=True)
    return title_case(strip(sub(split_camel(slug), r"[_\-\s]+", " ")))


@source("camsecure")
def camsecure(pages: DataFrame) -> DataFrame:
    locs = matches(documents(pages, fs.CAMSECURE_SITEMAP), F.col("body"), fs.ANY_LOC)
    lower = F.lower("m")
    wanted = F.contains(lower, F.lit(fs.CAMSECURE_DOMAIN)) & (F.regexp_replace(urls.path(F.col("m")), "^/+|/+$", "") != "")
    for word in fs.CAMSECURE_SKIP:
        wanted = wanted & ~F.contains(lower, F.lit(word))
    listed = locs.where(wanted).select(F.replace("m", F.lit(" "), F.lit("%20")).alias("url")).distinct()
    body = F.col("body")
    details = usable(pages).select(
        "url", first(body, fs.CAMSECURE_PLAYER, ignore_case=True).alias("player"),
        first_or_empty(body, fs.CAMSECURE_TITLE, ignore_case=True).alias("raw"),
    ).where(F.col("player").isNotNull())
    players = _camsecure_facts(pages).where(F.col("hls").isNotNull()).select(F.col("url").alias("player"), "hls")
    df = details.join(listed, "url").join(players, "player").where(~F.contains("hls", F.lit(fs.CAMSECURE_STUB)))
    df = first_by(df, ["hls"], ["url"], ["url", "raw"])
    raw = strip(F.col("raw"))
    plain = strip(sub(raw, fs.CAMSECURE_BOILER, ignore_case=True))
    leading = has(plain, fs.CAMSECURE_LEADING, ignore_case=True)
    place = strip(first_or_empty(raw, fs.CAMSECURE_FROM, ignore_case=True))
    title = F.when((plain == "") | leading, place).otherwise(plain)
    return _rows(
        df, k1=F.col("url"), title=F.when(title == "", _camsecure_name(F.col("url"))).otherwise(title),
        source_page_url=F.col("url"), target_url=F.col("hls"), predisc_key=urls.merge_key(F.col("hls")),
    )


@source("cxtvlive")
def cxtvlive(pages: DataFrame) -> DataFrame:
    slugs = _first_links(matches(documents(pages, fs.CXTV_SITEMAP), F.col("body"), fs.CXTV_SLUG))
    listed = slugs.select(F.concat(F.lit(fs.CXTV_PAGE), F.col("m")).alias("url"), F.col("part"), F.col("pos").alias("no"))
    body = F.col("body")
    details = usable(pages).where(F.col("url").startswith(fs.CXTV_PAGE)).select(
        "url", "body", first(body, fs.SHORT_H1).alias("h1"), slug_title(first(body, fs.CXTV_CATEGORY)).alias("category")
    )
    df = extract_candidates(details, ["h1", "category"]).join(listed, "url")
    slug = F.replace("url", F.lit(fs.CXTV_PAGE), F.lit(""))
    name = F.when(F.col("h1").isNotNull(), strip(F.col("h1"))).otherwise(slug_title(slug))
    return _rows(
        df, k2=F.col("part") * 1_000_000 + F.col("no"), k3=F.col("pos"), source_page_url=F.col("url"),
        title=with_location(name, location_parts(F.col("url")), F.col("category")),
    )


def earthcam_route(url: Column) -> Column:
    """struct(target, key) of a map link that some resolver can open, or null."""

    def to(target: Column, key: Column) -> Column:
        return F.struct(target.alias("target"), key.alias("key"))

    def pick(p: Column) -> Column:
        u, h = p["url"], p["host"]
        return (
            F.when(p["video"] != "", to(F.concat(F.lit(fe.WATCH_URL), p["video"]), F.concat(F.lit("yt:"), p["video"])))
            .when(h.isin(*fs.EARTHCAM_HOSTS), F.when(p["section"].isin(*fs.EARTHCAM_SECTIONS), to(u, _null())))
            .when(urls.host_in(h, fs.EARTHCAM_PARTNER), to(u, _null()))
            .when(F.contains(u, F.lit(".m3u8")), to(u, urls.merge_key(u)))
        )

    section_of = F.substring_index(F.regexp_replace(urls.path(url), "^/+", ""), "/", 1)
    parts = F.struct(
        url.alias("url"), urls.host(url).alias("host"), section_of.alias("section"),
        first_or_empty(url, fs.EARTHCAM_VIDEO).alias("video"),
    )
    return let(parts, pick)


@source("earthcam")
def earthcam(pages: DataFrame) -> DataFrame:
    place = "array<struct<name:string,url:string,country:string,state:string,city:string>>"
    body = F.col("body")
    wrapped = F.from_json(body, f"struct<data:array<struct<places:{place}>>>")["data"]
    bare = F.when(F.ltrim(body).startswith("["), F.from_json(body, f"array<struct<places:{place}>>"))
    feeds = documents(pages, fs.EARTHCAM_NETWORK, fs.EARTHCAM_GLOBAL).select(
        F.when(F.col("url") == fs.EARTHCAM_NETWORK, 0).otherwise(1).alias("feed"), "part",
        F.posexplode(F.coalesce(wrapped, bare)).alias("g", "group"),
    )
    df = feeds.select("feed", "part", "g", F.posexplode("group.places").alias("p", "x")).where(F.col("x").isNotNull())
    url = F.coalesce(F.col("x.url"), F.lit(""))
    df = df.withColumn("url", url).withColumn("to", earthcam_route(url)).where(F.col("to").isNotNull())
    df = df.withColumn("dedup", F.coalesce("to.key", "to.target"))
    df = first_by(df, ["dedup"], ["feed", "part", "g", "p"], ["feed", "part", "g", "p", "x", "url", "to"])
    none = F.lit("")
    geo = F.array_compact(F.array(*[F.nullif(F.col(f"x.{k}"), none) for k in ("country", "state", "city")]))
    return _rows(
        df, k2=F.col("feed") * 2**40 + F.col("part") * 2**20 + F.col("g"), k3=F.col("p"),
        title=with_location(F.coalesce(F.col("x.name"), none), geo), source_page_url=F.col("url"),
        target_url=F.col("to.target"), predisc_key=F.col("to.key"),
    )


@source("explore")
def explore(pages: DataFrame) -> DataFrame:
    item = "array<struct<state:string,playlistUrl:string,name:string>>"
    body = F.col("body")
    wrapped = F.from_json(body, f"struct<streams:{item}>")["streams"]
    bare = F.when(F.ltrim(body).startswith("["), F.from_json(body, item))
    df = documents(pages, fs.EXPLORE_API).select("part", F.posexplode(F.coalesce(wrapped, bare)).alias("pos", "s"))
    df = df.where((F.col("s.state") == "live") & F.contains("s.playlistUrl", F.lit(".m3u8")))
    df = df.select("part", "pos", F.col("s.playlistUrl").alias("target_url"), F.col("s.name").alias("name"))
    df = first_by(df, ["target_url"], ["part", "pos"], ["part", "pos", "name"])
    return _rows(
        df, k2=F.col("part"), k3=F.col("pos"), title=strip(F.coalesce("name", F.lit(""))), source_page_url=F.col("target_url"),
        predisc_key=urls.merge_key(F.col("target_url")),
    )


@source("feratel")
def feratel(pages: DataFrame) -> DataFrame:
    listed = matches(documents(pages, fs.FERATEL_SITEMAP), F.col("body"), fs.FERATEL_LOC, name="url").select("url").distinct()
    body = F.col("body")
    df = usable(pages).where(F.col("url").startswith("https://www.feratel.com/en/webcams/")).select(
        "url", first(body, fs.FERATEL_PLAYER).alias("cam"), first(body, fs.FERATEL_TITLE).alias("t")
    )
    df = df.where(F.col("cam").isNotNull()).join(listed, "url")
    df = df.withColumn("target_url", F.concat(F.lit(fs.FERATEL_URL), F.col("cam")))
    df = _decoded(df, "t")
    title = _title_or_slug(strip(F.col("t")), F.col("url"))
    segs = F.split(F.regexp_replace("url", "/+$", ""), "/")
    parts = F.transform(F.slice(segs, F.size(segs) - 2, F.lit(2)), slug_title)
    return _rows(
        df, k1=F.col("url"), title=with_location(title, parts), category=F.lit(ft.GEO_CATEGORY), source_page_url=F.col("url"),
        predisc_key=urls.merge_key(F.col("target_url")),
    )


@source("hdontap")
def hdontap(pages: DataFrame) -> DataFrame:
    locs = matches2(documents(pages, fs.HDONTAP_SITEMAP), F.col("body"), fs.HDONTAP_LOC, ("url", "cam"))
    listed = locs.groupBy("cam").agg(F.min("url").alias("url")).select("url")
    body = F.col("body")
    details = usable(pages).where(F.col("url").startswith("https://hdontap.com/stream/")).select(
        "url", "body", first(body, fs.HDONTAP_TITLE, ignore_case=True).alias("t"), embedded_stream(body).isNotNull().alias("own")
    )
    own = details.where("own").select(
        "url", "t", F.lit(0).alias("pos"), _null().alias("angle_key"), F.col("url").alias("target_url"), _null().alias("predisc_key")
    )
    other = extract_candidates(details.where(~F.col("own")), ["t"]).select(*own.columns)
    df = own.unionByName(other).join(listed, "url")
    raw = sub(strip(html_unescape("t")), fs.HDONTAP_SUFFIX, ignore_case=True)
    raw = _title_or_slug(raw, F.col("url"))
    title = strip(sub(raw, fs.HDONTAP_BOILER, ignore_case=True))
    return _rows(df, k1=F.col("url"), k3=F.col("pos"), title=F.when(title == "", raw).otherwise(title), source_page_url=F.col("url"))


@source("livefromiceland")
def livefromiceland(pages: DataFrame) -> DataFrame:
    items = F.when(F.ltrim(F.col("body")).startswith("["), F.from_json("body", "array<struct<link:string>>"))
    listed = documents(pages, fs.ICELAND_INDEX).select(F.explode(items).alias("i")).select(F.col("i.link").alias("url"))
    listed = listed.where(F.col("url").startswith(fs.ICELAND_PREFIX)).distinct()
    body = F.col("body")
    df = usable(pages).where(F.col("url").startswith(fs.ICELAND_PREFIX)).select(
        "url", first(body, fs.WHOLE_TITLE, dot_all=True).alias("t"), F.array_distinct(find_all(body, fs.ICELAND_PLAYER, 0)).alias("v")
    )
    df = df.select("url", "t", F.size("v").alias("n"), F.posexplode("v").alias("pos", "target_url")).join(listed, "url")
    df = _decoded(df, "t")
    title = _title_or_slug(sub(strip(F.col("t")), fs.ICELAND_TAIL, ignore_case=True), F.col("url"))
    return _rows(
        df, k1=F.col("url"), k3=F.col("pos"), title=with_location(title, F.array(F.lit("Iceland"))),
        angle_key=F.when(F.col("n") > 1, F.col("pos")), source_page_url=F.col("url"), predisc_key=_null(),
    )


@source("livespotting")
def livespotting(pages: DataFrame) -> DataFrame:
    country_urls = [fs.LIVESPOTTING_BASE + p for p in fs.LIVESPOTTING_COUNTRIES]
    docs = documents(pages, *country_urls)
    rank = F.array_position(F.array(*[F.lit(u) for u in country_urls]), F.col("url"))
    links = matches2(docs.withColumn("rank", rank), F.col("body"), fs.LIVESPOTTING_LINK, ("path", "cam"), ["rank"])
    cams = first_by(links, ["cam"], ["rank", "part", "pos"], ["path"])
    doc = F.from_json("body", "struct<source:string,name:string,country:string,city:string>")
    cam_of = F.regexp_extract("url", r"/livesource/([^?]*)", 1)
    api = usable(pages).where(F.col("url").startswith(fs.LIVESPOTTING_API)).select(cam_of.alias("cam"), doc.alias("d")).select(
        "cam", F.col("d.source").alias("target_url"), strip(F.coalesce("d.name", F.lit(""))).alias("name"),
        F.coalesce("d.country", F.lit("")).alias("country"), F.coalesce("d.city", F.lit("")).alias("city"),
    )
    df = api.where(F.contains("target_url", F.lit(".m3u8")) & (F.col("name") != "")).join(cams, "cam")
    df = first_by(df, ["target_url"], ["cam"], ["cam", "path", "name", "country", "city"])
    return _rows(
        df, k1=F.col("cam"), title=with_location(F.col("name"), F.array("country", "city")),
        source_page_url=F.concat(F.lit(fs.LIVESPOTTING_BASE), F.col("path")), predisc_key=urls.merge_key(F.col("target_url")),
    )


@source("ozolio")
def ozolio(pages: DataFrame) -> DataFrame:
    locs = matches(documents(pages, fs.OZOLIO_SITEMAP), F.col("body"), fs.ANY_LOC).select(strip(F.col("m")).alias("url"))
    listed = locs.where(has(F.col("url"), fs.OZOLIO_PAGE)).distinct()
    df = usable(pages).select("url", first(F.col("body"), fs.OZOLIO_TITLE, ignore_case=True).alias("t"))
    df = df.where(F.col("t").isNotNull()).join(listed, "url")
    return _rows(
        df, k1=F.col("url"), title=strip(F.col("t")), source_page_url=F.col("url"), target_url=F.col("url"), predisc_key=_null()
    )


@source("resortcams")
def resortcams(pages: DataFrame) -> DataFrame:
    listed = matches(documents(pages, fs.RESORT_SITEMAP), F.col("body"), fs.RESORT_LOC, name="url").select("url").distinct()
    details = usable(pages).where(F.col("url").startswith("https://www.resortcams.com/webcams/")).select(
        "url", "body", first(F.col("body"), fs.WHOLE_TITLE, dot_all=True).alias("t")
    )
    df = extract_candidates(details, ["t"]).join(listed, "url")
    title = _title_or_slug(sub(strip(html_unescape("t")), fs.RESORT_TAIL, ignore_case=True), F.col("url"))
    return _rows(df, k1=F.col("url"), k3=F.col("pos"), title=title, source_page_url=F.col("url"))


@source("shareju")
def shareju(pages: DataFrame) -> DataFrame:
    address = "struct<address:struct<addressLocality:string,addressRegion:string>>"
    item = f"struct<`@type`:string,name:string,embedUrl:string,url:string,description:string,locationCreated:{address}>"
    schema = f"struct<`@type`:string,itemListElement:array<struct<item:{item}>>>"
    blocks = matches(documents(pages, fs.SHAREJU_INDEX), F.col("body"), fs.SHAREJU_LD_JSON, name="block", dot_all=True)
    doc = F.from_json("block", schema, {"allowUnquotedControlChars": "true"})
    df = blocks.select("part", F.col("pos").alias("b"), doc.alias("d")).where(F.col("d.@type") == "ItemList")
    df = df.select("part", "b", F.posexplode("d.itemListElement").alias("pos", "e")).select("part", "b", "pos", "e.item")
    df = df.where(F.col("item.@type") == "VideoObject")
    embed = strip(F.coalesce("item.embedUrl", F.lit("")))
    df = df.withColumn("embed", embed).where(F.col("embed") != "").withColumn("predisc_key", urls.merge_key(F.col("embed")))
    is_video = F.col("predisc_key").startswith("yt:")
    target = F.when(is_video, F.concat(F.lit(fe.WATCH_URL), F.substr("predisc_key", F.lit(4)))).otherwise(F.col("embed"))
    df = df.withColumn("target_url", target)
    df = first_by(df, ["target_url"], ["part", "b", "pos"], ["part", "b", "pos", "item", "predisc_key"])
    none = F.lit("")
    name = strip(sub(sub(F.coalesce("item.name", none), fs.SHAREJU_PREFIX), fs.SHAREJU_SUFFIX))
    place = F.col("item.locationCreated.address")
    locality = strip(F.regexp_replace(F.coalesce(place["addressLocality"], none), "…+$", ""))
    region = strip(F.coalesce(place["addressRegion"], none))
    df = df.withColumn("_name", name)
    parts = F.filter(F.array(locality, region), lambda p: (p != "") & ~F.contains(F.col("_name"), p))
    title = F.when(F.size(parts) > 0, F.concat("_name", F.lit(" — "), F.array_join(parts, ", "))).otherwise(F.col("_name"))
    tags = F.split(strip(first(F.coalesce("item.description", none), fs.SHAREJU_TAGS)), r"(?U)\s+")
    page = strip(F.coalesce("item.url", none))
    return _rows(
        df, k2=F.col("part") * 1_000_000 + F.col("b"), k3=F.col("pos"), title=title,
        category=first_mapped(fs.SHAREJU_CATEGORY, tags), source_page_url=F.when(page == "", F.col("target_url")).otherwise(page),
    )


def _skyline_category_url(slug: Column) -> Column:
    return F.concat(F.lit(fs.SKYLINE_BASE + "/en/live-cams-category/"), slug, F.lit("-cams.html"))


@source("skyline")
def skyline(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    found = _first_links(matches(documents(pages, fs.SKYLINE_INDEX), F.col("body"), fs.SKYLINE_SLUG))
    slugs = found.select(F.col("m").alias("slug"), F.col("pos").cast("long").alias("slug_no"))
    if slugs.isEmpty():
        known = [(s, n) for n, s in enumerate(fs.SKYLINE_CATEGORY)]
        slugs = spark.createDataFrame(known, "slug string, slug_no long")
    slugs = slugs.withColumn("url", _skyline_category_url(F.col("slug")))
    listing = usable(pages).where(F.col("url").startswith(fs.SKYLINE_BASE + "/en/"))
    absolute = lambda c: F.concat(F.lit(fs.SKYLINE_BASE), c)
    cam_links = matches(listing, F.col("body"), fs.SKYLINE_CAM, name="rel", keep=["url"]).select(
        "url", absolute(F.concat(F.lit("/"), F.col("rel"))).alias("leaf")
    )
    filed = cam_links.join(slugs, "url")
    known_slug = F.col("slug").isin(list(fs.SKYLINE_CATEGORY))
    category = F.when(known_slug, lookup(fs.SKYLINE_CATEGORY, F.col("slug"))).otherwise(F.col("slug"))
    categories = first_by(
        filed.withColumn("category", category).where(F.col("category").isNotNull()), ["leaf"], ["slug_no"], ["category"]
    )
    # The regions hang on the links of the first category page that was fetched.
    fetched = listing.join(F.broadcast(slugs), "url")
    seed_no = fetched.agg(F.min("slug_no").alias("n")).scalar()
    seeds = matches(fetched.where(F.col("slug_no") == seed_no), F.col("body"), fs.SKYLINE_COUNTRY).select(absolute(F.col("m")).alias("node"))
    regions = matches(listing, F.col("body"), fs.SKYLINE_SUBREGION, name="rel", keep=["url"]).select(
        F.col("url").alias("src"), absolute(F.col("rel")).alias("dst")
    )
    crawled = leaves(reachable(seeds, regions), cam_links.select(F.col("url").alias("src"), "leaf"))
    listed = filed.select("leaf").union(crawled).distinct().join(categories, "leaf", "left").withColumnRenamed("leaf", "url")
    body = F.col("body")
    crumbs = find_all(first_or_empty(body, fs.SKYLINE_BREADCRUMB, 0, dot_all=True), fs.SKYLINE_CRUMB)
    df = usable(pages).where(F.col("url").startswith(fs.SKYLINE_BASE + "/en/webcam/")).select(
        "url", first_or_empty(body, fs.SHORT_H1).alias("h1"), F.transform(crumbs, strip).alias("geo"),
        has(body, fs.SKYLINE_TOKEN).alias("own"), first(body, fs.SKYLINE_VIDEO).alias("video"),
    )
    df = df.where(F.col("own") | F.col("video").isNotNull()).join(listed, "url")
    own = F.col("own")
    return _rows(
        df, k1=F.col("url"),
        title=with_location(sub(strip(F.col("h1")), fs.SKYLINE_NAME_TAIL, ignore_case=True), F.col("geo"), F.col("category")),
        source_page_url=F.col("url"),
        target_url=F.when(own, F.col("url")).otherwise(F.concat(F.lit(fe.WATCH_URL), F.col("video"))),
        predisc_key=F.when(~own, F.concat(F.lit("yt:"), F.col("video"))),
    )


@source("tomarigi")
def tomarigi(pages: DataFrame) -> DataFrame:
    listed = matches(documents(pages, fs.TOMARIGI_SITEMAP), F.col("body"), fs.TOMARIGI_LOC, name="url").select("url").distinct()
    details = usable(pages).where(F.col("url").startswith("https://tomarigi.me/spot/"))
    blocks = details.select("url", F.posexplode(find_all(F.col("body"), fs.LD_JSON, dot_all=True)).alias("pos", "block"))
    doc = F.from_json(html_unescape("block"), "struct<`@type`:string,name:string,contentUrl:string,description:string>")
    video = blocks.select("url", "pos", doc.alias("d")).where(F.col("d.@type") == "VideoObject")
    video = first_by(video, ["url"], ["pos"], ["d"]).join(listed, "url")
    df = video.withColumn("predisc_key", urls.merge_key(F.coalesce("d.contentUrl", F.lit(""))))
    df = df.where(F.col("predisc_key").startswith("yt:"))
    df = first_by(df, ["predisc_key"], ["url"], ["url", "d"])
    slug = first(F.coalesce("d.description", F.lit("")), fs.TOMARIGI_SENTENCE)
    category = F.when(~slug.isin(*fs.TOMARIGI_UNCATEGORISED), F.coalesce(lookup(fs.TOMARIGI_CATEGORY, slug), slug))
    return _rows(
        df, k1=F.col("url"), title=strip(F.coalesce("d.name", F.lit(""))), category=category, source_page_url=F.col("url"),
        target_url=F.concat(F.lit(fe.WATCH_URL), F.substr("predisc_key", F.lit(4))),
    )


@source("viewsurf")
def viewsurf(pages: DataFrame) -> DataFrame:
    docs = documents(pages, fs.VIEWSURF_SITEMAP)
    locs = matches2(docs, F.col("body"), fs.VIEWSURF_LOC, ("url", "univers"))
    locs = locs.withColumn("cam", F.regexp_extract("url", r"/vue/(\d+)-", 1))
    unknown = ~F.col("univers").isin(list(fs.VIEWSURF_CATEGORY))
    listed = first_by(locs.withColumn("unknown", unknown), ["cam"], ["unknown", "part", "pos"], ["url", "univers"])
    body, url = F.col("body"), F.col("url")
    df = usable(pages).where(F.contains("url", F.lit("viewsurf.com/univers/"))).select(
        "url", first(body, fs.VIEWSURF_EMBED, 1).alias("uuid"), first(body, fs.VIEWSURF_EMBED, 2).alias("kind"),
        first(body, fs.ANY_H1, dot_all=True).alias("h1"),
    )
    df = df.where(F.col("uuid").isNotNull()).join(listed, "url")
    slug = first(url, fs.VIEWSURF_UNIVERS)
    category = F.coalesce(lookup(fs.VIEWSURF_CATEGORY, slug), slug)
    df = df.withColumn("category", category).withColumn(
        "target_url", F.concat(F.lit(fs.VIEWSURF_URL), F.col("uuid"), F.lit("&type="), F.col("kind"))
    )
    df = _decoded(df.withColumn("h1", strip_tags(F.col("h1"))), "h1")
    name = squeeze(F.coalesce("h1", F.lit("")))
    country = title_case(first(url, fs.VIEWSURF_COUNTRY))
    return _rows(
        df, k2=F.col("cam"), title=with_location(name, F.array_compact(F.array(country)), F.col("category")),
        source_page_url=url, predisc_key=urls.merge_key(F.col("target_url")),
    )


def webcamera_page(url: Column) -> Column:
    """Canonical cam page of a link of that network, or null for a link that is no cam."""
    host = urls.host(url)
    name = F.regexp_replace(host, r"\.webcamera\.pl$", "")
    on_www = F.regexp_extract(urls.path(url), r"^/kamera/[a-z0-9-]+", 0)
    www = F.when(on_www != "", F.concat(F.lit(fs.WEBCAMERA_BASE), on_www, F.lit("/")))
    other = F.when(
        (name != "") & ~F.contains(name, F.lit(".")) & ~name.isin(*fs.WEBCAMERA_NOT_CAMS), F.concat(F.lit("https://"), host, F.lit("/"))
    )
    return F.when(host.endswith(".webcamera.pl"), F.when(name == "www", www).otherwise(other))


@source("webcamerapl")
def webcamerapl(pages: DataFrame) -> DataFrame:
    marker = F.from_json(
        from_marker(F.col("body"), fs.WEBCAMERA_MARKERS, "{"), "map<string,struct<url:string,name:string,is_inactive:string>>"
    )
    marks = documents(pages, fs.WEBCAMERA_MAP).select("part", F.posexplode(F.map_values(marker)).alias("pos", "v"))
    off = ~F.coalesce(F.col("v.is_inactive"), F.lit("")).isin("", "0", "false")
    marks = marks.select(
        "part", "pos", webcamera_page(F.col("v.url")).alias("url"), F.col("v.name").alias("name"),
        (off | F.coalesce(has(F.col("v.name"), fs.WEBCAMERA_SKIP, ignore_case=True), F.lit(False))).alias("skip"),
    ).where(F.col("url").isNotNull())
    on_map = marks.where(~F.col("skip"))
    names = first_by(on_map.where(F.col("name").isNotNull()), ["url"], ["part", "pos"], ["name"])
    listing_urls = [f"{fs.WEBCAMERA_BASE}/kategoria,{slug}" for slug, _ in fs.WEBCAMERA_LISTINGS]
    rank = F.array_position(F.array(*[F.lit(u) for u in listing_urls]), F.col("url"))
    # The grid between the markers; without an end marker it runs to the end of the page.
    grid = section(F.col("body"), fs.WEBCAMERA_LISTING_START, fs.WEBCAMERA_LISTING_END)
    in_list = matches(documents(pages, *listing_urls).withColumn("rank", rank), grid, fs.WEBCAMERA_LINK, keep=["rank"])
    in_list = in_list.select("rank", webcamera_page(F.col("m")).alias("url")).where(F.col("url").isNotNull())
    in_list = in_list.join(marks.where("skip").select("url").distinct(), "url", "left_anti")
    filed = first_by(in_list, ["url"], ["rank"], ["rank"])
    category = F.get(F.array(*[F.lit(c) for _, c in fs.WEBCAMERA_LISTINGS]), (F.col("rank") - 1).cast("int"))
    listed = (
        on_map.select("url").union(filed.select("url")).distinct()
        .join(names, "url", "left")
        .join(filed.select("url", category.alias("category")), "url", "left")
    )
    body, url = F.col("body"), F.col("url")
    src = rot13(F.replace(first(body, fs.WEBCAMERA_VIDEO), F.lit("\\/"), F.lit("/")))
    df = usable(pages).where(F.contains("url", F.lit(".webcamera.pl/"))).select(
        "url", src.alias("target_url"), first(body, fs.WEBCAMERA_H1, maybe_empty=True, ignore_case=True).alias("h1")
    )
    df = df.where(F.contains("target_url", F.lit(".m3u8"))).join(listed, "url")
    raw = F.when(F.col("h1").isNotNull(), strip(html_unescape("h1"))).otherwise(F.coalesce("name", F.lit("")))
    title = strip(sub(raw, fs.WEBCAMERA_BADGE, ignore_case=True))
    host = urls.host(url)
    slug = F.when(host.startswith("www."), last_segment(urls.path(url))).otherwise(F.substring_index(host, ".", 1))
    return _rows(
        df, k1=url, title=F.when(title == "", slug_title(slug)).otherwise(title), source_page_url=url,
        predisc_key=urls.merge_key(F.col("target_url")),
    )


def _on_whatsup(url: Column) -> Column:
    return urls.host_in(urls.host(url), (fs.WHATSUP_DOMAIN,))


@source("whatsupcams")
def whatsupcams(pages: DataFrame) -> DataFrame:
    index = matches(documents(pages, fs.WHATSUP_INDEX), F.col("body"), fs.ANY_LOC, name="url")
    maps = index.where(_on_whatsup(F.col("url")) & has(urls.path(F.col("url")), fs.WHATSUP_MAP)).select("url").distinct()
    sitemaps = usable(pages).where(has(urls.path(F.col("url")), fs.WHATSUP_MAP)).join(F.broadcast(maps), "url", "left_semi")
    segments = F.split(F.regexp_replace(urls.path(F.col("url")), "^/+|/+$", ""), "/")
    locs = matches(sitemaps.drop("url"), F.col("body"), fs.ANY_LOC, name="url")
    listed = locs.where(_on_whatsup(F.col("url")) & (F.size(segments) >= fs.WHATSUP_DEPTH)).select("url").distinct()
    body = F.col("body")
    cams = usable(pages).where(_on_whatsup(F.col("url"))).select(
        "url", first(body, fs.WHATSUP_ID).alias("cam"), first_or_empty(body, fs.WHATSUP_TITLE).alias("t")
    ).where(F.col("cam").isNotNull()).join(listed, "url")
    api = usable(pages).where(F.col("url").startswith(fs.WHATSUP_API)).select(
        F.replace("url", F.lit(fs.WHATSUP_API), F.lit("")).alias("cam"),
        F.from_json("body", "struct<hls:struct<url:string>>")["hls"]["url"].alias("target_url"),
    )
    df = cams.join(api.where(F.contains("target_url", F.lit(".m3u8"))), "cam")
    df = _decoded(first_by(df, ["target_url"], ["url"], ["url", "t"]), "t")
    parts = F.transform(F.slice(segments, 3, 3), slug_title)
    return _rows(
        df, k1=F.col("url"), title=with_location(strip(F.col("t")), parts), source_page_url=F.col("url"),
        predisc_key=urls.merge_key(F.col("target_url")),
    )


def _wildlife_title(text: Column) -> Column:
    t = sub(strip_tags(text), fs.WILDLIFE_APOSTROPHE, "'")
    t = squeeze(sub(t, fs.WILDLIFE_ENTITY, " "))
    t = sub(sub(t, fs.WILDLIFE_PREFIX, ignore_case=True), fs.WILDLIFE_TAIL, ignore_case=True)
    return strip(F.substring(t, 1, fs.WILDLIFE_TITLE_CHARS))


@source("wildlife-trusts")
def wildlife_trusts(pages: DataFrame) -> DataFrame:
    links = matches2(documents(pages, fs.WILDLIFE_INDEX), F.col("body"), fs.WILDLIFE_LINK, ("url", "text"), dot_all=True)
    links = links.where(
        has(F.col("url"), fs.WILDLIFE_IS_CAM, ignore_case=True) & ~has(F.col("url"), fs.WILDLIFE_NOT_CAM, ignore_case=True)
    )
    listed = first_by(links, ["url"], ["part", "pos"], ["text"])
    # The pages lie on many sites. They are read first and joined with the list afterwards, so that no body is shuffled.
    details = usable(pages).where(F.col("url") != fs.WILDLIFE_INDEX).select("url", "body")
    df = extract_candidates(details).join(listed.select("url", _wildlife_title(F.col("text")).alias("title")), "url")
    return _rows(df, k1=F.col("url"), k3=F.col("pos"), category=F.lit("Animals"), source_page_url=F.col("url"))


def windy_corpus(pages: DataFrame) -> DataFrame:
    """(id, title, city, country) out of the landed list pages; a later page wins."""
    item = "struct<id:long,title:string,location:struct<city:string,country:string>>"
    docs = usable(pages).where(F.col("url").startswith(fs.WINDY_LIST)).select(
        "url", F.from_json("body", f"struct<cams:array<{item}>>")["cams"].alias("cams")
    )
    number = lambda p: F.regexp_extract("url", p, 1).try_cast("double")
    at = F.struct(
        (number(r"offset=(\d+)") > 0).alias("deep"), number(r"nearby=(-?[\d.]+)").alias("lat"),
        number(r"nearby=[^,]*,(-?[\d.]+)").alias("lon"), number(r"offset=(\d+)").alias("off"),
    )
    none = F.lit("")
    cams = docs.select(at.alias("at"), F.posexplode("cams").alias("pos", "c")).where(F.col("c.id").isNotNull()).select(
        "at", "pos", F.col("c.id").alias("id"), F.coalesce("c.title", none).alias("title"),
        F.coalesce("c.location.city", none).alias("city"), F.coalesce("c.location.country", none).alias("country"),
    )
    return last_by(cams, ["id"], ["at", "pos"], ["title", "city", "country"])


def windy_streams(pages: DataFrame, corpus: DataFrame, batch: DataFrame) -> DataFrame:
    """Candidates of a probe batch (id, kind, seq) over a corpus (id, title, city, country)."""
    body = F.col("body")
    cam = F.replace("url", F.lit(fs.WINDY_STREAM), F.lit("")).try_cast("long")
    live = (F.length(body) >= fc.MIN_STREAM_PAGE) & has(body, fs.WINDY_IFRAME, ignore_case=True)
    details = pages.where(F.col("url").startswith(fs.WINDY_STREAM)).where(live)
    details = details.select("url", cam.alias("id"), html_unescape("body").alias("body"))
    df = extract_candidates(details, ["id"]).join(batch, "id").join(corpus, "id", "left")
    none = F.lit("")
    place = F.array(F.coalesce("country", none), F.coalesce("city", none))
    return _rows(
        df, k1=F.when(F.col("kind") == "live", "0").otherwise("1"), k2=F.coalesce("seq", "id"), k3=F.col("pos"),
        title=with_location(F.coalesce("title", none), place), source_page_url=F.col("url"),
    )


@source("windy")
def windy(pages: DataFrame) -> DataFrame:
    """Every landed page of the corpus counts: the pages are fetched already, so the budget of one build (`probe_batch`) has no part here."""
    corpus = windy_corpus(pages)
    ids = corpus.select("id")
    return windy_streams(pages, corpus, ids.select("id", F.lit("rotation").alias("kind"), F.col("id").alias("seq")))


def windy_verdicts(pages: DataFrame, batch: DataFrame) -> DataFrame:
    """(id, live) for a probe batch: null where no page was fetched. Verdicts are cut out where the bodies are read."""
    body = F.col("body")
    state = live_page(body, has(body, fs.WINDY_IFRAME, ignore_case=True))
    cam = F.replace("url", F.lit(fs.WINDY_STREAM), F.lit("")).try_cast("long")
    told = pages.where(F.col("url").startswith(fs.WINDY_STREAM)).select(cam.alias("id"), F.when(state != "unknown", state == "live").alias("live"))
    return batch.select("id").join(told, "id", "left")


def windy_turn(pages: DataFrame, state: Rotation, cycle: int, budget: int = fc.PROBE_BUDGET) -> tuple[DataFrame, Turn]:
    """The candidates of one cycle over the pages it landed, and what the state became. `pages` that were landed for other ids than those of the
    batch have no part; a cycle that was taken before gives the candidates of its live set."""
    taken: list[DataFrame] = []

    def probe(batch: DataFrame) -> DataFrame:
        taken.append(batch)
        return windy_verdicts(pages, batch)

    turn = state.run(cycle, lambda: (windy_corpus(pages).withColumn("seq", F.lit(cycle).cast("long")), False), probe, budget)
    batch = taken[0] if taken else state.live.read().select("id", F.lit("live").alias("kind"), F.lit(None).cast("long").alias("seq"))
    return windy_streams(pages, state.corpus.read().drop("seq"), batch), turn


@source("worldcams")
def worldcams(pages: DataFrame) -> DataFrame:
    number = F.regexp_extract("url", r"\?page=(\d+)$", 1).try_cast("int")
    lists = usable(pages).where(F.col("url").startswith(fs.WORLDCAMS_LIST)).withColumn("page_no", number)
    links = matches(lists, F.col("body"), fs.WORLDCAMS_LINK, name="link", keep=["page_no"])
    links = links.join(contiguous_pages(links), "page_no")
    listed = first_by(links, ["link"], ["page_no", "pos"], ["page_no", "pos"]).select(
        F.concat(F.lit(fs.WORLDCAMS_BASE), F.col("link")).alias("url"), F.col("page_no").alias("k2"), F.col("pos").alias("no")
    )
    body = F.col("body")
    named = F.arrays_zip(find_all(body, fs.WORLDCAMS_NAME, 1).alias("sid"), find_all(body, fs.WORLDCAMS_NAME, 2).alias("name"))
    details = usable(pages).where(F.col("url").startswith(fs.WORLDCAMS_BASE + "/") & number.isNull()).select(
        "url", "body", first_or_empty(body, fs.SHORT_H1).alias("h1"), strip(first(body, fs.WORLDCAMS_CATEGORY, 2)).alias("category"),
        named.alias("names"),
    )
    df = extract_candidates(details, ["h1", "category", "names"]).join(listed, "url")
    own = F.filter("names", lambda n: n["sid"] == F.col("angle_key"))
    name = F.coalesce(F.nullif(strip(F.get(own, F.size(own) - 1)["name"]), F.lit("")), strip(F.col("h1")))
    return _rows(
        df, k2=F.col("k2") * 1_000_000 + F.col("no"), k3=F.col("pos"), source_page_url=F.col("url"),
        title=with_location(name, location_parts(F.col("url")), F.col("category")),
    )


@source("youtube-api")
def youtube_api(pages: DataFrame) -> DataFrame:
    """Landed search responses: `part` numbers the windows in the order they were read."""
    item = "struct<id:struct<videoId:string>,snippet:struct<title:string,publishedAt:string>>"
    docs = usable(pages).where(F.col("url").startswith(fs.YT_SEARCH)).select(
        F.col("part").alias("window_no"), F.from_json("body", f"struct<items:array<{item}>>")["items"].alias("items")
    )
    hits = docs.select("window_no", F.posexplode("items").alias("pos", "i")).select(
        "window_no", "pos", F.col("i.id.videoId").alias("video_id"), F.col("i.snippet.title").alias("title")
    )
    df = search_windows(hits)
    watch = F.concat(F.lit(fe.WATCH_URL), F.col("video_id"))
    return _rows(
        df, k2=F.col("window_no"), k3=F.col("pos"), source_page_url=watch, target_url=watch,
        predisc_key=F.concat(F.lit("yt:"), F.col("video_id")),
    )


def live_videos(pages: DataFrame) -> DataFrame:
    """(video_id, category_name) of the landed lookups: only videos that are live now and have not ended."""
    item = (
        "struct<id:string,snippet:struct<liveBroadcastContent:string,categoryId:string>,"
        "liveStreamingDetails:struct<actualEndTime:string>>"
    )
    docs = usable(pages).where(F.col("url").startswith(fs.YT_VIDEOS))
    items = docs.select("part", F.posexplode(F.from_json("body", f"struct<items:array<{item}>>")["items"]).alias("pos", "i"))
    live = items.where(
        (F.col("i.snippet.liveBroadcastContent") == "live") & F.col("i.liveStreamingDetails.actualEndTime").isNull()
    ).select(
        "part", "pos", F.col("i.id").alias("video_id"),
        F.coalesce(lookup(ft.VIDEO_CATEGORY_IDS, F.col("i.snippet.categoryId")), F.lit("")).alias("category_name"),
    )
    return last_by(live, ["video_id"], ["part", "pos"], ["category_name"])


def unmapped_slugs(pages: DataFrame) -> DataFrame:
    """(source, slug): category pages of the crawled sites that have no entry in their tables."""
    camscape_slugs = matches(documents(pages, fs.CAMSCAPE_INDEX), F.col("body"), fs.CAMSCAPE_CATEGORY_PAGE).select(
        F.lit("camscape").alias("source"), last_segment(F.col("m")).alias("slug")
    ).where(~F.col("slug").isin(list(fs.CAMSCAPE_CATEGORY)))
    skyline_slugs = matches(documents(pages, fs.SKYLINE_INDEX), F.col("body"), fs.SKYLINE_SLUG).select(
        F.lit("skyline").alias("source"), F.col("m").alias("slug")
    ).where(~F.col("slug").isin(list(fs.SKYLINE_CATEGORY)))
    viewsurf_slugs = matches(documents(pages, fs.VIEWSURF_SITEMAP), F.col("body"), fs.VIEWSURF_LOC, 2).select(
        F.lit("viewsurf").alias("source"), F.col("m").alias("slug")
    ).where(~F.col("slug").isin(list(fs.VIEWSURF_CATEGORY)))
    return camscape_slugs.union(skyline_slugs).union(viewsurf_slugs).distinct()
