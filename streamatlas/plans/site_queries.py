"""Every source adapter over landed documents that Spark derives from the pages table.

Each page of the table becomes a page of the site (its markup put in front of the whole original document), and the index
documents of the site list them, cut into parts of limited size as a crawler lands them. The expected candidates follow from
the page numbers alone, which is what the SQL states.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed import sites as fs
from ..sources import adapters
from .registry import query, table

_PART = 500
_HOLE = re.compile(r"\{([^{}]+)\}")
OUT = ("title", "angle_key", "category", "source_page_url", "target_url", "predisc_key")


def T(template: str) -> Column:
    """A text with holes like {n} or {n % 5}, as a column."""
    pieces = _HOLE.split(template)
    cols = [F.lit(p) if i % 2 == 0 else F.expr(p).cast("string") for i, p in enumerate(pieces) if p != ""]
    return F.concat(*cols) if cols else F.lit("")


def S(template: str) -> str:
    """The same text as an SQL expression."""
    pieces = _HOLE.split(template)
    parts = ["'" + p.replace("'", "''") + "'" if i % 2 == 0 else f"({p})" for i, p in enumerate(pieces) if p != ""]
    return "(" + " || ".join(parts) + ")"


def numbered(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("n"), F.col("html"))


def index(df: DataFrame, url: str, item: Column, head: str = "", tail: str = "", sep: str = "\n") -> DataFrame:
    """An index document in parts of at most _PART items."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("i")))), lambda x: x["i"])
    return (
        df.groupBy(F.floor(F.col("n") / _PART).cast("int").alias("part"))
        .agg(F.concat(F.lit(head), F.array_join(items, sep), F.lit(tail)).alias("body"))
        .select(F.lit(url).alias("url"), "part", "body")
    )


def pages_of(df: DataFrame, url: Column, markup: Column, whole: bool = True) -> DataFrame:
    body = F.concat(markup, F.lit("\n"), F.col("html")) if whole else markup
    return df.select(url.alias("url"), F.lit(0).alias("part"), body.alias("body"))


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def one(spark, url: str, body: str) -> DataFrame:
    return spark.range(1).select(F.lit(url).alias("url"), F.lit(0).alias("part"), F.lit(body).alias("body"))


def run(name: str, pages: DataFrame) -> DataFrame:
    return adapters.ADAPTERS[name](pages).select(*OUT)


SITE_PAGES = {}


def site(name: str, query_name: str, sql: str):
    """Registers a source over the pages that a function makes; other queries may send the same pages another way."""

    def register(fn):
        SITE_PAGES[name] = fn
        query(query_name, sql)(lambda spark, sf: run(name, fn(spark, sf)))
        return fn

    return register


LISTED = "n % 9 <> 8"
_P = "WITH p AS (SELECT page_id AS n FROM pages), l AS (SELECT n FROM p WHERE n % 9 <> 8) "


def rows(title: str, url: str, target: str, key: str | None, category: str | None = None, angle: str | None = None, where: str = "true") -> str:
    value = lambda v: "CAST(NULL AS VARCHAR)" if v is None else S(v)
    return (
        f"SELECT {S(title)} AS title, {value(angle)} AS angle_key, {value(category)} AS category, {S(url)} AS source_page_url, "
        f"{S(target)} AS target_url, {value(key)} AS predisc_key FROM l WHERE {where}"
    )


def both(*parts: str) -> str:
    return _P + " UNION ALL ".join(parts)


VID = "{lpad('' || n, 11, 'V')}"


@query("source_airportwebcams", both(
    rows("Field {n} Airport", "https://airportwebcams.net/a-{n}/", "https://www.youtube.com/@A{n}/live", None, "Airports", "@A{n}", "n % 3 = 0"),
    rows("Field {n} Airport", "https://airportwebcams.net/a-{n}/", "https://www.youtube.com/channel/UC{n}/live", None, "Airports", "channel/UC{n}", "n % 3 = 0"),
    rows("Field {n} Airport", "https://airportwebcams.net/a-{n}/", "https://www.youtube.com/@Occ{n}/live", None, "Airports", None, "n % 3 = 1"),
    rows("Field {n} Airport", "https://airportwebcams.net/a-{n}/", "https://cdn.example.net/{n}.m3u8", "hls:https://cdn.example.net/{n}.m3u8", "Airports", None, "n % 3 = 2"),
))
def airportwebcams(spark, sf):
    df = numbered(spark, sf)
    links = index(df.where(LISTED), fs.AIRPORT_INDEX, T('<a href="https://airportwebcams.net/a-{n}/">'), "x <strong>Streaming</strong>",
                  '<strong>Still</strong><a href="https://airportwebcams.net/a-8/">')
    late = T("Live streamers with regular broadcasts youtube.com/@Occ{n}")
    mark = (
        F.when(F.expr("n % 3 = 0"), F.concat(T("youtube.com/@A{n} youtube.com/channel/UC{n} youtube.com/@A{n} "), late))
        .when(F.expr("n % 3 = 1"), late).otherwise(T('"https://cdn.example.net/{n}.m3u8"'))
    )
    return run("airportwebcams", union(links, pages_of(df, T("https://airportwebcams.net/a-{n}/"), F.concat(T('<a rel="bookmark" x>Field {n} Airport Webcams </a>'), mark))))


@site("beachcam", "source_beachcam_e9", both(
    *[rows("Praia {n} — Zona {n % 3}, Portugal", "https://beachcam.meo.pt/livecams/p{n}/", f"https://v.example.net/{{n}}/{x}.m3u8?wmsAuthSign=abcdefghij0123456789%2B%2F==",
           f"hls:https://v.example.net/{{n}}/{x}.m3u8", "Beaches", a, w) for x, a, w in (("a", None, "n % 4 > 0"), ("a", "0", "n % 4 = 0"), ("b", "1", "n % 4 = 0"))]))
def beachcam(spark, sf):
    df = numbered(spark, sf)
    links = index(df.where(LISTED), fs.BEACH_INDEX, T('<a href="https://beachcam.meo.pt/livecams/p{n}/">'))
    more = F.when(F.expr("n % 4 = 0"), T('<div data-video-url="https://v.example.net/{n}/b.m3u8">')).otherwise("")
    mark = F.concat(T('<b class="liveCamsHeader__label">LIVECAMS / Zona {n % 3}</b><b class="liveCamsHeader__title">Praia {n}</b><div data-video-url="https://v.example.net/{n}/a.m3u8">'), more)
    return union(links, one(spark, fs.BEACH_TOKEN_API, "abcdefghij0123456789+/==\n"), pages_of(df, T("https://beachcam.meo.pt/livecams/p{n}/"), mark))


_CS = "https://www.camscape.com/webcam/c{n}/"
_CST = "Town {n % 3}, Spain"


@query("source_camscape_j5_g1", both(
    rows("Cam {n} — " + _CST, _CS, "https://www.youtube.com/watch?v=" + VID, "yt:" + VID, "Beaches", "0", "n % 4 = 0"),
    rows(_CST, _CS, "https://www.twitch.tv/ch{n}", None, "Beaches", "1", "n % 4 = 0"),
    rows("Cam {n} — " + _CST, _CS, "https://camsecure.co/HLS/{n}.m3u8", "hls:https://camsecure.co/HLS/{n}.m3u8", "odd-tag", "0", "n % 4 IN (1, 2)"),
    rows("Cam {n} — " + _CST, _CS, "https://www.camsecure.co.uk/none{n}.html", None, None, "0", "n % 4 = 3"),
))
def camscape(spark, sf):
    df = numbered(spark, sf)
    top = one(spark, fs.CAMSCAPE_INDEX, '<a href="https://www.camscape.com/showing/beaches/"><a href="https://www.camscape.com/showing/bears/">')
    link = T(f'<a href="{_CS}">')
    first = index(df.where(LISTED + " AND n % 2 = 0"), fs.CAMSCAPE_INDEX + "beaches/", link, '<a href="https://www.camscape.com/showing/bears/page/2/">')
    second = index(df.where(LISTED + " AND n % 2 = 1"), fs.CAMSCAPE_INDEX + "bears/page/2/", link)
    tag = F.when(F.expr("n % 4 = 0"), 'a/showing/beaches/"').when(F.expr("n % 4 IN (1, 2)"), 'a/showing/odd-tag/"').otherwise('a/showing/culture/"')
    mark = F.concat(tag, T('<a x/location/town-{n % 3}/"><a x/location/spain/">'), F.lit('"streams":'), _camscape_streams(), F.lit(";"))
    player = df.where("n % 4 IN (1, 2)")
    return run("camscape", union(
        top, first, second, pages_of(df, T(_CS), mark),
        pages_of(player, T("https://camsecure.co/httpswebcam/{n}.html"), T('<source src="/HLS/{n}.m3u8">'), False),
        pages_of(df.where("n % 4 = 2"), T("https://www.camsecure.co.uk/page{n}.html"), T('<iframe x src="https://camsecure.co/httpswebcam/{n}.html">'), False),
    ))


def _camscape_streams() -> Column:
    def stream(url: Column, name: Column) -> Column:
        return F.struct(url.alias("url"), name.alias("name"))

    name = T("Cam {n}")
    two = F.array(stream(T("https://www.youtube.com/watch?v=" + VID), name), stream(T("https://player.twitch.tv/?channel=ch{n}&x"), F.lit("")))
    single = F.when(F.expr("n % 4 = 1"), T("https://camsecure.co/httpswebcam/{n}.html")).when(
        F.expr("n % 4 = 2"), T("https://www.camsecure.co.uk/page{n}.html")).otherwise(T("https://www.camsecure.co.uk/none{n}.html"))
    return F.when(F.expr("n % 4 = 0"), F.to_json(two)).otherwise(F.to_json(F.array(stream(single, name))))


_CSU = "https://www.camsecure.co.uk/BrightPier{n}_webcam.html"


@query("source_camsecure", f"""WITH p AS (SELECT page_id AS n FROM pages), l AS (SELECT n, {S(_CSU)} AS u FROM p WHERE n % 9 <> 8),
d AS (SELECT n // 2 AS h, min(u) AS u, arg_min(n, u) AS n FROM l GROUP BY n // 2)
SELECT CASE n % 3 WHEN 0 THEN 'Harbour ' || n WHEN 1 THEN 'Pier ' || n ELSE 'Bright Pier' || n END AS title, CAST(NULL AS VARCHAR) AS angle_key, CAST(NULL AS VARCHAR) AS category, u AS source_page_url,
  'https://camsecure.uk/HLS/s' || h || '.m3u8' AS target_url, 'hls:https://camsecure.uk/HLS/s' || h || '.m3u8' AS predisc_key FROM d""")
def camsecure(spark, sf):
    df = numbered(spark, sf)
    sm = index(df.where(LISTED), fs.CAMSECURE_SITEMAP, T(f"<loc>{_CSU}</loc>"), "<loc>https://www.camsecure.co.uk/</loc><loc>https://www.camsecure.co.uk/faq.html</loc>")
    title = F.when(F.expr("n % 3 = 0"), T("Harbour {n} Live Streaming Webcam")).when(F.expr("n % 3 = 1"), T("Live Shipping Webcam from Pier {n}")).otherwise("Webcam")
    mark = F.concat(F.lit("<title>"), title, F.lit("</title>"), T('<iframe src="https://camsecure.uk/httpswebcam/p{n div 2}.html"></iframe>'))
    return run("camsecure", union(sm, pages_of(df, T(_CSU), mark), pages_of(
        df.select(F.expr("n div 2").alias("n")).distinct(), T("https://camsecure.uk/httpswebcam/p{n}.html"), T('<source x src="/HLS/s{n}.m3u8">'), False)))


@query("source_cxtvlive", both(rows("View {n} — Slug {n}", "https://www.cxtvlive.com/live-camera/slug-{n}", "https://cdn.example.net/{n}.m3u8",
                                    "hls:https://cdn.example.net/{n}.m3u8", "Rivers Lakes")))
def cxtvlive(spark, sf):
    df = numbered(spark, sf)
    sm = index(df.where(LISTED), fs.CXTV_SITEMAP, T("<loc>https://www.cxtvlive.com/live-camera/slug-{n}</loc>"))
    mark = T('<h1 c> View {n} </h1><a href="/cameras/category/rivers-lakes">x "https://cdn.example.net/{n}.m3u8"')
    return run("cxtvlive", union(sm, pages_of(df, T("https://www.cxtvlive.com/live-camera/slug-{n}"), mark)))


_EC = "Place {n} — Town {n % 5}, Land"


@query("source_earthcam_p10_s6", _P.replace("n % 9 <> 8", "true") + " UNION ALL ".join([
    rows(_EC, "https://youtu.be/" + VID, "https://www.youtube.com/watch?v=" + VID, "yt:" + VID, where="n % 4 = 0"),
    rows(_EC, "https://www.earthcam.com/world/x{n}", "https://www.earthcam.com/world/x{n}", None, where="n % 4 = 1"),
    rows(_EC, "https://x.example.org/{n}/stream.m3u8", "https://x.example.org/{n}/stream.m3u8", "hls:https://x.example.org/{n}/stream.m3u8", where="n % 4 = 3")]))
def earthcam(spark, sf):
    df = numbered(spark, sf)
    url = (
        F.when(F.expr("n % 4 = 0"), T("https://youtu.be/" + VID)).when(F.expr("n % 4 = 1"), T("https://www.earthcam.com/world/x{n}"))
        .when(F.expr("n % 4 = 2"), T("https://www.earthcam.com/clients/{n}")).otherwise(T("https://x.example.org/{n}/stream.m3u8"))
    )

    def place(name: Column) -> Column:
        return F.to_json(F.struct(name.alias("name"), url.alias("url"), F.lit("Land").alias("country"), F.lit("").alias("state"), T("Town {n % 5}").alias("city")))

    net = index(df, fs.EARTHCAM_NETWORK, place(T("Place {n}")), '{"status": "ok", "data": [{"places": [', "]}]}", ",")
    glob = index(df.where("n % 2 = 0"), fs.EARTHCAM_GLOBAL, place(T("Copy {n}")), '[{"places": [', "]}]", ",")
    return run("earthcam", union(net, glob))


@query("source_explore", both(rows("Bears {n}", "https://e.example.net/{n}.m3u8", "https://e.example.net/{n}.m3u8", "hls:https://e.example.net/{n}.m3u8", where="n % 3 > 0")))
def explore(spark, sf):
    df = numbered(spark, sf).where(LISTED)
    state = F.when(F.expr("n % 3 = 0"), "offline").otherwise("live")
    item = F.to_json(F.struct(state.alias("state"), T("https://e.example.net/{n}.m3u8").alias("playlistUrl"), T(" Bears {n} ").alias("name")))
    return run("explore", index(df, fs.EXPLORE_API, item, '{"streams": [', "]}", ","))


_FE = "https://www.feratel.com/en/webcams/land-{n % 5}/area-{n % 7}/cam-{n}"


@site("feratel", "source_feratel_e7", both(rows("Lift & Lake {n} — Area {n % 7}, Land {n % 5}", _FE, "https://webtv.feratel.com/webtv/?cam={n}", "feratel:{n}", "Travel & Events", where="n % 3 > 0")))
def feratel(spark, sf):
    df = numbered(spark, sf)
    sm = index(df.where(LISTED), fs.FERATEL_SITEMAP, T(f"<loc>{_FE}</loc>"), "<loc>https://www.feratel.com/en/webcams/land-1</loc>")
    frame = F.when(F.expr("n % 3 > 0"), T('<iframe src="https://w/?cam=1"><iframe x data-src="https://w/?pg=1&cam={n}&d=2">')).otherwise('<iframe src="https://w/?cam=1">')
    return union(sm, pages_of(df, T(_FE), F.concat(T("<title>Webcams in Lift &amp; Lake {n} - Livecams from x</title>"), frame)))


_HD = "https://hdontap.com/stream/{n}/a-{n}/"


@query("source_hdontap_s8", both(
    rows("Bay {n}", _HD, _HD, None, where="n % 2 = 0"), rows("Bay {n}", _HD, "https://www.youtube.com/watch?v=" + VID, "yt:" + VID, where="n % 2 = 1")))
def hdontap(spark, sf):
    df = numbered(spark, sf)
    sm = index(df.where(LISTED), fs.HDONTAP_SITEMAP, T("<loc>https://hdontap.com/stream/{n}/b-{n}/</loc><loc>" + _HD + "</loc>"))
    blob = F.concat(F.lit('<script id="player-data" type="application/json">'), F.to_json(F.struct(T("https://l.example.net/{n}.m3u8?t=1&e=2").alias("streamSrc"))), F.lit("</script>"))
    mark = F.concat(T("<title>Bay {n} Live Webcam - HDOnTap</title>"), F.when(F.expr("n % 2 = 0"), blob).otherwise(T("https://www.youtube.com/embed/" + VID)))
    return run("hdontap", union(sm, pages_of(df, T(_HD), mark), pages_of(df, T("https://hdontap.com/stream/{n}/b-{n}/"), mark)))


_IP = "https://g0.ipcamlive.com/player/player.php?alias="


@site("livefromiceland", "source_livefromiceland", both(
    rows("Foss {n} — Iceland", "https://livefromiceland.is/webcam/f{n}/", _IP + "a{n}", None, where="n % 4 > 0"),
    rows("Foss {n} — Iceland", "https://livefromiceland.is/webcam/f{n}/", _IP + "a{n}", None, None, "0", "n % 4 = 0"),
    rows("Foss {n} — Iceland", "https://livefromiceland.is/webcam/f{n}/", _IP + "b{n}", None, None, "1", "n % 4 = 0")))
def livefromiceland(spark, sf):
    df = numbered(spark, sf)
    item = F.to_json(F.struct(F.col("n").alias("id"), T("https://livefromiceland.is/webcam/f{n}/").alias("link")))
    ix = index(df.where(LISTED), fs.ICELAND_INDEX, item, "[", ', {"link": "https://livefromiceland.is/about/"}]', ",")
    second = F.when(F.expr("n % 4 = 0"), T('data-litespeed-src="' + _IP + 'b{n}"')).otherwise("")
    mark = F.concat(T("<title>Foss {n} – Live From Iceland</title>" + f'<iframe src="about:blank" data-litespeed-src="{_IP}a{{n}}"> again {_IP}a{{n}} '), second)
    return union(ix, pages_of(df, T("https://livefromiceland.is/webcam/f{n}/"), mark))


_L8 = "{lpad('' || n, 8, 'a')}"


@query("source_livespotting_s11", both(
    rows("Ort {n} — Stadt {n % 6}, Land", "https://www.livespotting.tv/deutschland/x/" + _L8, "https://c.example.net/{n}.m3u8", "hls:https://c.example.net/{n}.m3u8", where="n % 2 = 0"),
    rows("Ort {n} — Stadt {n % 6}, Land", "https://www.livespotting.tv/schweiz/y/" + _L8, "https://c.example.net/{n}.m3u8", "hls:https://c.example.net/{n}.m3u8", where="n % 2 = 1 AND n % 5 > 0")))
def livespotting(spark, sf):
    df = numbered(spark, sf)
    de = index(df.where(LISTED + " AND n % 2 = 0"), fs.LIVESPOTTING_BASE + "/deutschland", T('<a href="/deutschland/x/' + _L8 + '">'))
    ch = index(df.where(LISTED), fs.LIVESPOTTING_BASE + "/schweiz", T('<a href="/schweiz/y/' + _L8 + '">'))
    src = F.when(F.expr("n % 2 = 1 AND n % 5 = 0"), "offline").otherwise(T("https://c.example.net/{n}.m3u8"))
    doc = F.to_json(F.struct(src.alias("source"), T("Ort {n}").alias("name"), T("Stadt {n % 6}").alias("city"), F.lit("Land").alias("country")))
    return run("livespotting", union(de, ch, pages_of(df, T("https://player.livespotting.com/v2/livesource/" + _L8 + "?type=hub"), doc, False)))


@site("ozolio", "source_ozolio", both(rows("Keauhou Bay {n}, Hawaii", "https://www.ozolio.com/explore/ABC{n}", "https://www.ozolio.com/explore/ABC{n}", None, where="n % 5 > 0")))
def ozolio(spark, sf):
    df = numbered(spark, sf)
    sm = index(df.where(LISTED), fs.OZOLIO_SITEMAP, T("<loc> https://www.ozolio.com/explore/ABC{n} </loc>"), "<loc>https://www.ozolio.com/about</loc>")
    title = F.when(F.expr("n % 5 = 0"), "<title>Ozolio</title>").otherwise(T("<title>Keauhou Bay {n}, Hawaii - Webcam - Ozolio</title>"))
    return union(sm, pages_of(df, T("https://www.ozolio.com/explore/ABC{n}"), title))


@query("source_resortcams", both(rows("Slope {n}", "https://www.resortcams.com/webcams/s{n}/", "https://stream.example.net/live/{n}.stream/playlist.m3u8",
                                      "hls:https://stream.example.net/live/{n}.stream/playlist.m3u8")))
def resortcams(spark, sf):
    df = numbered(spark, sf)
    sm = index(df.where(LISTED), fs.RESORT_SITEMAP, T("<loc>https://www.resortcams.com/webcams/s{n}/</loc>"))
    mark = T('<title>Slope {n} - Resort Cams</title><div data-src="https://stream.example.net/live/{n}.stream/playlist.m3u8">')
    return run("resortcams", union(sm, pages_of(df, T("https://www.resortcams.com/webcams/s{n}/"), mark)))


@query("source_shareju_s9", both(
    rows("川{n} — 港区{n % 3}, 東京", "https://its-i.com/c/{n}", "https://www.youtube.com/watch?v=" + VID, "yt:" + VID, "Rivers Lakes", where="n % 3 = 0"),
    rows("東京{n} — 港区{n % 3}", "https://its-i.com/c/{n}", "https://frame.example.net/{n}", None, None, where="n % 3 = 1")))
def shareju(spark, sf):
    df = numbered(spark, sf).where(LISTED)
    k = F.expr("n % 3")
    name = F.concat(F.lit("【ライブカメラ映像再生】"), F.when(k == 1, T("東京{n}")).otherwise(T("川{n}")), F.lit("【Share-Ju】公開カメラ"))
    embed = F.when(k == 0, T("https://www.youtube.com/embed/" + VID + "\n")).otherwise(T("https://frame.example.net/{n}"))
    tags = F.when(k == 0, "景色 河川 道路").otherwise("景色")
    addr = F.struct(F.struct(T("港区{n % 3}…").alias("addressLocality"), F.lit("東京").alias("addressRegion")).alias("address"))
    kind = F.when(k == 2, "ImageObject").otherwise("VideoObject")
    item = F.to_json(F.struct(F.struct(
        kind.alias("@type"), name.alias("name"), embed.alias("embedUrl"), T("https://its-i.com/c/{n}").alias("url"),
        F.concat(F.lit("このカメラに付されているタグ（"), tags, F.lit("）")).alias("description"), addr.alias("locationCreated")).alias("item")))
    # A raw line end inside a string, as the site writes it.
    item = F.replace(item, F.lit("\\n"), F.lit("\n"))
    head = '<script type="application/ld+json">{"@type": "WebSite"}</script><script type="application/ld+json">{"@type": "ItemList", "itemListElement": ['
    return run("shareju", index(df, fs.SHAREJU_INDEX, item, head, "]}</script>", ","))


_SK = "https://www.skylinewebcams.com/en/webcam/land/area/c{n}.html"


@query("source_skyline_j3_g1", both(
    rows("Place {n} — Area {n % 4}, Land", _SK, _SK, None, "Beaches", where="n % 3 = 0"),
    rows("Place {n} — Area {n % 4}, Land", _SK, "https://www.youtube.com/watch?v=" + VID, "yt:" + VID, "odd", where="n % 3 = 1"),
    rows("Place {n} — Area {n % 4}, Land", _SK, _SK, None, None, where="n % 3 = 2")))
def skyline(spark, sf):
    df = numbered(spark, sf)
    base = fs.SKYLINE_BASE
    top = one(spark, fs.SKYLINE_INDEX, "/en/live-cams-category/beach-cams.html /en/live-cams-category/odd-cams.html /en/live-cams-category/live-web-cams.html")
    link = T('<a href="en/webcam/land/area/c{n}.html">')
    beach = index(df.where(LISTED + " AND n % 3 = 0"), base + "/en/live-cams-category/beach-cams.html", link, '<a href="/en/webcam/land.html">')
    odd = index(df.where(LISTED + " AND n % 3 <= 1"), base + "/en/live-cams-category/odd-cams.html", link, '<a href="/en/webcam/never.html">')
    land = one(spark, base + "/en/webcam/land.html", '<a href="/en/webcam/land/area.html" class="btn x tag">')
    area = index(df.where(LISTED + " AND n % 3 = 2"), base + "/en/webcam/land/area.html", link, '<a href="/en/webcam/land.html" class="btn tag">')
    never = one(spark, base + "/en/webcam/never.html", '<a href="en/webcam/land/area/c8.html">')
    crumb = T('<h1 x>Place {n} live cam</h1><ol class="breadcrumb"><span itemprop="name">Land</span><span itemprop="name">Area {n % 4} </span></ol>')
    player = F.when(F.expr("n % 3 = 1"), T("videoId:'" + VID + "'")).otherwise(T("source:'livee.m3u8?a=tok{n}'"))
    return run("skyline", union(top, beach, odd, land, area, never, pages_of(df, T(_SK), F.concat(crumb, player))))


_TO = "https://tomarigi.me/spot/{lpad('' || n, 36, '0')}"


@query("source_tomarigi_s10", both(
    *[rows("Cam {n}", _TO, "https://www.youtube.com/watch?v=" + VID, "yt:" + VID, c, where=f"n % 4 = {k}") for k, c in ((0, "Beaches"), (1, None), (2, "新しい"))]))
def tomarigi(spark, sf):
    df = numbered(spark, sf)
    sm = index(df.where(LISTED), fs.TOMARIGI_SITEMAP, T(f"<loc>{_TO}</loc>"))
    word = F.when(F.expr("n % 4 = 0"), "海").when(F.expr("n % 4 = 1"), "河川・道路").otherwise("新しい")
    kind = F.when(F.expr("n % 4 = 3"), "Thing").otherwise("VideoObject")
    doc = F.to_json(F.struct(kind.alias("@type"), T(" Cam {n}").alias("name"), T("https://www.youtube.com/watch?v=" + VID).alias("contentUrl"),
                             F.concat(F.lit("説明(提供: x)。"), word, F.lit("のライブカメラを地図から探せる")).alias("description")))
    mark = F.concat(F.lit('<script type="application/ld+json">{"@type": "WebSite"}</script><script type="application/ld+json" x>'),
                    F.replace(doc, F.lit('"'), F.lit("&quot;")), F.lit("</script>"))
    return run("tomarigi", union(sm, pages_of(df, T(_TO), mark)))


_VS = "https://www.viewsurf.com/univers/{CASE WHEN n % 3 = 0 THEN 'plage' ELSE 'autre' END}/vue/{n}-france-paca-v"


@site("viewsurf", "source_viewsurf", both(
    rows("Nice Cam {n} — France", _VS, "https://platforms5.joada.net/embeded/embeded.html?uuid=ab-{n}&type=live", None, "{CASE WHEN n % 3 = 0 THEN 'Beaches' ELSE 'autre' END}", where="n % 4 > 0")))
def viewsurf(spark, sf):
    df = numbered(spark, sf)
    # Cams of three thirds are listed under an unknown section first; a third of them under a known one as well.
    sm = index(df.where(LISTED), fs.VIEWSURF_SITEMAP, T("<loc>https://www.viewsurf.com/univers/autre/vue/{n}-france-paca-v</loc><loc>" + _VS + "</loc>"))
    frame = F.when(F.expr("n % 4 > 0"), T('<iframe src="https://platforms8.joada.net/embeded/embeded.html?uuid=ab-{n}&amp;type=live&t=1">')).otherwise("")
    mark = F.concat(T("<h1>Nice <small>Cam {n}</small></h1>"), frame)
    other = pages_of(df.where("n % 3 = 0"), T("https://www.viewsurf.com/univers/autre/vue/{n}-france-paca-v"), mark)
    return union(sm, pages_of(df, T(_VS), mark), other)


@query("source_webcamerapl_c9_p26_u2", both(
    rows("Plaża {n}", "https://cam-{n}.webcamera.pl/", "https://hoktastream.example.pl/{n}.m3u8", "hls:https://hoktastream.example.pl/{n}.m3u8", None, where="n % 3 = 0"),
    rows("Molo {n}", "https://cam-{n}.webcamera.pl/", "https://hoktastream.example.pl/{n}.m3u8", "hls:https://hoktastream.example.pl/{n}.m3u8", "Rivers Lakes", where="n % 3 = 1"),
    rows("Cam {n}", "https://www.webcamera.pl/kamera/cam-{n}/", "https://hoktastream.example.pl/{n}.m3u8", "hls:https://hoktastream.example.pl/{n}.m3u8", "Mountains", where="n % 3 = 2 AND n % 5 > 0")))
def webcamerapl(spark, sf):
    df = numbered(spark, sf)
    k = F.expr("n % 3")
    page = F.when(k == 2, T("https://www.webcamera.pl/kamera/cam-{n}/")).otherwise(T("https://cam-{n}.webcamera.pl/"))
    mark = F.struct(page.alias("url"), F.when(k == 0, T("Plaża {n}")).otherwise(T("Playlist {n}")).alias("name"), F.lit(False).alias("is_inactive"))
    entry = F.concat(F.lit('"'), F.col("n"), F.lit('": '), F.to_json(mark))
    # Marked compilations are skipped even where a listing names them.
    on_map = index(df.where(LISTED + " AND (n % 3 = 0 OR (n % 3 = 2 AND n % 5 = 0))"), fs.WEBCAMERA_MAP, entry, "<script>var MAP_MARKERS = {", "}; var x = {};</script>", ",")
    link = F.concat(F.lit('<a href="'), page, F.lit('x">'))
    lakes = index(df.where(LISTED + " AND n % 3 = 1"), fs.WEBCAMERA_BASE + "/kategoria,mazury", link, 'a <div id="inline-camera-listing">', '<div class="searchbox-cams"><a href="https://cam-8.webcamera.pl/">')
    hills = index(df.where(LISTED + " AND n % 3 >= 1"), fs.WEBCAMERA_BASE + "/kategoria,gory", link, '<div id="inline-camera-listing">')
    h1 = F.when(k == 1, T('<h1 id="cam-description-toggler"> Molo {n} - nowość</h1>')).otherwise("")
    from ..functions.text import rot13

    src = F.replace(rot13(T("https://hoktastream.example.pl/{n}.m3u8")), F.lit("/"), F.lit("\\/"))
    return run("webcamerapl", union(on_map, lakes, hills, pages_of(df, page, F.concat(h1, F.lit('{"video_src":"'), src, F.lit('"}')))))


_WU = "https://www.whatsupcams.com/en/webcams/croatia/istria/town-{n % 5}/c{n}/"


@query("source_whatsupcams_s3", both(rows("Riva & Port {n} — Town {n % 5}, Istria, Croatia", _WU, "https://cdn.example.net/{n}.m3u8", "hls:https://cdn.example.net/{n}.m3u8", where="n % 4 > 0")))
def whatsupcams(spark, sf):
    df = numbered(spark, sf)
    top = one(spark, fs.WHATSUP_INDEX, "<loc>https://www.whatsupcams.com/webcams-sitemap1.xml</loc><loc>https://www.whatsupcams.com/post-sitemap.xml</loc><loc>https://evil.example.org/webcams-sitemap2.xml</loc>")
    sm = index(df.where(LISTED), "https://www.whatsupcams.com/webcams-sitemap1.xml", T(f"<loc>{_WU}</loc>"), "<loc>https://www.whatsupcams.com/en/webcams/</loc>")
    bad = index(df.where("n % 9 = 8"), "https://evil.example.org/webcams-sitemap2.xml", T(f"<loc>{_WU}</loc>"))
    mark = T('<meta property="og:title" content="Riva &amp; Port {n}"> services.whatsupcams.com/wgt/id{n}/')
    url = F.when(F.expr("n % 4 = 0"), "").otherwise(T("https://cdn.example.net/{n}.m3u8"))
    api = pages_of(df, T("https://www.whatsupcams.com/cdn-api/streams/id{n}"), F.to_json(F.struct(F.struct(url.alias("url")).alias("hls"))), False)
    return run("whatsupcams", union(top, sm, bad, pages_of(df, T(_WU), mark), api))


@query("source_wildlife_trusts_p25", both(rows("Barn Owl {n}", "https://trust{n % 7}.example.org/webcam/{n}", "https://www.youtube.com/watch?v=" + VID, "yt:" + VID, "Animals")))
def wildlife_trusts(spark, sf):
    df = numbered(spark, sf)
    link = T('<a x href="https://trust{n % 7}.example.org/webcam/{n}" y><b>Surrey Wildlife Trust</b> Barn Owl {n} Watch it&nbsp;live</a><a href="https://facebook.com/webcam">f</a>'
             '<a href="https://trust{n % 7}.example.org/webcam/{n}">again</a>')
    ix = index(df.where(LISTED), fs.WILDLIFE_INDEX, link)
    return run("wildlife-trusts", union(ix, pages_of(df, T("https://trust{n % 7}.example.org/webcam/{n}"), T('<iframe src="https://www.youtube.com/embed/' + VID + '">'))))


@query("source_windy_p27", both(rows("Cam {n} — City {n % 4}, Land", "https://webcams.windy.com/webcams/stream/{n}", "https://e.example.net/a?x=1&id={n}", None, where="n % 5 > 0")))
def windy(spark, sf):
    return run("windy", windy_pages(spark, sf))


def windy_pages(spark, sf) -> DataFrame:
    df = numbered(spark, sf)
    cam = F.to_json(F.struct(F.col("n").alias("id"), T("Cam {n}").alias("title"), F.struct(T("City {n % 4}").alias("city"), F.lit("Land").alias("country")).alias("location")))
    lists = index(df.where(LISTED), fs.WINDY_LIST + "1.0,2.0&radius=250&limit=25&offset=0", cam, '{"total": 5, "cams": [', "]}", ",")
    frame = T('<iframe src="https://e.example.net/a?x=1&amp;id={n}"></iframe>')
    live = pages_of(df.where("n % 5 > 0"), T("https://webcams.windy.com/webcams/stream/{n}"), frame)
    stub = pages_of(df.where("n % 5 = 0"), T("https://webcams.windy.com/webcams/stream/{n}"), frame, False)
    return union(lists, live, stub)


_WC = "https://worldcams.tv/italy/c{n}/"
_WC_PAGE = 20  # streams of a list page
# The list page at three quarters of the listing is missing, so later ones do not count.
_BEFORE_GAP = f"n // {_WC_PAGE} < (SELECT max(page_id) FROM pages) // {_WC_PAGE} * 3 // 4"


@query("source_worldcams_s4_j4", both(
    rows("Beach {n} C{n} — Italy", "https://worldcams.tv/italy/c{n}/", "https://a.example.net/{n}", None, "Beaches", "7", _BEFORE_GAP),
    rows("View {n} — C{n}, Italy", "https://worldcams.tv/italy/c{n}/", "https://b.example.net/{n}", None, "Beaches", "8", _BEFORE_GAP)))
def worldcams(spark, sf):
    df = numbered(spark, sf)
    last = df.agg(F.max("n")).first()[0] or 0
    page = F.expr(f"n div {_WC_PAGE}")
    gap = last // _WC_PAGE * 3 // 4
    listing = df.where(LISTED).select("n", (1 + page + F.when(page >= gap, 1).otherwise(0)).alias("no"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("n", T('<b class="cam-promo__title" x> <a href="/italy/c{n}/">').alias("i")))), lambda x: x["i"])
    lists = listing.groupBy("no").agg(F.array_join(items, "").alias("body")).select(
        F.concat(F.lit(fs.WORLDCAMS_LIST), F.col("no")).alias("url"), F.lit(0).alias("part"), "body"
    )
    mark = T('<h1>View {n}</h1>Category: <a href="/beaches/">Beaches</a><a id="streams__item_7" x> Beach {n} C{n} </a>'
             "streams[7] = '<iframe src=\"https://a.example.net/{n}\">'; streams[8] = '<iframe src=\"https://b.example.net/{n}\">';")
    return run("worldcams", union(lists, pages_of(df, T(_WC), mark)))


@query("source_youtube_api_s13", """
WITH h AS (SELECT CAST(epoch(date_trunc('day', ts)) / 86400 AS BIGINT) * 100000000 + event_id // 50 AS w, 'v' || user_id AS v, event_id FROM events),
f AS (SELECT v, min(w) AS w, arg_min('T' || event_id, w * 1000 + event_id % 50) AS title FROM h GROUP BY v),
n AS (SELECT x.w, count(f.v) AS new FROM (SELECT DISTINCT w FROM h) x LEFT JOIN f USING (w) GROUP BY ALL),
r AS (SELECT *, coalesce(sum(new) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen,
  coalesce(min(new) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS least FROM n)
SELECT title, CAST(NULL AS VARCHAR) AS angle_key, CAST(NULL AS VARCHAR) AS category, 'https://www.youtube.com/watch?v=' || v AS source_page_url, 'https://www.youtube.com/watch?v=' || v AS target_url, 'yt:' || v AS predisc_key
FROM f JOIN r USING (w) WHERE least > 0""")
def youtube_api(spark, sf):
    ev = table(spark, sf, "events")
    day = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400)
    window_no = day * 100_000_000 + F.floor(F.col("event_id") / 50)
    # A landed window holds at most fifty hits, as the search answers them.
    hit = F.struct("event_id", F.struct(F.concat(F.lit("v"), F.col("user_id")).alias("videoId")).alias("id"),
                   F.struct(F.concat(F.lit("T"), F.col("event_id")).alias("title")).alias("snippet"))
    docs = ev.groupBy(window_no.alias("part")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(hit)).alias("items"))).alias("body"))
    return run("youtube-api", docs.select(F.lit(fs.YT_SEARCH).alias("url"), "part", "body"))


@query("unmapped_slugs_c3c", """
SELECT DISTINCT 'viewsurf' AS source, 'u' || page_id % 7 AS slug FROM pages WHERE page_id % 7 < 5 UNION ALL
SELECT DISTINCT 'camscape', 'k' || page_id % 3 FROM pages UNION ALL SELECT DISTINCT 'skyline', 'z' || page_id % 4 FROM pages""")
def unmapped_slugs(spark, sf):
    df = numbered(spark, sf)
    slug = F.when(F.expr("n % 7 < 5"), T("u{n % 7}")).otherwise("plage")
    vs = index(df, fs.VIEWSURF_SITEMAP, F.concat(F.lit("<loc>https://www.viewsurf.com/univers/"), slug, T("/vue/{n}-fr-x</loc>")))
    cs = index(df, fs.CAMSCAPE_INDEX, T('<a href="https://www.camscape.com/showing/k{n % 3}/"><a href="https://www.camscape.com/showing/bears/">'))
    sk = index(df, fs.SKYLINE_INDEX, T("/en/live-cams-category/z{n % 4}-cams.html /en/live-cams-category/beach-cams.html"))
    return adapters.unmapped_slugs(union(vs, cs, sk))

