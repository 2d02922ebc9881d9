"""Queries over documents: scans, metadata, the extraction ladder, resolution, manifests, reachability and probe planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.regex import first, first_or_empty
from ..operators import extract, graph, keyed, liveness, manifests, probe, resolve
from .registry import query, table


def documents(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id"), "url", F.lit(0).alias("part"), F.col("html").alias("body"))


@query("page_scan_s1", "SELECT page_id, length(html) AS n FROM pages WHERE page_id % 6 <> 0")
def page_scan(spark, sf):
    docs = documents(spark, sf)
    n = F.col("page_id")
    body = F.when(n % 6 == 0, F.when(n % 4 == 0, "")).otherwise(F.col("body"))
    return extract.usable(docs.withColumn("body", body)).select("page_id", F.length("body").cast("long").alias("n"))


@query("page_links_s2", r"""
SELECT DISTINCT link FROM (SELECT unnest(regexp_extract_all(html, '<a href="(/[^"]+)"', 1)) AS link FROM pages)""")
def page_links(spark, sf):
    return extract.matches(documents(spark, sf), F.col("body"), r'<a href="(/[^"]+)"', name="link").select("link").distinct()


@query("section_links_s5", r"""
WITH s AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN substr(html, strpos(html, '<nav>'))
   ELSE substr(html, strpos(html, '<nav>'), strpos(html, '</nav>') - strpos(html, '<nav>')) END AS sec FROM pages),
l AS (SELECT page_id, unnest(regexp_extract_all(sec, 'href="([^"]*)"', 1)) AS link FROM s)
SELECT page_id, link, count(*) AS n FROM l GROUP BY ALL""")
def section_links(spark, sf):
    docs, n = documents(spark, sf), F.col("page_id")
    # A page without the start marker, and one without the end marker.
    body = F.when(n % 5 == 0, F.replace("body", F.lit("<nav>"), F.lit("<div>"))).when(
        n % 5 == 1, F.replace("body", F.lit("</nav>"), F.lit(""))
    ).otherwise(F.col("body"))
    sec = extract.section(body, "<nav>", "</nav>")
    links = extract.matches(docs, sec, r'href="([^"]*)"', name="link", keep=["page_id"])
    return links.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query("paged_listing_s4", """
WITH p AS (SELECT page_id + 1 AS page_no, (SELECT count(*) FROM pages) * 3 // 4 AS gap FROM pages)
SELECT page_no FROM p WHERE page_no < gap""")
def paged_listing(spark, sf):
    """Every document is a list page of its own; the one at three quarters of the listing is missing."""
    gap = table(spark, sf, "pages").count() * 3 // 4
    n = F.col("page_id") + 1
    return probe.contiguous_pages(documents(spark, sf).where(n != gap).select(n.alias("page_no")))


@query("page_meta_e5", r"""
SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)', 1)) AS title, trim(regexp_extract(html, '<h1[^>]*>([^<]{1,120})</h1>', 1)) AS h1,
  CASE WHEN page_id % 3 = 0 THEN upper(substr(regexp_extract(html, 'lang="([a-z]*)"', 1), 1, 1)) || substr(regexp_extract(html, 'lang="([a-z]*)"', 1), 2)
    ELSE trim(regexp_extract(html, '<title>([^<]*)', 1)) END AS name FROM pages""")
def page_meta(spark, sf):
    from ..functions.text import slug_title, strip

    body = F.col("body")
    title = strip(first_or_empty(body, r"<title>([^<]*)"))
    lang = slug_title(first(body, r'lang="([a-z]*)"'))
    name = F.coalesce(F.when(F.col("page_id") % 3 == 0, lang), F.nullif(title, F.lit("")))
    return documents(spark, sf).select(
        "page_id", title.alias("title"), strip(first_or_empty(body, r"<h1[^>]*>([^<]{1,120})</h1>")).alias("h1"),
        F.coalesce(name, title).alias("name"),
    )


@query("page_category_e6", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Beaches' WHEN 1 THEN 'Animals' WHEN 2 THEN 'new-tag' END AS category FROM pages""")
def page_category(spark, sf):
    from ..fixed import sites as fs
    from ..functions.regex import find_all

    n = F.col("page_id") % 4
    links = (
        F.when(n == 0, '<a href="/showing/odd/"><a href="/showing/beaches/"><a href="/showing/bears/">')
        .when(n == 1, '<a href="/showing/bears/"><a href="/showing/beaches/">')
        .when(n == 2, '<a href="/showing/culture/"><a href="/showing/new-tag/">')
        .otherwise('<a href="/showing/culture/">')
    )
    tags = find_all(F.concat("body", links), fs.CAMSCAPE_TAG)
    cat = F.coalesce(extract.first_mapped(fs.CAMSCAPE_CATEGORY, tags), extract.first_unknown(fs.CAMSCAPE_CATEGORY, tags))
    return documents(spark, sf).select("page_id", cat.alias("category"))


# --- the extraction ladder over pages that carry embeds chosen by their number ------------------------------------------

def embedded_pages(spark, sf):
    n = F.col("page_id")
    c = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    vid = F.lpad(n.cast("string"), 11, "V")
    frame = c('<iframe class="p" src="/player/', n, '"></iframe>')
    two = c('x="https://www.youtube.com/embed/', vid, '" y="https://cdn.example.net/', n, '.m3u8?a=1" z="//www.youtube.com/watch?v=', vid, '"')
    angles = c("streams[11] = '<iframe src=\\\"https://a.example.net/", n, "\\\">'; streams[12] = \"<iframe src=\\\"/rel/", n,
               "\\\">\"; streams[13]='<iframe src=\\\"https://a.example.net/", n, ".jpg?x\\\">';")
    gtm = c('<iframe src="https://www.googletagmanager.com/ns.html?id=', n, '"></iframe>')
    channel = c('Source: <a href="https://www.youtube.com/@hidden">x</a> <a href="https://www.youtube.com/@Chan', n, '/videos">')
    embed = (
        F.when(n % 7 == 0, frame).when(n % 7 == 1, two).when(n % 7 == 2, angles).when(n % 7 == 3, gtm).when(n % 7 == 4, channel)
        .when(n % 7 == 5, c('<b data="https://worldcams.tv/player?url=https%3A%2F%2Fh%2F', n, '.m3u8">'))
        .otherwise("")
    )
    url = c("https://cams.example.org/c/", n, "/page.html")
    return documents(spark, sf).select("page_id", url.alias("url"), F.concat(embed, F.col("body")).alias("body"))


_BASE = "'https://cams.example.org/c/' || page_id || '/page.html'"


@query("extract_ladder_e1_e2_e3_e4", f"""
WITH p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS n, lpad(CAST(page_id AS VARCHAR), 11, 'V') AS vid FROM pages),
x AS (
  SELECT page_id, NULL AS angle_key, 'https://cams.example.org/player/' || n AS target_url, NULL AS predisc_key FROM p WHERE page_id % 7 = 0
  UNION ALL SELECT page_id, '0', 'https://www.youtube.com/watch?v=' || vid, 'yt:' || vid FROM p WHERE page_id % 7 = 1
  UNION ALL SELECT page_id, '2', 'https://cdn.example.net/' || n || '.m3u8?a=1', 'hls:https://cdn.example.net/' || n || '.m3u8?a=1' FROM p WHERE page_id % 7 = 1
  UNION ALL SELECT page_id, '11', 'https://a.example.net/' || n, NULL FROM p WHERE page_id % 7 = 2
  UNION ALL SELECT page_id, '12', 'https://cams.example.org/rel/' || n, NULL FROM p WHERE page_id % 7 = 2
  UNION ALL SELECT page_id, NULL, 'https://www.youtube.com/@Chan' || n || '/live', NULL FROM p WHERE page_id % 7 = 4
  UNION ALL SELECT page_id, '0', 'https://worldcams.tv/player?url=https%3A%2F%2Fh%2F' || n || '.m3u8', 'hls:https://h/' || n || '.m3u8' FROM p WHERE page_id % 7 = 5)
SELECT page_id, angle_key, target_url, predisc_key FROM x""")
def extract_ladder(spark, sf):
    return extract.extract_candidates(embedded_pages(spark, sf), ["page_id"]).select("page_id", "angle_key", "target_url", "predisc_key")


@query("stream_names_j4", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Cam ' || page_id WHEN 1 THEN 'H1 ' || page_id ELSE 'H1 ' || page_id END AS name FROM pages""")
def stream_names(spark, sf):
    from ..fixed import sites as fs

    n = F.col("page_id")
    marks = F.when(n % 3 == 0, F.concat(F.lit('<a id="streams__item_7" x> Cam '), n, F.lit("</a>"))).otherwise('<a id="streams__item_8">Other</a>')
    docs = documents(spark, sf).withColumn("body", F.concat(marks, F.col("body")))
    names = extract.matches2(docs, F.col("body"), fs.WORLDCAMS_NAME, ("angle_key", "name"), ["page_id"]).select("page_id", "angle_key", "name")
    rows = documents(spark, sf).select("page_id", F.lit("7").alias("angle_key"), F.concat(F.lit("H1 "), n).alias("h1"))
    joined = rows.join(names, ["page_id", "angle_key"], "left")
    return joined.select("page_id", F.coalesce(F.nullif("name", F.lit("")), F.col("h1")).alias("name"))


@query("two_hop_j5", """
SELECT a.page_id AS page_id, c.url AS url FROM pages a JOIN pages b ON b.page_id = a.page_id + 1 JOIN pages c ON c.page_id = b.page_id + 2
WHERE a.page_id % 4 = 0""")
def two_hop(spark, sf):
    hop = table(spark, sf, "pages").select(F.col("page_id"), "url")
    a = hop.where(F.col("page_id") % 4 == 0).select("page_id", (F.col("page_id") + 1).alias("b"))
    b = hop.select(F.col("page_id").alias("b"), (F.col("page_id") + 2).alias("c"))
    return a.join(b, "b").join(hop.select(F.col("page_id").alias("c"), "url"), "c").select("page_id", "url")


@query("canonical_targets_e8_e7", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://www.twitch.tv/chan' || page_id WHEN 1 THEN 'https://webtv.feratel.com/webtv/?cam=' || page_id
  ELSE 'https://platforms5.joada.net/embeded/embeded.html?uuid=ab-' || page_id || '&type=live' END AS target FROM pages""")
def canonical_targets(spark, sf):
    from ..fixed import sites as fs

    n, body = F.col("page_id"), F.col("body")
    mark = (
        F.when(n % 3 == 0, F.concat(F.lit('src="https://player.twitch.tv/?x=1&channel=chan'), n, F.lit('&p"')))
        .when(n % 3 == 1, F.concat(F.lit('<iframe src="https://w/?cam=9"><iframe data-src="https://w/?pg=1&cam='), n, F.lit('&d=2">')))
        .otherwise(F.concat(F.lit('platforms12.joada.net/embeded/embeded.html?uuid=ab-'), n, F.lit('&amp;type=live&t=9"')))
    )
    docs = documents(spark, sf).select("page_id", F.concat(mark, F.lit("\n"), body).alias("body"))
    target = F.coalesce(
        F.concat(F.lit(fs.TWITCH_URL), first(body, fs.TWITCH_CHANNEL)),
        F.concat(F.lit(fs.FERATEL_URL), first(body, fs.FERATEL_PLAYER)),
        F.concat(F.lit(fs.VIEWSURF_URL), first(body, fs.VIEWSURF_EMBED), F.lit("&type="), first(body, fs.VIEWSURF_EMBED, 2)),
    )
    return docs.select("page_id", target.alias("target"))


@query("feed_json_s6_c12", """
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events
WHERE event_id % 3 <> 2""")
def feed_json(spark, sf):
    ev = table(spark, sf, "events")
    n = F.col("event_id") % 3
    # An object that wraps the list, a bare list, and a body that is no JSON.
    body = F.when(n == 0, F.concat(F.lit('{"data": ['), "props", F.lit("]}"))).when(n == 1, F.concat(F.lit("["), "props", F.lit("] tail"))).otherwise("<html>")
    wrapped = F.from_json("body", "struct<data:array<struct<k:long>>>")["data"]
    bare = F.when(F.ltrim("body").startswith("["), F.from_json("body", "array<struct<k:long>>"))
    return ev.select("event_id", body.alias("body")).select("event_id", F.inline(F.coalesce(wrapped, bare)))


@query("prefix_json_s7", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def prefix_json(spark, sf):
    page = F.concat(F.lit('<script>var x = 1; "streams": '), F.lit("["), "props", F.lit('], "more": [1]; if (a[0]) {}</script>'))
    part = extract.from_marker(page, '"streams":', "[")
    return table(spark, sf, "events").select("event_id", F.inline(F.from_json(part, "array<struct<k:long>>")))


@query("script_json_s8", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'https://live.example.net/' || event_id || '/a.m3u8?t=1&e=2' END AS stream FROM events""")
def script_json(spark, sf):
    n = F.col("event_id")
    c = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    body = (
        F.when(n % 3 == 0, c('<script type="application/json" id="player-data" type="application/json">{"id": 1, "streamSrc": "https://live.example.net/', n,
                             '/a.m3u8?t=1\\u0026e=2", "p": ', F.col("props"), "}</script>"))
        .when(n % 3 == 1, c('<script id="player-data">{"streamSrc": ', n, "}</script>"))
        .otherwise(c("<p>", n, "</p>"))
    )
    return table(spark, sf, "events").select("event_id", resolve.embedded_stream(body).alias("stream"))


@query("live_lookup_s12", """
SELECT o_custkey AS video_id, CASE WHEN max(o_orderkey) % 4 = 0 THEN 'Gaming' ELSE '' END AS category_name FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey""")
def live_lookup(spark, sf):
    from ..sources.adapters import live_videos
    from ..fixed import sites as fs

    k = F.col("o_orderkey")
    c = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    state = F.when(k % 6 == 0, "none").otherwise("live")
    ended = F.when((k % 3 == 0) & (k % 6 != 0), '"actualEndTime": "2024-01-01T00:00:00Z"').otherwise("")
    cat = F.when(k % 4 == 0, "20").otherwise("999")
    item = c('{"items": [{"id": "', F.col("o_custkey"), '", "snippet": {"liveBroadcastContent": "', state, '", "categoryId": "', cat,
             '"}, "liveStreamingDetails": {', ended, "}}]}")
    docs = table(spark, sf, "orders").select(F.lit(fs.YT_VIDEOS).alias("url"), k.alias("part"), item.alias("body"))
    return live_videos(docs).select(F.col("video_id").cast("long").alias("video_id"), "category_name")


# --- resolution -----------------------------------------------------------------------------------------------------------

_KINDS = (
    "https://balticlivecam.com/cameras/", "https://www.ipcamlive.com/alias", "https://webtv.feratel.com/webtv/?cam=",
    "https://api.wetmet.net/widgets/stream/frame.php?uid=", "https://www.skylinewebcams.com/en/webcam/x/", "https://www.earthcam.com/usa/",
    "https://hdontap.com/stream/", "https://www.ozolio.com/explore/", "https://platforms5.joada.net/embeded/embeded.html?type=live&uuid=",
    "https://www.youtube.com/watch?v=", "https://cdn.example.net/a.m3u8?id=", "https://unknown.example.net/",
)
_K = len(_KINDS)


def resolution_inputs(spark, sf):
    """Targets, documents, tool output and manifests of all kinds, one target per order; every fifth one has something wrong."""
    from ..fixed import embeds as fe

    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select(k.alias("k"))
    k = F.col("k")
    kind = (k % _K).cast("int")
    c = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    target = F.concat(F.element_at(F.array(*[F.lit(x) for x in _KINDS]), kind + 1), k)
    t = orders.select("k", kind.alias("kind"), target.alias("target_url"), (F.floor(k / _K) % 5 == 0).alias("bad"))
    kind, bad = F.col("kind"), F.col("bad")
    hls = lambda *p: c("https://cdn.example.net/", *p, ".m3u8")
    page = (
        F.when(kind == 0, F.when(bad, "<p>no id").otherwise(c("{ action: 'auth_token', id: ", k, ", embed: 1 }")))
        .when(kind == 1, F.when(bad, 'var address = "https://s1.example.net/"; var streamid = "";').otherwise(
            c("var address = 'https://s1.example.net/'; var streamid = '", k, "';")))
        .when(kind == 2, F.when(bad, "<meta>").otherwise(c('<meta property="og:video" content="https://m.example.net/', k, '.mp4">')))
        .when(kind == 3, F.when(bad, "").otherwise(c("var vurl = '", hls(k), "?s=1'")))
        .when(kind == 4, F.when(bad, "source:''").otherwise(c("source:'livee.m3u8?a=tok", k, "'")))
        .when(kind == 5, F.when(bad, "offline").otherwise(c('"https:\\/\\/videos-3.earthcam.com\\/f\\/', k, '\\/playlist.m3u8?t=1"')))
        .when(kind == 6, F.when(bad, "<p>").otherwise(c('<script id="player-data">{"streamSrc": "', hls(k), '?t=1\\u0026e=2"}</script>')))
    )
    fetched = page.isNotNull()
    own = F.when(kind == 1, c(fe.IPCAM_PLAYER, "alias", k)).otherwise(F.col("target_url"))
    pages = t.where(fetched & (F.floor(k / _K) % 7 != 0)).select(own.alias("url"), page.alias("body"))
    ajax = t.where((kind == 0) & ~bad).select(
        resolve.ajax_url(k.cast("string")).alias("url"), c("<video src='", hls(k), "?token=h:1700000500123'>").alias("body")
    )
    init = t.where(kind == 7).select(
        resolve.first_hop(F.lit("ozolio"), F.col("target_url")).alias("url"),
        F.when(bad, "<html>down</html>").otherwise(c('{"session": {"id": "SID_', k, '"}}')).alias("body"),
    )
    opened = t.where((kind == 7) & ~bad).select(
        resolve.second_hop(F.lit("ozolio"), F.col("target_url"), c("SID_", k)).alias("url"),
        c('{"output": {"media": "', F.when(k % 2 == 0, "LIVE").otherwise("ROLL"), '", "source": "https://relay.example.net/hls-live/', k, '.m3u8"}}').alias("body"),
    )
    api1 = t.where(kind == 8).select(
        resolve.first_hop(F.lit("viewsurf"), F.col("target_url")).alias("url"),
        F.when(bad, "<html>").otherwise(c('{"m3u8": "', hls("v1/", k), '"}')).alias("body"),
    )
    api2 = t.where((kind == 8) & bad & (k % 2 == 0)).select(
        resolve.second_hop(F.lit("viewsurf"), F.col("target_url"), F.lit("")).alias("url"), c('{"m3u8": "', hls("v2/", k), '"}').alias("body")
    )
    bodies = pages.unionByName(ajax).unionByName(init).unionByName(opened).unionByName(api1).unionByName(api2)
    tool = t.where(kind == 9).select(
        "target_url", F.when(bad, "https://a/1\nhttps://a/2").otherwise(c("https://yt.example.net/expire/1700000900/", k, "\n")).alias("output")
    )
    return t, bodies, tool


_NOW = 1_700_000_000
RESOLVED_SQL = f"""
t AS (SELECT o_orderkey AS k, o_orderkey % {_K} AS kind, (o_orderkey // {_K}) % 5 = 0 AS bad, (o_orderkey // {_K}) % 7 = 0 AS gone,
  list_extract([{", ".join("'" + x + "'" for x in _KINDS)}], CAST(o_orderkey % {_K} AS INTEGER) + 1) || o_orderkey AS target_url FROM orders),
u AS (SELECT *, CASE
  WHEN kind < 7 AND (gone OR bad) THEN NULL
  WHEN kind = 0 THEN 'https://cdn.example.net/' || k || '.m3u8?token=h:1700000500123'
  WHEN kind = 1 THEN 'https://s1.example.net/streams/' || k || '/stream.m3u8'
  WHEN kind = 2 THEN 'https://m.example.net/' || k || '.mp4'
  WHEN kind = 3 THEN 'https://cdn.example.net/' || k || '.m3u8?s=1'
  WHEN kind = 4 THEN 'https://hd-auth.skylinewebcams.com/live.m3u8?a=tok' || k
  WHEN kind = 5 THEN 'https://videos-3.earthcam.com/f/' || k || '/playlist.m3u8?t=1'
  WHEN kind = 6 THEN 'https://cdn.example.net/' || k || '.m3u8?t=1&e=2'
  WHEN kind = 7 THEN CASE WHEN NOT bad AND k % 2 = 0 THEN 'https://relay.example.net/hls-live/' || k || '.m3u8' END
  WHEN kind = 8 THEN CASE WHEN NOT bad THEN 'https://cdn.example.net/v1/' || k || '.m3u8' WHEN k % 2 = 0 THEN 'https://cdn.example.net/v2/' || k || '.m3u8' END
  WHEN kind = 9 THEN CASE WHEN NOT bad THEN 'https://yt.example.net/expire/1700000900/' || k END
  WHEN kind = 10 THEN target_url END AS url,
  CASE kind WHEN 0 THEN 'baltic' WHEN 1 THEN 'ipcamlive' WHEN 2 THEN 'metatag' WHEN 3 THEN 'wetmet' WHEN 4 THEN 'skyline' WHEN 5 THEN 'earthcam' WHEN 6 THEN 'hdontap'
    WHEN 7 THEN 'ozolio' WHEN 8 THEN 'viewsurf' WHEN 9 THEN 'ytdlp' WHEN 10 THEN 'direct' END AS resolver FROM t),
r AS (SELECT *, CASE WHEN url IS NOT NULL THEN CASE WHEN kind = 2 THEN 'mp4' ELSE 'hls' END END AS stream_type,
  CASE WHEN url IS NOT NULL THEN CASE kind WHEN 0 THEN 500 WHEN 3 THEN 300 WHEN 4 THEN 60 WHEN 5 THEN 120 WHEN 6 THEN 3600 WHEN 7 THEN 180 WHEN 8 THEN 1800 WHEN 9 THEN 900 END END::BIGINT AS ttl_seconds,
  CASE WHEN url IS NOT NULL OR kind = 11 THEN NULL WHEN kind < 7 AND gone THEN 'resolver fetch failed'
    WHEN kind = 0 THEN 'baltic: no camera id in target' WHEN kind = 1 THEN 'ipcamlive: no address/streamid (offline?)' WHEN kind = 2 THEN 'no og:video'
    WHEN kind = 3 THEN 'wetmet: no m3u8 in widget frame' WHEN kind = 4 THEN 'skyline: no stream token (offline?)' WHEN kind = 5 THEN 'earthcam: no live HLS (offline?)'
    WHEN kind = 6 THEN 'hdontap: no player-data stream (offline?)' WHEN kind = 7 AND bad THEN 'ozolio: relay returned non-JSON' WHEN kind = 7 THEN 'ozolio: canned loop, not a live camera'
    WHEN kind = 8 THEN 'viewsurf: no manifest from any api host' WHEN kind = 9 THEN 'yt-dlp returned a split format, not a muxed stream' END AS error FROM u)"""


@query("resolve_x1_x11_j6", f"WITH {RESOLVED_SQL} SELECT target_url, resolver, url, stream_type, ttl_seconds, error FROM r")
def resolve_targets(spark, sf):
    t, bodies, tool = resolution_inputs(spark, sf)
    return resolve.resolve(t.select("target_url"), bodies, tool, _NOW)


@query("error_detail_x12", r"""
SELECT page_id, substr('failed ' || regexp_replace(url, '\?\S*', '') || ' ' || repeat('x', 60), 1, 80) AS detail FROM pages""")
def error_detail(spark, sf):
    msg = F.concat(F.lit("failed "), F.col("url"), F.lit(" "), F.lit("x" * 60))
    return table(spark, sf, "pages").select("page_id", resolve.error_detail(msg).alias("detail"))


def landed_manifests(spark, sf):
    """A manifest for two of three resolved URLs; some of them play, others are empty. The documents are read once, for these and for what follows."""
    from ..operators.resolve import read_documents, resolve as run

    t, bodies, tool = resolution_inputs(spark, sf)
    bodies = read_documents(bodies)
    resolved = keyed.materialise(run(t.select("target_url"), bodies, tool, _NOW).where(F.col("url").isNotNull()), "resolved")
    h = F.length("url") % 3
    text = F.when(h == 1, "#EXTM3U\n#EXT-X-ENDLIST\n").otherwise(
        F.concat(F.lit("#EXTM3U\n#EXTINF:4.0,\nseg1.ts\n#EXTINF:4.0,\nhttps://other.example.org/x.ts\nsub/low.m3u8?x=1\n"))
    )
    return t, bodies, tool, resolved, resolved.where(h != 2).select("url", text.alias("text"))


@query("liveness_p12_p9", f"""WITH {RESOLVED_SQL}
SELECT target_url, CASE WHEN resolver IS NULL THEN 'no-extractor' WHEN error IS NOT NULL THEN 'resolve-failed:' || error
  WHEN stream_type = 'hls' AND length(url) % 3 <> 0 THEN 'dead-manifest' END AS reason FROM r""")
def liveness_verdicts(spark, sf):
    t, bodies, tool, _, texts = landed_manifests(spark, sf)
    return liveness.target_verdicts(t.select("target_url"), bodies, texts, tool, _NOW)


@query("check_candidates_j2_p13", f"""WITH {RESOLVED_SQL},
v AS (SELECT k, target_url, CASE WHEN resolver IS NULL THEN 'no-extractor' WHEN error IS NOT NULL THEN 'resolve-failed:' || error
  WHEN stream_type = 'hls' AND length(url) % 3 <> 0 THEN 'dead-manifest' END AS reason FROM r)
SELECT l_orderkey * 10 + l_linenumber AS ord, CASE WHEN v.k % {_K} = 9 THEN CASE WHEN v.k % 5 = 0 THEN NULL ELSE 'yt-offline' END ELSE reason END AS reason
FROM lineitem JOIN v ON l_orderkey = v.k""")
def check_candidates(spark, sf):
    t, bodies, tool, _, texts = landed_manifests(spark, sf)
    key = F.when(F.col("kind") == 9, F.concat(F.lit("yt:"), F.col("k")))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    cands = li.join(t, "k").select(
        "ord", "target_url", key.alias("predisc_key"), F.lit("skyline").alias("source"), F.lit(None).cast("string").alias("category")
    )
    live = t.where((F.col("kind") == 9) & (F.col("k") % 5 == 0)).select(F.col("k").cast("string").alias("video_id"), F.lit("").alias("category_name"))
    return liveness.check_candidates(cands, live, bodies, texts, tool, _NOW).select("ord", "reason")


@query("serving_view_j11_p14_m3", f"""WITH {RESOLVED_SQL},
s AS (SELECT *, CASE WHEN url IS NULL THEN 502 WHEN stream_type = 'mp4' THEN 302 WHEN length(url) % 3 <> 0 THEN 502 ELSE 200 END AS status FROM r)
SELECT CAST(k AS VARCHAR) AS id, status, CASE WHEN url IS NULL THEN 'resolve failed' WHEN stream_type = 'mp4' THEN 'redirect' WHEN length(url) % 3 = 2 THEN 'upstream manifest fetch failed'
   WHEN length(url) % 3 = 1 THEN 'not a playable HLS stream' ELSE 'manifest' END AS action, CASE WHEN status = 302 THEN url END AS location,
  CASE WHEN status = 200 THEN contains(url, 'skylinewebcams') OR contains(url, 'earthcam') END AS relayed FROM s""")
def serving_view(spark, sf):
    t, _, _, resolved, texts = landed_manifests(spark, sf)
    cat = t.select(F.col("k").cast("string").alias("id"), "target_url")
    view = manifests.serving_view(cat, resolved, texts, "http://b")
    return view.select("id", "status", "action", "location", F.contains("body", F.lit("/s?u=")).alias("relayed"))


# --- manifests: every document becomes a playlist, every word of its whole text a segment ---------------------------------


def text_manifests(spark, sf):
    # Between two words stands one line end, so that a word of signs alone stays as an empty one. The named class costs a fifth of the same one spelt in ranges.
    words = F.split(F.regexp_replace(F.regexp_replace("text", r"[ \n\t\r]+", "\n"), r"[^\p{Alnum}\n]+", ""), "\n")
    seg = lambda w: F.concat(
        F.when(F.length(w) % 5 == 4, "#EXT-X-DISCONTINUITY\n").otherwise(""), F.lit("#EXTINF:"), F.length(w), F.lit(".5,\ns"), w,
        F.when(F.length(w) % 5 == 0, ".m3u8?k=1").otherwise(".ts"),
    )
    lines = F.transform(words, seg)
    head = "#EXTM3U\n#EXT-X-VERSION:3\n\n#EXT-X-MEDIA-SEQUENCE:7\n"
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("manifest_id"), F.concat(F.lit(head), F.array_join(lines, "\n"), F.lit("\n#EXT-X-ENDLIST\n")).alias("text")
    )


_WORDS = r"""d AS (SELECT doc_id, list_transform(string_split_regex(text, '[ \n\t\r]+'), lambda w: regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
s AS (SELECT doc_id, i, length(w) + 0.5 AS d, length(w) % 5 = 4 AS disc, 's' || w || CASE WHEN length(w) % 5 = 0 THEN '.m3u8?k=1' ELSE '.ts' END AS ref,
  CASE WHEN length(w) % 5 = 4 THEN '#EXT-X-DISCONTINUITY' || chr(10) ELSE '' END || '#EXTINF:' || length(w) || '.5,' || chr(10) AS tags,
  'https://' || CASE doc_id % 3 WHEN 0 THEN 'a.example.net' WHEN 1 THEN 'edge.wetmet.net' ELSE 'b.example.org' END || '/live/' AS base FROM w)"""


@query("manifest_lines_w1_c24", f"WITH {_WORDS} SELECT doc_id AS manifest_id, i AS seg_no, ref AS url, CAST(d AS DOUBLE) AS duration, CAST(disc AS BIGINT) AS discontinuities FROM s")
def manifest_segments(spark, sf):
    return manifests.parse_segments(text_manifests(spark, sf))


def _served(spark, sf):
    k = F.col("manifest_id")
    host = F.when(k % 3 == 0, "a.example.net").when(k % 3 == 1, "edge.wetmet.net").otherwise("b.example.org")
    up = F.concat(F.lit("https://"), host, F.lit("/live/index.m3u8?q=1"))
    return text_manifests(spark, sf).select(k.alias("entry_id"), up.alias("upstream_url"), "text")


@query("manifest_refs_m1", f"""WITH {_WORDS}
SELECT doc_id AS entry_id, ref, base || ref AS absolute_url, CASE WHEN contains(ref, '.m3u8') THEN 'child' WHEN contains(base, 'wetmet') THEN 'relay' ELSE 'direct' END AS kind, count(*) AS n FROM s GROUP BY ALL""")
def manifest_refs(spark, sf):
    refs = manifests.classify_references(_served(spark, sf))
    return refs.groupBy("entry_id", "ref", "absolute_url", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("manifest_rewrite_m2", f"""WITH {_WORDS},
o AS (SELECT *, CASE WHEN contains(ref, '.m3u8') THEN 'http://b/stream/' || doc_id || '/m?u=' || url_encode(base || ref) WHEN contains(base, 'wetmet')
   THEN 'http://b/stream/' || doc_id || '/s?u=' || url_encode(base || ref) ELSE base || ref END AS served FROM s)
SELECT doc_id AS entry_id, md5('#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || chr(10) || '#EXT-X-MEDIA-SEQUENCE:7' || chr(10) ||
   string_agg(tags || served, chr(10) ORDER BY i) || chr(10) || '#EXT-X-ENDLIST' || chr(10)) AS body FROM o GROUP BY doc_id""")
def manifest_rewrite(spark, sf):
    return manifests.rewrite_manifests(_served(spark, sf), "http://b").select("entry_id", F.md5("body").alias("body"))


@query("live_edge_w2", """
WITH s AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity AS d, row_number() OVER w - 1 AS c,
   coalesce(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem
   WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC))
SELECT l_suppkey, l_orderkey, l_linenumber FROM s WHERE total <= 200 OR after < 120 OR c < 6""")
def live_edge(spark, sf):
    segs = table(spark, sf, "lineitem").withColumnRenamed("l_quantity", "duration")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return manifests.mark_live_edge(segs, "l_suppkey", order, month).where("keep").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("live_edge_text_w3", f"""WITH {_WORDS},
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) - 1 AS after_n, count(*) OVER (PARTITION BY doc_id) AS total,
   coalesce(sum(d) OVER (PARTITION BY doc_id ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after_d FROM s),
k AS (SELECT *, total <= 200 OR after_d < 120 OR after_n < 6 AS keep FROM x),
g AS (SELECT doc_id, count(*) FILTER (NOT keep) AS dropped, count(*) FILTER (NOT keep AND disc) AS dd, string_agg(tags || ref, chr(10) ORDER BY i) FILTER (keep) AS b FROM k GROUP BY doc_id)
SELECT doc_id AS manifest_id, dropped, md5('#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || CASE WHEN dropped = 0 THEN chr(10) ELSE '' END || '#EXT-X-MEDIA-SEQUENCE:' || (7 + dropped) || chr(10) ||
  CASE WHEN dd > 0 THEN '#EXT-X-DISCONTINUITY-SEQUENCE:' || dd || chr(10) ELSE '' END || b || chr(10) || CASE WHEN dropped = 0 THEN '#EXT-X-ENDLIST' || chr(10) ELSE '' END) AS text FROM g""")
def live_edge_text(spark, sf):
    return manifests.trim_to_live_edge(text_manifests(spark, sf)).select("manifest_id", "dropped", F.md5("text").alias("text"))


# --- graph and probes -----------------------------------------------------------------------------------------------------


def _link_graph(spark, sf):
    """Links between numbered pages: every page links to two others, so that long chains and cycles occur."""
    n = F.col("page_id")
    ids = table(spark, sf, "pages").select(n)
    top = F.lit(ids.agg(F.max("page_id")).first()[0] + 1)
    return ids.select(n.alias("src"), F.explode(F.array((n * 3) % top, (n * 7 + 2) % top)).alias("dst"))


@query("reachable_g1", """
WITH RECURSIVE e AS (SELECT page_id AS src, unnest([page_id * 3 % (SELECT max(page_id) + 1 FROM pages), (page_id * 7 + 2) % (SELECT max(page_id) + 1 FROM pages)]) AS dst FROM pages),
w AS (SELECT 5 AS node UNION SELECT dst FROM w JOIN e ON w.node = e.src)
SELECT CAST(node AS BIGINT) AS node FROM w""")
def reachable(spark, sf):
    seeds = table(spark, sf, "pages").where(F.col("page_id") == 5).select(F.col("page_id").alias("node"))
    return graph.reachable(seeds, _link_graph(spark, sf)).select("node")


@query("reachable_leaves_g1_u4", """
WITH RECURSIVE e AS (SELECT page_id AS src, unnest([page_id * 3 % (SELECT max(page_id) + 1 FROM pages), (page_id * 7 + 2) % (SELECT max(page_id) + 1 FROM pages)]) AS dst FROM pages),
w AS (SELECT 5 AS node UNION SELECT dst FROM w JOIN e ON w.node = e.src)
SELECT DISTINCT link AS leaf FROM (SELECT unnest(regexp_extract_all(html, '<a href="(/[^"]+)"', 1)) AS link FROM pages WHERE page_id IN (SELECT node FROM w))""")
def reachable_leaves(spark, sf):
    seeds = table(spark, sf, "pages").where(F.col("page_id") == 5).select(F.col("page_id").alias("node"))
    nodes = graph.reachable(seeds, _link_graph(spark, sf))
    links = extract.matches(documents(spark, sf), F.col("body"), r'<a href="(/[^"]+)"', name="leaf", keep=["page_id"])
    return graph.leaves(nodes, links.select(F.col("page_id").alias("src"), "leaf"))


_GRID = """grid AS (SELECT r * 1000 + c AS ord, round_even(-60.0::DOUBLE + r * 3.15::DOUBLE, 2) AS lat, round_even(-180.0::DOUBLE + c * step, 2) AS lon
  FROM (SELECT r, 3.15::DOUBLE / greatest(0.2::DOUBLE, cos(radians(-60.0::DOUBLE + r * 3.15::DOUBLE))) AS step FROM range(42) t(r)) x, LATERAL (SELECT unnest(range(CAST(ceil(360.0 / step) AS BIGINT))) AS c) y)"""


def _circles(spark, sf):
    """Grid points with the number of customers that fall on them."""
    g = probe.grid(spark)
    n = g.count()
    ranked = probe.with_position(g, ["ord"])
    slot = F.col("c_custkey") * F.col("c_custkey") % F.lit(n)
    per = table(spark, sf, "customer").groupBy(slot.alias("position")).agg(F.sum(F.col("c_custkey") % 400).alias("total"))
    return ranked.join(per, "position", "left")


_CIRC = f"""{_GRID}, gp AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS pos FROM grid), gn AS (SELECT count(*) AS n FROM grid),
per AS (SELECT c_custkey * c_custkey % (SELECT n FROM gn) AS pos, sum(c_custkey % 400) AS total FROM customer GROUP BY ALL),
circ AS (SELECT ord, lat, lon, CAST(total AS BIGINT) AS total FROM gp LEFT JOIN per USING (pos))"""


@query("grid_circles_s14_c19", f"WITH {_CIRC} SELECT ord, lat, lon, total FROM circ")
def grid_circles(spark, sf):
    return _circles(spark, sf).select("ord", "lat", "lon", "total")


@query("page_plan_s15_l4", f"""WITH {_CIRC},
pl AS (SELECT ord, unnest(range(25, least(total, 4500), 25)) AS off FROM circ WHERE total > 25),
rk AS (SELECT *, row_number() OVER (ORDER BY ord, off) AS r FROM pl)
SELECT CAST(ord AS BIGINT) AS ord, off AS "offset" FROM rk WHERE r <= 7000 - (SELECT n FROM gn)""")
def page_plan(spark, sf):
    return probe.page_plan(_circles(spark, sf), ceiling=7000, circle_cap=4500).select("ord", "offset")


@query("probe_batch_t3", """
WITH live AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderkey % 5 = 0),
rest AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer WHERE c_custkey NOT IN (SELECT id FROM live)),
n AS (SELECT (SELECT count(*) FROM rest) AS n, (SELECT count(*) FROM live) AS l),
z AS (SELECT n, 1000003 % n AS st, least(n, greatest(0, (SELECT count(*) FROM customer) * 2 // 3 - l)) AS sz FROM n)
SELECT id, 'live' AS kind, NULL AS seq FROM live UNION ALL
SELECT id, 'rotation', (pos - st + n) % n FROM rest, z WHERE (pos - st + n) % n < sz""")
def probe_batch(spark, sf):
    o = table(spark, sf, "orders")
    live = o.where((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("o_orderkey") % 5 == 0)).select(F.col("o_custkey").alias("id")).distinct()
    corpus = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    batch, _, _ = probe.probe_batch(corpus, keyed.materialise(live, "live"), cursor=1_000_003, budget=corpus.count() * 2 // 3)
    return batch


@query("live_set_t2_p27", """
WITH v AS (SELECT user_id AS id, event_id, CASE event_type WHEN 'view' THEN true WHEN 'error' THEN false END AS live FROM events),
t AS (SELECT id, arg_max(live, event_id) AS live FROM v WHERE live IS NOT NULL GROUP BY id),
w AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 2 = 0 UNION SELECT 1000000)
SELECT coalesce(w.id, t.id) AS id FROM w FULL JOIN t ON w.id = t.id WHERE coalesce(t.live, w.id IS NOT NULL)""")
def live_set(spark, sf):
    ev = table(spark, sf, "events")
    t = F.col("event_type")
    # A frame in a page of enough text is live, a stub is dead, no page is no verdict.
    body = F.when(t == "view", "<iframe>" + "x" * 300).when(t == "error", "<iframe>stub")
    state = probe.live_page(body, F.contains(body, F.lit("<iframe")))
    told = F.when(state != "unknown", state == "live")
    verdicts = ev.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), told.alias("live"))
    was = ev.where(F.col("user_id") % 2 == 0).select(F.col("user_id").alias("id")).distinct().union(spark.range(1_000_000, 1_000_001))
    return probe.update_live(was, verdicts)


@query("corpus_upsert_a13_j9", """
WITH f AS (SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey)
SELECT c_custkey AS id, coalesce(f.p, c_mktsegment) AS title FROM customer LEFT JOIN f ON c_custkey = f.id""")
def corpus_upsert(spark, sf):
    corpus = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("title"))
    found = table(spark, sf, "orders").where(F.col("o_orderkey") % 2 == 0).select(
        F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("seq")
    )
    return probe.remember(corpus, found)


@query("search_windows_s13_w7", """
WITH h AS (SELECT CAST(epoch(date_trunc('day', ts)) / 86400 AS BIGINT) AS window_no, user_id AS video_id FROM events),
f AS (SELECT video_id, min(window_no) AS window_no FROM h GROUP BY ALL),
n AS (SELECT w.window_no, count(f.video_id) AS new FROM (SELECT DISTINCT window_no FROM h) w LEFT JOIN f USING (window_no) GROUP BY ALL),
r AS (SELECT *, coalesce(sum(new) OVER (ORDER BY window_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen,
  coalesce(min(new) OVER (ORDER BY window_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS least FROM n)
SELECT video_id, f.window_no AS window_no FROM f JOIN r USING (window_no) WHERE seen < 1000 AND least > 0""")
def search_windows(spark, sf):
    hits = table(spark, sf, "events").select(
        F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).alias("window_no"), F.col("event_id").alias("pos"), F.col("user_id").alias("video_id")
    )
    return probe.search_windows(hits, max_ids=1000).select("video_id", "window_no")


@query("all_search_windows_w7", """
WITH h AS (SELECT event_id // 10 AS window_no, event_id % 10 AS pos, event_id * 7 // 8 AS video_id FROM events),
f AS (SELECT video_id, min(window_no * 10 + pos) AS place FROM h GROUP BY ALL),
n AS (SELECT w.window_no, count(f.video_id) AS new FROM (SELECT DISTINCT window_no FROM h) w LEFT JOIN f ON place // 10 = window_no GROUP BY ALL)
SELECT video_id, place // 10 AS window_no, CAST(seen AS BIGINT) AS seen_before FROM f JOIN (
  SELECT window_no, coalesce(sum(new) OVER (ORDER BY window_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM n) r ON place // 10 = window_no""")
def all_search_windows(spark, sf):
    """A search without a limit: one window for every ten events, each with the ids that were seen before it."""
    n = F.col("event_id")
    hits = table(spark, sf, "events").select(F.floor(n / 10).alias("window_no"), (n % 10).alias("pos"), F.floor(n * 7 / 8).alias("video_id"))
    return probe.search_windows(hits).select("video_id", "window_no", "seen_before")


@query("id_order_l3", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer")
def id_order(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.regexp_extract("c_name", r"(\d+)$", 1).cast("long").alias("n"))
    return probe.with_position(df, ["n"]).select("c_custkey", "position")


