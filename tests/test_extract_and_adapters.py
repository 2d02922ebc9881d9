import pytest
from pyspark.sql import functions as F

from streamatlas.fixed import catalogue as fc
from streamatlas.fixed import sites as fs
from streamatlas.operators import extract, routing
from streamatlas.sources import adapters


def pages(spark, docs):
    rows = [(u, 0, b) for u, b in docs.items()]
    return spark.createDataFrame(rows, "url string, part int, body string")


def ladder(spark, body, url="https://site.example/a/b.html"):
    df = extract.extract_candidates(pages(spark, {url: body}).drop("part"))
    return [(r.angle_key, r.target_url, r.predisc_key) for r in df.orderBy("pos").collect()]


def test_ladder_prefers_the_stream_array(spark):
    body = (
        "streams[12] = '<iframe src=\\\"https://p.example/1\\\">';\nstreams[7] = \"<iframe src=\\\"/rel/2\\\">\"; streams[8]='no frame';"
        "streams[9]='<iframe src=\\\"https://p.example/x.jpg?y\\\">' https://www.youtube.com/embed/abcdefghijk"
    )
    assert ladder(spark, body) == [("12", "https://p.example/1", None), ("7", "https://site.example/rel/2", None)]


def test_ladder_rungs(spark):
    assert ladder(spark, '<iframe src="https://www.googletagmanager.com/ns.html"></iframe>') == []
    assert ladder(spark, "<IFRAME class=x SRC='player.html'>") == [(None, "https://site.example/a/player.html", None)]
    assert ladder(spark, 'x <iframe src="/a.png?live=1">') == []
    twice = "https://www.youtube.com/embed/abcdefghijk https://www.youtube-nocookie.com/embed/abcdefghijk"
    assert ladder(spark, twice) == [("0", "https://www.youtube.com/watch?v=abcdefghijk", "yt:abcdefghijk")]
    mixed = '"https://h/x.m3u8?token=1" youtube.com/@One youtube.com/channel/UCx www.youtube.com/embed?list=PL1'
    assert ladder(spark, mixed) == [
        ("0", "https://www.youtube.com/embed?list=PL1", None), ("1", "https://h/x.m3u8?token=1", "hls:https://h/x.m3u8"),
        ("2", "https://www.youtube.com/@One/live", None),
    ]
    credited = 'Source: &nbsp;<a href="x">https://www.youtube.com/embed/abcdefghijk</a>\n<iframe src="https://p/1">'
    assert ladder(spark, credited) == [(None, "https://p/1", None)]


def test_section_and_markers(spark):
    df = spark.createDataFrame([("aSTARTbENDc",), ("aSTARTb",), ("ab",)], "t string")
    assert [r[0] for r in df.select(extract.section(F.col("t"), "START", "END")).collect()] == ["b", "b", None]
    assert [r[0] for r in df.select(extract.from_marker(F.col("t"), "START", "E")).collect()] == ["ENDc", None, None]


@pytest.mark.parametrize(
    "target, name",
    [
        ("https://balticlivecam.com/c/1", "baltic"), ("https://g0.ipcamlive.com/player/player.php?alias=1", "ipcamlive"),
        ("https://www.ipcamlive.com/abc", "ipcamlive"), ("https://s1.ipcamlive.com/streams/1/stream.m3u8", "direct"),
        ("https://webtvfc.feratel.com/webtv/?cam=1", "metatag"), ("https://evil.org/?x=feratel.com/webtv", None),
        ("https://www.hdontap.com/stream/1/x/", "hdontap"), ("https://live.hdontap.com/hls/x.m3u8", "direct"), ("https://evil.org/?x=hdontap.com/stream/", None),
        ("https://www.ozolio.com/explore/AB1", "ozolio"), ("https://x.joada.net/embeded/embeded.html?uuid=1", "viewsurf"), ("https://notjoada.net/embeded/embeded.html", None),
        ("https://youtu.be/x", "ytdlp"), ("https://www.earthcam.com/world/x", "earthcam"), ("https://worldcams.tv/player?url=x", "direct"), ("https://h/x", None),
    ],
)
def test_routes(spark, target, name):
    assert spark.createDataFrame([(target,)], "t string").select(routing.route(F.col("t"))).first()[0] == name


def test_unknown_resolver_is_refused(spark):
    with pytest.raises(ValueError, match="nosuch"):
        routing.route(F.col("t"), rules=[("nosuch", lambda u, h, p: F.lit(True))])


def run(spark, name, docs):
    order = ["k1", "k2", "k3"]
    return [r.asDict() for r in adapters.ADAPTERS[name](pages(spark, docs)).orderBy(*order).collect()]


def test_every_source_has_an_adapter():
    assert set(adapters.ADAPTERS) == set(fc.SOURCE_ORDER)


@pytest.mark.parametrize("name", fc.SOURCE_ORDER)
def test_no_documents_give_no_rows(spark, name):
    broken = {u: "<html>error</html>" for u in (
        fs.AIRPORT_INDEX, fs.BEACH_INDEX, fs.CAMSCAPE_INDEX, fs.CAMSECURE_SITEMAP, fs.CXTV_SITEMAP, fs.EARTHCAM_NETWORK, fs.EARTHCAM_GLOBAL, fs.EXPLORE_API,
        fs.FERATEL_SITEMAP, fs.HDONTAP_SITEMAP, fs.ICELAND_INDEX, fs.OZOLIO_SITEMAP, fs.SHAREJU_INDEX, fs.WEBCAMERA_MAP, fs.WHATSUP_INDEX, fs.YT_SEARCH)}
    assert run(spark, name, broken) == []


def test_feratel_takes_the_lazy_player_and_keeps_sitemap_order(spark):
    page = "https://www.feratel.com/en/webcams/austria/tirol/"
    docs = {
        fs.FERATEL_SITEMAP: f"<loc>{page}b</loc><loc>{page}a-cam</loc><loc>https://www.feratel.com/en/webcams/austria</loc>",
        page + "b": '<title>Webcams in Gschnitz &ndash; Zentrum - Livecams and more</title><iframe src="x?cam=9"><iframe class="m" data-src="https://w/?pg=1&cam=5132&c=1">',
        page + "a-cam": '<iframe data-src="https://w/?cam=77">',
    }
    got = run(spark, "feratel", docs)
    assert [(r["title"], r["target_url"], r["predisc_key"]) for r in got] == [
        ("A Cam — Tirol, Austria", "https://webtv.feratel.com/webtv/?cam=77", "feratel:77"),
        ("Gschnitz – Zentrum — Tirol, Austria", "https://webtv.feratel.com/webtv/?cam=5132", "feratel:5132"),
    ]


def test_beachcam_without_a_token_keeps_the_bare_url(spark):
    docs = {
        fs.BEACH_INDEX: '<a href="https://beachcam.meo.pt/livecams/costa/"><a href="https://beachcam.meo.pt/livecams/">', fs.BEACH_TOKEN_API: "<html>nope</html>",
        "https://beachcam.meo.pt/livecams/costa/": '<div data-video-url="https://v/auth/costa/playlist.m3u8"> youtube.com/@Beachcamportugal',
    }
    got = run(spark, "beachcam", docs)
    assert [(r["title"], r["target_url"], r["category"]) for r in got] == [("Costa — Portugal", "https://v/auth/costa/playlist.m3u8", "Beaches")]


def test_camsecure_titles_and_duplicates(spark):
    base = "https://www.camsecure.co.uk/"
    frame = '<iframe src="https://camsecure.co/httpswebcam/{}.html">'
    docs = {
        fs.CAMSECURE_SITEMAP: "".join(f"<loc>{base}{p}</loc>" for p in ("", "Brixham Cam.html", "faq.html", "redcar.html", "WeymouthHarbour_webcam.html", "zdup.html", "stub.html")),
        base + "Brixham%20Cam.html": "<title>Brixham Harbour Live Streaming Webcam</title>" + frame.format(1),
        base + "redcar.html": "<title>Live Coastal Shipping Webcam from Coastwatch Redcar</title>" + frame.format(2),
        base + "WeymouthHarbour_webcam.html": frame.format(3), base + "zdup.html": "<title>Dup</title>" + frame.format(1), base + "stub.html": frame.format(4),
        **{f"https://camsecure.co/httpswebcam/{i}.html": f'<source type="x" src="/HLS/{i}.m3u8">' for i in (1, 2, 3)},
        "https://camsecure.co/httpswebcam/4.html": '<source src="https://rtsp.me/x.m3u8">',
    }
    got = run(spark, "camsecure", docs)
    assert [(r["title"], r["target_url"]) for r in got] == [
        ("Brixham Harbour", "https://camsecure.co/HLS/1.m3u8"), ("Weymouth Harbour", "https://camsecure.co/HLS/3.m3u8"),
        ("Coastwatch Redcar", "https://camsecure.co/HLS/2.m3u8"),
    ]


def test_skyline_falls_back_to_the_known_slugs(spark):
    cam = "https://www.skylinewebcams.com/en/webcam/espana/x.html"
    docs = {
        "https://www.skylinewebcams.com/en/live-cams-category/city-cams.html": '<a href="en/webcam/espana/x.html">',
        "https://www.skylinewebcams.com/en/live-cams-category/beach-cams.html": "",
        cam: "<h1>Gran Via Live Cam</h1><ol class=\"breadcrumb\"><span itemprop=\"name\">Spain</span></ol>source:'live.m3u8?a=abc9'",
    }
    got = run(spark, "skyline", docs)
    assert [(r["title"], r["category"], r["target_url"]) for r in got] == [("Gran Via — Spain", "Cities", cam)]


def test_viewsurf_prefers_a_known_section_and_sorts_by_number(spark):
    v = "https://www.viewsurf.com/univers/{}/vue/{}-france-x"
    page = "<h1>Nice <small>Promenade</small></h1>platforms9.joada.net/embeded/embeded.html?uuid=ab-1&amp;type=vod"
    docs = {
        fs.VIEWSURF_SITEMAP: "".join(f"<loc>{v.format(u, n)}</loc>" for u, n in (("odd", 10), ("plage", 10), ("surf", 10), ("new", 9))),
        v.format("plage", 10): page, v.format("new", 9): page,
    }
    got = run(spark, "viewsurf", docs)
    assert [(r["k2"], r["category"], r["title"]) for r in got] == [(9, "new", "Nice Promenade — France"), (10, "Beaches", "Nice Promenade — France")]


def test_webcamera_skips_marked_cams_everywhere(spark):
    docs = {
        fs.WEBCAMERA_MAP: 'var MAP_MARKERS = {"1": {"url": "https://sopot.webcamera.pl/", "name": "Sopot", "is_inactive": 0}, "2": {"url": "https://www.webcamera.pl/kamera/off", "name": "Off", "is_inactive": 1},'
                          ' "3": {"url": "https://static.webcamera.pl/", "name": "S"}}; more {',
        "https://www.webcamera.pl/kategoria,miasta": '<a href="https://no.webcamera.pl/"><div id="inline-camera-listing"><a href="https://sopot.webcamera.pl/"><a href="https://www.webcamera.pl/kamera/off/">',
        "https://sopot.webcamera.pl/": '{"video_src":"uggcf:\\/\\/u.cy\\/k.z3h8"}', "https://www.webcamera.pl/kamera/off/": '{"video_src":"uggcf:\\/\\/u.cy\\/k.z3h8"}',
    }
    got = run(spark, "webcamerapl", docs)
    assert [(r["title"], r["category"], r["target_url"]) for r in got] == [("Sopot", "Cities", "https://h.pl/x.m3u8")]


def test_worldcams_stops_at_the_first_page_without_links(spark):
    link = '<b class="cam-promo__title"><a href="{}">'
    docs = {
        fs.WORLDCAMS_LIST + "1": link.format("/spain/a/"), fs.WORLDCAMS_LIST + "2": "none", fs.WORLDCAMS_LIST + "3": link.format("/spain/b/"),
        **{f"https://worldcams.tv/spain/{x}/": "<h1>Plaza</h1>https://www.youtube.com/embed/abcdefghijk" for x in "ab"},
    }
    assert [r["source_page_url"] for r in run(spark, "worldcams", docs)] == ["https://worldcams.tv/spain/a/"]


def test_windy_decodes_the_frame_before_the_ladder(spark):
    docs = {
        fs.WINDY_LIST + "1.0,2.0&radius=250&limit=25&offset=0": '{"total": 1, "cams": [{"id": 5, "title": "Old", "location": {"city": "Bern", "country": "CH"}}, {"id": "x"}]}',
        fs.WINDY_LIST + "1.0,2.0&radius=250&limit=25&offset=25": '{"cams": [{"id": 5, "title": "New"}]}',
        fs.WINDY_STREAM + "5": "<p>" + "x" * 300 + '<iframe src="https://h/x.m3u8?a=1&amp;b=2">',
    }
    assert [(r["title"], r["target_url"]) for r in run(spark, "windy", docs)] == [("New", "https://h/x.m3u8?a=1&b=2")]


def test_ord_follows_source_and_listing_order(spark):
    feeds = {n: adapters.ADAPTERS[n](pages(spark, {fs.EXPLORE_API: '{"streams": [{"state": "live", "name": "b", "playlistUrl": "https://h/b.m3u8"}, {"state": "live", "name": "a", "playlistUrl": "https://h/a.m3u8"}]}',
                                                     fs.YT_SEARCH: '{"items": [{"id": {"videoId": "v1"}, "snippet": {"title": "t"}}]}'})) for n in ("explore", "youtube-api")}
    got = adapters.number_candidates(feeds).orderBy("ord").collect()
    assert [r.title for r in got] == ["t", "b", "a"] and len({r.ord for r in got}) == 3


def test_live_videos(spark):
    body = ('{"items": [{"id": "a", "snippet": {"liveBroadcastContent": "live", "categoryId": "20"}, "liveStreamingDetails": {}},'
            '{"id": "b", "snippet": {"liveBroadcastContent": "live", "categoryId": "777"}}, {"id": "c", "snippet": {"liveBroadcastContent": "none"}},'
            '{"id": "d", "snippet": {"liveBroadcastContent": "live"}, "liveStreamingDetails": {"actualEndTime": "2024-01-01T00:00:00Z"}}]}')
    got = {r.video_id: r.category_name for r in adapters.live_videos(pages(spark, {fs.YT_VIDEOS: body})).collect()}
    assert got == {"a": "Gaming", "b": ""}
