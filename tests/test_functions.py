"""URL and text functions against the standard library and fixed examples."""

import html
import re
from urllib.parse import parse_qsl, quote, unquote, urlencode, urljoin, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from streamatlas.fixed import catalogue as fc
from streamatlas.functions import text, urls

URLS = [
    "http://Ex.COM:80/a/b/?utm_source=x&b=&a=1&c=%7Ex*+y%zz#f", "https://u:p@h.com", "http://h.com/?a=b=c&UTM_Medium=2&x=%C3%A9é",
    "http://[::1]:80/x", "foo/bar", "https://h.com?q=1", "HTTP://h.com/a//", "http://h.com/%zz?%3D=1&q=%ff", " http://h.com/a\tb",
    "https://a.b/c?x&y=1&fbclid=2", "", "http://h.com/a?x=1;y=2&z=3", "http://h.com/p?q=a/b?c",
]


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_canonical_url(spark):
    def expected(url):
        s = urlsplit(url)
        kept = [(k, v) for k, v in parse_qsl(s.query) if k.lower() not in fc.TRACKING_PARAMS]
        return urlunsplit(("https", (s.hostname or "").lower(), s.path.rstrip("/") or "/", urlencode(kept), ""))

    assert column(spark, URLS, urls.canonical_url) == [expected(u) for u in URLS]


def test_url_parts(spark):
    assert column(spark, URLS, urls.host) == [(urlsplit(u).hostname or "").lower() for u in URLS]
    assert column(spark, URLS, urls.path) == [urlsplit(u).path for u in URLS]
    assert column(spark, URLS, urls.query) == [urlsplit(u).query for u in URLS]


def test_stable_id_ignores_cosmetic_differences_and_the_target(spark):
    df = spark.createDataFrame(
        [("s", "HTTP://Ex.com/a/?utm_source=q", ""), ("s", "https://ex.com/a", None), ("s", "https://ex.com/a", "1"), ("t", "https://ex.com/a", None)],
        "s string, u string, a string",
    )
    ids = [r[0] for r in df.select(urls.stable_id(F.col("s"), F.col("u"), F.col("a"))).collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 3 and all(re.fullmatch("[0-9a-f]{16}", i) for i in ids)


BASES = ["https://a.com/b/c/d?q=1#f", "https://a.com", "https://a.com/", "http://a.com/x/./y/../z", "https://a.com//x//y"]
REFS = [
    "", "e", "/e", "../e", "../../../../e", "./", "..", "?x=1", "#z", "//h.com/p", "https://o.com/q?", "http://a.com/x", "mailto:x",
    "e//f", "/e//f/../g", "a/./b/../../c", "/", "data:abc", "https://a.com/r#", "x?y=1#z", "seg-1.ts?a=b/../c", ".hidden", "a..b/c", "/.x/y",
    "x:y", "e?", "/e?", "//h.com", "/a/b/..", "...", "a b",
]


def test_url_join(spark):
    pairs = [(b, r) for b in BASES for r in REFS]
    df = spark.createDataFrame(pairs, "b string, r string").select("b", "r", urls.url_join(F.col("b"), F.col("r")).alias("j"))
    assert [(r.b, r.r, r.j) for r in df.collect()] == [(b, r, urljoin(b, r)) for b, r in pairs]


def test_percent_codecs(spark):
    values = ["a%20b+c%zz%C3%A9", "100%", "%", "~*()!'", "ü/ß=?&"]
    assert column(spark, values, urls.percent_decode) == [unquote(v) for v in values]
    assert column(spark, values, lambda c: urls.percent_encode(c, "=/")) == [quote(v, safe="=/") for v in values]


@pytest.mark.parametrize(
    "target, key",
    [
        ("https://www.youtube.com/watch?v=abcdefghijk&x=1", "yt:abcdefghijk"),
        ("https://www.youtube-nocookie.com/embed/abcdefghijk?x", "yt:abcdefghijk"),
        ("https://webtvfc.feratel.com/webtv/?design=v3&pg=1&cam=5132", "feratel:5132"),
        ("https://h/x.m3u8?token=1&st=2&expire=3", "hls:https://h/x.m3u8&st=2"),
        ("https://worldcams.tv/player?url=https%3A%2F%2Fh%2Fx.m3u8%3Fhdnts%3D1", "hls:https://h/x.m3u8"),
        ("https://www.youtube.com/@chan/live", None),
        ("https://h/player", None),
    ],
)
def test_merge_key(spark, target, key):
    assert column(spark, [target], urls.merge_key) == [key]


def test_title_case_and_entities(spark):
    values = ["o'neil 3rd-st A_b", "ÉTÉ ñandú", "日a b", "x"]
    assert column(spark, values, text.title_case) == [v.title() for v in values]
    coded = ["a&amp;b&eacute;&#39;&nosuch;", "plain"]
    assert column(spark, coded, text.html_unescape) == [html.unescape(v) for v in coded]


@pytest.mark.parametrize(
    "title, parts, drop, expected",
    [
        ("Dusseldorf Airport", ["Germany", "Dusseldorf"], "", "Dusseldorf Airport — Germany"),
        ("Italy Beaches", ["Italy", "Cinque Terre"], "", "Italy Beaches — Cinque Terre"),
        ("Playa", ["Spain", "Gran Canaria", "Beaches"], "Beaches", "Playa — Gran Canaria, Spain"),
        ("", ["Spain", "Madrid"], "", "Madrid, Spain"),
        ("X", ["Parish", "Parish"], "", "X — Parish"),
        ("St John's Town", ["Johns"], "", "St John's Town"),
        ("東京", ["港区"], "", "東京"),
        ("", [], "", ""),
    ],
)
def test_with_location(spark, title, parts, drop, expected):
    df = spark.createDataFrame([(title, parts, drop)], "t string, p array<string>, d string")
    assert df.select(text.with_location(F.col("t"), F.col("p"), F.col("d"))).first()[0] == expected


def test_scrub(spark):
    values = [
        "x?key=abc&y=1", "developerKey=abc", "API_KEY=abc'", "apikey=a developer_key=b", "monkey=1&turkey=2", "session_key=zz", "no secrets",
    ]
    pattern = re.compile(fc.CREDENTIAL)
    assert column(spark, values, urls.scrub_credentials) == [pattern.sub(r"\1REDACTED", v) for v in values]


def test_retry_after_and_settings(spark):
    assert column(spark, ["5", " 2.5 ", "-1", "0", "", "Wed, 21 Oct 2026 07:28:00 GMT", None], text.retry_after_seconds) == [
        5.0, 2.5, None, None, None, None, None,
    ]
    assert column(spark, [" A, b ,,a"], text.csv_set) == [["a", "b"]]


def test_still_images_count_only_in_the_path(spark):
    values = ["https://h/a.JPG", "https://h/a.jpg?x=1", "https://h/a?x=b.png", "https://h/a.jpeg/live"]
    assert column(spark, values, urls.is_still_image) == [True, True, False, False]
