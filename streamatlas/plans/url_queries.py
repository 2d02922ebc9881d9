"""Queries over URLs and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.regex import has
from ..operators import categorise, extract, routing, vetting
from ..fixed import taxonomy as ft
from .registry import query, table

# Page addresses made awkward: upper-case host, user and port, a blank and an encoded parameter.
MESSY = r"""regexp_replace(regexp_replace(url, '^(https?)://([^/?#]*)', '\1://User:pw@\2:8080', 'g'), '#.*$', '')
  || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'b=&c=%7Ex+y&GCLID=7' || CASE WHEN contains(url, '#') THEN '#top' ELSE '' END"""


def _messy(pages):
    u = F.col("url")
    head = F.regexp_replace(F.regexp_replace(u, r"^(https?)://([^/?#]*)", "$1://User:pw@$2:8080"), "#.*$", "")
    sep = F.when(F.contains(u, F.lit("?")), "&").otherwise("?")
    tail = F.when(F.contains(u, F.lit("#")), "#top").otherwise("")
    return pages.withColumn("messy", F.concat(head, sep, F.lit("b=&c=%7Ex+y&GCLID=7"), tail))


_CANON = rf"""
WITH m AS (SELECT page_id, url, {MESSY} AS messy FROM pages),
s AS (SELECT page_id, messy, lower(regexp_extract(messy, '^https?://[^@/?#]*@([^/?#:]*)', 1)) AS host,
             regexp_replace(regexp_extract(messy, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS p,
             string_split(regexp_extract(messy, '\?([^#]*)', 1), '&') AS q FROM m),
k AS (SELECT page_id, messy, host, CASE WHEN p = '' THEN '/' ELSE p END AS p,
             list_filter(q, lambda x: regexp_extract(x, '=(.*)$', 1) <> ''
               AND lower(regexp_extract(x, '^([^=]*)', 1)) NOT IN
                 ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid')) AS q FROM s),
c AS (SELECT page_id, messy, 'https://' || host || p || CASE WHEN len(q) = 0 THEN '' ELSE '?' ||
        array_to_string(list_transform(q, lambda x: replace(x, '%7E', '~')), '&') END AS canonical FROM k)
"""


@query("canonical_url_p1", _CANON + "SELECT page_id, canonical FROM c")
def canonical_url(spark, sf):
    return _messy(table(spark, sf, "pages")).select("page_id", urls.canonical_url(F.col("messy")).alias("canonical"))


@query("stable_id_p2_c18", _CANON + """SELECT page_id, substr(sha256('src' || page_id % 4 || '|' || canonical || '|' ||
   CASE page_id % 3 WHEN 0 THEN '0' ELSE CAST(page_id % 3 AS VARCHAR) END), 1, 16) AS id FROM c""")
def stable_id(spark, sf):
    src = F.concat(F.lit("src"), F.col("page_id") % 4)
    angle = F.when(F.col("page_id") % 3 != 0, (F.col("page_id") % 3).cast("string")).otherwise(F.lit(""))
    return _messy(table(spark, sf, "pages")).select("page_id", urls.stable_id(src, F.col("messy"), angle).alias("id"))


@query("url_parts_c11", rf"""
WITH m AS (SELECT page_id, {MESSY} AS u FROM pages)
SELECT page_id, regexp_extract(u, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(u, '@([^/?#:]*)', 1)) AS host,
       regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '\?([^#]*)', 1) AS query,
       regexp_extract(u, '^([a-z]+)://', 1) || '://' || lower(regexp_extract(u, '@([^/?#:]*)', 1)) || '/' AS origin FROM m""")
def url_parts(spark, sf):
    u = F.col("messy")
    return _messy(table(spark, sf, "pages")).select(
        "page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"),
        urls.query(u).alias("query"), urls.origin(u).alias("origin"),
    )


@query("host_match_p4_p5", r"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, host, (host = 'example.com' OR host LIKE '%.example.com' OR host = 'spam-farm.example.org') AS matched,
       array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
       array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') = 'example.net' AS same_site FROM h""")
def host_match(spark, sf):
    h = urls.host(F.col("url"))
    df = table(spark, sf, "pages").select("page_id", h.alias("host"))
    return df.select(
        "page_id", "host", urls.host_in(F.col("host"), ("example.com", "spam-farm.example.org")).alias("matched"),
        urls.registrable_domain(F.col("host")).alias("domain"), urls.same_site(F.col("host"), F.lit("cdn.Example.net")).alias("same_site"),
    )


# A target of every kind, chosen by the page number and made unique by it.
_T = {
    0: "'https://www.youtube.com/watch?v=' || lpad(CAST(page_id AS VARCHAR), 11, 'A')",
    1: "'https://webtvfc.feratel.com/webtv/?design=v3&cam=' || page_id",
    2: "'https://cdn.example.net/live/' || page_id || '/index.m3u8?token=abc&quality=1&expire=99'",
    3: "'https://worldcams.tv/player?url=https%3A%2F%2Fh.example.com%2F' || page_id || '%2Fa.m3u8%3Ftoken%3Dx'",
    4: "'https://balticlivecam.com/cameras/' || page_id",
    5: "'https://www.ipcamlive.com/alias' || page_id",
    6: "'https://g0.ipcamlive.com/player/player.php?alias=x' || page_id",
    7: "'https://api.wetmet.net/widgets/stream/frame.php?uid=' || page_id",
    8: "'https://www.skylinewebcams.com/en/webcam/a/b/' || page_id || '.html'",
    9: "'https://www.earthcam.com/world/' || page_id",
    10: "'https://portal.hdontap.com/stream/' || page_id || '/x/'",
    11: "'https://www.ozolio.com/explore/CID' || page_id",
    12: "'https://platforms5.joada.net/embeded/embeded.html?uuid=ab-' || page_id || '&type=live'",
    13: "'https://www.twitch.tv/chan' || page_id",
    14: "'https://evil.example.org/?x=hdontap.com/stream/' || page_id",
    15: "'https://cam.example.org/' || page_id || '.jpg?x=1'",
}
TARGETS_SQL = "(SELECT page_id, CASE page_id % 16 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _T.items()) + " END AS target FROM pages)"


def targets(spark, sf):
    case = "CASE page_id % 16 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _T.items()) + " END"
    case = case.replace("CAST(page_id AS VARCHAR)", "CAST(page_id AS STRING)")
    return table(spark, sf, "pages").select("page_id", F.expr(case).alias("target"))


@query("merge_key_p3_c4", f"""
SELECT page_id, CASE page_id % 16
  WHEN 0 THEN 'yt:' || lpad(CAST(page_id AS VARCHAR), 11, 'A')
  WHEN 1 THEN 'feratel:' || page_id
  WHEN 2 THEN 'hls:https://cdn.example.net/live/' || page_id || '/index.m3u8&quality=1'
  WHEN 3 THEN 'hls:https://h.example.com/' || page_id || '/a.m3u8' END AS merge_key,
  CASE page_id % 16 WHEN 3 THEN 'https://h.example.com/' || page_id || '/a.m3u8?token=x' ELSE target END AS unwrapped
FROM {TARGETS_SQL}""")
def merge_key(spark, sf):
    t = F.col("target")
    return targets(spark, sf).select("page_id", urls.merge_key(t).alias("merge_key"), urls.unwrap(t).alias("unwrapped"))


@query("route_p6", rf"""
WITH t AS (SELECT page_id, target, lower(regexp_extract(target, '^https?://([^/?#:]*)', 1)) AS host,
                  regexp_extract(target, '^https?://[^/?#]*([^?#]*)', 1) AS p FROM {TARGETS_SQL})
SELECT page_id, CASE
  WHEN contains(target, 'balticlivecam.com') THEN 'baltic'
  WHEN contains(target, 'ipcamlive.com/player/player.php') OR regexp_matches(target, '^https?://(?:www\.)?ipcamlive\.com/([A-Za-z0-9_-]+)/?$') THEN 'ipcamlive'
  WHEN host LIKE '%.feratel.com' AND contains(p, '/webtv') THEN 'metatag'
  WHEN contains(target, 'api.wetmet.net/widgets/stream/frame.php') THEN 'wetmet'
  WHEN contains(target, 'skylinewebcams.com/en/webcam/') THEN 'skyline'
  WHEN contains(target, 'earthcam.') THEN 'earthcam'
  WHEN (host = 'hdontap.com' OR host LIKE '%.hdontap.com') AND starts_with(p, '/stream/') THEN 'hdontap'
  WHEN host LIKE '%.ozolio.com' AND contains(p, '/explore/') THEN 'ozolio'
  WHEN host LIKE '%.joada.net' AND starts_with(p, '/embeded/embeded.html') THEN 'viewsurf'
  WHEN regexp_matches(target, 'youtube\.com|youtu\.be|twitch\.tv|dailymotion\.com|earthcam') THEN 'ytdlp'
  WHEN contains(target, '.m3u8') OR contains(target, 'worldcams.tv/player?url=') THEN 'direct' END AS resolver FROM t""")
def route(spark, sf):
    return targets(spark, sf).select("page_id", routing.route(F.col("target")).alias("resolver"))


@query("stream_filters_p7_p8_p11", rf"""
SELECT page_id, page_id % 16 = 15 AS still_image, page_id % 5 = 0 AS never_a_stream, page_id % 7 <> 0 AS safe FROM pages""")
def stream_filters(spark, sf):
    n, t = F.col("page_id"), F.col("target")
    frame = F.when(n % 5 == 0, F.concat(F.lit("https://www.GoogleTagManager.com/ns.html?id="), n)).otherwise(t)
    odd = F.when(n % 7 == 0, F.when(n % 2 == 0, F.concat(F.lit("ftp://x/"), n)).otherwise(F.concat(t, F.lit("\r\nX: 1")))).otherwise(t)
    return targets(spark, sf).select(
        "page_id", urls.is_still_image(t).alias("still_image"), urls.is_never_a_stream(frame).alias("never_a_stream"),
        urls.is_safe_redirect(odd).alias("safe"),
    )


@query("url_join_c6", r"""
WITH b AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS sch, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
                  regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p FROM pages),
d AS (SELECT *, regexp_replace(p, '[^/]*$', '') AS dir FROM b)
SELECT page_id, CASE page_id % 8
  WHEN 0 THEN sch || '://' || host || '/abs/' || page_id
  WHEN 1 THEN sch || '://' || host || dir || 'rel' || page_id || '.ts?x=1'
  WHEN 2 THEN sch || '://' || host || regexp_replace(dir, '[^/]+/$', '') || 'up' || page_id
  WHEN 3 THEN sch || '://cdn.example.net/n/' || page_id
  WHEN 4 THEN 'https://other.example.com/o/' || page_id
  WHEN 5 THEN sch || '://' || host || p || '?q=' || page_id
  WHEN 6 THEN url
  ELSE sch || '://' || host || dir || 'a/c' || page_id END AS absolute FROM d""")
def url_join(spark, sf):
    n = F.col("page_id")
    c = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    ref = (
        F.when(n % 8 == 0, c("/abs/", n)).when(n % 8 == 1, c("rel", n, ".ts?x=1")).when(n % 8 == 2, c("../up", n))
        .when(n % 8 == 3, c("//cdn.example.net/n/", n)).when(n % 8 == 4, c("https://other.example.com/o/", n))
        .when(n % 8 == 5, c("?q=", n)).when(n % 8 == 6, F.lit("")).otherwise(c("./a/b/../c", n))
    )
    return table(spark, sf, "pages").select("page_id", urls.url_join(F.col("url"), ref).alias("absolute"))


@query("percent_codec_c5_c4", """
SELECT doc_id, md5(url_encode(text)) AS encoded, true AS round_trip FROM documents""")
def percent_codec(spark, sf):
    t = F.col("text")
    enc = urls.percent_encode(t)
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(enc).alias("encoded"), (urls.percent_decode(enc) == t).alias("round_trip")
    )


@query("slug_title_c8", """
SELECT p_partkey, array_to_string(list_transform(string_split(p_name || ' ' || p_type || ' o''neil 3rd', ' '),
  lambda w: CASE w WHEN '3rd' THEN '3Rd' WHEN 'o''neil' THEN 'O''Neil' ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') AS title FROM part""")
def slug_title(spark, sf):
    slug = F.replace(F.concat_ws(" ", "p_name", "p_type", F.lit("o'neil 3rd")), F.lit(" "), F.lit("-"))
    return table(spark, sf, "part").select("p_partkey", text.slug_title(slug).alias("title"))


@query("rot13_c9", """
SELECT doc_id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz',
  'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')) AS coded FROM documents""")
def rot13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.rot13(F.col("text"))).alias("coded"))


@query("normalise_c10", """
SELECT conv_id, turn, trim(regexp_replace(replace(replace(lower(text), '''', ''), '’', ''), '[^a-z0-9]+', ' ', 'g')) AS norm
FROM conversations""")
def normalise(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.normalise(F.col("text")).alias("norm"))


@query("strip_tags_c13", r"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS plain FROM pages""")
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.squeeze(text.strip_tags(F.col("html")))).alias("plain"))


@query("entity_decode_c7")
def entity_decode(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.html_unescape("html")).alias("decoded"))


@query("title_cleanup_c14_c15", r"""
SELECT page_id, rtrim(regexp_extract(html, '<title>([^<]*)', 1)) AS title,
       'Harbour View ' || page_id AS spaced FROM pages""")
def title_cleanup(spark, sf):
    from ..functions.regex import first_or_empty, sub

    raw = F.concat(first_or_empty(F.col("html"), r"<title>([^<]*)"), F.lit(" – Resort Cams "))
    return table(spark, sf, "pages").select(
        "page_id", sub(raw, r"\s*[–-]\s*Resort Cams\s*$", ignore_case=True).alias("title"),
        F.concat(text.split_camel(F.lit("HarbourView")), F.lit(" "), F.col("page_id")).alias("spaced"),
    )


_SECRET = "text || ' see https://x.example.com/a?API_KEY=' || {id} || 'abc&monkey=1&session_key=zz&key=\"q\" end'"


@query("credential_scrub_p22", f"""
SELECT doc_id, md5(regexp_replace({_SECRET.format(id='doc_id')},
  '(?i)(^|[^a-z0-9])((?:developer_?key|api_?key|key)=)[^&\\s"'']+', '\\1\\2REDACTED', 'g')) AS scrubbed FROM documents""")
def credential_scrub(spark, sf):
    t = F.expr(_SECRET.format(id="doc_id"))
    return table(spark, sf, "documents").select("doc_id", F.md5(urls.scrub_credentials(t)).alias("scrubbed"))


@query("query_strip_p23", r"""
SELECT page_id, 'failed for ' || regexp_replace(url, '\?\S*', '') || ' twice' AS message,
  regexp_extract(url, '^([^?#]*)', 1) AS bare FROM pages""")
def query_strip(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", urls.strip_query(F.concat(F.lit("failed for "), u, F.lit(" twice"))).alias("message"), urls.bare_url(u).alias("bare")
    )


@query("shape_checks_p24", r"""
SELECT event_id, regexp_matches(md5(CAST(event_id AS VARCHAR)), '^[A-Za-z0-9+/=_-]{20,}$') AS token_ok,
  regexp_full_match(upper(event_type), 'SID_[A-Z0-9]+') OR event_id % 2 = 0 AS session_ok FROM events""")
def shape_checks(spark, sf):
    from ..fixed import embeds as fe, sites as fs

    sid = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("SID_"), F.upper("event_type"))).otherwise(F.upper("event_type"))
    return table(spark, sf, "events").select(
        "event_id", has(F.md5(F.col("event_id").cast("string")), fs.BEACH_TOKEN_SHAPE).alias("token_ok"),
        sid.rlike(fe.OZOLIO_SESSION).alias("session_ok"),
    )


@query("link_filters_p25", r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, count(*) AS n FROM l
WHERE regexp_matches(href, '(?i)(on|en|th)') AND NOT regexp_matches(href, '(?i)tion|facebook|\.(jpg|png)') GROUP BY ALL""")
def link_filters(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.lit(0).alias("part"), F.col("html").alias("body"))
    links = extract.matches(pages, F.col("body"), r'href="([^"]*)"', name="href", keep=["page_id"])
    keep = has(F.col("href"), "(on|en|th)", ignore_case=True) & ~has(F.col("href"), r"tion|facebook|\.(jpg|png)", ignore_case=True)
    return links.where(keep).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query("retry_after_c17", """
SELECT event_id, CASE WHEN event_id % 5 < 3 AND value > 0 AND event_id % 5 <> 1 THEN round(value, 2) END AS seconds FROM events""")
def retry_after(spark, sf):
    n, v = F.col("event_id") % 5, F.round("value", 2)
    header = (
        F.when(n == 0, v.cast("string")).when(n == 1, F.concat(F.lit("-"), v)).when(n == 2, F.concat(F.lit(" "), v, F.lit(" ")))
        .when(n == 3, F.lit("Wed, 21 Oct 2026 07:28:00 GMT"))
    )
    return table(spark, sf, "events").select("event_id", text.retry_after_seconds(header).alias("seconds"))


@query("csv_setting_c21_c20", """
SELECT c_custkey, lower(c_mktsegment) || '|cities' AS names FROM customer""")
def csv_setting(spark, sf):
    setting = F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ,, CITIES,cities , "))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(text.csv_set(setting), "|").alias("names"))


@query("location_suffix_p20_p21", """
WITH x AS (SELECT s_suppkey, s_name, n_name, r_name, CASE s_suppkey % 4 WHEN 0 THEN s_name || ' ' || lower(n_name) WHEN 1 THEN '' ELSE s_name END AS t
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
y AS (SELECT s_suppkey, t, n_name, r_name,
  list_filter([r_name, n_name], lambda p: t = '' OR NOT contains(lower(regexp_replace(t, '[^A-Za-z0-9]+', ' ', 'g')), regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g'))) AS extra FROM x),
z AS (SELECT s_suppkey, t, CASE WHEN s_suppkey % 3 = 0 THEN list_filter(extra, lambda p: p <> r_name) ELSE extra END AS extra FROM y)
SELECT s_suppkey, CASE WHEN t = '' THEN array_to_string(extra, ', ') WHEN len(extra) = 0 THEN t
  ELSE t || ' — ' || array_to_string(extra, ', ') END AS title FROM z""")
def location_suffix(spark, sf):
    s, n, r = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region")
    # nation and region have a fixed number of rows.
    df = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(
        F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")
    )
    k = F.col("s_suppkey") % 4
    title = F.when(k == 0, F.concat("s_name", F.lit(" "), F.lower("n_name"))).when(k == 1, "").otherwise(F.col("s_name"))
    drop = F.when(F.col("s_suppkey") % 3 == 0, F.col("r_name")).otherwise(F.lit(""))
    return df.select("s_suppkey", text.with_location(title, F.array("r_name", "n_name", "r_name"), drop).alias("title"))


_RAW = "CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Birds' WHEN 3 THEN 'Rivers Lakes' WHEN 4 THEN 'Gaming' " \
       "WHEN 5 THEN 'Other' WHEN 6 THEN p_type WHEN 7 THEN 'Ports' ELSE 'slug-' || p_size % 5 END"
_MAP_VALUES = ", ".join("('%s', '%s')" % (k.replace("'", "''"), v) for k, v in {**{n: n for n in ft.PASS_THROUGH}, **ft.CATEGORY_MAP}.items())
_MAPPED = f"""WITH m(raw, cat) AS (VALUES {_MAP_VALUES}), p AS (SELECT p_partkey, {_RAW} AS raw FROM part)"""


def _with_raw(spark, sf):
    return table(spark, sf, "part").withColumn("raw", F.expr(_RAW))


@query("category_map_c1_j10", _MAPPED + """
SELECT p_partkey, CASE WHEN coalesce(p.raw, '') = '' THEN 'Other' ELSE coalesce(m.cat, 'Unmapped Category') END AS category
FROM p LEFT JOIN m ON p.raw = m.raw""")
def category_map(spark, sf):
    return _with_raw(spark, sf).select("p_partkey", categorise.map_category(F.col("raw")).alias("category"))


@query("unmapped_report_c3c", _MAPPED + """
SELECT p.raw AS raw, count(*) AS n FROM p LEFT JOIN m ON p.raw = m.raw WHERE p.raw <> '' AND m.raw IS NULL GROUP BY p.raw""")
def unmapped_report(spark, sf):
    return categorise.unmapped_report(_with_raw(spark, sf), "raw")


_WORDS = (
    "harbour", "Strand", "the strand", "weather", "Golfplatz", "golfer", "I-95 exit", "city", "Lake Como", "osprey nest", "plaza",
    "old town, Spain", "view - Norway", "x — Bath", "hotell", "pupp", "train", "beachfront", "skiing", "ski", "dam", "dame",
)
_WORD_SQL = "[" + ", ".join("'" + w + "'" for w in _WORDS) + "]"


def _ascii_rule(pattern: str) -> str:
    """The rule as an engine without lookaround can run it on Latin titles: no lookbehind, no unspaced scripts."""
    cut = pattern.replace("(?<!the )", "")
    for i, ch in enumerate(cut):
        if ord(ch) > 0x2E80:
            return cut[: cut.rindex("|", 0, i)]
    return cut


_TITLE_SQL = f"(p_name || ' ' || list_extract({_WORD_SQL}, 1 + CAST(p_partkey % {len(_WORDS)} AS INTEGER)) || CASE WHEN p_partkey % 4 = 0 THEN ' 2' ELSE '' END)"
TITLE_CASES = " ".join(
    f"WHEN regexp_matches(h, '(?i){_ascii_rule(p)}') THEN '{c}'" for c, p in ft.TITLE_RULES
)


@query("title_category_c2", f"""
WITH t AS (SELECT p_partkey, {_TITLE_SQL} AS title FROM part),
s AS (SELECT p_partkey, title, regexp_replace(string_split(title, ' — ')[1], '(?i)the strand', 'the_trand', 'g') AS h FROM t)
SELECT p_partkey, title, CASE {TITLE_CASES}
  WHEN regexp_matches(title, ' — |,\\s+[A-Z]| - [A-Z][a-z]+\\s*\\.?\\s*$') THEN 'Travel & Events' END AS category FROM s""")
def title_category(spark, sf):
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("p_partkey") % len(_WORDS) + 1).cast("int"))
    tail = F.when(F.col("p_partkey") % 4 == 0, " 2").otherwise("")
    df = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" "), word, tail).alias("title"))
    return df.withColumn("category", categorise.category_from_title(F.col("title")))


@query("page_title_category_c2")
def page_title_category(spark, sf):
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return table(spark, sf, "pages").select("page_id", categorise.final_category(F.lit(None).cast("string"), title).alias("category"))


@query("exclude_categories_p15", """
SELECT c_custkey, c_mktsegment AS category FROM customer WHERE lower(c_mktsegment) NOT IN ('building', 'machinery')""")
def exclude_categories(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("category"))
    return categorise.exclude_categories(df, [" Building", "MACHINERY ", ""])


@query("unknown_categories_p16", _MAPPED + f"""
SELECT DISTINCT lower(p.raw) AS name FROM p WHERE p.raw <> ''
  AND lower(p.raw) NOT IN ({", ".join("'" + c.lower().replace("'", "''") + "'" for c in ft.TAXONOMY)})""")
def unknown_categories(spark, sf):
    names = _with_raw(spark, sf).where(F.col("raw") != "").select(F.lower("raw").alias("name")).distinct()
    return categorise.unknown_categories(names)


_IP = """CASE hash_no % 8 WHEN 0 THEN '10.1.2.' || hash_no % 250 WHEN 1 THEN '172.' || (10 + hash_no % 40) || '.0.9'
  WHEN 2 THEN '169.254.1.1' WHEN 3 THEN '224.0.0.' || hash_no % 9 WHEN 4 THEN '192.0.0.' || hash_no % 20 ELSE '93.184.' || hash_no % 256 || '.34' END"""


@query("url_vetting_p17", f"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'ftp' || substr(url, strpos(url, ':')) ELSE url END AS url,
                  lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM pages),
h AS (SELECT DISTINCT host, length(host) * 31 + ascii(substr(host, length(host) - 14, 1)) AS hash_no FROM p),
d AS (SELECT host, hash_no, {_IP} AS ip FROM h WHERE hash_no % 13 <> 0),
n AS (SELECT host, ip, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
        + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS x, hash_no % 17 = 0 AS v6 FROM d),
u AS (SELECT host, ip, v6 OR (x BETWEEN 167772160 AND 184549375 OR x BETWEEN 2886729728 AND 2887778303 OR x BETWEEN 2851995648 AND 2852061183
        OR x BETWEEN 3758096384 AND 4026531839 OR (x BETWEEN 3221225472 AND 3221225727 AND x NOT IN (3221225481, 3221225482))) AS unsafe FROM n)
SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'bad-scheme' WHEN u.host IS NULL THEN 'dns-error' WHEN unsafe THEN 'blocked-ip' ELSE 'ok' END AS verdict,
  CASE WHEN page_id % 11 <> 0 AND NOT unsafe THEN ip END AS ip
FROM p LEFT JOIN u ON p.host = u.host""")
def url_vetting(spark, sf):
    pages = table(spark, sf, "pages")
    u = F.when(F.col("page_id") % 11 == 0, F.concat(F.lit("ftp"), F.substr("url", F.locate(":", F.col("url"))))).otherwise(F.col("url"))
    hosts = pages.select(urls.host(F.col("url")).alias("host")).distinct()
    no = F.length("host") * 31 + F.ascii(F.substr("host", F.length("host") - 14, F.lit(1)))
    hosts = hosts.withColumn("hash_no", no).where(F.col("hash_no") % 13 != 0)
    v4 = hosts.select("host", F.lit(0).alias("seq"), F.expr(_IP).alias("ip"))
    v6 = hosts.where(F.col("hash_no") % 17 == 0).select("host", F.lit(1).alias("seq"), F.lit("fe80::1").alias("ip"))
    out = vetting.vet_urls(pages.select("page_id", u.alias("url")), v4.unionByName(v6))
    return out.select("page_id", "verdict", "ip")
