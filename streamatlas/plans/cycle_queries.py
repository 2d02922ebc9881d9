"""Queries over several build cycles: the whole build with its failures, and state that is carried from cycle to cycle."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, functions as F

from ..fixed import sites as fs
from ..functions import urls
from ..operators.crawl_log import CrawlLog
from ..operators.rotation import Rotation
from ..session import ensure_checkpoint_dir
from ..sources import adapters, isolation
from . import build
from .registry import ORACLES, query, table
from .site_queries import LISTED, OUT, SITE_PAGES, T, index, numbered, pages_of, rows, run, union, windy_pages

_NUMBER = re.compile(r"cam=(\w+)")
_SOURCES = ("cxtvlive", "explore", "resortcams", "ozolio")


def _by_function(url: str, part: int, body: str):
    """A site given as a function of one document; a number that is none is an error of that document."""
    n = int(_NUMBER.search(body)[1])
    yield {"title": f"Bear river {n}", "source_page_url": url, "target_url": f"https://cdn.example.net/o{n}.m3u8"}


def _by_frame(pages: DataFrame) -> DataFrame:
    """The same site as a frame; there such a number fails the whole job."""
    df = pages.select("url", F.regexp_extract("body", _NUMBER.pattern, 1).cast("int").alias("n"))
    target = T("https://cdn.example.net/r{n}.m3u8")
    return adapters._rows(
        df, k2=F.col("n"), title=T("Bear river {n}"), source_page_url=F.col("url"), target_url=target, predisc_key=urls.merge_key(target)
    )


def _landed(df: DataFrame, cycle: int) -> DataFrame:
    """The documents of a cycle. In the second, one source has a third of its streams and two have documents that break them."""
    cxtv = df.where(LISTED).where(F.expr("n % 4 <> 0" if cycle == 2 else "true"))
    listing = index(cxtv, fs.CXTV_SITEMAP, T("<loc>https://www.cxtvlive.com/live-camera/slug-{n}</loc>"))
    cams = pages_of(cxtv, T("https://www.cxtvlive.com/live-camera/slug-{n}"), T('<h1>Bear river {n}</h1>"https://cdn.example.net/c{n}.m3u8"'))
    item = F.to_json(F.struct(F.lit("live").alias("state"), T("Bear river {n}").alias("name"), T("https://cdn.example.net/e{n}.m3u8").alias("playlistUrl")))
    feed = index(df.where(F.expr("n % 9 = 0" if cycle == 2 else "n % 3 = 0")), fs.EXPLORE_API, item, '{"streams": [', "]}", ",")
    broken = lambda where: F.when(F.expr(where) & F.lit(cycle == 2), F.lit("cam=lost ")).otherwise(T("cam={n} "))
    by_function = pages_of(df.where("n % 5 = 1"), T("https://function.example.net/{n}"), broken("n % 50 = 1"))
    by_frame = pages_of(df.where("n % 5 = 2"), T("https://frame.example.net/{n}"), broken("n = 7"))
    of = {"cxtvlive": union(listing, cams), "explore": feed, "resortcams": by_frame, "ozolio": by_function}
    return union(*[pages.withColumn("source", F.lit(name)) for name, pages in of.items()])


_KEPT = "SELECT page_id AS n FROM pages WHERE page_id % 10 <> 3"


def _entries(source: str, page: str, target: str, where: str, suffix: str = "''") -> str:
    return (
        f"SELECT 'entry' AS kind, '{source}' AS source, left(sha256('{source}|' || {page} || '|0'), 16) AS id, 'Bear river ' || n || {suffix} AS title, 'Animals' AS category, "
        f"{page} AS url, 'https://cdn.example.net/{target}' || n || '.m3u8' AS target_url FROM k WHERE {where}"
    )


def _told(kind: str, source: str, id_: str, title: str, category: str, url: str = "NULL", tail: str = "") -> str:
    return f"SELECT '{kind}', '{source}', {id_}, '{title}', '{category}', {url}, NULL {tail}"


@query("build_cycles_t8", f"WITH k AS ({_KEPT}) " + " UNION ALL ".join([
    _entries("cxtvlive", "'https://www.cxtvlive.com/live-camera/slug-' || n", "c", "n % 9 <> 8 AND n % 4 <> 0", "' — Slug ' || n"),
    _entries("explore", "'https://cdn.example.net/e' || n || '.m3u8'", "e", "n % 3 = 0"),
    _entries("ozolio", "'https://function.example.net/' || n", "o", "n % 5 = 1"),
    _entries("resortcams", "'https://frame.example.net/' || n", "r", "n % 5 = 2"),
    _told("guard", "cxtvlive", "'2'", "accept", "ok"), _told("guard", "explore", "'1'", "hold", "degraded"),
    _told("guard", "ozolio", "'1'", "reuse", "dead"), _told("guard", "resortcams", "'1'", "reuse", "dead"),
    _told("quarantine", "ozolio", "'0'", "ValueError", "invalid literal for int() with base 10: ''lost''", "'https://function.example.net/' || page_id", "FROM pages WHERE page_id % 50 = 1"),
    _told("quarantine", "resortcams", "'0'", "CAST_INVALID_INPUT", "", "'https://frame.example.net/7'"),
]))
def build_cycles(spark, sf):
    """Two whole cycles, from landed documents to entries. A source broken by one document is served from its last cycle, and the documents are told."""
    df = numbered(spark, sf)
    text = F.when(F.expr("n % 10 = 3"), F.lit("<html>gone</html>")).otherwise(F.lit("#EXTM3U\n#EXTINF:4,\ns.ts\n"))
    manifests = df.select(F.explode(F.array(*[T("https://cdn.example.net/" + x + "{n}.m3u8") for x in "ceor"])).alias("url"), text.alias("text"))
    bodies = df.select(T("https://player.example.net/{n}").alias("url"), F.col("html").alias("body"))
    sites = {**adapters.ADAPTERS, "ozolio": isolation.document_source(_by_function), "resortcams": _by_frame}
    first = build.run_cycle(_landed(df, 1), manifests, bodies, 1, names=_SOURCES, table=sites)
    second = build.run_cycle(_landed(df, 2), manifests, bodies, 2, history=first.rollup, kept_before=first.kept, names=_SOURCES, table=sites)
    none = F.lit(None).cast("string")
    entries = second.entries.select(F.lit("entry").alias("kind"), "source", "id", "title", "category", F.col("source_page_url").alias("url"), "target_url")
    guard = second.guarded.where("cycle = 2").select(
        F.lit("guard"), "source", F.col("served_cycle").cast("string"), "decision", "status", none, none
    )
    # the message of a failed job differs between versions of Spark; its condition doesn't
    detail = F.when(F.col("source") == "ozolio", F.col("detail")).otherwise("")
    broken = second.quarantine.select(F.lit("quarantine"), "source", F.col("part").cast("string"), "error", detail, "url", none)
    return entries.union(guard).union(broken)


_CYCLES, _EVERY = 16, 12

_ROTATION = f"""WITH RECURSIVE c AS (SELECT list(c_custkey ORDER BY c_custkey) AS ids, count(*) // 4 AS budget FROM customer),
s AS (
  SELECT 0 AS t, CAST([] AS BIGINT[]) AS live, CAST(0 AS BIGINT) AS cursor, CAST(0 AS BIGINT) AS builds_left, 0 AS scans, CAST(0 AS BIGINT) AS probed, false AS enumerated
  UNION ALL
  SELECT t + 1, list_filter(list_concat(live, turn), lambda x: CASE WHEN (x * 31 + (t + 1) * 17) % 10 < 3 THEN true WHEN (x * 31 + (t + 1) * 17) % 10 < 7 THEN false ELSE list_contains(live, x) END),
    CAST((st + sz) % len(rest) AS BIGINT), CAST(builds_left AS BIGINT), scans, CAST(len(live) + sz AS BIGINT), due
  FROM (SELECT *, list_slice(list_concat(rest, rest), st + 1, st + sz) AS turn FROM (
    SELECT *, cursor % len(rest) AS st, least(len(rest), greatest(0, budget - len(live))) AS sz FROM (
      SELECT *, list_filter(ids, lambda x: (scans >= 3 OR x % 3 <> 0 OR (scans = 2 AND x % 7 <> 0)) AND NOT list_contains(live, x)) AS rest FROM (
        SELECT t, live, cursor, due, scans + due::INT AS scans, (CASE WHEN NOT due THEN builds_left WHEN scans = 0 THEN 0 ELSE {_EVERY} END) - 1 AS builds_left, ids, budget
        FROM (SELECT s.*, (scans = 0 OR builds_left <= 0) AS due, ids, budget FROM s, c WHERE t < {_CYCLES})))))
)
SELECT 'cycle' AS kind, CAST(t AS BIGINT) AS n, probed, cursor, builds_left, CAST(len(live) AS BIGINT) AS live, enumerated FROM s WHERE t > 0
UNION ALL SELECT 'live', unnest(live), NULL, NULL, NULL, NULL, NULL FROM s WHERE t = {_CYCLES}"""


@query("rotation_t4_t3", _ROTATION)
def rotation(spark, sf):
    """Cycles of a corpus with its state: the first enumeration is cut short, the second starts the countdown, the third comes when it ends. One cycle is run twice."""
    customers = table(spark, sf, "customer")
    state = Rotation(spark, f"{ensure_checkpoint_dir(spark)}/rotation-{uuid.uuid4().hex}", buckets=2, every=_EVERY)
    corpus = customers.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("").alias("city"), F.lit("").alias("country"), F.lit(0).cast("long").alias("seq")
    )
    scans = [corpus.where("id % 3 <> 0"), corpus.where("id % 7 <> 0"), corpus]
    budget, turns, done = customers.count() // 4, [], 0

    for cycle in range(1, _CYCLES + 1):
        answer = F.expr(f"(id * 31 + {cycle} * 17) % 10")
        verdicts = lambda batch: batch.select("id", F.when(answer < 3, True).when(answer < 7, False).alias("live"))
        for _ in range(2 if cycle == 9 else 1):
            turn = state.run(cycle, lambda: (scans[done].withColumn("seq", F.lit(cycle).cast("long")), done == 0), verdicts, budget)
        done += turn.enumerated
        turns.append(("cycle", turn.cycle, turn.probed, turn.cursor, turn.builds_left, turn.live, turn.enumerated))
    schema = "kind string, n long, probed long, cursor long, builds_left long, live long, enumerated boolean"
    live = state.live.read().select(F.lit("live").alias("kind"), F.col("id").alias("n"))
    return spark.createDataFrame(turns, schema).unionByName(live, allowMissingColumns=True)


@query("windy_turns_t3", """
WITH c AS (SELECT page_id AS n, row_number() OVER (ORDER BY page_id) AS r FROM pages WHERE page_id % 9 <> 8), b AS (SELECT count(*) // 2 AS b FROM pages),
live1 AS (SELECT n FROM c, b WHERE r <= b AND n % 5 > 0), rest AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS pos FROM c WHERE n NOT IN (SELECT n FROM live1)),
z AS (SELECT count(*) AS m, least(count(*), greatest(0, any_value(b) - (SELECT count(*) FROM live1))) AS size, any_value(b) % count(*) AS start FROM rest, b),
l AS (SELECT n FROM live1 UNION ALL SELECT n FROM rest, z WHERE (pos - start + m) % m < size)
""" + rows("Cam {n} — City {n % 4}, Land", "https://webcams.windy.com/webcams/stream/{n}", "https://e.example.net/a?x=1&id={n}", None, where="n % 5 > 0"))
def windy_turns(spark, sf):
    """The second cycle of the source with its state: the streams found live in the first, and the next slice of the corpus."""
    pages = windy_pages(spark, sf)
    state = Rotation(spark, f"{ensure_checkpoint_dir(spark)}/windy-{uuid.uuid4().hex}", buckets=4)
    budget = table(spark, sf, "pages").count() // 2
    adapters.windy_turn(pages, state, 1, budget)
    return adapters.windy_turn(pages, state, 2, budget)[0].select(*OUT)


@query("crawl_log_s1", """
WITH f AS (
  SELECT page_id, url, 1 AS cycle, CASE WHEN page_id % 11 = 0 THEN 'http-503' WHEN octet_length(encode(html)) > 8000 THEN 'too-large' ELSE 'ok' END AS outcome, html FROM pages
  UNION ALL SELECT page_id, url, 2, CASE WHEN octet_length(encode(html)) + 9 > 8000 THEN 'too-large' ELSE 'ok' END, html || '<!-- 2 --' FROM pages WHERE page_id % 25 = 0
), last AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY cycle DESC, page_id DESC) AS r FROM f)
SELECT url, outcome, cycle AS seq, CASE WHEN outcome = 'ok' THEN sha256(html) END AS body FROM last WHERE r = 1""")
def crawl_log(spark, sf):
    """Two landings of the pages, the second with a few of them fetched again, and an older fetch that comes late; the log has the last fetch of each URL."""
    pages = table(spark, sf, "pages").withColumn("source", F.lit("site")).withColumn("part", F.lit(0))
    at = lambda cycle: F.timestamp_seconds(F.lit(cycle * 1000).cast("long") * 1_000_000 + F.col("page_id"))
    first = pages.select("source", "url", "part", at(1).alias("fetched_at"), F.lit(1).alias("seq"), F.when(F.expr("page_id % 11 = 0"), "http-503").otherwise("ok").alias("outcome"), F.col("html").alias("body"))
    again = pages.where("page_id % 25 = 0").select("source", "url", "part", at(2).alias("fetched_at"), F.lit(2).alias("seq"), F.lit("ok").alias("outcome"), F.concat("html", F.lit("<!-- 2 --")).alias("body"))
    late = pages.where("page_id % 7 = 0").select("source", "url", "part", at(0).alias("fetched_at"), F.lit(0).alias("seq"), F.lit("timeout").alias("outcome"), F.lit(None).cast("string").alias("body"))
    log = CrawlLog(spark, f"{ensure_checkpoint_dir(spark)}/crawl-{uuid.uuid4().hex}", max_bytes=8000)
    log.land(1, first)
    log.land(2, again.unionByName(late))
    return log.last_fetches().select("url", "outcome", F.col("seq").cast("int").alias("seq"), F.sha2("body", 256).alias("body"))


_FETCHED_TWICE = {"beachcam": "source_beachcam_e9", "feratel": "source_feratel_e7", "livefromiceland": "source_livefromiceland", "ozolio": "source_ozolio", "viewsurf": "source_viewsurf"}


@query("fetched_twice_s1", " UNION ALL ".join(f"SELECT '{name}' AS site, * FROM ({ORACLES[own]})" for name, own in _FETCHED_TWICE.items()))
def fetched_twice(spark, sf):
    """Five sources over pages that were all fetched twice, the second time as they are now. Through the crawl log each gives the rows of one fetch."""
    log = CrawlLog(spark, f"{ensure_checkpoint_dir(spark)}/twice-{uuid.uuid4().hex}", buckets=8)
    now = union(*[SITE_PAGES[name](spark, sf).withColumn("source", F.lit(name)) for name in _FETCHED_TWICE])
    fetch = lambda n, body: now.withColumn("body", body).withColumns(
        {"fetched_at": F.timestamp_seconds(F.lit(1_000_000 * n)), "seq": F.lit(n), "outcome": F.lit("ok")}
    )
    log.land(1, fetch(1, F.concat(F.col("body"), F.lit("\n<p>of yesterday</p>"))).unionByName(fetch(2, F.col("body"))))
    documents = log.documents_of()
    found = [run(name, documents.where(F.col("source") == name).drop("source")).withColumn("site", F.lit(name)) for name in _FETCHED_TWICE]
    return union(*found)
