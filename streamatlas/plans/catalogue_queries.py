"""Queries of the catalogue build: merge, entries, snapshot, playlist, liveness joins, reports and the guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed import catalogue as fc
from ..operators import asof, categorise, guard, keyed, liveness, merge, reports
from ..sources import sinks
from .registry import query, table
from .url_queries import TITLE_CASES, _MAP_VALUES

# --- candidates out of the pages table ---------------------------------------------------------------------------------

CANDIDATES_SQL = r"""
SELECT page_id AS ord, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  CASE WHEN page_id % 5 = 0 THEN 'a' || page_id % 2 END AS angle_key,
  CASE page_id % 7 WHEN 0 THEN 'Birds' WHEN 1 THEN 'Ports' WHEN 2 THEN 'Other' WHEN 3 THEN 'slug' || page_id % 3 END AS category,
  CASE page_id % 5 WHEN 0 THEN 'youtube-api' WHEN 1 THEN 'worldcams' WHEN 2 THEN 'cxtvlive' ELSE 'site' || page_id % 3 END AS source,
  url AS source_page_url, 'https://t.example.net/' || page_id AS target_url,
  CASE WHEN page_id % 11 <> 0 THEN 'hls:' || regexp_extract(url, '^https?://(?:www\.|m\.|blog\.)?([^/?#]*)', 1) END AS predisc_key
FROM pages"""


def candidates(spark, sf):
    n = F.col("page_id")
    raw = F.when(n % 7 == 0, "Birds").when(n % 7 == 1, "Ports").when(n % 7 == 2, "Other").when(n % 7 == 3, F.concat(F.lit("slug"), n % 3))
    src = (
        F.when(n % 5 == 0, "youtube-api").when(n % 5 == 1, "worldcams").when(n % 5 == 2, "cxtvlive")
        .otherwise(F.concat(F.lit("site"), n % 3))
    )
    key = F.concat(F.lit("hls:"), F.regexp_extract("url", r"^https?://(?:www\.|m\.|blog\.)?([^/?#]*)", 1))
    return table(spark, sf, "pages").select(
        n.cast("long").alias("ord"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.when(n % 5 == 0, F.concat(F.lit("a"), n % 2)).alias("angle_key"), raw.alias("category"), src.alias("source"),
        F.col("url").alias("source_page_url"), F.concat(F.lit("https://t.example.net/"), n).alias("target_url"),
        F.when(n % 11 != 0, key).alias("predisc_key"),
    )


def _rank(x: str) -> str:
    cases = " ".join(f"WHEN '{s}' THEN {r}" for s, r in fc.MERGE_RANK.items())
    return f"((CASE {x}.source {cases} ELSE -1 END) * 2 + CASE WHEN {x}.category IS NULL THEN 0 ELSE 1 END)"


def _side(win: str, lose: str) -> str:
    return (
        "struct_pack(title := CASE WHEN a.source = 'youtube-api' AND a.title <> '' THEN a.title WHEN b.source = 'youtube-api' AND b.title <> '' "
        f"THEN b.title WHEN length(b.title) > length(a.title) THEN b.title ELSE a.title END, category := coalesce({win}.category, {lose}.category), "
        f"source := {win}.source, page := {win}.page, target := {win}.target, angle := {win}.angle)"
    )


MERGED_SQL = f"""
c AS ({CANDIDATES_SQL}),
g AS (SELECT predisc_key, min(ord) AS ord, list(struct_pack(title := title, category := category, source := source, page := source_page_url,
        target := target_url, angle := angle_key) ORDER BY ord) AS l FROM c WHERE predisc_key IS NOT NULL GROUP BY predisc_key),
r AS (SELECT predisc_key, ord, list_reduce(l, lambda a, b: CASE WHEN {_rank('a')} >= {_rank('b')} THEN {_side('a', 'b')} ELSE {_side('b', 'a')} END) AS m FROM g),
merged AS (SELECT ord, m.title AS title, m.angle AS angle_key, m.category AS category, m.source AS source, m.page AS source_page_url,
             m.target AS target_url, predisc_key FROM r
           UNION ALL SELECT ord + {merge.TAIL_BIT}, title, angle_key, category, source, source_page_url, target_url, predisc_key FROM c
           WHERE predisc_key IS NULL)"""

_H = "string_split(title, ' — ')[1]"
ENTRIES_SQL = MERGED_SQL + rf""",
mp(raw, cat) AS (VALUES {_MAP_VALUES}),
cu AS (SELECT *, lower(regexp_extract(source_page_url, '^https?://([^/?#:]*)', 1)) AS chost,
         regexp_replace(regexp_extract(source_page_url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS cpath,
         array_to_string(list_filter(string_split(regexp_extract(source_page_url, '\?([^#]*)', 1), '&'),
           lambda x: x <> '' AND NOT starts_with(x, 'utm_')), '&') AS cq FROM merged),
mc AS (SELECT cu.*, CASE WHEN coalesce(category, '') = '' THEN 'Other' ELSE coalesce(mp.cat, 'Unmapped Category') END AS mapped
       FROM cu LEFT JOIN mp ON cu.category = mp.raw),
h AS (SELECT *, {_H} AS h FROM mc),
entries AS (SELECT ord, substr(sha256(source || '|https://' || chost || CASE WHEN cpath = '' THEN '/' ELSE cpath END ||
      CASE WHEN cq = '' THEN '' ELSE '?' || cq END || '|' || coalesce(angle_key, '0')), 1, 16) AS id,
    CASE WHEN title = '' THEN '(untitled)' ELSE title END AS title,
    CASE WHEN mapped <> 'Other' THEN mapped ELSE coalesce(CASE {TITLE_CASES}
      WHEN regexp_matches(title, ' — |,\s+[A-Z]| - [A-Z][a-z]+\s*\.?\s*$') THEN 'Travel & Events' END, 'Other') END AS category,
    source, source_page_url, target_url FROM h)"""


@query("keyed_merge_a1", f"WITH {MERGED_SQL} SELECT * FROM merged")
def keyed_merge(spark, sf):
    return merge.merge_candidates(candidates(spark, sf))


def entries(spark, sf):
    return categorise.to_entries(merge.merge_candidates(candidates(spark, sf)))


@query("entries_c3", f"WITH {ENTRIES_SQL} SELECT * FROM entries")
def entries_query(spark, sf):
    return entries(spark, sf)


_SNAP = ENTRIES_SQL + """,
kept AS (SELECT *, ord % 4 AS bucket FROM entries WHERE lower(category) NOT IN ('traffic')),
shared AS (SELECT ord, CASE WHEN bucket = 0 THEN substr(id, 1, 1) ELSE id END AS id, title, category, source, source_page_url, target_url FROM kept),
snap AS (SELECT min(ord) AS ord, id, arg_max(title, ord) AS title, arg_max(category, ord) AS category, arg_max(source, ord) AS source,
  arg_max(source_page_url, ord) AS source_page_url, arg_max(target_url, ord) AS target_url FROM shared GROUP BY id)"""


def snapshot(spark, sf):
    kept = categorise.exclude_categories(entries(spark, sf), ["traffic"])
    # A quarter of the ids is cut to one digit, so that ids collide.
    return sinks.snapshot_rows(kept.withColumn("id", F.when(F.col("ord") % 4 == 0, F.substring("id", 1, 1)).otherwise(F.col("id"))))


@query("snapshot_k2", f"WITH {_SNAP} SELECT * FROM snap")
def snapshot_query(spark, sf):
    return snapshot(spark, sf)


@query("playlist_k1_l1", f"""WITH {_SNAP}
SELECT -1 AS ord, 0 AS line_no, '#EXTM3U' AS line UNION ALL
SELECT ord, 0, '#EXTINF:-1 tvg-id="' || id || '" tvg-name="' || title || '" group-title="' || category || '",' || title FROM snap UNION ALL
SELECT ord, 1, 'http://cat.example/stream/' || id FROM snap""")
def playlist(spark, sf):
    return sinks.playlist_lines(snapshot(spark, sf), "http://cat.example").orderBy("ord", "line_no")


@query("catalogue_totals_a14", f"WITH {ENTRIES_SQL} SELECT category, source, count(*) AS n FROM entries GROUP BY CUBE (category, source)")
def catalogue_totals(spark, sf):
    return reports.catalogue_totals(entries(spark, sf))


@query("distinct_first_a2", """
SELECT md5(text) AS text_hash, arg_min(source, doc_id) AS source, min(doc_id) AS doc_id FROM documents GROUP BY md5(text)""")
def distinct_first(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("text_hash"))
    return keyed.first_by(docs, ["text_hash"], ["doc_id"], ["doc_id", "source"])


@query("two_feeds_u1_u3_u4", """
WITH f AS (SELECT 0 AS feed, l_partkey AS k, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey
  UNION ALL SELECT 1, l_partkey, min(l_orderkey * 10 + l_linenumber) FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_partkey)
SELECT k, CAST(arg_min(feed, feed) AS INTEGER) AS feed, arg_min(pos, feed) AS pos FROM f GROUP BY k""")
def two_feeds(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "l_returnflag", "l_linestatus"
    )
    both = li.where(F.col("l_returnflag") == "R").withColumn("feed", F.lit(0)).unionByName(
        li.where(F.col("l_linestatus") == "O").withColumn("feed", F.lit(1))
    )
    return keyed.first_by(both, ["k"], ["feed", "pos"], ["feed", "pos"])


@query("union_minus_skip_u2", """
SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' UNION SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def union_minus_skip(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    both = o.where(F.col("o_orderstatus") == "O").select(F.col("o_custkey").alias("k")).union(
        c.where(F.col("c_acctbal") > 5000).select("c_custkey")
    ).distinct()
    return both.join(c.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("k")), "k", "left_anti")


# --- liveness ----------------------------------------------------------------------------------------------------------


@query("live_semi_j1", "SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) l ON o_custkey = c_custkey")
def live_semi(spark, sf):
    live = table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(live, "o_custkey", "left_semi")


@query("live_anti_j1", """
SELECT o_orderkey, o_custkey, 'yt-offline' AS reason FROM orders ANTI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) l ON o_custkey = c_custkey""")
def live_anti(spark, sf):
    live = table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("o_custkey"))
    gone = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(live, "o_custkey", "left_anti")
    return gone.withColumn("reason", F.lit(fc.YT_OFFLINE))


@query("video_verdict_p13_c3b", """
SELECT o_orderkey AS ord, CASE WHEN live.id IS NULL THEN 'yt-offline' END AS reason,
  CASE WHEN o_orderkey % 3 = 0 AND live.id IS NOT NULL AND live.name <> '' THEN live.name ELSE 'Ports' END AS category
FROM orders LEFT JOIN (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS name FROM customer WHERE c_acctbal > 0) live
ON o_custkey = live.id""")
def video_verdict(spark, sf):
    k = F.col("o_orderkey")
    cands = table(spark, sf, "orders").select(
        k.alias("ord"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("angle_key"), F.lit("Ports").alias("category"),
        F.when(k % 3 == 0, fc.OFFICIAL_TITLE_SOURCE).otherwise("skyline").alias("source"), F.lit("p").alias("source_page_url"),
        F.lit("u").alias("target_url"), F.concat(F.lit("yt:"), F.col("o_custkey")).alias("predisc_key"),
    )
    name = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment"))
    live = table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").cast("string").alias("video_id"), name.alias("category_name")
    )
    empty = spark.createDataFrame([], "url string, body string"), spark.createDataFrame([], "url string, text string")
    return liveness.check_candidates(cands, live, *empty).select("ord", "reason", "category")


@query("fill_category_c3b", """
SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(n.name, 'Ports') ELSE 'Ports' END AS category
FROM orders LEFT JOIN (SELECT c_custkey AS id, c_mktsegment AS name FROM customer WHERE c_custkey % 4 <> 0) n ON o_custkey = n.id""")
def fill_category(spark, sf):
    k = F.col("o_orderkey")
    cands = table(spark, sf, "orders").select(
        k.alias("ord"), F.lit("Ports").alias("category"), F.concat(F.lit("yt:"), F.col("o_custkey")).alias("predisc_key"),
        F.when(k % 3 == 0, fc.OFFICIAL_TITLE_SOURCE).otherwise("skyline").alias("source"),
    )
    name = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment"))
    live = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("video_id"), name.alias("category_name"))
    return categorise.fill_video_category(cands, live).select("ord", "category")


@query("shared_verdict_j2", """
SELECT l_orderkey, l_linenumber, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'dead-manifest' ELSE 'resolve-failed:' || p_brand END AS reason
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def shared_verdict(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"))
    size = F.col("p_size") % 3
    reason = F.when(size == 1, fc.DEAD_MANIFEST).when(size == 2, F.concat(F.lit(fc.RESOLVE_FAILED + ":"), F.col("p_brand")))
    probes = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), reason.alias("reason"))
    return keyed.lookup_by_key(li, probes, "k", F.col("l_orderkey"), ["reason"]).select("l_orderkey", "l_linenumber", "reason")


@query("listing_priority_j3", """
WITH l AS (SELECT l_partkey, arg_min('list' || l_suppkey % 7, (l_suppkey % 7) * 10000000000 + l_orderkey * 10 + l_linenumber) AS category
  FROM lineitem WHERE l_discount > 0.05 GROUP BY l_partkey)
SELECT p_partkey, l.category AS category FROM part LEFT JOIN l ON p_partkey = l_partkey""")
def listing_priority(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_discount") > 0.05).select(
        F.col("l_partkey").alias("p_partkey"), (F.col("l_suppkey") % 7).alias("rank"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b")
    )
    firsts = keyed.first_by(li, ["p_partkey"], ["rank", "a", "b"], ["rank"])
    named = firsts.select("p_partkey", F.concat(F.lit("list"), F.col("rank")).alias("category"))
    return table(spark, sf, "part").select("p_partkey").join(named, "p_partkey", "left")


_ASOF = """
WITH log AS (SELECT event_id AS seq, user_id, ts, 't' || event_id % 2 AS target,
    CASE WHEN event_type = 'error' THEN NULL ELSE 'https://u.example/' || event_id END AS url,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value * 40) AS BIGINT) - 200 END AS ttl
  FROM events WHERE event_type IN ('error', 'signup', 'view')),
req AS (SELECT event_id, user_id, ts, 't' || event_id % 2 AS target FROM events WHERE event_type IN ('click', 'purchase')),
j AS (SELECT req.event_id, req.ts AS asked_at, req.target AS asked, arg_max(struct_pack(ts := log.ts, target := log.target, url := log.url, ttl := log.ttl),
        struct_pack(ts := log.ts, seq := log.seq)) AS f
  FROM req LEFT JOIN log ON req.user_id = log.user_id AND log.ts <= req.ts GROUP BY ALL),
a AS (SELECT event_id, asked_at, asked, f, CASE WHEN f.url IS NULL THEN 60.0 WHEN f.ttl IS NULL THEN 480.0 WHEN f.ttl > 0 THEN f.ttl * 0.8 ELSE 0.0 END AS life FROM j),
b AS (SELECT event_id, f, f.target = asked AND epoch_us(asked_at) < epoch_us(f.ts) + CAST(round(life * 1000000) AS BIGINT) AS fresh FROM a)
SELECT event_id, CASE WHEN coalesce(fresh, false) THEN CASE WHEN f.url IS NULL THEN 'failed' ELSE 'hit' END ELSE 'miss' END AS answer,
  CASE WHEN coalesce(fresh, false) THEN f.url END AS resolved_url FROM b"""


@query("resolve_asof_j8_c16", _ASOF)
def resolve_asof(spark, sf):
    ev = table(spark, sf, "events")
    n = F.col("event_id")
    target = F.concat(F.lit("t"), n % 2)
    log = ev.where(F.col("event_type").isin("error", "signup", "view")).select(
        n.alias("seq"), F.col("user_id").alias("entry_id"), F.col("ts").alias("resolved_at"), target.alias("target_url"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("https://u.example/"), n)).alias("url"),
        F.when(n % 5 != 0, F.floor(F.col("value") * 40) - 200).cast("long").alias("ttl_seconds"),
    )
    req = ev.where(F.col("event_type").isin("click", "purchase")).select(
        "event_id", F.col("user_id").alias("entry_id"), F.col("ts").alias("at"), target.alias("target_url")
    )
    return liveness.resolve_lookup(req, log).select("event_id", "answer", "resolved_url")


# --- reports over the events table --------------------------------------------------------------------------------------

_CHECKED = """c AS (SELECT 's' || user_id % 23 AS source, event_id, user_id,
  CASE event_type WHEN 'error' THEN 'resolve-failed:code ' || CAST(value AS INTEGER) % 5 WHEN 'signup' THEN 'dead-manifest' WHEN 'purchase' THEN 'no-extractor' END AS reason,
  'https://h' || user_id || '.example.org/x/' || event_id AS target_url FROM events)"""


def checked(spark, sf):
    t = F.col("event_type")
    reason = (
        F.when(t == "error", F.concat(F.lit("resolve-failed:code "), F.bround("value").cast("int") % 5))
        .when(t == "signup", fc.DEAD_MANIFEST).when(t == "purchase", fc.NO_EXTRACTOR)
    )
    return table(spark, sf, "events").select(
        F.concat(F.lit("s"), F.col("user_id") % 23).alias("source"), "event_id", reason.alias("reason"),
        F.concat(F.lit("https://h"), F.col("user_id"), F.lit(".example.org/x/"), F.col("event_id")).alias("target_url"),
    )


@query("drop_reasons_a4", f"""WITH {_CHECKED}
SELECT source, split_part(reason, ':', 1) AS label, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY ALL""")
def drop_reasons(spark, sf):
    return reports.drop_reasons(checked(spark, sf))


@query("missing_hosts_a5", f"""WITH {_CHECKED}
SELECT source, 'h' || user_id || '.example.org' AS host, count(*) AS n FROM c WHERE reason = 'no-extractor' GROUP BY ALL""")
def missing_hosts(spark, sf):
    return reports.missing_extractor_hosts(checked(spark, sf))


@query("failure_details_a6", f"""WITH {_CHECKED}
SELECT source, split_part(reason, ':', 2) AS detail, count(*) AS n FROM c WHERE contains(reason, ':') GROUP BY ALL""")
def failure_details(spark, sf):
    return reports.failure_details(checked(spark, sf))


@query("top_reasons_l2", f"""WITH {_CHECKED},
n AS (SELECT source, 'h' || user_id || '.example.org' AS host, count(*) AS n FROM c WHERE reason = 'no-extractor' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, host) AS rk FROM n)
SELECT source, string_agg(n || 'x ' || host, ', ' ORDER BY rk) AS hosts FROM r WHERE rk <= 3 GROUP BY source""")
def top_reasons(spark, sf):
    return keyed.top_counts(reports.missing_extractor_hosts(checked(spark, sf)), ["source"], "host", "n", 3, "hosts")


@query("source_rollup_a3", f"""WITH {_CHECKED}
SELECT source, count(*) AS discovered, count(*) FILTER (reason IS NULL) AS kept FROM c GROUP BY source""")
def source_rollup(spark, sf):
    return guard.source_rollup(checked(spark, sf), ["source"])


_LOG = """f AS (SELECT 's' || user_id % 23 AS source, CASE WHEN user_id % 50 = 0 THEN '' ELSE 'h' || user_id END AS host,
  CASE WHEN user_id % 23 = 3 THEN 'http-403' WHEN user_id % 23 = 4 THEN 'ok' WHEN event_type IN ('click', 'view') THEN 'ok' WHEN event_type = 'error' THEN 'http-503'
    WHEN event_type = 'signup' THEN 'timeout' ELSE 'http-404' END AS outcome, ts, value / 100 AS backoff_s, event_id FROM events),
o AS (SELECT source, CASE WHEN host = '' THEN '?' ELSE host END AS host, outcome, count(*) AS n FROM f GROUP BY ALL)"""


def fetch_log(spark, sf):
    t, u = F.col("event_type"), F.col("user_id")
    outcome = (
        F.when(u % 23 == 3, "http-403").when(u % 23 == 4, "ok").when(t.isin("click", "view"), "ok").when(t == "error", "http-503")
        .when(t == "signup", "timeout").otherwise("http-404")
    )
    return table(spark, sf, "events").select(
        F.concat(F.lit("s"), u % 23).alias("source"), F.when(u % 50 == 0, "").otherwise(F.concat(F.lit("h"), u)).alias("host"),
        outcome.alias("outcome"), "ts", (F.col("value") / 100).alias("backoff_s"), "event_id",
    )


@query("outcome_labels_p18_p19", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'signup' THEN 'http-' || (400 + CAST(user_id % 100 AS INTEGER)) WHEN 'purchase' THEN 'conn-error'
  ELSE 'ok' END AS outcome, CASE event_type WHEN 'error' THEN 'hop.example.org' WHEN 'view' THEN '?' ELSE 'h' || user_id || '.example.org' END AS host FROM events""")
def outcome_labels(spark, sf):
    t = F.col("event_type")
    status = F.when(t == "signup", 400 + F.col("user_id") % 100).when(t.isin("click", "view"), 200).cast("int")
    error = F.when(t == "error", "ConnectTimeout").when(t == "purchase", "ConnectionError").when(t == "signup", "HTTPError")
    url = F.when(t != "view", F.concat(F.lit("https://h"), F.col("user_id"), F.lit(".example.org/a"))).otherwise("")
    hop = F.when(t == "error", "https://Hop.example.org:8080/x")
    return table(spark, sf, "events").select(
        "event_id", reports.outcome_label(status, error).alias("outcome"), reports.attributed_host(hop, url).alias("host")
    )


@query("fetch_outcomes_a7", f"WITH {_LOG} SELECT * FROM o")
def fetch_outcomes(spark, sf):
    return reports.fetch_outcomes(fetch_log(spark, sf))


_CAP = f"""WITH {_LOG}, rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, host, outcome) AS r FROM o),
cap AS (SELECT source, CASE WHEN r <= 10 THEN host ELSE 'other' END AS host, outcome, CAST(sum(n) AS BIGINT) AS n FROM rk GROUP BY ALL)"""


@query("capped_hosts_a7", _CAP + " SELECT * FROM cap")
def capped_hosts(spark, sf):
    return reports.cap_hosts(reports.fetch_outcomes(fetch_log(spark, sf)), 10)


@query("outcome_maps_a7_c23", _CAP + """, h AS (SELECT source, host, '{' || string_agg('"' || outcome || '":' || n, ',' ORDER BY outcome) || '}' AS m FROM cap GROUP BY ALL)
SELECT source, string_agg(host || '=' || m, ' ' ORDER BY host) AS fetches FROM h GROUP BY source""")
def outcome_maps(spark, sf):
    maps = reports.outcome_maps(reports.cap_hosts(reports.fetch_outcomes(fetch_log(spark, sf)), 10))
    entry = F.transform(F.array_sort(F.map_entries("fetches")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return maps.select("source", F.array_join(entry, " ").alias("fetches"))


@query("failure_counts_a8", f"WITH {_LOG} SELECT source, outcome || ' ' || host AS failure, CAST(sum(n) AS BIGINT) AS n FROM o WHERE outcome <> 'ok' GROUP BY ALL")
def failure_counts(spark, sf):
    return reports.failure_counts(reports.fetch_outcomes(fetch_log(spark, sf)))


@query("phase_totals_a12_a8", f"""WITH {_LOG}
SELECT CASE WHEN event_id % 3 = 0 THEN 'probe' ELSE 'resolver' END AS phase, count(*) AS fetched, count(*) FILTER (outcome = 'ok') AS ok,
  count(*) FILTER (outcome <> 'ok') AS failed FROM f GROUP BY ALL""")
def phase_totals(spark, sf):
    phase = F.when(F.col("event_id") % 3 == 0, "probe").otherwise("resolver")
    return reports.fetch_totals(reports.fetch_outcomes(fetch_log(spark, sf).withColumn("phase", phase), ("phase",)), "phase")


@query("host_pressure_a11", f"""WITH {_LOG}
SELECT host, count(*) FILTER (outcome IN ('http-429', 'http-503')) AS penalties FROM f GROUP BY host""")
def host_pressure(spark, sf):
    return reports.pressure(fetch_log(spark, sf)).select("host", "penalties")


@query("top_pressure_a11_l4", f"""WITH {_LOG}
SELECT host, count(*) FILTER (outcome IN ('http-429', 'http-503')) AS penalties FROM f GROUP BY host ORDER BY penalties DESC, host LIMIT 3""")
def top_pressure(spark, sf):
    return reports.top_pressure(reports.pressure(fetch_log(spark, sf))).select("host", "penalties")


def _top(src: str, label: str, k: int, out: str) -> str:
    return (f"(SELECT source, string_agg(n || 'x ' || {label}, ', ' ORDER BY rk) AS {out} FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY source ORDER BY n DESC, {label}) AS rk FROM {src}) WHERE rk <= {k} GROUP BY source)")


_DIAG = f"""WITH {_CHECKED}, {_LOG},
roll AS (SELECT source, CASE WHEN source IN ('s3', 's4') THEN 0 ELSE count(*) END AS discovered,
           CASE WHEN source IN ('s3', 's4') THEN 0 ELSE count(*) FILTER (reason IS NULL) END AS kept FROM c GROUP BY source),
tot AS (SELECT source, sum(n) AS fetched, sum(CASE WHEN outcome = 'ok' THEN n ELSE 0 END) AS ok FROM o GROUP BY source),
fl AS (SELECT source, outcome || ' ' || host AS failure, sum(n) AS n FROM o WHERE outcome <> 'ok' GROUP BY ALL),
dr AS (SELECT source, split_part(reason, ':', 1) AS label, count(*) AS n FROM c WHERE reason IS NOT NULL AND source NOT IN ('s3', 's4') GROUP BY ALL),
dn AS (SELECT source, sum(n) AS dropped FROM dr GROUP BY source),
j AS (SELECT roll.*, fetched, ok, fetched - ok AS failed, coalesce(top5, '') AS top5, top3, reasons, coalesce(dropped, 0) AS dropped FROM roll
  LEFT JOIN tot USING (source) LEFT JOIN {_top('fl', 'failure', 5, 'top5')} USING (source) LEFT JOIN {_top('fl', 'failure', 3, 'top3')} USING (source)
  LEFT JOIN {_top('dr', 'label', 4, 'reasons')} USING (source) LEFT JOIN dn USING (source)),
q AS (SELECT *, concat_ws('; ', CASE WHEN failed > 0 THEN fetched || ' fetched, ' || failed || ' failed: ' || top3 END,
   CASE WHEN dropped > 0 THEN 'dropped ' || dropped || ' (' || reasons || ')' END) AS parts FROM j)"""


def _diagnosis(spark, sf):
    empty = F.col("source").isin("s3", "s4")
    rows = checked(spark, sf)
    rollup = guard.source_rollup(rows, ["source"]).select(
        "source", F.when(empty, 0).otherwise(F.col("discovered")).alias("discovered"), F.when(empty, 0).otherwise(F.col("kept")).alias("kept")
    )
    outcomes = reports.fetch_outcomes(fetch_log(spark, sf))
    return reports.diagnose(
        rollup, reports.fetch_totals(outcomes), reports.failure_counts(outcomes), reports.drop_reasons(rows.where(~empty))
    )


@query("diagnose_sources_a10", _DIAG + """
SELECT source, CASE WHEN discovered = 0 AND ok = 0 THEN 'blocked' WHEN discovered = 0 THEN 'soft-block-or-layout' ELSE 'normal' END AS verdict, discovered = 0 AS warned,
 CASE WHEN discovered = 0 AND ok = 0 THEN source || ': 0 kept / 0 discovered — ' || fetched || ' fetched, 0 ok (' || top5 || ')'
  WHEN discovered = 0 THEN source || ': 0 kept / 0 discovered — ' || ok || ' fetched ok but extracted 0 URLs (site layout changed, or a soft block returning 200?)'
  WHEN parts <> '' THEN source || ': ' || kept || ' kept / ' || discovered || ' discovered — ' || parts
  ELSE source || ': ' || kept || ' kept / ' || discovered || ' discovered' END AS line FROM q""")
def diagnose_sources(spark, sf):
    return _diagnosis(spark, sf)


@query("drop_report_k4", f"""WITH {_CHECKED},
h AS (SELECT source, 'h' || user_id || '.example.org' AS host, count(*) AS n FROM c WHERE reason = 'no-extractor' GROUP BY ALL),
d AS (SELECT source, split_part(reason, ':', 2) AS detail, count(*) AS n FROM c WHERE contains(reason, ':') GROUP BY ALL),
hs AS (SELECT source, CAST(sum(n) AS BIGINT) AS missing FROM h GROUP BY source)
SELECT coalesce(hs.source, f.source) AS source, coalesce(missing, 0) AS missing, hosts, failures FROM hs LEFT JOIN {_top('h', 'host', 5, 'hosts')} USING (source)
  FULL JOIN {_top('d', 'detail', 3, 'failures')} f ON hs.source = f.source""")
def drop_report(spark, sf):
    return reports.drop_detail_lines(checked(spark, sf))


# --- guard ---------------------------------------------------------------------------------------------------------------

_USER = "'u' || user_id"
_TEAM = "'s' || user_id % 23"


def _roll_sql(src: str) -> str:
    return f"""roll AS (SELECT u.source, d.cycle, coalesce(e.kept, 0) + 1 AS discovered, CASE WHEN coalesce(e.crashed, false) THEN 0 ELSE coalesce(e.kept, 0) END AS kept,
    coalesce(e.crashed, false) AS crashed
  FROM (SELECT DISTINCT {src} AS source FROM events) u
  JOIN (SELECT DISTINCT CAST(epoch(date_trunc('day', ts)) / 86400 AS BIGINT) AS cycle FROM events) d ON true
  LEFT JOIN (SELECT {src} AS source, CAST(epoch(date_trunc('day', ts)) / 86400 AS BIGINT) AS cycle, count(*) AS kept,
      bool_or(event_type = 'error' AND value > 120) AS crashed FROM events GROUP BY ALL) e ON u.source = e.source AND d.cycle = e.cycle)"""


def rollups(spark, sf, team: bool = False):
    """(source, cycle, discovered, kept, crashed): one row per user (or per one of 23 teams) and day, also for days without events."""
    source = F.concat(F.lit("s"), F.col("user_id") % 23) if team else F.concat(F.lit("u"), F.col("user_id"))
    ev = table(spark, sf, "events").select(
        source.alias("source"), F.floor(F.unix_timestamp("ts") / 86400).alias("cycle"),
        ((F.col("event_type") == "error") & (F.col("value") > 120)).alias("crash"),
    )
    counted = ev.groupBy("source", "cycle").agg(F.count(F.lit(1)).alias("kept"), F.bool_or("crash").alias("crashed"))
    days = counted.agg(F.min("cycle").alias("a"), F.max("cycle").alias("b")).first()
    dense = counted.select("source").distinct().withColumn("cycle", F.explode(F.sequence(F.lit(days["a"]).cast("long"), F.lit(days["b"]).cast("long"))))
    crashed = F.coalesce("crashed", F.lit(False))
    return dense.join(counted, ["source", "cycle"], "left").select(
        "source", "cycle", (F.coalesce("kept", F.lit(0)) + 1).alias("discovered"),
        F.when(crashed, 0).otherwise(F.coalesce("kept", F.lit(0))).cast("long").alias("kept"), crashed.alias("crashed"),
    )


def _guard_sql(src: str) -> str:
    return f"""WITH RECURSIVE {_roll_sql(src)},
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cycle) AS i FROM roll),
s AS (SELECT source, cycle, discovered, kept, crashed, i, CASE WHEN crashed OR kept = 0 THEN 'dead' ELSE 'ok' END AS status, 'accept' AS decision,
        cycle AS served_cycle, kept AS last_count, 0 AS streak, CAST(NULL AS BIGINT) AS previous_count FROM n WHERE i = 1
  UNION ALL
  SELECT n.source, n.cycle, n.discovered, n.kept, n.crashed, n.i,
    CASE WHEN n.crashed OR n.kept = 0 THEN 'dead' WHEN s.last_count > 0 AND n.kept < s.last_count * 0.5 THEN 'degraded' ELSE 'ok' END,
    CASE WHEN n.crashed AND s.last_count > 0 THEN 'reuse' WHEN s.last_count > 0 AND n.kept < s.last_count * 0.5 AND s.streak = 0 THEN 'hold' ELSE 'accept' END,
    CASE WHEN n.crashed AND s.last_count > 0 THEN s.served_cycle WHEN s.last_count > 0 AND n.kept < s.last_count * 0.5 AND s.streak = 0 THEN s.served_cycle ELSE n.cycle END,
    CASE WHEN n.crashed AND s.last_count > 0 THEN s.last_count WHEN s.last_count > 0 AND n.kept < s.last_count * 0.5 AND s.streak = 0 THEN s.last_count ELSE n.kept END,
    CASE WHEN n.crashed AND s.last_count > 0 THEN s.streak WHEN s.last_count > 0 AND n.kept < s.last_count * 0.5 AND s.streak = 0 THEN 1 ELSE 0 END,
    s.last_count FROM s JOIN n ON n.source = s.source AND n.i = s.i + 1)"""


_GUARD = _guard_sql(_USER)
GUARD_RESULT = _GUARD + " SELECT source, cycle, discovered, kept, crashed, status, decision, served_cycle, last_count, streak AS shrink_streak FROM s"


@query("guard_cycles_w4_w5", GUARD_RESULT)
def guard_cycles(spark, sf):
    return guard.guard_cycles(rollups(spark, sf)).drop("previous_count")


@query("status_transitions_w6", _GUARD + """, p AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY source ORDER BY cycle), 'ok') AS previous_status FROM s)
SELECT source, cycle, previous_status, status, CASE WHEN status <> previous_status THEN 'transition' ELSE 'still-dead' END AS kind, kept, previous_count
FROM p WHERE status <> previous_status OR status = 'dead'""")
def status_transitions(spark, sf):
    return guard.status_transitions(guard.guard_cycles(rollups(spark, sf)))


def _latest(spark, sf):
    guarded = guard.guard_cycles(rollups(spark, sf, team=True))
    return keyed.last_by(guarded, ["source"], ["cycle"], ["kept", "discovered", "crashed", "status"])


def expected_sources(spark, sf):
    """The 23 teams that have events, and one source that was never tried."""
    team = F.col("user_id") % 23
    known = table(spark, sf, "events").select(team.alias("rank")).distinct().select(F.concat(F.lit("s"), F.col("rank")).alias("source"), "rank")
    return known.unionByName(spark.range(1).select(F.lit("never").alias("source"), F.lit(-1).cast("long").alias("rank")))


_HEALTH = _guard_sql(_TEAM) + """, l AS (SELECT * FROM s WHERE cycle = (SELECT max(cycle) FROM roll)),
e AS (SELECT DISTINCT 's' || user_id % 23 AS source, user_id % 23 AS rank FROM events UNION ALL SELECT 'never', -1),
h AS (SELECT e.source, e.rank, coalesce(l.kept, 0) AS kept, coalesce(l.discovered, 0) AS discovered, coalesce(l.crashed, false) AS crashed,
  coalesce(l.status, 'unknown') AS status, l.source IS NOT NULL AND (l.crashed OR l.kept = 0) AS unhealthy FROM e LEFT JOIN l ON e.source = l.source)"""


@query("health_sources_a9_j7", _HEALTH + " SELECT * FROM h")
def health_sources(spark, sf):
    return reports.health_sources(expected_sources(spark, sf), _latest(spark, sf))


@query("health_payload_k3", _HEALTH + """
SELECT true AS ready, count(*) FILTER (unhealthy) = 0 AS healthy, sum(kept)::BIGINT AS streams,
  string_agg(source, ',' ORDER BY rank) FILTER (unhealthy) AS unhealthy_sources,
  string_agg(source || ':' || kept || '/' || discovered || ':' || status, ',' ORDER BY rank) AS sources FROM h""")
def health_payload(spark, sf):
    src = reports.health_sources(expected_sources(spark, sf), _latest(spark, sf))
    row = reports.health(src, F.lit(0), True, 12.5)
    total = F.aggregate(F.map_values("sources"), F.lit(0).cast("long"), lambda a, v: a + v["kept"])
    item = lambda e: F.concat(
        e["key"], F.lit(":"), e["value"]["kept"], F.lit("/"), e["value"]["discovered"], F.lit(":"), e["value"]["status"]
    )
    return row.select(
        "ready", "healthy", total.alias("streams"), F.array_join("unhealthy_sources", ",").alias("unhealthy_sources"),
        F.array_join(F.transform(F.map_entries("sources"), item), ",").alias("sources"),
    )


@query("served_rows_w4_u1", _GUARD + """, g AS (SELECT source, served_cycle FROM s WHERE cycle = (SELECT max(cycle) FROM roll))
SELECT event_id, g.source AS source, g.served_cycle AS cycle FROM events JOIN g ON g.source = 'u' || user_id
  AND g.served_cycle = CAST(epoch(date_trunc('day', ts)) / 86400 AS BIGINT)""")
def served_rows(spark, sf):
    rolls = rollups(spark, sf)
    rows = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("u"), F.col("user_id")).alias("source"), F.floor(F.unix_timestamp("ts") / 86400).alias("cycle")
    )
    last = rolls.agg(F.max("cycle")).first()[0]
    return guard.served_rows(rows, guard.guard_cycles(rolls), last, salt_on="event_id").select("event_id", "source", "cycle")


# --- episodes and windows of a fetch log ---------------------------------------------------------------------------------


@query("shedding_episodes_t5", f"""WITH {_LOG},
x AS (SELECT host, ts, event_id % 97 AS retry, lag(ts) OVER (PARTITION BY host ORDER BY ts) AS prev FROM f WHERE outcome = 'http-503'),
y AS (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(prev) <= 7200000000 THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT host, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n, max(retry) AS retry_after_s FROM y GROUP BY host, g""")
def shedding_episodes(spark, sf):
    log = fetch_log(spark, sf).where(F.col("outcome").isin(*fc.SHEDDING_OUTCOMES)).withColumn("retry_after_s", F.col("event_id") % 97)
    runs = asof.episodes(log, "host", "ts", 7200, ["retry_after_s"], block_seconds=6 * 3600)
    return runs.select("host", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", "retry_after_s")


WINDOWS_SQL = f"""WITH {_LOG}
SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_start, source, outcome, count(*) AS n FROM f GROUP BY ALL"""


@query("outcome_windows_t6", WINDOWS_SQL)
def outcome_windows(spark, sf):
    return (
        fetch_log(spark, sf).groupBy(F.window("ts", "1 hour").alias("w"), "source", "outcome").agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_timestamp("w.start").alias("hour_start"), "source", "outcome", "n")
    )


