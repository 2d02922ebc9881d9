import ipaddress

from pyspark.sql import functions as F

from streamatlas.fixed import embeds as fe
from streamatlas.operators import liveness, reports, resolve, vetting


def test_resolution_errors_and_fallbacks(spark):
    v = "https://x.joada.net/embeded/embeded.html?uuid="
    oz = "https://www.ozolio.com/explore/"
    init = lambda cid: (
        f"{fe.OZOLIO_RELAY}/ses.api?cmd=init&oid=CID_{cid}&ver=5&channel=0&control=0&document="
        f"https%3A%2F%2Frelay.ozolio.com%2Fpub.api%3Fcmd%3Dexplore%26oid%3DCID_{cid}%26channel%3D0"
    )
    opened = lambda sid: f"{fe.OZOLIO_RELAY}/ses.api?cmd=open&oid={sid}&output=1&format=M3U8&profile=AUTO"
    bodies = {
        f"{fe.VIEWSURF_HOSTS[0]}/api/videos/manifest/a1": "[1]", f"{fe.VIEWSURF_HOSTS[1]}/api/videos/manifest/a1": '{"m3u8": "https://d/1.m3u8"}',
        f"{fe.VIEWSURF_HOSTS[0]}/api/videos/manifest/a2": '{"m3u8": 5}', f"{fe.VIEWSURF_HOSTS[1]}/api/videos/manifest/a2": '{"m3u8": "https://d/2.m3u8"}',
        init("AB"): '{"session": {"id": "SID_1"}}', opened("SID_1"): '{"output": {"source": "https://r/hls-live/x.m3u8", "media": "LIVE"}}',
        init("CD"): '{"session": {"id": "SID_1&oid=evil"}}', init("EF"): '{"session": {"id": "SID_2"}}', opened("SID_2"): '{"output": {}}',
        "https://balticlivecam.com/x": "no id here", fe.IPCAM_PLAYER + "me": 'var address = "https://s/"; var streamid = "q";',
    }
    targets = [v + "a1", v + "a2", v + "a3", "https://x.joada.net/embeded/embeded.html", oz + "CID_AB", oz + "CD", oz + "EF", oz + "GH",
               "https://balticlivecam.com/x", "https://balticlivecam.com/gone", "https://www.ipcamlive.com/me/", "https://nobody.example"]
    t = spark.createDataFrame([(x,) for x in targets], "target_url string")
    b = spark.createDataFrame(list(bodies.items()), "url string, body string")
    got = {r.target_url: (r.url, r.error) for r in resolve.resolve(t, b).collect()}
    assert got == {
        targets[0]: ("https://d/1.m3u8", None), targets[1]: (None, fe.ERR_VIEWSURF_HLS), targets[2]: (None, fe.ERR_VIEWSURF_HOSTS),
        targets[3]: (None, fe.ERR_VIEWSURF_UUID), targets[4]: ("https://r/hls-live/x.m3u8", None), targets[5]: (None, fe.ERR_OZOLIO_SESSION),
        targets[6]: (None, fe.ERR_OZOLIO_STREAM), targets[7]: (None, fe.ERR_FETCH), targets[8]: (None, fe.ERR_BALTIC_ID), targets[9]: (None, fe.ERR_FETCH),
        targets[10]: ("https://s/streams/q/stream.m3u8", None), targets[11]: (None, None),
    }


def test_the_last_fetch_of_a_document_counts_once(spark):
    url = "https://balticlivecam.com/gone"
    name = fe.IPCAM_PLAYER + "me"
    page = lambda host: f'var address = "https://{host}/"; var streamid = "q";'
    fetched = spark.createDataFrame([(name, page("old"), 1), (name, page("new"), 3), (name, page("mid"), 2)], "url string, body string, fetched_at long")
    targets = spark.createDataFrame([("https://www.ipcamlive.com/me/",), (url,)], "target_url string")
    got = sorted((r.target_url, r.url) for r in resolve.resolve(targets, fetched).collect())
    assert got == [(url, None), ("https://www.ipcamlive.com/me/", "https://new/streams/q/stream.m3u8")]


def test_verdicts(spark):
    rows = [(None, None, None, None), ("direct", None, "hls", True), ("direct", None, "hls", False), ("direct", None, "hls", None), ("metatag", None, "mp4", None),
            ("x", "failed https://h/p?token=1 " + "y" * 99, None, None)]
    df = spark.createDataFrame(rows, "r string, e string, s string, p boolean")
    got = [r[0] for r in df.select(liveness.verdict(*(F.col(c) for c in "resp"))).collect()]
    assert got[:5] == ["no-extractor", None, "dead-manifest", "dead-manifest", None]
    assert got[5] == "resolve-failed:" + ("failed https://h/p " + "y" * 99)[:80]


def test_lookup_takes_the_latest_row_even_if_an_older_one_is_still_valid(spark):
    ts = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    log = [("e", 1, ts(0), "t", "https://u/1", None), ("e", 2, ts(100), "other", "https://u/2", 1000), ("f", 1, ts(0), "t", None, None),
           ("g", 1, ts(0), "t", "https://u/3", 0), ("h", 1, ts(0), "t", "https://u/4", 100)]
    asks = [("e", "t", ts(50)), ("e", "t", ts(101)), ("e", "t", ts(480)), ("f", "t", ts(59)), ("f", "t", ts(60)), ("g", "t", ts(0)), ("h", "t", ts(79)), ("h", "t", ts(80)), ("z", "t", ts(1))]
    log_df = spark.createDataFrame(log, "entry_id string, seq int, resolved_at string, target_url string, url string, ttl_seconds long")
    req = spark.createDataFrame(asks, "entry_id string, target_url string, at string").withColumn("at", F.col("at").cast("timestamp"))
    out = liveness.resolve_lookup(req, log_df.withColumn("resolved_at", F.col("resolved_at").cast("timestamp")))
    got = {(r.entry_id, str(r["at"])[14:19]): r.answer for r in out.collect()}
    assert got == {("e", "00:50"): "hit", ("e", "01:41"): "miss", ("e", "08:00"): "miss", ("f", "00:59"): "failed", ("f", "01:00"): "miss", ("g", "00:00"): "miss",
                   ("h", "01:19"): "hit", ("h", "01:20"): "miss", ("z", "00:01"): "miss"}


def test_addresses_against_the_standard_library(spark):
    ips = ["8.8.8.8", "10.0.0.1", "172.15.255.255", "172.16.0.0", "172.32.0.0", "192.0.0.8", "192.0.0.9", "192.0.0.11", "198.17.0.1", "198.20.0.0", "224.0.0.1",
           "255.255.255.255", "0.1.2.3", "100.64.0.1", "169.254.3.3", "203.0.113.9", "127.0.0.1", "1.1.1.1"]
    bad = lambda a: a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast
    df = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", vetting.unsafe_v4(F.col("ip")).alias("u"))
    assert {r.ip: r.u for r in df.collect()} == {i: bad(ipaddress.ip_address(i)) for i in ips}


def test_one_unsafe_address_blocks_the_host(spark):
    dns = spark.createDataFrame([("a.com", 0, "8.8.8.8"), ("a.com", 1, "::1"), ("b.com", 0, "2606:4700::1111"), ("b.com", 1, "8.8.4.4")], "host string, seq int, ip string")
    urls = spark.createDataFrame([("https://A.com:8443/x",), ("http://b.com",), ("ftp://b.com",), ("https://c.com",), ("https:///x",)], "url string")
    got = {r.url: (r.verdict, r.ip) for r in vetting.vet_urls(urls, dns).collect()}
    assert got == {"https://A.com:8443/x": ("blocked-ip", None), "http://b.com": ("ok", "2606:4700::1111"), "ftp://b.com": ("bad-scheme", None),
                   "https://c.com": ("dns-error", None), "https:///x": ("bad-scheme", None)}


def test_diagnosis(spark):
    rollup = spark.createDataFrame([("blocked", 0, 0), ("soft", 0, 0), ("fine", 5, 3), ("quiet", 0, 0)], "source string, discovered long, kept long")
    log = [("blocked", "h", "http-403")] * 3 + [("soft", "h", "ok")] * 2 + [("fine", "h", "ok"), ("fine", "g", "timeout")]
    outcomes = reports.fetch_outcomes(spark.createDataFrame(log, "source string, host string, outcome string"))
    drops = spark.createDataFrame([("fine", "dead-manifest", 2)], "source string, label string, n long")
    got = {r.source: (r.verdict, r.warned, r.line) for r in reports.diagnose(rollup, reports.fetch_totals(outcomes), reports.failure_counts(outcomes), drops).collect()}
    assert got["blocked"] == ("blocked", True, "blocked: 0 kept / 0 discovered — 3 fetched, 0 ok (3x http-403 h)")
    assert got["soft"][:2] == ("soft-block-or-layout", True) and got["soft"][2].startswith("soft: 0 kept / 0 discovered — 2 fetched ok but extracted 0 URLs")
    assert got["fine"] == ("normal", False, "fine: 3 kept / 5 discovered — 2 fetched, 1 failed: 1x timeout g; dropped 2 (2x dead-manifest)")
    assert got["quiet"] == ("normal", False, "quiet: 0 kept / 0 discovered")


def test_host_cap_keeps_the_totals(spark):
    log = [("s", f"h{i}", "ok") for i in range(30) for _ in range(i + 1)]
    outcomes = reports.fetch_outcomes(spark.createDataFrame(log, "source string, host string, outcome string"))
    capped = {r.host: r.n for r in reports.cap_hosts(outcomes, 4).collect()}
    assert capped == {"h29": 30, "h28": 29, "h27": 28, "h26": 27, "other": sum(range(1, 27))}


def test_liveness_reads_the_documents_once(spark, monkeypatch):
    from streamatlas.operators import resolve as module
    from streamatlas.plans.all_queries import QUERIES

    read, seen = module.document_facts, []
    monkeypatch.setattr(module, "document_facts", lambda bodies: seen.append(1) or read(bodies))
    assert QUERIES["liveness_p12_p9"](spark, "/root/testdata/sf0.001").count() > 0 and len(seen) == 1
