"""The whole build over two cycles, with a source that crashes and one that collapses."""


from streamatlas.fixed import sites as fs
from streamatlas.plans import build
from streamatlas.sources import adapters, sinks

PLAYABLE = "#EXTM3U\n#EXTINF:4,\ns.ts\n"


def feed(n):
    items = ",".join(f'{{"state": "live", "name": "Bear river {i}", "playlistUrl": "https://h.example/{i}.m3u8"}}' for i in range(n))
    return '{"streams": [' + items + "]}"


def landed(spark, n):
    rows = [
        ("explore", fs.EXPLORE_API, 0, feed(n)),
        ("youtube-api", fs.YT_SEARCH, 0, '{"items": [{"id": {"videoId": "AAAAAAAAAAA"}, "snippet": {"title": "Harbour cam"}}, {"id": {"videoId": "offlineoffl"}, "snippet": {"title": "x"}}]}'),
        ("youtube-api", fs.YT_VIDEOS, 0, '{"items": [{"id": "AAAAAAAAAAA", "snippet": {"liveBroadcastContent": "live", "categoryId": "19"}}]}'),
        ("cxtvlive", fs.CXTV_SITEMAP, 0, "<loc>https://www.cxtvlive.com/live-camera/old-harbour</loc>"),
        ("cxtvlive", "https://www.cxtvlive.com/live-camera/old-harbour", 0, "<h1>Old Harbour</h1>https://www.youtube.com/embed/AAAAAAAAAAA"),
    ]
    return spark.createDataFrame(rows, "source string, url string, part int, body string")


def test_two_cycles(spark, tmp_path):
    names = ["youtube-api", "cxtvlive", "explore", "windy"]
    texts = spark.createDataFrame([(f"https://h.example/{i}.m3u8", PLAYABLE) for i in range(9)], "url string, text string")
    bodies = spark.createDataFrame([], "url string, body string")

    def broken(pages):
        raise RuntimeError("layout changed")

    table = {**adapters.ADAPTERS, "windy": broken}
    first = build.run_cycle(landed(spark, 10), texts, bodies, 1, names=names, table=table)
    assert first.crashed == ("windy",)
    rollup = {r.source: (r.discovered, r.kept, r.crashed) for r in first.rollup.collect()}
    assert rollup == {"youtube-api": (2, 1, False), "cxtvlive": (1, 1, False), "explore": (10, 9, False), "windy": (0, 0, True)}
    entries = first.entries.orderBy("ord").collect()
    merged = [e for e in entries if "AAAAAAAAAAA" in e.target_url]
    # One stream of two sources: the page of the higher-ranked one, the official title, the category of the live lookup.
    assert [(e.source, e.title, e.category) for e in merged] == [("cxtvlive", "Harbour cam", "Travel & Events")]
    assert sum(e.category == "Animals" for e in entries) == 9 and len(entries) == 10

    kept = first.kept
    second = build.run_cycle(landed(spark, 3), texts, bodies, 2, history=first.rollup, kept_before=kept, names=names, table=table, exclude=["travel & EVENTS"])
    guarded = {r.source: (r.decision, r.served_cycle, r.status) for r in second.guarded.where("cycle = 2").collect()}
    assert guarded["explore"] == ("hold", 1, "degraded") and guarded["cxtvlive"] == ("accept", 2, "ok")
    assert second.entries.count() == 9

    third = build.run_cycle(landed(spark, 3), texts, bodies, 3, history=second.rollup.unionByName(first.rollup), kept_before=kept.unionByName(second.kept), names=names, table=table)
    assert third.entries.where("source = 'explore'").count() == 3

    out = build.report(third, 3, names=names, seconds=1.5)
    health = out["health"].first()
    assert not health.healthy and health.unhealthy_sources == ["windy"] and health.streams == 4
    assert {r.source for r in out["transitions"].collect()} == {"windy"}

    root = str(tmp_path / "site")
    assert build.publish(third, root, "http://b") == 1 and build.publish(first, root, "http://b") == 2
    assert sinks.read_snapshot(spark, root + "/catalogue").count() == 10
    lines = [r.value for r in spark.read.text(root + "/playlist=2").collect()]
    assert len(lines) == 21 and "#EXTM3U" in lines
