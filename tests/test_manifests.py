"""Manifests against a plain line-by-line reading."""

import random
from urllib.parse import quote, urljoin, urlsplit

from pyspark.sql import functions as F

from streamatlas.fixed import catalogue as fc
from streamatlas.operators import liveness, manifests


def plain_trim(text):
    """Line-by-line trim: header tags first, tags belong to the next URL, keep from the end until 120 s and 6 segments."""
    if "#EXT-X-STREAM-INF" in text:
        return text
    lines = [x for x in text.splitlines() if x.strip()]
    n_head = 0
    while n_head < len(lines) and lines[n_head].startswith("#") and lines[n_head].split(":")[0] in fc.PLAYLIST_TAGS:
        n_head += 1
    head, segs, tags = lines[:n_head], [], []
    for x in lines[n_head:]:
        tags.append(x)
        if not x.startswith("#"):
            segs.append(tags)
            tags = []
    if len(segs) <= fc.TRIM_ABOVE:
        return text

    def seconds(seg):
        inf = [x for x in seg[:-1] if x.startswith("#EXTINF:")]
        try:
            return float(inf[0][8:].split(",")[0]) if inf else 0.0
        except ValueError:
            return 0.0

    total, count = 0.0, 0
    while count < len(segs) and (total < fc.LIVE_WINDOW_SECONDS or count < fc.MIN_KEEP):
        count += 1
        total += seconds(segs[-count])
    if count == len(segs):
        return text
    dropped = segs[: len(segs) - count]

    def number(tag):
        values = [x.split(":", 1)[1] for x in head if x.startswith(tag + ":")]
        return int(values[0]) if values and values[0].strip().isdigit() else 0

    media = f"{manifests.MEDIA_SEQUENCE}:{number(manifests.MEDIA_SEQUENCE) + len(dropped)}"
    gone = number(manifests.DISCONTINUITY_SEQUENCE) + sum(seg.count(manifests.DISCONTINUITY) for seg in dropped)
    disc = f"{manifests.DISCONTINUITY_SEQUENCE}:{gone}"
    swapped = [media if x.startswith(manifests.MEDIA_SEQUENCE + ":") else disc if x.startswith(manifests.DISCONTINUITY_SEQUENCE + ":") else x for x in head]
    if media not in swapped:
        swapped.append(media)
    if gone and disc not in swapped:
        swapped.append(disc)
    return "\n".join(swapped + [x for seg in segs[-count:] for x in seg]) + "\n"


def playlist(n, seconds, head="#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:1000\n", disc_every=0):
    out = [head]
    for i in range(n):
        if disc_every and i % disc_every == 0:
            out.append("#EXT-X-DISCONTINUITY\n")
        out.append(f"#EXTINF:{seconds},\nseg{i}.ts\n")
    return "".join(out)


def trimmed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "manifest_id int, text string").repartition(3)
    return [r.text for r in manifests.trim_to_live_edge(df).orderBy("manifest_id").collect()]


def test_trim(spark):
    rnd = random.Random(1)
    texts = [
        playlist(300, 1), playlist(50, 1), "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1\n" + playlist(300, 1),
        playlist(300, 1, "#EXTM3U\n#EXT-X-DISCONTINUITY-SEQUENCE:5\n", 10), playlist(250, 60, "#EXTM3U\n", 7), playlist(300, "x"),
        playlist(201, 0), playlist(300, 4.004, "#EXTM3U\r\n\r\n#EXT-X-TARGETDURATION:5\n#EXT-X-MEDIA-SEQUENCE:bad\n"), playlist(260, 1) + "#EXT-X-ENDLIST\n",
        "#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:3\n" + "".join(f"#EXTINF:{rnd.choice([0, 1, 2, 9])},t\n#EXT-X-VERSION:3\ns{i}.ts\n" for i in range(400)),
        "", "#EXTM3U\n",
    ]
    assert trimmed(spark, texts) == [plain_trim(t) for t in texts]
    first = trimmed(spark, [playlist(300, 1)])[0]
    assert "#EXT-X-MEDIA-SEQUENCE:1180\n" in first and first.count("#EXTINF") == 120


def test_marking_over_block_borders_equals_the_text_trim(spark):
    text = playlist(500, 1, disc_every=9)
    df = spark.createDataFrame([(1, text)], "manifest_id int, text string")
    segs = manifests.segments(manifests.manifest_lines(df))
    for block in (F.floor(F.col("seg_no") / 37), F.lit(0)):
        kept = manifests.mark_live_edge(segs, "manifest_id", ["seg_no"], block).where("keep").orderBy("seg_no").collect()
        assert [r.url for r in kept] == [x for x in plain_trim(text).splitlines() if not x.startswith("#")]


def rewritten(spark, text, upstream):
    df = spark.createDataFrame([("id1", upstream, text)], "entry_id string, upstream_url string, text string")
    return manifests.rewrite_manifests(df, "http://b").first().body


def test_rewrite(spark):
    up = "https://edge.wetmet.net/live/x/index.m3u8?s=1"
    text = "#EXTM3U\n#EXTINF:4,\nseg 1.ts\nseg1.ts?a=1  \n\n\n/abs/low.m3u8?k=2\nhttps://cdn.other.org/x.ts\n//cdn.wetmet.net/y.ts\n  lead.ts\n#EXT-X-ENDLIST\n../z.ts\n"
    relay = lambda ref: f"http://b/stream/id1/s?u={quote(urljoin(up, ref), safe='')}"
    child = f"http://b/stream/id1/m?u={quote(urljoin(up, '/abs/low.m3u8?k=2'), safe='')}"
    assert rewritten(spark, text, up) == "\n".join([
        "#EXTM3U", "#EXTINF:4,", "seg 1.ts", relay("seg1.ts?a=1"), child, "https://cdn.other.org/x.ts", relay("//cdn.wetmet.net/y.ts"), "  lead.ts",
        "#EXT-X-ENDLIST", relay("../z.ts")])


def test_direct_segments_are_made_absolute(spark):
    up = "https://a.example.net/live/index.m3u8"
    assert rewritten(spark, "#EXTM3U\nseg.ts\n", up) == "#EXTM3U\n" + urljoin(up, "seg.ts")
    assert urlsplit(up).hostname == "a.example.net"


def test_playable(spark):
    texts = ["#EXTM3U\n#EXTINF:1,\na", "#EXTM3U\n#EXT-X-STREAM-INF:x\na", "#EXTM3U\n#EXT-X-ENDLIST", "<MPD>", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(liveness.is_playable(F.col("t")))
    assert [r[0] for r in df.collect()] == [True, True, False, False, False, False]


def test_serving_view(spark):
    ok = "#EXTM3U\n#EXTINF:1,\ns.ts\n"
    cases = {
        "a": ("https://h.example/x.m3u8", "hls", ok), "b": (None, None, None), "c": ("ftp://h/x", "hls", None), "d": ("https://h.example/\r\nX: y", "hls", None),
        "e": ("https://h.example/v.mp4", "mp4", None), "f": ("https://cdn.pixelcaster.com/x.m3u8", "hls", None), "g": ("https://r1.googlevideo.com/x.m3u8", "hls", ok),
        "h": ("https://h.example/gone.m3u8", "hls", None), "i": ("https://h.example/stub.m3u8", "hls", "#EXTM3U\n"),
    }
    cat = spark.createDataFrame([(k, "t" + k) for k in cases], "id string, target_url string")
    res = spark.createDataFrame([("t" + k, u, s) for k, (u, s, _) in cases.items()], "target_url string, url string, stream_type string")
    texts = spark.createDataFrame([(u, t) for u, _, t in cases.values() if t], "url string, text string")
    got = {r.id: (r.status, r.action) for r in manifests.serving_view(cat, res, texts, "http://b").collect()}
    assert got == {
        "a": (200, "manifest"), "b": (502, "resolve failed"), "c": (502, "unsafe upstream URL"), "d": (502, "unsafe upstream URL"), "e": (302, "redirect"),
        "f": (302, "redirect"), "g": (302, "redirect"), "h": (502, "upstream manifest fetch failed"), "i": (502, "not a playable HLS stream"),
    }
    proxied = manifests.serving_view(cat.where("id = 'g'"), res, texts, "http://b", proxy_video=True).first()
    assert proxied.status == 200 and proxied.body.endswith("https://r1.googlevideo.com/s.ts")


def test_segments_parsed_in_the_row(spark):
    """Against the parse over rows of lines: line ends of all kinds, blank lines, missing or broken durations, tags behind the last URL, lone headers, nothing."""
    rng = random.Random(21)
    pieces = [
        "#EXTM3U", "#EXT-X-VERSION:3", "#EXT-X-MEDIA-SEQUENCE:9", "#EXTINF:4.5,", "#EXTINF:x,title", "#EXTINF:7", "#EXTINF: 2 ,a", manifests.DISCONTINUITY,
        manifests.DISCONTINUITY + " ", "#EXT-X-DISCONTINUITY-SEQUENCE:1", "a.ts", " b.ts?x=#EXTINF:9", "", "  \t", "#", "\u00e9.m3u8",
    ]
    ends = ["\n", "\n", "\r\n", "\r", "\x0b", "\x85", "\u2028"]
    texts = ["".join(rng.choice(pieces) + rng.choice(ends) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += [None, "", "\n", "#EXTM3U", "a.ts", "#EXTINF:3,\n" * 20_000 + "a.ts", "#EXTINF:1,\nb.ts\n" * 20_000]
    df = spark.createDataFrame([*enumerate(texts)], "manifest_id long, text string")
    names = ["manifest_id", "seg_no", "url", "duration", "discontinuities"]
    one, other = manifests.parse_segments(df).select(names), manifests.segments(manifests.manifest_lines(df)).select(names)
    assert one.dtypes == other.dtypes
    assert sorted(one.collect()) == sorted(other.collect())
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_work_that_grew_with_every_line_is_gone(spark):
    """Durations are read where the window needs them, and tags are no rows of the reference table."""
    text = "#EXTM3U\r\n#EXT-X-MEDIA-SEQUENCE:7\n" + "".join(f"#EXTINF:{k % 7}.5, {'' if k % 9 else manifests.DISCONTINUITY + chr(10)}s{k}.ts\x0b\n" for k in range(260))
    df = spark.createDataFrame([(1, text), (2, None), (3, text.replace(" ", "\n")), (4, text.replace(" ", "\x85"))], "manifest_id long, text string")
    cut = {r["manifest_id"]: (r["text"], r["dropped"]) for r in manifests.trim_to_live_edge(df).collect()}
    assert cut[2] == (None, 0) and cut[1] == cut[3] == cut[4] and cut[1][1] > 200
    tail = [k for k in range(260) if f"\ns{k}.ts\n" in cut[1][0]]
    assert tail == list(range(cut[1][1], 260)) and sum(k % 7 + 0.5 for k in tail[1:]) < 120 <= sum(k % 7 + 0.5 for k in tail)
    assert f"#EXT-X-MEDIA-SEQUENCE:{7 + cut[1][1]}\n#EXT-X-DISCONTINUITY-SEQUENCE:{sum(k % 9 == 0 for k in range(cut[1][1]))}\n" in cut[1][0]
    assert "reverse(transform(" not in _plan(manifests.trim_to_live_edge(df))
    served = df.selectExpr("manifest_id as entry_id", "'https://a.example.net/live/i.m3u8' as upstream_url", "text")
    plan = _plan(manifests.classify_references(served))
    assert "posexplode" not in plan and "inline(filter(" in plan


def test_references_lose_white_space_behind_them(spark):
    rows = [(1, "https://a.example.net/live/i.m3u8", "#EXTM3U\na.ts  \n\n\n#X\nb.ts\n \t\nc d\n//o.example.org/x.ts\nhttps://p.example.net/y.m3u8\nk:z\n e.ts\nf.ts")]
    found = manifests.classify_references(spark.createDataFrame(rows, "entry_id long, upstream_url string, text string")).orderBy("pos").collect()
    assert [(r["pos"], r["ref"], r["kind"]) for r in found] == [
        (1, "a.ts", "direct"), (3, "b.ts", "direct"), (5, "//o.example.org/x.ts", "offsite"), (6, "https://p.example.net/y.m3u8", "child"), (7, "k:z", "offsite"),
        (8, "\xa0e.ts", "direct"), (9, "f.ts", "direct"),
    ]


def test_words_of_documents_are_cut_over_the_whole_text(spark, tmp_path):
    from streamatlas.plans.page_queries import text_manifests

    spark.createDataFrame([(1, " one -- two,three\r\n\tf\u00fcnf\u2028x !"), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = text_manifests(spark, str(tmp_path))
    got = {r["manifest_id"]: r["url"] for r in manifests.parse_segments(df).groupBy("manifest_id").agg(F.concat_ws(" ", F.collect_list("url")).alias("url")).collect()}
    assert got == {1: "s.m3u8?k=1 sone.ts s.m3u8?k=1 stwothree.ts sfnfx.ts s.m3u8?k=1", 3: "s.m3u8?k=1"}
    assert "lambdafunction(regexp_replace" not in _plan(df)
