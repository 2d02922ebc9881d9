import math

from pyspark.sql import functions as F

from streamatlas.fixed import catalogue as fc
from streamatlas.operators import graph, guard, probe
from streamatlas.plans.stream_queries import replay
from streamatlas.streaming import streams


def test_grid_equals_a_plain_scan(spark):
    want, lat = [], fc.GRID_LAT_MIN
    while lat <= fc.GRID_LAT_MAX:
        lon = -180.0
        while lon < 180.0:
            want.append((round(lat, 2), round(lon, 2)))
            lon += fc.GRID_STEP / max(0.2, math.cos(math.radians(lat)))
        lat += fc.GRID_STEP
    assert [(r.lat, r.lon) for r in probe.grid(spark).orderBy("ord").collect()] == want


def test_page_plan_stops_at_the_ceiling(spark):
    df = spark.createDataFrame([(0, 100), (1, 25), (2, 51), (3, 10_000)], "ord long, total long")
    got = [(r.ord, r.offset) for r in probe.page_plan(df, ceiling=10).orderBy("ord", "offset").collect()]
    assert got == [(0, 25), (0, 50), (0, 75), (2, 25), (2, 50), (3, 25)]
    assert len(probe.page_plan(df, ceiling=7000, circle_cap=4500).where("ord = 3").collect()) == 179


def test_probe_batch_rotates(spark):
    corpus = spark.createDataFrame([(i,) for i in range(10)], "id long")
    live = spark.createDataFrame([(2,), (5,)], "id long")
    rest, cursor, seen = [i for i in range(10) if i not in (2, 5)], 0, []
    for _ in range(3):
        batch, cursor, _ = probe.probe_batch(corpus, live, cursor, budget=5)
        rows = batch.collect()
        assert {r.id for r in rows if r.kind == "live"} == {2, 5}
        seen += [r.id for r in sorted((r for r in rows if r.kind == "rotation"), key=lambda r: r.seq)]
    assert seen == (rest + rest)[:9] and cursor == 1
    full, nxt, _ = probe.probe_batch(corpus, live, 3, budget=100)
    assert full.count() == 10 and nxt == 3


def test_enumeration_countdown():
    assert probe.enumeration_due(True, 5) and probe.enumeration_due(False, 0) and not probe.enumeration_due(False, 1)
    assert probe.builds_after_enumeration(True) == 0 and probe.builds_after_enumeration(False) == fc.ENUM_EVERY


def test_search_windows_stop(spark):
    hits = [(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "c"), (2, 0, "a"), (3, 0, "z")]
    df = spark.createDataFrame(hits, "window_no long, pos int, video_id string")
    assert sorted(r.video_id for r in probe.search_windows(df).collect()) == ["a", "b", "c"]
    assert sorted(r.video_id for r in probe.search_windows(df, max_ids=2).collect()) == ["a", "b"]


def test_reachability_with_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("d", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",)], "node string")
    assert {(r.node, r.level) for r in graph.reachable(seeds, links).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_streamed_guard_equals_the_batch_guard_over_several_batches(spark, tmp_path):
    rows = [(s, c, k + 1, k, x) for s in ("a", "b") for c, (k, x) in enumerate([(10, False), (3, False), (0, True), (2, False), (9, False), (0, False), (0, False)])]
    schema = "source string, cycle long, discovered long, kept long, crashed boolean"
    rolls = spark.createDataFrame(rows, schema)
    for c in range(7):
        rolls.where(F.col("cycle") == c).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.guard_stream(source).writeStream.option("checkpointLocation", str(tmp_path / "ck")).format("parquet").option("path", str(tmp_path / "out"))
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    columns = ["source", "cycle", "status", "decision", "served_cycle", "last_count", "shrink_streak"]
    got = spark.read.parquet(str(tmp_path / "out")).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, guard.guard_cycles(rolls).select(columns).collect()))


def test_rows_without_a_key_pass_the_streamed_dedup(spark):
    df = spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, None), (5, "")], "ord long, predisc_key string")
    for slices in (1, 3):
        got = [r.predisc_key for r in replay(df, streams.first_seen_stream, F.col("ord"), slices).collect()]
        assert len(got) == 4 and got.count("k") == 1


def test_live_changes_do_not_depend_on_the_batches(spark):
    df = spark.createDataFrame([(k % 3, k, None if k % 5 == 0 else k % 7 < 4) for k in range(60)], "id long, seq long, live boolean")
    one, many = (sorted(map(tuple, replay(df, streams.live_set_stream, F.col("seq"), slices).collect())) for slices in (1, 4))
    assert one == many and len(one) > 6


def test_late_cycles_are_told(spark):
    df = spark.createDataFrame([("a", c, 5, 4, False, at) for at, c in enumerate((0, 1, 3, 2, 4))], "source string, cycle long, discovered long, kept long, crashed boolean, at int")
    got = replay(df, streams.guard_stream, F.col("at"), slices=5).collect()
    assert {r.cycle: r.decision for r in got} == {0: "accept", 1: "accept", 3: "accept", 2: "late", 4: "accept"}
