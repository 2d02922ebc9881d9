"""Versioned tables, and the state of a rotating source: retries, failures between commits, conflicts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from streamatlas.operators import probe
from streamatlas.operators.crawl_log import CrawlLog
from streamatlas.operators.rotation import CORPUS, Rotation
from streamatlas.operators.versioned import VersionConflict, VersionedTable

SCHEMA = "url string, seq long, outcome string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "url", 8)
    assert table.current().number == 0 and table.read().collect() == []
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    one = table.upsert(1, make([(f"u{k}", 1, "ok") for k in range(50)]), ["seq"])
    two = table.upsert(2, make([("u3", 2, "http-500"), ("u3", 1, "late"), ("new", 0, "ok")]), ["seq"], {"cursor": 7})
    changed = [b for b in two.buckets if two.buckets[b] != one.buckets.get(b)]
    assert two.rows == 51 and len(changed) <= 2  # only buckets of the landed keys are written
    assert rows_of(table.read().where("url in ('u3', 'new', 'u4')")) == [("new", 0, "ok"), ("u3", 2, "http-500"), ("u4", 1, "ok")]
    assert table.read(version=1).where("outcome <> 'ok'").count() == 0
    # a step that was taken is not taken again, by this object or by one that reads the state anew
    again = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "url", 8)
    assert again.upsert(2, make([("u9", 9, "x")]), ["seq"]) == two and again.current().values == {"cursor": 7}
    # what a run that failed before its commit has written is never seen
    make([("zzz", 1, "ok")]).write.parquet(str(tmp_path / "t" / "data" / "lost" / "bucket=0"))
    assert again.read().where("url = 'zzz'").count() == 0
    # two writers of one version: the second is told
    table.upsert(3, make([("a", 1, "ok")]), ["seq"])
    with pytest.raises(VersionConflict):
        again.upsert(3, make([("b", 1, "ok")]), ["seq"])
    # a commit that ended before its file appeared leaves an empty folder, which is no version
    (tmp_path / "t" / "log" / "version=4" / "_temporary").mkdir(parents=True)
    assert table.upsert(4, make([("c", 1, "ok")]), ["seq"]).number == 4
    emptied = table.commit(5, None, range(8), {"cursor": 0})
    assert emptied.rows == 0 and VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "url", 8).current() == emptied


def corpus(spark, ids):
    return spark.createDataFrame([(i, f"Cam {i}", "", "", 0) for i in ids], CORPUS)


def test_rotation(spark, tmp_path):
    state = Rotation(spark, str(tmp_path / "r"), buckets=2)
    seen = []

    def answering(live):
        def answer(batch):
            ids = [r["id"] for r in batch.orderBy(F.col("kind"), "seq", "id").collect()]
            seen.append(ids)
            return batch.select("id", F.when(F.col("id").isin(live), True).when(F.col("id") != 5, False).alias("live"))

        return answer

    nothing = lambda: (corpus(spark, []), False)
    turn = state.run(1, nothing, answering([]), 3)
    assert (turn.probed, turn.live, turn.builds_left, turn.enumerated) == (0, 0, 39, True) and not seen
    scan = lambda: (corpus(spark, range(1, 8)), True)
    turn = state.run(2, scan, answering([2, 3]), 4)  # an empty corpus is enumerated at once
    assert seen[-1] == [1, 2, 3, 4] and (turn.cursor, turn.live, turn.builds_left) == (4, 2, -1)
    again = Rotation(spark, str(tmp_path / "r"), buckets=2)
    assert again.run(2, scan, answering([]), 4) == turn and len(seen) == 1

    def failing(batch):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):  # the corpus is committed, the cycle isn't
        again.run(3, lambda: (corpus(spark, range(1, 10)), False), failing, 4)
    turn = Rotation(spark, str(tmp_path / "r"), buckets=2).run(3, failing, answering([2, 5, 6]), 4)
    # live ids first, then the others (1, 4, 5, 6, 7, 8, 9) from the cursor on; 3 died
    assert seen[-1] == [2, 3, 7, 8] and (turn.probed, turn.cursor, turn.live, turn.builds_left, turn.enumerated) == (4, 6, 1, 39, True)
    last = Rotation(spark, str(tmp_path / "r"), buckets=2)
    turn = last.run(4, failing, answering([2, 6]), None)
    assert sorted(seen[-1]) == list(range(1, 10)) and (turn.live, turn.builds_left, turn.enumerated) == (2, 38, False)
    assert {r["id"] for r in last.live.read().collect()} == {2, 6}


def test_positions(spark):
    found, n = probe.with_position_and_count(spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("id")), ["id"])
    assert n == 1000 and found.where("id <> position").count() == 0
    assert probe.with_position_and_count(spark.range(0), ["id"])[1] == 0


def test_crawl_log(spark, tmp_path):
    log = CrawlLog(spark, str(tmp_path / "log"), buckets=16, max_bytes=10)
    fetch = "source string, url string, part int, fetched_at timestamp, seq long, outcome string, body string"
    land = lambda step, rows: log.land(step, spark.createDataFrame([(s, u, p, datetime(2024, 1, d), q, o, b) for s, u, p, d, q, o, b in rows], fetch))
    one = land(1, [("s", f"u{k}", 0, 1, 0, "ok", f"body {k}") for k in range(40)] + [("s", "big", 0, 1, 0, "ok", "x" * 11), ("s", "empty", 0, 1, 0, None, ""), ("t", "u1", 0, 1, 0, "ok", "other")])
    rows = [("s", "u1", 0, 2, 0, "ok", "first"), ("s", "u1", 0, 2, 1, "ok", "second"), ("s", "u2", 0, 2, 0, "http-503", None), ("s", "u3", 0, 0 + 1, -1, "ok", "older"), ("s", "u4", 1, 2, 0, "ok", "part")]
    two = land(2, rows)
    assert sum(two.buckets[b] != one.buckets.get(b) for b in two.buckets) <= 4
    told = {(r.source, r.url, r.part): (r.outcome, r.body) for r in log.last_fetches().collect()}
    assert told["s", "u1", 0] == ("ok", "second") and told["t", "u1", 0] == ("ok", "other") and told["s", "u2", 0] == ("http-503", None)
    assert told["s", "u3", 0] == ("ok", "body 3") and told["s", "u4", 1] == ("ok", "part") and told["s", "big", 0] == ("too-large", None)
    assert told["s", "empty", 0] == ("ok", None) and len(told) == 44
    assert log.documents_of().count() == 41 and log.documents_of(version=1).where("url = 'u2'").count() == 1
    assert land(2, [("s", "u1", 0, 9, 9, "ok", "again")]) == two  # a landing that comes twice


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "65536")
    try:
        table = VersionedTable(spark, str(tmp_path / "wide"), "url string, n long, body string", "url", 2)
        body = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)), 512) for k in range(16)])
        rows = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("u"), "id").alias("url"), F.col("id").alias("n"), body.alias("body"))
        made = table.upsert(1, rows, ["n"])
    finally:
        spark.conf.set(size, before)
    assert made.rows == 4000 and table.read().select("url").distinct().count() == 4000
    for bucket, (folder, _) in made.buckets.items():
        assert len(list((tmp_path / "wide" / "data" / folder / f"bucket={bucket}").glob("part-*"))) > 1
