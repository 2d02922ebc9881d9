"""The merge and the guard against plain sequential folds, on random rows in random order."""

import random

import pytest

from streamatlas.fixed import catalogue as fc
from streamatlas.operators import guard, keyed, merge

SCHEMA = (
    "ord long, title string, angle_key string, category string, source string, source_page_url string, target_url string, predisc_key string"
)


def fold(a, b):
    rank = lambda r: (fc.MERGE_RANK.get(r["source"], -1), bool(r["category"]))
    win, lose = (a, b) if rank(a) >= rank(b) else (b, a)
    official = next((r for r in (a, b) if r["source"] == "youtube-api" and r["title"]), None)
    title = official["title"] if official else max((a["title"], b["title"]), key=len)
    return {**win, "title": title, "category": win["category"] or lose["category"] or None}


def expected_merge(rows):
    keyed_rows, tail = {}, []
    for r in rows:
        k = r["predisc_key"]
        if k:
            keyed_rows[k] = fold(keyed_rows[k], r) if k in keyed_rows else r
        else:
            tail.append(r)
    return list(keyed_rows.values()) + tail


def random_rows(seed, keys, sizes):
    rnd = random.Random(seed)
    rows = []
    for k in range(keys):
        for _ in range(rnd.choice(sizes)):
            i = len(rows)
            rows.append({
                "ord": i, "title": rnd.choice(["", "", "a", "bb", "cc", "ddd", "éé"]) + (str(i) if rnd.random() < 0.2 else ""), "angle_key": str(i),
                "category": rnd.choice([None, None, "", f"c{i}"]), "source": rnd.choice(["cxtvlive", "worldcams", "youtube-api", "youtube-api", "x", "y"]),
                "source_page_url": f"p{i}", "target_url": f"t{i}", "predisc_key": rnd.choice([f"k{k}"] * 9 + [None, ""]),
            })
    return rows


def merged(spark, rows, seed):
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    df = spark.createDataFrame([tuple(r[c] for c in merge.CANDIDATE_COLUMNS) for r in shuffled], SCHEMA).repartition(5)
    return [r.asDict() for r in merge.merge_candidates(df).orderBy("ord").collect()]


def plain(rows):
    return [{k: (v or None if k == "category" else v) for k, v in r.items() if k != "ord"} for r in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_equals_the_fold(spark, seed):
    rows = random_rows(seed, 1500, [1, 2, 3, 4, 5, 6, 8])
    assert plain(merged(spark, rows, seed)) == plain(expected_merge(rows))


def test_merge_with_a_key_that_owns_most_rows(spark, monkeypatch):
    monkeypatch.setattr(keyed, "HOT_MIN_ROWS", 50)
    rows = random_rows(3, 40, [1, 2, 3]) + [
        {**r, "ord": 10_000 + r["ord"], "predisc_key": "hot"} for r in random_rows(4, 300, [1, 2, 3])
    ]
    assert plain(merged(spark, rows, 5)) == plain(expected_merge(rows))


def test_official_title_only_while_its_source_leads(spark):
    base = {"angle_key": None, "category": None, "source_page_url": "p", "target_url": "t", "predisc_key": "k"}
    rows = [
        {**base, "ord": 0, "title": "Official", "source": "youtube-api"}, {**base, "ord": 1, "title": "A much longer title", "source": "worldcams"},
        {**base, "ord": 2, "title": "A much much longer title", "source": "z"},
    ]
    assert merged(spark, rows, 1)[0]["title"] == "A much much longer title"
    assert merged(spark, rows[:2], 1)[0]["title"] == "Official"


def sequential_guard(cycles):
    known, streak, served, out = None, 0, None, []
    for cycle, kept, crashed in cycles:
        low = known is not None and known > 0 and kept < known * 0.5
        status = "dead" if crashed or kept == 0 else "degraded" if low else "ok"
        before = known
        if crashed and known:
            decision = "reuse"
        elif low and streak + 1 < fc.AGREE_TO_ACCEPT:
            decision, streak = "hold", streak + 1
        else:
            decision, streak, known, served = "accept", 0, kept, cycle
        out.append((cycle, status, decision, served, known, streak, before))
    return out


def test_guard_equals_the_recurrence(spark):
    rnd, rows, want = random.Random(7), [], {}
    for s in range(300):
        cycles = []
        for c in range(rnd.randint(1, 25)):
            crashed = rnd.random() < 0.2
            cycles.append((c, 0 if crashed else rnd.choice([0, 0, 1, 2, 3, 5, 10, 20, 21, 40, 100]), crashed))
        rows += [(f"s{s}", c, k + 1, k, x) for c, k, x in cycles]
        want.update({(f"s{s}", o[0]): o[1:] for o in sequential_guard(cycles)})
    df = spark.createDataFrame(rows, "source string, cycle long, discovered long, kept long, crashed boolean")
    got = {
        (r.source, r.cycle): (r.status, r.decision, r.served_cycle, r.last_count, r.shrink_streak, r.previous_count)
        for r in guard.guard_cycles(df).collect()
    }
    assert got == want


def test_exactly_half_is_no_collapse_and_zero_disables_the_guard(spark):
    rows = [("a", i, 9, k, False) for i, k in enumerate([10, 5, 2, 2, 0, 0, 7])]
    df = spark.createDataFrame(rows, "source string, cycle long, discovered long, kept long, crashed boolean")
    got = [r.decision for r in guard.guard_cycles(df).orderBy("cycle").collect()]
    assert got == ["accept", "accept", "hold", "accept", "hold", "accept", "accept"]


def test_transitions(spark):
    rows = [("a", 0, 1, 1, False), ("a", 1, 1, 0, False), ("a", 2, 1, 0, True), ("a", 3, 1, 4, False), ("b", 0, 0, 0, True)]
    df = spark.createDataFrame(rows, "source string, cycle long, discovered long, kept long, crashed boolean")
    got = {(r.source, r.cycle, r.kind, r.previous_status, r.status) for r in guard.status_transitions(guard.guard_cycles(df)).collect()}
    assert got == {("a", 1, "transition", "ok", "dead"), ("a", 2, "still-dead", "dead", "dead"), ("a", 3, "transition", "dead", "ok"), ("b", 0, "transition", "ok", "dead")}
