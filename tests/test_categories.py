import re

import pytest
from pyspark.sql import functions as F

from streamatlas.fixed import taxonomy as ft
from streamatlas.operators import categorise

TITLES = [
    ("Eagle nest by the lake", "Animals"), ("Osprey Harbour", "Animals"), ("Old Harbour", "Ports & Ships"), ("Golfo di Napoli", None),
    ("Kungsbacka Golfklubb", "Sports"), ("The Strand, London", "Travel & Events"), ("Timmendorfer Strand", "Beaches"), ("Plaża Sopot", "Beaches"),
    ("Plaza Mayor", "Cities"), ("Puente Viejo", "Landmarks"), ("旭川市役所", None), ("神田川 ライブカメラ", "Water & Waterways"), ("琵琶湖", "Water & Waterways"),
    ("西除川映像", "Water & Waterways"), ("滝沢市", None), ("国道17号", "Traffic"), ("道の駅 あらい", "Traffic"), ("東京駅前", "Trains & Railways"), ("羽田空港", "Airports"),
    ("Quiet view — Bath, England", "Travel & Events"), ("Somewhere - Norway", "Travel & Events"), ("Nothing here", None), ("I-95 North", "Traffic"),
    ("BRÜCKE Mitte", "Landmarks"), ("Rynek Główny", "Cities"), ("Thing — Harbour Town", "Travel & Events"), ("pupp", "Animals"),
]


def test_titles(spark):
    df = spark.createDataFrame(TITLES, "t string, e string")
    assert [(r.t, r.c) for r in df.select("t", categorise.category_from_title(F.col("t")).alias("c")).collect()] == TITLES


def test_titles_agree_with_the_rules_run_by_python(spark):
    rules = [(c, re.compile(p, re.I)) for c, p in ft.TITLE_RULES]

    def expected(title):
        head = title.split(" — ")[0]
        hit = next((c for c, p in rules if p.search(head)), None)
        return hit or (ft.GEO_CATEGORY if re.search(ft.GEO_HINT, title) else None)

    words = ["bear", "Ski", "Bergbahn", "川", "湖西市", "山頂", "駅", "the strand", "strand", "plaža", "montagna", "guest house", "Caves", "port", "sport",
             "airport", "I-5", "old town", "hotell", "dam", "Dame", "universität", "fjord", "ダム", "道の駅", "beach", "café", "ñ-port", "São-pier"]
    titles = [f"{a} {b}" for a in words for b in words]
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", categorise.category_from_title(F.col("t")).alias("c"))
    assert [r.c for r in got.collect()] == [expected(t) for t in titles]


@pytest.mark.parametrize("raw, expected", [(None, "Other"), ("", "Other"), ("Birds", "Animals"), ("Gaming", "Gaming"), ("zzz", "Unmapped Category"), ("Other", "Other")])
def test_map(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "r string")
    assert df.select(categorise.map_category(F.col("r"))).first()[0] == expected


def test_every_target_is_in_the_taxonomy():
    assert {c for c, _ in ft.TITLE_RULES} | {ft.GEO_CATEGORY} <= set(ft.TAXONOMY)
    known = set(ft.CATEGORY_MAP) | set(ft.PASS_THROUGH)
    assert set(ft.VIDEO_CATEGORY_IDS.values()) <= known


def test_title_only_steps_in_for_other(spark):
    df = spark.createDataFrame([(None, "Harbour"), ("Other", "Harbour"), ("zzz", "Harbour"), ("Birds", "Harbour"), (None, "x")], "r string, t string")
    got = [r[0] for r in df.select(categorise.final_category(F.col("r"), F.col("t"))).collect()]
    assert got == ["Ports & Ships", "Ports & Ships", "Unmapped Category", "Animals", "Other"]


def test_exclusion_and_unknown_names(spark):
    df = spark.createDataFrame([("Traffic",), ("Cities",)], "category string")
    assert [r[0] for r in categorise.exclude_categories(df, ["TRAFFIC ", "nope"]).collect()] == ["Cities"]
    names = spark.createDataFrame([("traffic",), ("Trafic",)], "name string")
    assert [r[0] for r in categorise.unknown_categories(names).collect()] == ["Trafic"]
