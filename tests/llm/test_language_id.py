"""Operator 13: the kernel against sets of n-grams, the solution against its dual form, and accuracy on rows that were held out."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from streamatlas.llm import language_id

SCHEMA = "doc_id long, text string, lang string, n int, lettered int, held_out int, score int"


def gram_set(text):
    data = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode())
    data = b" " + data.strip(b" ") + b" " if data.strip(b" ") else b" "
    return {data[i : i + k] for k in language_id.ORDERS for i in range(len(data) - k + 1)}


TEXTS = ["Der Hund", "the  dog's 12 legs", "", "42", "ÉTÉ été", "日本語 のテキスト", "x", " a\n\tb ", "dog the the dog " * 50]


def test_presence_is_the_set_of_grams():
    places = np.arange(1 << language_id.GRAM_BITS, dtype=np.int32)
    held = language_id.presence(pa.array([t.lower() for t in TEXTS]), places, len(places))
    kernel = held @ held.T
    sets = [gram_set(t) for t in TEXTS]
    assert kernel.tolist() == [[len(a & b) for b in sets] for a in sets]


def test_weights_are_the_nystroem_ridge_solution():
    rng = np.random.default_rng(4)
    held, owner = (rng.random((30, 200)) < 0.3).astype(np.uint8), np.arange(30) % 3
    weights = language_id.landmark_weights(held, owner, 3)
    unit = held / np.sqrt(held.sum(axis=1, keepdims=True))
    # with every row a landmark, the kernel is whole and the dual of ridge regression gives the same scores
    kernel = unit @ unit.T
    dual = kernel @ np.linalg.solve(kernel + language_id.RIDGE * 30 * np.eye(30), np.where(owner[:, None] == np.arange(3), 1.0, -1.0))
    assert np.allclose(unit @ weights, dual, atol=1e-6)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = {"aa": ["ba", "bana", "nab", "anna", "kabana"], "bb": ["über", "öl", "fünf", "grün", "schön"], "日": ["日本", "本語", "のは", "語"]}
    write = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    out = [(k, write(lang, rng.choice([1, 3, 20, 200])), lang) for k in range(300) for lang in [rng.choice(["aa", "aa", "bb", "日"])]]
    return [*out, (300, None, "aa"), (301, "", "bb"), (302, "12 !? 3", "aa"), (None, write("bb", 30), "bb"), (303, write("aa", 30), None), (304, write("bb", 60_000), "bb"), out[5], out[5]]


def test_identify(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    lang = {(d, g) for d, _, g in rows}
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id in (300, 301, 302):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.doc_id == 303:
            assert r.lang_pred == "aa"
        else:
            assert (r.doc_id, r.lang_pred) in lang


def test_no_part_for_what_is_held_out(spark, rows):
    """Other langs of held-out rows, or other ids of the rows that are scored, change nothing."""
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)
    wrong = spark.createDataFrame([(d, t, "zz" if d is not None and zlib.crc32(str(d).encode()) % 3 == 1 else g, 1, 2, 3, 4) for d, t, g in rows], SCHEMA)
    ordered = lambda df: sorted((r.doc_id or -1, r.lang_pred, round(r.score, 6)) for r in df.collect())
    assert ordered(language_id.identify(docs)) == ordered(language_id.identify(wrong))


def test_nothing_to_learn_from(spark):
    assert language_id.identify(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "words", None, 1, 2, 3, 4), (None, "words", "aa", 1, 2, 3, 4), (2, "7", "aa", 1, 2, 3, 4)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(d, "words", "aa", 1, 2, 3, 4) for d in range(8)], SCHEMA)
    assert {r.lang_pred for r in language_id.identify(one).collect()} == {"aa"}
