"""Operator 11 against sending every document through every order."""

import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from streamatlas.llm import filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n int, mask int, part string, digest string"


def brute(rows, labels):
    """rows: (doc_id, text, source)."""
    smallest = {}
    for d, t, _ in rows:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    by_part = defaultdict(list)
    for d, t, s in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = {f for f, bad in zip("ABCD", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t))) if bad}
        if d is not None and d > smallest[t]:
            fails.add("E")
        by_part[s or ""].append((fails, d in good, d in toxic))
    out = {}
    for part, own in by_part.items():
        removed_by = defaultdict(int)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                removed_by[f] += len(gone)
                failing = sum(f in x[0] for x in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = removed_by[row[-1]]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    write = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [None, "", " \n\t", "few words", "A B C D", "a # b", "Few Words |", write(60), write(49), write(50), write(20) * 9, write(80).upper(), write(70) + "$", write(30_000)]
    out = [(k, t, rng.choice(["x", "y", "", None, "hot"])) for k, t in enumerate(texts * 3)]
    out += [(500 + k, texts[7], "hot") for k in range(40)]
    out += [(7, texts[7], "y"), (0, None, "x"), (None, texts[8], "hot"), (None, None, None), (8, texts[9], "z")]
    rng.shuffle(out)
    return out


def test_audit(spark, rows):
    labels = [(k, q, t) for k in range(0, 560, 3) for q, t in [(k % 2, k % 5 == 0)]] + [(6, 0, 1), (6, 1, 0), (9, None, None), (None, 1, 1), (99_999, 1, 1)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    docs = spark.createDataFrame([(d, t, s, 1, 2, "p", "q") for d, t, s in rows], SCHEMA)
    known = spark.createDataFrame([(*x, "source") for x in labels], "doc_id long, quality int, toxic int, source string")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(docs, known).collect()}
    assert got == brute(rows, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, None, None, 1, 2, "p", "q")], SCHEMA)
    assert filter_audit.audit(one, labels).count() == 600


def test_gray_walk_visits_every_set():
    counts = np.random.default_rng(1).integers(0, 9, (4, 3, 32))
    got = filter_audit.gray_walk(counts)
    for state in range(32):
        assert (got[..., state] == counts[..., [m for m in range(32) if not m & state]].sum(axis=-1)).all()
