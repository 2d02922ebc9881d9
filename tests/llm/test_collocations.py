"""Operator 12 against counting every phrase in dictionaries."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from streamatlas.llm import collocations, hat_trie

SCHEMA = "doc_id long, text string, lang string, n int, phrase string, prefix string"


def grams_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
        w = re.findall(r"[^\x20\x09]+", piece)
        for k in (1, 2, 3):
            for i in range(len(w) - k + 1):
                yield tuple(w[i : i + k])


def brute(rows, top):
    f = defaultdict(Counter)
    for text, lang in rows:
        f["und" if lang is None else lang].update(grams_of(text))
    out = []
    for lang, count in f.items():
        total = sum(n for g, n in count.items() if len(g) == 1)
        candidates = {g: n for g, n in count.items() if len(g) > 1 and n >= 10}
        scored = []
        for g, a in candidates.items():
            if any(len(h) > len(g) and g in (h[:2], h[1:]) and 100 * b >= 50 * a for h, b in candidates.items()):
                continue
            cuts = [(Fraction(1000000 * a * a, count[g[:k]] * count[g[k:]]).__floor__(), k) for k in range(1, len(g))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(g).encode(), count[g[:k]], count[g[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, total, -s) for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdéß漢") for _ in range(rng.randint(1, 3))) for _ in range(40)] + ["Ab", "#x", "\x1fq", "\x00", "und"]
    write = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!\r\n"]) for _ in range(n))
    texts = [(write(rng.randint(0, 300)), rng.choice(["en", "en", "xx", "", None])) for _ in range(120)]
    return [*texts, (None, "en"), (None, None), ("", "en"), (" \t\n,,", "xx"), *[("New York city. New York", "und")] * 12, ("same same " * 4000, "en"), ("rare phrase", "lone")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k % 50, t, g, 1, "p", "q") for k, (t, g) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("top", [2000, 7])
def test_collocations(docs, rows, top):
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations.collocations(docs, top).collect())
    assert got == brute(rows, top)


def test_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, "a b", "en", 1, "p", "q"), (None, None, None, 1, "p", "q")], SCHEMA)).collect() == []


def test_trie_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(hat_trie, "BURST", 20)
    rng = np.random.default_rng(2)
    trie, want, got = hat_trie.Trie(1000), Counter(), Counter()
    runs, nodes = [], 0
    ids = rng.choice(hat_trie.MAX_IDS, 60) + 1
    for _ in range(60):
        keys = (ids[rng.integers(0, 30, 400)] << 42) | (ids[rng.integers(0, 60, 400)] << 21) | rng.integers(0, 3, 400)
        want.update(keys.tolist())
        trie.add(keys)
        nodes += sum(isinstance(child, hat_trie.Node) for child in trie.root.children)
        if trie.held > 1000:
            runs += list(trie.spill(500))
            assert trie.held <= 500 and trie.held == trie.root.size()
    assert nodes > 20
    for keys, counts in [*runs, *trie.spill(0)]:
        assert (np.diff(keys) > 0).all()
        for key, n in zip(keys.tolist(), counts.tolist()):
            got[key] += n
    assert got == want and trie.held == 0


def test_tasks_that_run_full(monkeypatch, rows):
    monkeypatch.setattr(collocations, "HELD_KEYS", 60)
    monkeypatch.setattr(collocations, "ID_LIMIT", 30)
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 35)
    batch = pa.RecordBatch.from_arrays([pa.array(["und" if g is None else g for _, g in rows]), pa.array([t or "" for t, _ in rows])], ["lang", "text"])
    monkeypatch.setattr(collocations, "batches_of", lambda batches: (b.slice(k, 9) for b in batches for k in range(0, b.num_rows, 9)))
    got, want = Counter(), Counter()
    pieces = list(collocations._count(lambda: collocations._pairs_and_words)(iter([batch])))
    for out in pieces:
        for r in out.to_pylist():
            got[r["lang"], r["phrase"]] += r["n"]
            assert r["prefix"] == r["phrase"]
    for t, g in rows:
        want.update(("und" if g is None else g, " ".join(x)) for x in grams_of(t) if len(x) < 3)
    assert got == want and len(pieces) > 20


def test_table_of_frequent_pairs(spark):
    pairs = [("en", "a b"), ("en", "b a"), ("xx", "a b"), ("", "é 漢")]
    table = collocations._frequent_table(spark.createDataFrame(pairs, "lang string, phrase string").repartition(3))
    assert np.unpackbits(table).sum() == len(pairs)
    keys = collocations._triples(table)

    def passing(lang, words):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, ends, _ = collocations.word_spans(data, np.array([0, len(data)]), collocations._LETTERS)
        return len(keys(np.arange(1, len(words) + 1), np.zeros(len(words), int), 99, lambda: collocations._word_hashes(data, starts, ends, lang))[0])

    assert [passing("en", w) for w in ("aba", "bab", "aab", "baba")] == [1, 1, 0, 2] and passing("xx", "aba") == 0
