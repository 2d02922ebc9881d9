"""Operator 4: toxicity of texts that may be disguised, as a noisy channel.

A word's disguise (digits and signs for letters, letters repeated, letters set apart) is undone by a Viterbi search through the lattice of its readings, under a
character language model whose counts are taken from all documents. Features of the restored text (words, and beginnings of words, which inflected forms
share) get log-odds from the labelled documents; the strongest ones and their number, calibrated on the labels, make the score.

Defined results: a null or empty text is scored as a text without words; each row of a repeated document is scored; a null doc_id isn't held out and never learnt from;
labels of unknown documents and null labels are left out; other columns are ignored; an empty table gives no rows. Without labels every score is 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .frames import SMALL_SLICE_BYTES, batches_of, id_and_text, text_buffers
from .hashing import byte_prefix, word_spans

FEATURE_BITS = 20
BEGINNINGS = (3, 4, 5, 6, 7)  # bytes
TRAIN_ROWS = 40_000  # bound of the sample of labelled rows that weights are fitted on; it is taken by a hash of the id
LEAST_TOXIC = 5  # labelled toxic documents behind a feature
TOP_WEIGHT, LEVELS = 8.0, 16
THRESHOLD = 0.3
SYMBOLS = 64
U64 = np.uint64

# What a sign may stand for.
READINGS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
_APART = re.compile(r"(?<![^\W_])[^\W_](?:([ .\-_*])[^\W_])(?:\1[^\W_]){2,}(?![^\W_])")
_MIXED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])(?=\S*(?:[013457894@$!|+]\S*[^\W\d_]|(.)\1\1))\S+")
_TAIL = re.compile(r"[^\w@$]+$|([@$!|+])\1+$")

_CODE = np.full(256, 28, np.int64)  # letters 1 to 26, a word's border 0, other ASCII 27, bytes of other letters 28 to 63
_CODE[:128] = 27
_CODE[[32, *range(9, 14)]] = 0
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:192] = 28 + np.arange(64) % 18
_CODE[192:256] = 46 + np.arange(64) % 18


def _trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches_of(batches, limit=SMALL_SLICE_BYTES):
        data, _ = text_buffers(batch.column("text"))
        code = _CODE[data]
        if len(code) >= 3:
            total += np.bincount((code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:], minlength=SYMBOLS**3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of a character after two others, from all documents; its size is that of the alphabet, not of the corpus."""
    counts = id_and_text(docs).mapInArrow(_trigram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most SYMBOLS^3 rows
    table = np.full(SYMBOLS**3, 0.05)
    for r in counts:
        table[r["gram"]] += r["n"]
    table = table.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return np.log(table / table.sum(axis=2, keepdims=True)).astype(np.float32)


def _codes(text: str) -> list[int]:
    return _CODE[np.frombuffer(text.encode(), np.uint8)].tolist()


def restore(word: str, model: np.ndarray) -> str:
    """The likeliest reading of a disguised word (Viterbi over its lattice; the state is the last two characters)."""
    lattice: list[list[str]] = []
    for m in re.finditer(r"(.)\1*", word.lower()):
        one, n = m[1], len(m[0])
        options = list(READINGS.get(one, one))
        if n > 2:
            lattice.append([o * k for o in options for k in (1, 2)])
        else:
            lattice += [options] * n
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in [*lattice, [" "]]:
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (x, y), (score, text) in states.items():
            for option in options:
                a, b, s = x, y, score
                for c in _codes(option):
                    s += float(model[a, b, c])
                    a, b = b, c
                if (a, b) not in after or s > after[a, b][0]:
                    after[a, b] = (s, text + option)
        states = after
    return max(states.values())[1][:-1]


class Restorer:
    """Restores texts; readings of disguised words are kept in a dictionary of bounded size."""

    def __init__(self, model: np.ndarray) -> None:
        self.model, self.memo = model, {}

    def word(self, raw: str) -> str:
        tail = _TAIL.search(raw)
        core, rest = (raw[: tail.start()], raw[tail.start() :]) if tail else (raw, "")
        if len(core) < 3 or len(core) > 64:
            return raw
        if core not in self.memo:
            if len(self.memo) > 100_000:
                self.memo = {}
            self.memo[core] = restore(core, self.model)
        return self.memo[core] + rest

    def text(self, raw: str) -> str:
        if _APART.search(raw):
            raw = _APART.sub(lambda m: self.word("".join(c for c in m[0] if c != m[1])), raw)
        return _MIXED.sub(lambda m: self.word(m[0]), raw)


_EDGE = np.zeros(256, bool)
_EDGE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text: hashes of its words and of their beginnings, with the text's index."""
    data, offsets = text_buffers(pa.array(texts, pa.large_string()))
    starts, ends, doc = word_spans(data, offsets, _EDGE)
    prefix = byte_prefix(data)
    found = [prefix.ranges(starts, ends) + U64(1)]
    owners = [doc]
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts >= n)
        found.append(prefix.ranges(starts[long], starts[long] + n))
        owners.append(doc[long])
    pairs = np.unique((np.concatenate(owners).astype(U64) << U64(FEATURE_BITS)) | (np.concatenate(found) >> U64(64 - FEATURE_BITS)))
    return (pairs & U64((1 << FEATURE_BITS) - 1)).astype(np.int64), (pairs >> U64(FEATURE_BITS)).astype(np.int64)


def _prepared(batches: Iterator[pa.RecordBatch], model: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    restorer = Restorer(model)
    for batch in batches_of(batches, limit=SMALL_SLICE_BYTES):
        texts = [restorer.text(t or "").lower() for t in batch.column("text").to_pylist()]
        yield (batch, *_features(texts))


class Scorer:
    """Weights of features and the calibrated score of each level of evidence."""

    def __init__(self, weights: np.ndarray, levels: np.ndarray) -> None:
        self.weights, self.levels = weights, levels

    def level(self, features: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Evidence of n texts: their strongest feature in steps, one step more if several words speak for it."""
        own = self.weights[features]
        top, total = np.zeros(n), np.zeros(n)
        np.maximum.at(top, owner, own)
        np.add.at(total, owner, own)
        steps = np.ceil(np.minimum(top, TOP_WEIGHT) / TOP_WEIGHT * (LEVELS // 2 - 1)).astype(np.int64)
        return 2 * steps + (total > 2.5 * np.maximum(top, 1e-9)).astype(np.int64) * (steps > 0)


def held_out() -> Column:
    """Rows that are never learnt from: the checksum of their id leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, model: np.ndarray) -> Scorer:
    """Weights and calibration from labelled documents that aren't held out, TRAIN_ROWS at most. What comes back is bounded by the number of features."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    train = id_and_text(docs).join(F.broadcast(sample), "doc_id")  # at most TRAIN_ROWS pairs of numbers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << FEATURE_BITS
        total, toxic, n = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(2, np.int64)
        for batch, features, owner in _prepared(batches, model):
            label = np.asarray(batch.column("toxic")) == 1
            n += (len(label), int(label.sum()))
            total += np.bincount(features, minlength=size)
            toxic += np.bincount(features[label[owner]], minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], n[0])), pa.array(np.append(toxic[seen], n[1]))], ["feature", "n", "n_toxic"]
        )

    counts = train.mapInArrow(count, "feature long, n long, n_toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    rows = counts.where((F.col("n_toxic") >= LEAST_TOXIC) & (3 * F.col("n_toxic") > F.col("n")) | (F.col("feature") == -1)).collect()
    weights = np.zeros(1 << FEATURE_BITS)
    whole = next(((r["n"], r["n_toxic"]) for r in rows if r["feature"] == -1), (0, 0))
    prior = math.log((whole[0] - whole[1] + 1) / (whole[1] + 1))
    for r in rows:
        if r["feature"] >= 0:
            # pessimistic odds: two deviations off both counts
            good, bad = r["n_toxic"], r["n"] - r["n_toxic"]
            weights[r["feature"]] = max(0.0, math.log(max(0.2, good - 1.5 * math.sqrt(good)) / (bad + 1.5 * math.sqrt(bad) + 0.5)) + prior)
    plain = Scorer(weights, np.zeros(LEVELS))

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, toxic = np.zeros(LEVELS, np.int64), np.zeros(LEVELS, np.int64)
        for batch, features, owner in _prepared(batches, model):
            level = plain.level(features, owner, batch.num_rows)
            n += np.bincount(level, minlength=LEVELS)
            toxic += np.bincount(level[np.asarray(batch.column("toxic")) == 1], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(n), pa.array(toxic)], ["level", "n", "n_toxic"])

    levels = np.zeros(LEVELS)
    share = (whole[1] + 0.5) / (whole[0] + 1) if whole[1] else 0.0
    found = train.mapInArrow(calibrate, "level long, n long, n_toxic long").groupBy("level").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("t")).collect()
    for r in found:
        levels[r["level"]] = (r["t"] + share) / (r["n"] + 1)
    return Scorer(weights, levels)


def _fitted(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None) -> Broadcast:
    """Character model and scorer, learnt from `corpus` (or the documents themselves); their size is bounded by the alphabet and the number of features."""
    corpus = docs if corpus is None else corpus
    model = character_model(corpus)
    return docs.sparkSession.sparkContext.broadcast((model, learn(corpus, labels, model)))


def score(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row. `corpus`: documents to learn from, if not those that are scored."""
    held = _fitted(docs, labels, corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = held.value
        for batch, features, owner in _prepared(batches, model):
            value = scorer.levels[scorer.level(features, owner, batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value)], ["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """The rows of `docs`, all columns as they are, that `score` doesn't predict to be toxic; each row is judged by itself in the pass that scores it, so no text is shuffled."""
    held = _fitted(docs, labels, corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = held.value
        for batch, features, owner in _prepared(batches, model):
            yield batch.filter(pa.array(scorer.levels[scorer.level(features, owner, batch.num_rows)] < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
