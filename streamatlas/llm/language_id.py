"""Operator 13: the language of a text, by a string kernel.

The kernel of two texts counts the byte n-grams of 1 to 4 letters (blended spectrum) that both hold, each once, over the geometric mean of their own numbers.
Landmarks, taken from the labelled rows, span a Nyström space: a text is known by its kernel values with them, times the inverse root of the landmarks' own
kernel matrix. One ridge regression per language (one versus the rest) is fitted there. As a kernel value is a product of two presence vectors, landmarks,
root and weights are multiplied once into a matrix of n-grams by languages, and batches of texts are scored by one product of their presence matrix with it.

What is learnt from is bounded: at most PER_LANGUAGE rows of a language and FIT_ROWS in all, drawn by a hash of the id; the VOCABULARY n-grams that most of
them hold; LANDMARKS of them. N-grams are told apart by GRAM_BITS bits of a hash. Every text is scored whole.

Defined results: a text that is null or without a letter is `und` with score 0; a text whose n-grams are all unknown gets the language with the most labelled
rows; a row with a null doc_id isn't held out and never learnt from, and neither is one with a null lang; each row of a repeated document is scored; lang and
doc_id play no part in a score; other columns are ignored; without anything to learn from every text is `und`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import share_package
from .frames import batches_of, materialise, text_buffers
from .hashing import U64

ORDERS = (1, 2, 3, 4)
GRAM_BITS = 20
VOCABULARY = 1 << 14
FIT_ROWS, PER_LANGUAGE, LANGUAGES = 20_000, 400, 500
LANDMARKS, LANDMARKS_EACH = 1024, 64
RIDGE = 1e-3
SHARPNESS = 5.0
ROWS_AT_ONCE = 512  # of the dense presence matrix
UNKNOWN = "und"

_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[:128] = 32
_LETTER[97:123] = np.arange(97, 123)


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of letters with one blank for whatever stands between them, also around each text; and the texts they belong to."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) + 2)
    inside = np.ones(len(owner), bool)
    inside[offsets[:-1] + 2 * np.arange(len(offsets) - 1)] = False
    inside[offsets[1:] + 2 * np.arange(len(offsets) - 1) + 1] = False
    out = np.full(len(owner), 32, np.uint8)
    out[inside] = _LETTER[data]
    again = np.zeros(len(out), bool)
    again[1:] = (out[1:] == 32) & (out[:-1] == 32) & (owner[1:] == owner[:-1])
    return out[~again], owner[~again]


def grams(data: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: the hashes (GRAM_BITS bits) of all n-grams, and the texts they stand in."""
    code = np.zeros(len(data), np.uint64)
    for order in ORDERS:
        n = len(data) - order + 1
        if n <= 0:
            return
        code = code[:n] << U64(8) | data[order - 1 :].astype(np.uint64)
        same = owner[:n] == owner[order - 1 :]
        hashed = (code + (U64(order) << U64(40))) * U64(0x9E3779B97F4A7C15) >> U64(64 - GRAM_BITS)
        yield (hashed if order == 1 else hashed[same]).astype(np.int64), owner[:n] if order == 1 else owner[:n][same]


def presence(column: pa.Array, places: np.ndarray, size: int) -> np.ndarray:
    """Texts by n-grams of the vocabulary: 1 where a text holds one. places: the vocabulary's column of each hash, -1 for none."""
    data, owner = _letters(*text_buffers(column))
    held = np.zeros((len(column), size), np.float32)
    flat = held.reshape(-1)
    for hashed, text in grams(data, owner):
        place = places[hashed]
        known = place >= 0
        flat[text[known] * size + place[known]] = 1
    return held


@dataclass
class Model:
    languages: list[str]  # the one with the most labelled rows first
    places: np.ndarray
    weights: np.ndarray  # n-grams of the vocabulary by languages

    def scores(self, column: pa.Array) -> np.ndarray:
        held = presence(column, self.places, len(self.weights))
        return (held @ self.weights) / np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1))


def normalised(held: np.ndarray) -> np.ndarray:
    return held / np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1))


def landmark_weights(sample: np.ndarray, owner: np.ndarray, languages: int) -> np.ndarray:
    """Weights of n-grams from the presence matrix of the sample and the languages' numbers of its rows."""
    unit = normalised(sample.astype(np.float64))
    each = max(1, min(LANDMARKS_EACH, LANDMARKS // languages))
    chosen = np.sort(np.concatenate([np.flatnonzero(owner == k)[:each] for k in range(languages)]))
    landmarks = unit[chosen]
    values, vectors = np.linalg.eigh(landmarks @ landmarks.T)
    firm = values > 1e-6 * values[-1]
    root = vectors[:, firm] / np.sqrt(values[firm])
    space = unit @ landmarks.T @ root
    target = np.where(owner[:, None] == np.arange(languages), 1.0, -1.0)
    beta = np.linalg.solve(space.T @ space + RIDGE * len(space) * np.eye(space.shape[1]), space.T @ target)
    return landmarks.T @ (root @ beta)


def held_out() -> Column:
    """Rows that are never learnt from: the checksum of their id leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _texts(docs: DataFrame) -> DataFrame:
    share_package(docs.sparkSession)
    text = F.coalesce(F.lower("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("lang").cast("string").alias("lang"), text.rlike(r"\p{L}").alias("lettered"))


def _distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches):
        data, owner = _letters(*text_buffers(batch.column("text")))
        both = np.unique(np.concatenate([text << GRAM_BITS | hashed for hashed, text in grams(data, owner)] or [np.zeros(0, np.int64)]))
        offsets = np.searchsorted(both >> GRAM_BITS, np.arange(batch.num_rows + 1)).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(offsets), pa.array((both & (1 << GRAM_BITS) - 1).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), found], ["doc_id", "lang", "grams"])


def learn(docs: DataFrame) -> Model | None:
    """The model of the labelled rows that aren't held out; None without such rows."""
    known = _texts(docs).where("lang is not null and doc_id is not null and lettered").where(~held_out())
    by_hash = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    languages = [r["lang"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()]
    if not languages:
        return None
    each = min(PER_LANGUAGE, FIT_ROWS // len(languages))
    ids = known.where(F.col("lang").isin(languages)).select("doc_id", "lang").withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= each)
    ids = materialise(ids.select("doc_id", "lang").distinct(), "language-sample")  # at most FIT_ROWS pairs
    rows = known.join(F.broadcast(ids), ["doc_id", "lang"]).select("doc_id", "text", "lang")
    sample = materialise(rows.mapInArrow(_distinct_grams, "doc_id long, lang string, grams array<int>").dropDuplicates(["doc_id", "lang"]), "language-grams")
    common = sample.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(VOCABULARY)
    vocabulary = np.sort(np.array([r["gram"] for r in common.collect()], np.int64))
    places = np.full(1 << GRAM_BITS, -1, np.int32)
    places[vocabulary] = np.arange(len(vocabulary))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for own in batch.column("grams"):
                row = np.zeros(len(vocabulary), bool)
                place = places[own.values.to_numpy()]
                row[place[place >= 0]] = True
                held.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(held, pa.binary())], ["doc_id", "lang", "held"])

    # FIT_ROWS rows of VOCABULARY bits at most
    found = sorted(sample.mapInArrow(bits, "doc_id long, lang string, held binary").collect(), key=lambda r: (r["doc_id"], r["lang"]))
    held = np.stack([np.unpackbits(np.frombuffer(r["held"], np.uint8), count=len(vocabulary)) for r in found])
    owner = np.array([languages.index(r["lang"]) for r in found])
    return Model(languages, places, landmark_weights(held, owner, len(languages)).astype(np.float32))


def identify(docs: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row. `corpus`: documents to learn from, if not those that are scored."""
    model = learn(docs if corpus is None else corpus)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^GRAM_BITS places and VOCABULARY by LANGUAGES weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        names = pa.array([UNKNOWN] if model is None else [*model.languages, UNKNOWN])
        for part in batches_of(batches):
            for lo in range(0, part.num_rows, ROWS_AT_ONCE):
                batch = part.slice(lo, ROWS_AT_ONCE)
                lettered = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
                best, sure = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
                if model is not None:
                    own = model.scores(batch.column("text")).astype(np.float64)
                    odds = np.exp(SHARPNESS * (own - own.max(axis=1, keepdims=True)))
                    best = np.where(lettered, own.argmax(axis=1), best)
                    sure = np.where(lettered, 1 / odds.sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names.take(pa.array(best)), pa.array(sure)], ["doc_id", "lang_pred", "score"])

    scored = _texts(docs).select("doc_id", "text", "lettered").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
