"""Operator 12: phrases of two and three words that occur more often than their parts suggest.

Occurrences are counted in tasks by a HAT-trie (`hat_trie`) under a shallow trie of word ids; full tries hand out whole subtrees as sorted runs, which are
dealt by the phrase's first two words and merged there. Words and pairs are counted first. A phrase of three words can only be frequent if both of its
pairs are, so the second pass counts those triples alone whose pairs both stand in a bit table of the frequent ones. The table has a fixed size; a crowded
one lets more triples through, which costs time and changes nothing, since all counts are exact.

Defined results: a null text has no words; a null lang is `und`, together with documents that say so; each row of a repeated document counts; ids play no part;
other columns are ignored; an empty table, or one without a frequent phrase, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.keyed import lookup_by_key
from ..session import share_package
from .frames import batches_of, materialise
from .hashing import U64, Prefix, byte_prefix, mix, word_spans
from .hat_trie import ID_BITS, MAX_IDS, Trie, WordIds

LEAST = 10  # occurrences of a candidate
TOP = 2000
HELD_KEYS = 1_200_000  # of all tries of a task; beyond it subtrees are spilled
ID_LIMIT = MAX_IDS // 2  # words of a language in a task; beyond it its trie is spilled and ids begin anew
BLOCK_WORDS = 500_000  # words that are taken up before the two limits are looked at
FILTER_BITS = 27  # the table of frequent pairs has 2^27 bits (16 MB)
BLOCK_BITS = 18  # of a block of the table

# What ends a piece, and what parts words.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_ENDS))
_LETTERS = np.ones(256, bool)
_LETTERS[[32, 10]] = False

def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * U64(0x9E3779B97F4A7C15) + second) >> U64(64 - FILTER_BITS)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: str) -> np.ndarray:
    """Hashes of words, different in each language."""
    seed = np.frombuffer(lang.encode(), np.uint8)
    own = byte_prefix(seed).ranges(np.zeros(1, np.int64), np.array([len(seed)]))[0]
    return mix(byte_prefix(data).ranges(starts, ends) + own)


class _Counts:
    """The tries of a task, one per language, and the words behind their ids."""

    def __init__(self) -> None:
        self.tries: dict[str, tuple[WordIds, Trie]] = {}

    def of(self, lang: str) -> tuple[WordIds, Trie]:
        if lang not in self.tries:
            self.tries[lang] = (WordIds(), Trie(HELD_KEYS))
        return self.tries[lang]

    def relieve(self, everything: bool = False) -> Iterator[pa.RecordBatch]:
        """Sorted runs of what has to go: half of the keys once they are too many, all of a language that runs out of ids, or everything."""
        crowded = sum(trie.held for _, trie in self.tries.values()) > HELD_KEYS
        for lang, (ids, trie) in list(self.tries.items()):
            full = everything or len(ids) > ID_LIMIT
            if full or crowded:
                yield from self._rows(lang, ids, trie.spill(0 if full else trie.held // 2))
            if full:
                del self.tries[lang]

    @staticmethod
    def _rows(lang: str, ids: WordIds, runs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        own = np.fromiter(ids.values(), np.int64, len(ids))
        order = np.argsort(own)
        own, words = own[order], pa.array([b"", *ids.keys()], pa.binary()).cast(pa.string()).take(pa.array(np.concatenate(([0], order + 1))))

        def spelled(part: np.ndarray) -> pa.Array:
            return words.take(pa.array(np.searchsorted(own, part) + 1))

        def cut(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            one, two, three = keys >> 2 * ID_BITS, keys >> ID_BITS & MAX_IDS, keys & MAX_IDS
            length = 1 + (two > 0) + (three > 0)
            for k in (1, 2, 3):
                at = length == k
                if at.any():
                    parts = [spelled(ids_[at]) for ids_ in (one, two, three)[:k]]
                    phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, " ")
                    prefix = phrase if k < 3 else pc.binary_join_element_wise(*parts[:2], " ")
                    n = len(phrase)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(n, np.int64))), prefix, phrase, pa.array(counts[at])], ["lang", "prefix", "phrase", "n"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for run in runs:  # small containers of a run leave together
            held.append(run)
            size += len(run[0])
            if size > 100_000:
                yield from cut(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
                held, size = [], 0
        if held:
            yield from cut(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))


def _pairs_and_words(ids: np.ndarray, piece: np.ndarray, n: int, hashes: Callable[[], np.ndarray]) -> list[np.ndarray]:
    """Keys of the words and of the pairs that begin at the first n words."""
    single = ids << 2 * ID_BITS
    joined = piece[1:] == piece[:-1]
    return [single[:n], (single[:-1] | ids[1:] << ID_BITS)[:n][joined[:n]]]


def _triples(table: np.ndarray) -> Callable:
    def keys(ids: np.ndarray, piece: np.ndarray, n: int, hashes: Callable[[], np.ndarray]) -> list[np.ndarray]:
        if len(ids) < 3:
            return []
        own = hashes()
        bit = _pair_hash(own[:-1], own[1:])
        frequent = (table[bit >> U64(3)] >> (bit & U64(7)).astype(np.uint8) & 1).astype(bool) & (piece[1:] == piece[:-1])
        at = np.flatnonzero((frequent[:-1] & frequent[1:])[:n])
        return [ids[at] << 2 * ID_BITS | ids[at + 1] << ID_BITS | ids[at + 2]]

    return keys


def _count(make: Callable[[], Callable]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts the keys that `make()` finds in each batch's words and hands them out as (lang, prefix, phrase, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, keys = _Counts(), make()
        for batch in batches_of(batches):
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                texts = batch.column("text").filter(pc.equal(langs, lang)).to_pylist()
                plain = "\n".join(texts).encode().translate(_PLAIN)
                words = plain.split()
                if not words:
                    continue
                data = np.frombuffer(plain, np.uint8)
                starts, ends, _ = word_spans(data, np.array([0, len(data)]), _LETTERS)
                piece = np.cumsum(data == 10)[starts]
                for lo in range(0, len(words), BLOCK_WORDS):  # a block sees the two words after it
                    block = slice(lo, lo + BLOCK_WORDS + 2)
                    known, trie = counts.of(lang)
                    ids = np.fromiter(map(known.__getitem__, words[block]), np.int64)
                    for found in keys(ids, piece[block], BLOCK_WORDS, lambda: _word_hashes(data, starts[block], ends[block], lang)):
                        trie.add(found)
                    yield from counts.relieve()
        yield from counts.relieve(everything=True)

    return run


_COUNTED = "lang string, prefix string, phrase string, n long"


def _merged(runs: DataFrame) -> DataFrame:
    """Runs merged per prefix partition: phrases that share their first two words meet in one partition, where their counts are added."""
    return runs.repartition("lang", "prefix").groupBy("lang", "prefix", "phrase").agg(F.sum("n").alias("n"))


def _frequent_table(pairs: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits: those of the frequent pairs are set. A block of the table is put together where its pairs meet, so the driver gets the
    blocks' bytes alone."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                own = batch.column("phrase").filter(pc.equal(batch.column("lang"), lang)).to_pylist()
                data = np.frombuffer("\n".join(own).encode(), np.uint8)
                starts, ends, _ = word_spans(data, np.array([0, len(data)]), _LETTERS)
                words = _word_hashes(data, starts, ends, lang)
                bit = _pair_hash(words[0::2], words[1::2]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((bit >> BLOCK_BITS).astype(np.int32)), pa.array((bit & (1 << BLOCK_BITS) - 1).astype(np.int32))], ["block", "bit"])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            at, bit = batch.column("block").to_numpy(), batch.column("bit").to_numpy()
            for block in np.unique(at).tolist():
                own = bit[at == block]
                np.bitwise_or.at(blocks.setdefault(block, np.zeros(1 << BLOCK_BITS - 3, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], ["block", "bits"])

    found = pairs.mapInArrow(hashed, "block int, bit int").repartition("block").mapInArrow(assembled, "block int, bits binary")
    table = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    size = 1 << BLOCK_BITS - 3
    for r in found.collect():  # 2^FILTER_BITS bits
        table[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return table


def phrase_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, words, n): every word, pair and triple with LEAST occurrences or more, and per language a row without words that counts all its words."""
    spark = docs.sparkSession
    share_package(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1
    counted = _merged(rows.mapInArrow(_count(lambda: _pairs_and_words), _COUNTED)).withColumn("words", words)
    totals = F.when(F.col("words") == 1, F.col("n"))
    # one write holds the frequent ones, and the rare words summed up per partition
    kept = materialise(
        counted.groupBy("lang", F.when(F.col("n") >= LEAST, F.col("phrase")).alias("phrase"), F.when(F.col("n") >= LEAST, F.col("words")).alias("words"))
        .agg(F.sum("n").alias("n"), F.sum(totals).alias("total")),
        "phrases",
    )
    total = kept.groupBy("lang").agg(F.sum("total").alias("n")).select("lang", F.lit("").alias("phrase"), F.lit(0).alias("words"), "n")
    short = kept.where("phrase is not null").select("lang", "phrase", "words", "n")
    table = spark.sparkContext.broadcast(_frequent_table(short.where("words = 2")))  # 2^FILTER_BITS bits
    long = _merged(rows.mapInArrow(_count(lambda: _triples(table.value)), _COUNTED)).where(F.col("n") >= LEAST)
    return materialise(short.unionByName(total).unionByName(long.select("lang", "phrase", F.lit(3).alias("words"), "n")), "phrase-counts")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Per language the `top` phrases by score, with their rank."""
    counts = phrase_counts(docs)
    candidates = counts.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    # a pair goes if a frequent phrase around it occurs half as often or more
    parts = F.split("phrase", " ")
    both = F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))
    around = candidates.where("words = 3").select("lang", F.explode(both).alias("phrase"), F.col("a").alias("b")).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    free = candidates.join(around, ["lang", "phrase"], "left").where((F.col("b").isNull()) | (100 * F.col("b") < 50 * F.col("a"))).drop("b")
    cuts = F.expr("transform(sequence(1, words - 1), k -> struct(k, substring_index(phrase, ' ', k) as head, substring_index(phrase, ' ', k - words) as tail))")
    cut = free.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.k", F.struct("lang", "c.head").alias("head"), F.struct("lang", "c.tail").alias("tail"))
    known = counts.where("words in (1, 2)")
    for side, out in (("head", "l"), ("tail", "r")):
        table = known.select(F.struct("lang", F.col("phrase").alias(side)).alias(side), F.col("n").alias(out))
        cut = lookup_by_key(cut, table, side, F.xxhash64("phrase"), [out], "inner")
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece
), gram AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM worded
  UNION ALL SELECT lang, 2, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM worded WHERE len(w) >= 2
  UNION ALL SELECT lang, 3, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM worded WHERE len(w) >= 3
), f AS (SELECT lang, k, phrase, count(*) AS n FROM gram GROUP BY ALL
), total AS (SELECT lang, count(*) AS n FROM gram WHERE k = 1 GROUP BY ALL
), cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE k >= 2 AND n >= 10
), around AS (
  SELECT lang, phrase, max(b) AS b FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a AS b FROM cand WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM cand WHERE k = 3
  ) GROUP BY ALL
), cut AS (
  SELECT lang, phrase, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM cand
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM cand WHERE k = 3
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.n AS l, r.n AS r, (1000000::HUGEINT * c.a * c.a) // (l.n::HUGEINT * r.n) AS score
  FROM cut c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.tail
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), free AS (SELECT best.* FROM best LEFT JOIN around USING (lang, phrase) WHERE b IS NULL OR 100 * b < 50 * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT ranked.lang, rank, phrase, a, l, r, total.n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
