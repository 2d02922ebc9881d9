"""Operator 5: quality rules as a ledger of failure bits.

Every rule is evaluated once per document: the ledger holds what was measured and one bit per rule that failed. A policy is a version with the mask of the
rules it applies; verdicts, and what each rule alone costs, come from the bits without reading a text again.

Defined results: a null or blank text has no words (it fails the rule of 50 words); each row of a repeated document has its own entry; a null id stays null; columns
other than id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import batches_of, id_and_text, text_buffers
from .hashing import Prefix, byte_prefix, word_spans

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_marks")
_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)



def rules() -> tuple[tuple[str, Column], ...]:
    """Rules by name, with the condition under which they fail. The place in this list is the bit of a rule and stays; new rules are appended."""
    c = F.col
    return (
        ("under_50_words", c("n_words") < 50),
        ("repeated_trigrams", 100 * c("n_repeat_words") > 50 * c("n_words")),
        ("symbols", 10 * c("n_symbols") > c("n_words")),
        ("repeated_lines", 10 * c("n_dup_lines") > 5 * c("n_lines")),
        ("word_length", (c("word_chars") > 14 * c("n_words")) | (c("word_chars") < 2 * c("n_words"))),
        ("capitals", 10 * c("n_capitals") > 4 * c("n_letters")),
        ("exclamations", 10 * c("n_marks") > 3 * c("n_words")),
        ("over_100000_words", c("n_words") > 100_000),
    )


# Policies: version and the rules it applies.
POLICIES = {
    "base": ("under_50_words", "repeated_trigrams"),
    "v1": ("under_50_words", "repeated_trigrams", "symbols", "repeated_lines"),
    "v2": ("under_50_words", "repeated_trigrams", "symbols", "repeated_lines", "word_length", "capitals", "exclamations"),
}
BASE, CURRENT = "base", "v2"


def _table(members: str | range) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[[ord(m) if isinstance(m, str) else m for m in members]] = True
    return mask


_SYMBOL, _MARK, _CAPITAL, _SPACE = _table("#*$%&|<>"), _table("!?"), _table(range(65, 91)), _table([32, *range(9, 14)])
_LETTER = _table([*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)])  # lead bytes of Latin letters with marks count as letters


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches):
        n = batch.num_rows
        data, offsets = text_buffers(batch.column("text"))
        starts, ends, doc = word_spans(data, offsets)

        def per_text(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask)))
            return total[offsets[1:]] - total[offsets[:-1]]

        visible = ~_SPACE[data]
        prefix = byte_prefix(data)
        # lines with a word, and those equal to an earlier line of the text
        edges = np.union1d(np.concatenate((offsets[:-1], np.flatnonzero(data == 10) + 1)), [])[: len(data) + n].astype(np.int64)
        begin = np.unique(edges[edges < len(data)]) if len(data) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(data))
        end = end - ((end > begin) & (data[end - 1] == 10)) if len(begin) else end
        seen = np.concatenate(([0], np.cumsum(visible)))
        has = seen[end] > seen[begin]
        begin, end = begin[has], end[has]
        owner = np.searchsorted(offsets, begin, "right") - 1
        lines = np.unique(np.stack((owner.astype(np.uint64), prefix.ranges(begin, end))), axis=1) if len(begin) else np.zeros((2, 0), np.uint64)
        n_lines = np.bincount(owner, minlength=n)
        distinct = np.bincount(lines[0].astype(np.int64), minlength=n)
        # words in windows of three that occur twice
        covered = np.zeros(len(starts) + 3, bool)
        if len(starts) >= 3:
            at = np.flatnonzero(doc[2:] == doc[:-2])
            keys = (doc[at].astype(np.uint64) << np.uint64(52)) | (Prefix(prefix.ranges(starts, ends), 1).windows(3)[at] >> np.uint64(12))
            order = np.argsort(keys)
            same = keys[order][1:] == keys[order][:-1]
            twice = at[order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]] if len(at) else at
            for k in range(3):
                covered[twice + k] = True
        repeat = np.bincount(doc[covered[: len(starts)]], minlength=n)
        measured = (
            np.bincount(doc, minlength=n), per_text(visible & ((data & 0xC0) != 0x80)), per_text(_SYMBOL[data]), n_lines - distinct, repeat, n_lines,
            per_text(_LETTER[data]), per_text(_CAPITAL[data]), per_text(_MARK[data]),
        )
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(m.astype(np.int64)) for m in measured]], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and `failed`: bit k is set if rule k fails."""
    measured = id_and_text(docs).mapInArrow(_measure, _SCHEMA)
    bits = [F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, fails) in enumerate(rules())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("failed", total)


def mask(policy: str) -> int:
    names = [name for name, _ in rules()]
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def passes(policy: str) -> Column:
    """Whether a ledger's row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(entries: DataFrame) -> DataFrame:
    """(policy, rule, kept, kept_without): documents a policy keeps, and keeps if one of its rules is left out. The ledger is reduced to counts by bit
    pattern first, of which there are at most two to the number of rules."""
    counts = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    plan = [(policy, rule, mask(policy), mask(policy) & ~(1 << k)) for policy in POLICIES for k, (rule, _) in enumerate(rules()) if rule in POLICIES[policy]]
    cells = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).alias("m"), F.lit(w).alias("w")) for p, r, m, w in plan])
    each = counts.select("failed", "n", F.explode(cells).alias("c"))
    kept = lambda m: F.sum(F.when(F.col("failed").bitwiseAND(F.col(m)) == 0, F.col("n")).otherwise(0))
    return each.groupBy("c.policy", "c.rule").agg(kept("c.m").alias("kept"), kept("c.w").alias("kept_without"))


def judge(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with the verdicts of the base rules and of a policy; a base failure always counts."""
    base_failed = ~passes(BASE)
    return ledger(docs).select("doc_id", *MEASURES, "failed", base_failed.alias("base_failed"), (~base_failed & passes(policy)).alias("kept"))
