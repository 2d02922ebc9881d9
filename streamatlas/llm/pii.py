"""Operator 9: personal data, and the terms of its documents that give it away.

Base spans are found by patterns. A term of a document that holds a value reveals it if, over the whole corpus, seeing the term leaves little doubt about the value: the
information that the term gives about the value, divided by what the value itself holds, is its disclosure,

    log2(p(value | term) / p(value)) / log2(1 / p(value)),    p(value) = n(value) / N,    p(value | term) = (n(term, value) + p(value)) / (n(term) + 1),

with numbers of documents: to those that hold the term one more is added, in which the value is as likely as anywhere, so that one document proves less than many. Terms
from the threshold on are generalised like the value, wherever they stand in its documents. Documents without personal data are never touched.

Values and terms of a row are only paired where two rows are needed to decide: a value of one document is decided by the number of documents of the term, and
values that stand in the same rows are paired as one, so a list of many addresses stays linear, copied or not.

Defined results: a null text is empty and has no spans; each row is a document of its own, repeated or not; a null id stays null; other columns are ignored; an empty
table gives no rows. Of overlapping spans of different kinds all are reported; in sanitised texts they are replaced as one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.keyed import attach_by_key
from .frames import batches_of, id_and_text, materialise, text_buffers
from .hashing import BYTE_VALUE, Prefix, word_spans

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSURE = 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_WORD = re.compile(r"[^\W_]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, leftmost and not overlapping, found from each @ so that long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) in code points, in order."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TERM_BITS = 52


def _term_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash (52 bits) of every term of a slice (ASCII letters lowered), and the text it stands in. A term is a run of letters, digits and non-ASCII characters."""
    data, offsets = text_buffers(texts)
    starts, ends, doc = word_spans(data, offsets, _LETTERS)
    keys = Prefix(BYTE_VALUE[_LOWER[data]]).ranges(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return keys >> np.uint64(64 - _TERM_BITS), doc


def _distinct_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each text of a slice, and the text they stand in."""
    keys, doc = _term_keys(texts)
    pairs = np.unique((doc.astype(np.uint64) << np.uint64(_TERM_BITS)) | keys)
    return (pairs & np.uint64((1 << _TERM_BITS) - 1)).view(np.int64), (pairs >> np.uint64(_TERM_BITS)).astype(np.int64)


_SPANS = "array<struct<start:int,kind:int,end:int>>"
_FOUND = f"doc_id long, row long, digest long, spans {_SPANS}, base_sha256 string, values array<long>, terms array<long>, text string"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def _value(text: str, span: tuple[int, int, int]) -> int:
    """Hash of what a base span says, however it is written."""
    start, kind, end = span
    said = text[start:end].lower() if kind == 0 else "".join(c for c in text[start:end] if c.isdigit())
    return _key(f"{KINDS[kind]}:{said}")


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans; of texts with any also the distinct values and terms, and the text."""
    for batch in batches_of(batches):
        texts = batch.column("text").to_pylist()
        own = [base_spans(text) for text in texts]
        digests = [hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest() for spans in own]
        held = [i for i, spans in enumerate(own) if spans]
        terms, doc = _distinct_terms(pa.array([texts[i] for i in held], pa.large_string()))
        cuts = np.searchsorted(doc, np.arange(len(held) + 1))
        of_text: list[np.ndarray | None] = [None] * len(texts)
        for k, i in enumerate(held):
            of_text[i] = terms[cuts[k] : cuts[k + 1]]
        spans = [[{"start": a, "kind": k, "end": b} for a, k, b in x] for x in own]
        values = [sorted({_value(t, x) for x in found}) for t, found in zip(texts, own)]
        kept = [t if found else None for t, found in zip(texts, own)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), batch.column("digest"), pa.array(spans, _SPAN_TYPE), pa.array(digests),
             pa.array(values, pa.list_(pa.int64())), pa.array(of_text, pa.list_(pa.int64())), pa.array(kept, pa.string())],
            ["doc_id", "row", "digest", "spans", "base_sha256", "values", "terms", "text"],
        )


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per term the number of a slice's texts that hold it."""
    for batch in batches_of(batches):
        terms, n = np.unique(_distinct_terms(batch.column("text"))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n)], ["term", "n"])


def _all_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and the places of telling terms outside them, in order."""
    for batch in batches_of(batches):
        out = []
        for text, spans, telling in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), batch.column("telling").to_pylist()):
            if telling:
                told, base = set(telling), list(spans)
                for m, key in zip(_RUN.finditer(text), _term_keys(pa.array([text]))[0].tolist()):
                    if key in told and _WORD.search(m[0]) and not any(m.start() < x["end"] and x["start"] < m.end() for x in base):
                        spans.append({"start": m.start(), "kind": KINDS.index("term"), "end": m.end()})
                spans.sort(key=lambda x: (x["start"], x["kind"], x["end"]))
            out.append(spans)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "row", "digest", "base_sha256")], pa.array(out, _SPAN_TYPE)], ["doc_id", "row", "digest", "base_sha256", "found"])


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """One row per row of the input: doc_id, row (a number of its own), digest (hash of the text), base_sha256, `found` (all spans in order: start, kind's place in KINDS, end)."""
    rows = id_and_text(docs)
    found = materialise(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.xxhash64("text")).mapInArrow(_find, _FOUND), "base-spans")
    total = F.lit(float(max(2, found.count())))
    held = found.select("row", F.explode("values").alias("value"))
    # values of the same rows are one class: every term gives the same information about each of them
    seeds = {"class_a": 1, "class_b": 2}
    rows_of = [F.bit_xor(F.xxhash64(F.lit(seed), F.col("row"))).alias(name) for name, seed in seeds.items()]
    of_value = attach_by_key(held, held.groupBy("value").agg(F.count(F.lit(1)).alias("n_value"), *rows_of), ["value"], "n_value", F.col("row"))
    of_row = of_value.groupBy("row").agg(
        F.collect_set(F.struct("n_value", *seeds)).alias("held"), F.min("n_value").alias("rarest"), F.max("n_value").alias("top")
    )
    values = materialise(of_row, "values")
    # a term can tell a value of n documents only up to so many documents of its own: all of the value's would have to hold it
    share = lambda n: F.col(n) / total
    most = lambda n: (F.col(n) + share(n)) * F.pow(share(n), F.lit(disclosure - 1)) - 1 + 1e-6

    def measure(n_both: Column, n: str) -> Column:
        return F.log2((n_both + share(n)) / (F.col("n_term") + 1) / share(n)) / F.greatest(-F.log2(share(n)), F.lit(1e-9))

    # the counts of all terms of the corpus are summed by task before they are shuffled
    counts = rows.select("text").mapInArrow(_document_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    own = found.where(F.size("values") > 0).select("row", F.explode("terms").alias("term")).join(values.select("row", "rarest", "top"), "row")
    rare = attach_by_key(own, counts, ["term"], "n_term", F.col("row")).where(F.col("n_term") <= most("top"))
    rare = materialise(rare.select("row", "term", "n_term", "rarest", "top"), "rare-terms")
    # this row alone may prove enough for its rarest value; more rows that hold both would only add to it
    alone = measure(F.lit(1), "rarest") >= disclosure
    # what is left takes two rows that hold term and value, so values of one document are settled
    open_ = rare.where(~alone & (F.col("top") > 1)).select("row", "term", "n_term").join(values.select("row", "held"), "row")
    beside = open_.select("row", "term", "n_term", F.explode(F.filter("held", lambda v: v["n_value"] > 1)).alias("v")).select("row", "term", "n_term", "v.*")
    beside = materialise(beside.where(F.col("n_term") <= most("n_value")), "candidates")
    pair = ["n_value", *seeds, "term"]
    both = beside.groupBy(*pair).agg(F.count(F.lit(1)).alias("n_both"), F.first("n_term").alias("n_term"))
    telling = both.where(measure(F.col("n_both"), "n_value") >= disclosure).select(*pair, "n_both")
    told = attach_by_key(beside.select("row", *pair), telling, pair, "n_both", F.col("row")).select("row", "term")
    told = rare.where(alone).select("row", "term").unionByName(told).groupBy("row").agg(F.collect_set("term").alias("telling"))
    columns = ["doc_id", "row", "digest", "base_sha256", "spans", F.coalesce("text", F.lit("")).alias("text"), "telling"]
    return found.join(told, "row", "left").select(*columns).mapInArrow(_all_spans, f"doc_id long, row long, digest long, base_sha256 string, found {_SPANS}")


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of each base kind, base_sha256 and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    said = F.transform("found", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], "base_sha256", F.array_join(said, ",").alias("spans"), count("term"))


def replace_spans(text: str, spans: list) -> str:
    """The text with every span replaced by its kind in brackets; overlapping ones by the kind of the first."""
    out, done = [], 0
    for span in spans:
        if span["start"] >= done:
            out += [text[done : span["start"]], f"[{KINDS[span['kind']].upper()}]"]
        done = max(done, span["end"])
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with all spans replaced in `text`, and `n_chars` (where there is such a column) counted anew; other columns as they are."""
    found = find_personal_data(docs).where(F.size("found") > 0).groupBy("doc_id", "digest").agg(F.first("found").alias("found"))

    @F.pandas_udf("string")
    def replaced(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else replace_spans(t, s) for t, s in zip(text, spans)], dtype=object)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    same = F.col("r.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce("r.text", F.lit(""))) == F.col("digest"))
    joined = rows.join(found, same, "left")
    touched = joined.where("found is not null").withColumn("new", replaced("r.text", "found"))
    row = F.col("r").withField("text", F.col("new"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("new").cast(docs.schema["n_chars"].dataType))
    return joined.where("found is null").select("r.*").unionByName(touched.select(row.alias("r")).select("r.*"))
