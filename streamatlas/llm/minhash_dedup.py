"""Operator 7: near duplicates by minima of universal hashes.

Each document's set of five-word shingles gives 128 minima, in 32 bands of four: two sets with a similarity of 0.75 miss each other in all bands with a probability of
5 in a million. Documents with the same set are one class, whose smallest id stands for it, so exact copies cost one row each. Candidates of a band
are first compared with one leader (as many pairs as rows, not their square); only in bands that still hold different components are signatures then compared
across components, in blocks inside tasks, so no link between components is lost. Signatures sort candidates out, full sets decide.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a null id is linked with nothing and its component is null; rows
that share an id are one node; ties go to the smallest id; columns other than id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .frames import SMALL_SLICE_BYTES, batches_of, id_and_text, materialise, text_buffers
from .hashing import BYTE_VALUE, Prefix, mix, word_spans

SHINGLE, HASHES, ROWS = 5, 128, 4
FINE = 512  # further hashes, taken only of texts that share a band with another
SIMILAR = (75, 100)  # intersection and union
# Five standard deviations of the estimate by so many hashes, at the similarity asked for: what lies below is no link but for one case in millions.
SLACK = {HASHES: 0.2, HASHES + FINE: 0.086}
BLOCK = 4096  # members of a band that are compared with each other in one task
SIGNATURES = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, low binary"
DOC_BITS = 12
U64, U32 = np.uint64, np.uint32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(75))
_FACTOR = _RNG.integers(0, 2**31, HASHES + FINE, dtype=np.uint32) * U32(2) + U32(1)
_SHIFT = _RNG.integers(0, 2**32, HASHES + FINE, dtype=np.uint32)


def shingle_keys(texts: pa.Array) -> np.ndarray:
    """Sorted distinct keys of a slice: the text's index in the slice in the leading bits, then the shingle's hash."""
    data, offsets = text_buffers(texts)
    starts, ends, doc = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, U64)
    words = Prefix(Prefix(BYTE_VALUE[_LOWER[data]]).ranges(starts, ends), 1)
    count = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    full = np.flatnonzero(doc[SHINGLE - 1 :] == doc[: len(doc) - SHINGLE + 1]) if len(doc) >= SHINGLE else np.zeros(0, np.int64)
    hashes = np.concatenate((words.windows(SHINGLE)[full], words.ranges(first[short], first[short] + count[short])))
    owner = np.concatenate((doc[full], short)).astype(U64)
    keys = np.sort((owner << U64(64 - DOC_BITS)) | (hashes >> U64(DOC_BITS)))
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def _minima(values: np.ndarray, start: np.ndarray, has: np.ndarray, n: int, hashes: range) -> np.ndarray:
    """Per hash and text the least value of the text's shingles."""
    minima = np.zeros((len(hashes), n), U32)
    if len(has):
        small, held = (values >> U64(32)).astype(U32), np.empty(len(values), U32)
        for row, k in enumerate(hashes):
            np.multiply(small, _FACTOR[k], out=held)
            np.add(held, _SHIFT[k], out=held)
            minima[row, has] = np.minimum.reduceat(held, start)
    return minima


def _low(minima: np.ndarray) -> pa.Array:
    """One byte of each minimum: enough to see how many agree."""
    return pa.array([row.tobytes() for row in ((minima * U32(0x9E3779B1)) >> U32(24)).astype(np.uint8).T], pa.binary())


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values of all shingles of a slice, where each text's begin, which texts have any, and how many each has."""
    keys = shingle_keys(texts)
    count = np.bincount((keys >> U64(64 - DOC_BITS)).astype(np.int64), minlength=len(texts))
    has = np.flatnonzero(count)
    return mix(keys << U64(DOC_BITS)), np.concatenate(([0], np.cumsum(count[has])[:-1])).astype(np.int64), has, count


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, limit=SMALL_SLICE_BYTES):
        values, start, has, _ = _sets(batch.column("text"))
        low = _low(_minima(values, start, has, batch.num_rows, range(HASHES, HASHES + FINE)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), low], ["doc_id", "fine"])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = HASHES // ROWS
    for batch in batches_of(batches, limit=SMALL_SLICE_BYTES):
        n = batch.num_rows
        values, start, has, count = _sets(batch.column("text"))
        minima = _minima(values, start, has, n, range(HASHES))
        sums = np.zeros((2, n), U64)
        if len(has):
            sums[0, has] = np.add.reduceat(values, start)
            sums[1, has] = np.add.reduceat(mix(values + U64(1)), start)
        wide = minima.astype(U64).reshape(bands, ROWS, n)
        key = np.arange(bands, dtype=U64)[:, None] + np.zeros(n, U64)
        for r in range(ROWS):
            key = mix(key ^ wide[:, r]) + U64(r)
        columns = [
            batch.column("doc_id"),
            pa.array(count),
            pa.array(sums[0].view(np.int64)),
            pa.array(sums[1].view(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32)), pa.array(np.ascontiguousarray(key.T).view(np.int64).ravel())),
            _low(minima),
        ]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SIGNATURES.split(", ")])


def _least(hashes: int) -> float:
    """Minima that must agree in a pair that may be linked."""
    return (SIMILAR[0] / SIMILAR[1] - SLACK[hashes]) * hashes


def _across(frame: pd.DataFrame) -> pd.DataFrame:
    """Pairs of different components in (two blocks of) a band that may be similar enough, by the first hashes and then by all of them. A pair that shares
    several bands is told by the first of these alone."""
    low = np.frombuffer(b"".join(frame["low"]), np.uint8).reshape(-1, HASHES)
    fine = np.frombuffer(b"".join(frame["fine"]), np.uint8).reshape(-1, FINE)
    ids, component, block = (frame[c].to_numpy() for c in ("doc_id", "component", "block"))
    one = frame["lo"].iloc[0] == frame["hi"].iloc[0]
    bands = np.stack(frame["bands"].to_numpy())
    earlier = bands[:, : int(np.argmax(bands[0] == frame["key"].iloc[0]))]
    found: list[np.ndarray] = []
    step = max(1, 8_000_000 // (len(ids) * HASHES))
    for at in range(0, len(ids), step):
        rows = slice(at, at + step)
        same = (low[rows, None, :] == low[None, :, :]).sum(axis=2)
        other = component[rows, None] != component[None, :]
        wanted = (same >= _least(HASHES)) & other & ((ids[rows, None] < ids[None, :]) if one else (block[rows, None] < block[None, :]))
        a, b = np.nonzero(wanted)
        a += at
        for lo in range(0, len(a), 20_000):
            x, y = a[lo : lo + 20_000], b[lo : lo + 20_000]
            first = ~(earlier[x] == earlier[y]).any(axis=1)
            x, y = x[first], y[first]
            total = (fine[x] == fine[y]).sum(axis=1) + (low[x] == low[y]).sum(axis=1)
            near = total >= _least(HASHES + FINE)
            found.append(np.stack((ids[x[near]], ids[y[near]])))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pd.DataFrame({"a": pairs.min(axis=0), "b": pairs.max(axis=0)})


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both signatures those that may be similar enough."""
    least = _least(HASHES)
    for batch in batches:
        both = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("low_a", "low_b")]
        same = (both[0] == both[1]).sum(axis=1) if batch.num_rows else np.zeros(0)
        yield batch.select(["a", "b"]).filter(pa.array(same >= least))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts those whose whole sets are similar enough."""
    for batch in batches_of(batches, "text_a", SMALL_SLICE_BYTES):
        a, b = shingle_keys(batch.column("text_a")), shingle_keys(batch.column("text_b"))
        sizes = [np.bincount((k >> U64(64 - DOC_BITS)).astype(np.int64), minlength=batch.num_rows) for k in (a, b)]
        common = np.intersect1d(a, b, assume_unique=True)
        shared = np.bincount((common >> U64(64 - DOC_BITS)).astype(np.int64), minlength=batch.num_rows)
        yield batch.select(["a", "b"]).filter(pa.array(SIMILAR[1] * shared >= SIMILAR[0] * (sizes[0] + sizes[1] - shared)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    rows = id_and_text(docs)
    signed = materialise(rows.mapInArrow(_signatures, SIGNATURES), "signatures")
    of_set = ["n_shingles", "set_a", "set_b"]
    classes = signed.where("n_shingles > 0").groupBy(*of_set).agg(F.min("doc_id").alias("first")).where("first is not null")
    classes = materialise(classes, "classes")
    leaders = signed.join(classes, (signed.doc_id == classes["first"]) & (signed.set_a == classes.set_a) & (signed.set_b == classes.set_b), "left_semi")
    banded = leaders.select("doc_id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    members = materialise(banded.join(shared, "key", "left_semi").distinct(), "band-members")
    active = members.select("doc_id").distinct()
    lows = materialise(leaders.select("doc_id", "low", "bands").join(active, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "band-signatures")
    texts = materialise(rows.join(active, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "band-texts")
    base = members.select("doc_id").distinct()
    whole = lows.join(texts.mapInArrow(_fine, "doc_id long, fine binary"), "doc_id")

    def open_bands(component: DataFrame) -> DataFrame:
        """Rows of the bands that hold more than one component, with the number of rows."""
        state = members.join(component, "doc_id")
        keys = state.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y")
        return materialise(state.join(keys.select("key", "n"), "key"), "open-bands")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
        return materialise(both.mapInArrow(_linked, "a long, b long"), "links")

    # Copies of one text share most bands with that text and fewer with each other: who shares most leads its bands.
    state = open_bands(base.withColumn("component", F.col("doc_id")))
    central = state.groupBy("doc_id").agg((-F.sum("n")).alias("order"))
    first = state.join(central, "doc_id").groupBy("key").agg(F.min(F.struct("order", "doc_id")).alias("f")).select("key", F.col("f.doc_id").alias("leader"))
    led = state.join(first, "key").where("doc_id <> leader")
    led = materialise(led.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct(), "pairs")
    signed_pairs = led.join(lows.select(F.col("doc_id").alias("a"), F.col("low").alias("low_a")), "a")
    signed_pairs = signed_pairs.join(lows.select(F.col("doc_id").alias("b"), F.col("low").alias("low_b")), "b").select("a", "b", "low_a", "low_b")
    links = verified(signed_pairs.mapInArrow(_alike, "a long, b long"))
    # What is still apart in a band is compared pair by pair, inside tasks and in blocks, so that no link is lost and no pair but a likely one is a row.
    state = open_bands(base.join(connected_components(links), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component")))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cells = state.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = cells.select("key", "doc_id", "component", "block", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))
    across = cells.join(whole, "doc_id").groupBy("key", "lo", "hi").applyInPandas(_across, "a long, b long").distinct()
    links = links.unionByName(verified(across.join(led, ["a", "b"], "left_anti")))
    component = base.join(connected_components(links), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    of_class = classes.join(component.withColumnRenamed("doc_id", "first"), "first", "left").select(*of_set, F.coalesce("component", "first").alias("component_id"))
    out = signed.select("doc_id", *of_set).join(of_class, of_set, "left")
    # an id that stands in several rows is one node: its rows may have different sets only if the table repeats ids
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
