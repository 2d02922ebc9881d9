"""What a Python worker holds: of one slice of texts while it works, and of other operators when it goes on."""

import tracemalloc

import numpy as np
import pyarrow as pa

from streamatlas.llm import decontaminate, tokens
from streamatlas.llm.frames import batches_of
from streamatlas.llm.queries import tokenizer_file


def _batch(texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


def test_a_worker_lets_go_of_what_other_operators_kept():
    own = tokens.encoder(tokenizer_file("word_bpe_49k.json"))
    search = decontaminate._search("block", [(7, b"what is the capital of the country in which the longest river ends")])
    own.encode(pa.array(["a few words"]))
    list(search(iter([_batch(["none"])])))
    assert not own.now and not own.old


def test_packing_keeps_its_ids_from_task_to_task(spark):
    """Functions are sent to workers with copies of the values they use, so a task names what it keeps."""
    path = tokenizer_file("word_bpe_49k.json")

    def run(batches):
        own = tokens.encoder(path)
        for batch in batches_of(batches, keep=tokens.KEPT):
            own.encode(batch.column("text"))
        list(batches_of(iter([]), keep=tokens.KEPT))
        kept = len(own.now)
        list(batches_of(iter([])))
        yield pa.RecordBatch.from_arrays([pa.array([kept]), pa.array([len(own.now)])], ["kept", "left"])

    docs = spark.createDataFrame([("some words and others",)], "text string").coalesce(1)
    rows = docs.mapInArrow(run, "kept long, left long").collect()
    assert [tuple(r) for r in rows] == [(4, 0)]


def test_passages_are_searched_in_little_memory():
    rng = np.random.Generator(np.random.PCG64(3))
    texts = ["".join(chr(c) for c in rng.integers(97, 123, 2000)) for _ in range(2000)]
    item = texts[1234][500:700]
    search = decontaminate._search("little", [(1, item.encode())])
    list(search(iter([_batch(texts[:500])])))  # tables of powers stay
    tracemalloc.start()
    try:
        found = [r for b in search(iter([_batch(texts)])) for r in b.to_pylist()]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == [{"doc_id": 1234, "item_id": 1, "start": 500, "end": 700, "distance": 0}]
    assert most < 90e6, most
