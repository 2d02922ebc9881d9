"""Texts are handled in slices small enough for workers that outlive their stage."""

import numpy as np
import pyarrow as pa

from streamatlas.llm import minhash_dedup, toxicity


def _batch(n=40, size=50_000):
    words = [f"w{k}" for k in range(size // 6)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([" ".join([str(k), *words]) for k in range(n)])], ["doc_id", "text"])


def test_near_duplicates_and_toxicity_hold_small_slices(monkeypatch):
    batch, seen = _batch(), []
    sets, features = minhash_dedup._sets, toxicity._features
    monkeypatch.setattr(minhash_dedup, "_sets", lambda texts: seen.append(texts.nbytes) or sets(texts))
    monkeypatch.setattr(toxicity, "_features", lambda texts: seen.append(sum(map(len, texts))) or features(texts))
    signed = pa.Table.from_batches(minhash_dedup._signatures(iter([batch])))
    assert signed["doc_id"].to_pylist() == list(range(40)) and max(seen) < 800_000
    seen.clear()
    rows = sum(b.num_rows for b, _, _ in toxicity._prepared(iter([batch]), np.zeros((64, 64, 64), np.float32)))
    assert rows == 40 and max(seen) < 800_000
