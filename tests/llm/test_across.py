"""Pairs across components: each is told once, however many bands the two share."""

import numpy as np
import pandas as pd

from streamatlas.llm import minhash_dedup as m


def test_a_pair_is_told_by_its_first_shared_band():
    rng = np.random.default_rng(7)
    n, bands = 40, m.HASHES // m.ROWS
    keys = rng.integers(0, 3, (n, bands)) + 10 * np.arange(bands)
    low, fine = rng.bytes(m.HASHES), rng.bytes(m.FINE)
    frames = []
    for band in range(bands):
        for key in np.unique(keys[:, band]):
            rows = np.flatnonzero(keys[:, band] == key)
            frames.append(pd.DataFrame({"key": key, "doc_id": rows, "component": rows // 2, "block": 0, "lo": 0, "hi": 0, "low": low, "fine": fine, "bands": [keys[r] for r in rows]}))
    found = [(a, b) for f in frames for a, b in m._across(f).itertuples(index=False)]
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if a // 2 != b // 2 and (keys[a] == keys[b]).any()}
    assert len(found) == len(set(found)) and set(found) == want
