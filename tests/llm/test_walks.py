"""CGK walks of windows that overlap go on together once they have met, and lead to the keys that each walk has by itself."""

import numpy as np

from streamatlas.llm import decontaminate

LENGTH = 160


class _Counted(np.ndarray):
    """Counts the characters that are read."""

    read = 0

    def take(self, indices, *args, **kwargs):
        _Counted.read += len(indices)
        return super().take(indices, *args, **kwargs)


def _text(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(5)).choice(np.frombuffer(b"abcdefghij klmn", np.uint8), n)


def test_walks_that_met_are_not_taken_twice():
    data, starts = _text(700), np.arange(500)
    plain = decontaminate.WALKS * len(starts) * LENGTH
    _Counted.read = 0
    decontaminate._Walks(LENGTH).keys(data.view(_Counted), starts)
    assert 0 < _Counted.read < plain / 2, (_Counted.read, plain)


def test_keys_are_those_of_each_walk_by_itself():
    data = _text(400)
    starts = np.array([0, 1, 2, 3, 7, 8, 60, 61, 62, 100, 200, 239, 240])
    want = np.zeros((decontaminate.WALKS, decontaminate.KEYS, len(starts)), np.uint64)
    for k in range(decontaminate.WALKS):
        walk = decontaminate._Walk(k, LENGTH)
        for w, at in enumerate(starts.tolist()):
            for t in range(walk.steps):
                for j in np.flatnonzero(walk.places == t):
                    want[k, walk.owner[j], w : w + 1] += np.array([data[at] + 1], np.uint64) * walk.factor[j]
                at += int(walk.moves[t, data[at]])
    got = decontaminate._Walks(LENGTH).keys(data, starts).reshape(want.shape)
    # a key has an offset of its own beside what was walked over
    assert (got - want == (got - want)[:, :, :1]).all()


def test_copies_and_neighbours_are_all_candidates():
    rng = np.random.Generator(np.random.PCG64(6))
    write = lambda n: rng.choice(np.frombuffer(b"abcdefghij klmn", np.uint8), n).tobytes()
    items = [(k, write(200)) for k in range(5)]
    texts = b"".join(write(90) + items[k][1] for k in (3, 0, 3, 1, 4, 3)) + write(50)
    data = np.frombuffer(texts, np.uint8)
    held = decontaminate._Items(items)
    found = held.candidates(data, decontaminate._hashes(data), np.full(len(data), len(data)))
    assert found == sorted(set(found))
    assert {(90 + 290 * i, k) for i, k in enumerate((3, 0, 3, 1, 4, 3))} <= set(found)
