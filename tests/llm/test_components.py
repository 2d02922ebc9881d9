"""Connected components against a union of sets."""

import random

from streamatlas.llm.components import connected_components


def _least(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root) if find(x) != x}


def test_connected_components(spark):
    rng = random.Random(5)
    path = [(k, k + 1) for k in range(1000, 1040)]
    rng.shuffle(path)
    star = [(5, k) for k in range(100, 160)] + [(k, 5) for k in range(150, 170)]
    mesh = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(90)]
    for edges in (path, star, path + star + mesh + path[:5] + [(7, 7)], []):
        found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(found) == len({r.doc_id for r in found})
        assert {r.doc_id: r.component for r in found} == _least(edges)
