"""Connected components against union-find, over graphs of several shapes."""

import random

import pytest

from gridloom.operators.graph import connected_components


def _union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


_rng = random.Random(5)
GRAPHS = {
    "chain": [(i, i + 1) for i in range(60)],
    "star, loops and repeats": [(7, i) for i in range(40)] * 2 + [(99, 99)],
    "random": [(_rng.randrange(200), _rng.randrange(200)) for _ in range(120)],
    "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    edges = spark.createDataFrame([*GRAPHS[name], (None, 3)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == _union_find(GRAPHS[name])
