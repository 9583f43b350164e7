"""Hard negatives against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.llm import pivot_negatives

ROWS = "vec_id long, embedding array<double>, label int, row string, score int, block int"


def _brute(rows, anchor, k=5, n=10):
    fine = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (i, v, lab) in enumerate(fine):
        if not anchor(i):
            continue
        scored = sorted((-dot(v, w), j, m == lab) for b, (j, w, m) in enumerate(fine) if b != a)
        for p, j, _ in [x for x in scored if x[2]][:k]:
            found = [x for x in scored if not x[2] and 30 * -p <= 100 * -x[0] <= 90 * -p][:n]
            out += [(i, j, rank, m, -p, -s) for rank, (s, m, _) in enumerate(found, 1)]
    return sorted(out)


def _table(spark, rows):
    return spark.createDataFrame([(*r, "r", 1, 2) for r in rows], ROWS)


def _mine(spark, rows, step):
    found = pivot_negatives.mine(_table(spark, rows), F.col("vec_id") % step == 0)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    out = [(k, [x / 2 + r.gauss(0, 0.4) for x in centres[r.randrange(4)]], r.randrange(4)) for k in range(900)]
    out += [(1000 + k, [0.5] * 6, k % 2) for k in range(60)]  # ties
    out += [(7, out[7][1], 1), (20, out[20][1], out[20][2]), (20, out[20][1], out[20][2])]  # repeated ids and rows
    out += [(1200, None, 1), (1220, [1.0, None] * 3, 1), (1240, [math.nan] * 6, 1), (1260, [math.inf] * 6, 1), (1280, [0.1] * 6, None), (None, [0.2] * 6, 1), (1300, [], 1), (1320, [1.0, 2.0], 2), (1340, [0.0] * 6, 3)]
    return out


def test_against_brute_force(spark, rows):
    assert _mine(spark, rows, 20) == _brute(rows, lambda i: i % 20 == 0)


def test_several_blocks_of_anchors(spark, rows, monkeypatch):
    monkeypatch.setattr(pivot_negatives, "BLOCK_BYTES", 8 * 40 * 30)
    assert _mine(spark, rows, 10) == _brute(rows, lambda i: i % 10 == 0)


def test_large_numbers_are_exact(spark):
    r = random.Random(2)
    rows = [(k, [r.randrange(-(2**20), 2**20) / 2**2 for _ in range(3)], k % 3) for k in range(300)]
    assert _mine(spark, rows, 10) == _brute(rows, lambda i: i % 10 == 0)


def test_equal_vectors_and_none(spark):
    rows = [(k, [0.25, -0.5], k % 2) for k in range(400)]
    assert _mine(spark, rows, 100) == _brute(rows, lambda i: i % 100 == 0)
    near = [(k, [0.5] if k % 2 else [1.0], k % 2) for k in range(300)]
    assert _mine(spark, near, 100) == _brute(near, lambda i: i % 100 == 0) != []
    assert _mine(spark, [], 100) == []
    assert _mine(spark, [(1, [1.0], 0)], 100) == []  # no anchor
    assert _mine(spark, [(0, [1.0], 0)], 100) == []  # no other row
