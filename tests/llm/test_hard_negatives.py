import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.hard_negatives import bit_planes, hard_negatives, intervals, one_bit_codes, rotate, rotate_back

SCHEMA = "vec_id long, embedding array<double>, label int, rid string, score string"


def plain(rows, every, k=5, m=5, share=(80, 100)):
    ok = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows
          if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, l in ok:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, lab) for j, w, lab in ok if len(w) == len(v)]
        scored = sorted(s for s in scored if -2**63 <= -s[0] < 2**63)
        pos = [s for s in scored if s[2] == l and s[1] != i][:k]
        for p in pos:
            neg = [s for s in scored if s[2] != l and share[0] * -p[0] <= 100 * -s[0] <= share[1] * -p[0]][:m]
            out += [(i, p[1], r + 1, s[1], -p[0], -s[0]) for r, s in enumerate(neg)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def random_rows(rng, n, d, labels=4):
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, 0.7) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]


def run(spark, rows, every, **kw):
    return sorted(map(tuple, hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0, **kw).collect()))


def test_equals_brute_force(spark):
    rng = random.Random(5)
    for d in (16, 70):
        rows = random_rows(rng, 300, d)
        want = plain(rows, 10)
        assert len(want) > 50
        assert run(spark, rows, 10, anchor_block=7, row_block=64) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [1.0, 1.9], 2), (4, [1.0, 1.9], 2), (5, [1.0, 2.0], 2),
            (6, None, 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [1.0, inf], 2), (11, [1.0, 2.0], None), (None, [1.0, 2.0], 1),
            (20, [], 1), (21, [], 1), (22, [], 2), (30, [0.0, 0.0], 3), (31, [0.0, 0.0], 3), (12, [1.0, 2.0, 3.0], 1),
            (40, [1.0, -2.0, 3.0], 1), (41, [-1.0, 2.0, -3.0], 1), (3, [1.0, 1.9], 2), (10, [3.0, -1.0], 2), (5, [0.3, 1.2], 1),
            (50, [1e12, 3.0, 1e-9, 4.0], 1), (51, [1e3, 1.0, 7.0, 1.0], 1), (52, [9e2, 1.0, 7.0, 1.0], 2), (53, [1e300, 1.0, 0.0, 1.0], 1)]
    assert run(spark, rows, 10) == plain(rows, 10)
    assert run(spark, rows, 10, positives=1, negatives=2, row_block=3, anchor_block=2) == plain(rows, 10, 1, 2)
    assert run(spark, [], 10) == [] and run(spark, rows, 1000003) == plain(rows, 1000003)


def test_copies_and_ties(spark):
    rng = random.Random(8)
    rows = random_rows(rng, 40, 8) + [(100 + i, [0.5] * 8, i % 3) for i in range(200)]
    assert run(spark, rows, 20, row_block=50) == plain(rows, 20)


def test_repeated_anchor_rows(spark):
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [1.0, 0.8], 2)]
    assert run(spark, rows, 10) == plain(rows, 10)


def test_intervals_hold_and_are_narrow():
    rng = np.random.default_rng(3)
    x, y = np.floor(256 * rng.normal(size=(500, 64))), np.floor(256 * rng.normal(size=(20, 64)))
    assert np.allclose(rotate(x, 1) @ rotate(y, 1).T, x @ y.T) and np.allclose(rotate_back(rotate(x, 1), 1), x)
    lengths = np.linalg.norm(y, axis=1)
    low, high = intervals(one_bit_codes(x, 6, 1), bit_planes(y, 6, 1), lengths, 64)
    true = y @ x.T
    assert (low <= true).all() and (true <= high).all()
    assert ((high - low) / 2 / (lengths[:, None] * np.linalg.norm(x, axis=1)[None, :])).mean() < 0.08
