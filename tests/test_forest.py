"""Forests grown side by side against a plain recursion on the same draws."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forest as fo
from tidemark.operators.selection import shadow_selection


def _frame(spark, n=500, classes=2, seed=0, keys=None):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    y = np.clip(np.floor((a + rng.normal(0, 0.7, n)) * classes / 4 + classes / 2), 0, classes - 1)
    pdf = pd.DataFrame({"a": a, "b": rng.integers(0, 4, n).astype(float), "c": np.where(rng.random(n) < 0.2, np.nan, rng.random(n)), "y": y})
    rows = [(int(i) if keys is None else keys, *map(float, r)) for i, r in enumerate(pdf.to_numpy())]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(3)


def _gini(y, w, classes):
    p = np.array([w[y == k].sum() for k in range(classes)]) / max(w.sum(), 1)
    return 1 - (p ** 2).sum()


def _plain(x, y, w, tried, depth, classes, d=0, node=0):
    """(class of a leaf or None, {feature: decrease x rows}) of a subtree."""
    leaf = int(np.argmax([w[y == k].sum() for k in range(classes)]))
    best = (1e-15, None)
    if d < depth:
        for f in tried[d][node]:
            for cut in range(fo.BINS):
                go = x[f] <= cut
                a, b = w[go].sum(), w[~go].sum()
                if a and b:
                    gain = _gini(y, w, classes) - (a * _gini(y[go], w[go], classes) + b * _gini(y[~go], w[~go], classes)) / w.sum()
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, go))
    if best[1] is None:
        return leaf, {}
    f, go = best[1]
    (la, ia), (lb, ib) = (_plain(x[:, s], y[s], w[s], tried, depth, classes, d + 1, 2 * node + i) for i, s in enumerate((go, ~go)))
    if la is not None and la == lb:
        return la, {}
    out = {f: best[0] * w.sum()}
    for more in (ia, ib):
        for k, v in more.items():
            out[k] = out.get(k, 0) + v
    return None, out


@pytest.mark.parametrize("classes", [2, 3])
def test_importances_match_a_plain_recursion(spark, classes):
    blocks = fo.pack(_frame(spark, 500, classes), ["a", "b", "c"], "y", "id", block_rows=200)
    forests = [fo.Forest(0, (0, 1, 2), 2), fo.Forest(1, (0, 2), 3)]
    trees, depth, seed = 4, 3, 5
    got = fo.importances(blocks, forests, seed, trees, depth)
    packed = blocks.frame.collect()
    assert sum(r["n"] for r in packed) == 500 and len(packed) == 3 and blocks.classes == classes
    for forest, imp in zip(forests, got):
        parts = []
        for r in packed:
            y = np.frombuffer(r["y"], np.uint8)
            parts.append((y, *fo.drawn(y, np.frombuffer(r["x"], np.uint8).reshape(3, -1), forest, seed, r["block"], trees)))
        y, x, w = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1), np.concatenate(
            [p[2] for p in parts], axis=1).astype(float)
        choice, want = fo.subsets(forest, seed, trees, depth), np.zeros(forest.width)
        for t in range(trees):
            use = w[t] > 0
            one = _plain(x[:, use], y[use], w[t][use], [c[t] for c in choice], depth, classes)[1]
            for f, v in one.items():
                want[f] += v / sum(one.values())
        assert imp == pytest.approx(want, abs=1e-9) and imp.argmax() == 0


def test_forests_do_not_depend_on_partitions(spark):
    df = _frame(spark)
    one, two = (fo.pack(d, ["a", "b", "c"], "y", "id", block_rows=100) for d in (df, df.repartition(7)))
    f = [fo.Forest(3, (0, 1, 2), 2)]
    assert (fo.importances(one, f, 1, 5, 3)[0] == fo.importances(two, f, 1, 5, 3)[0]).all()


def test_rows_of_one_key_do_not_fill_one_block(spark):
    """NULL keys and a key that all rows share: the blocks stay small."""
    for key in (None, 7):
        packed = fo.pack(_frame(spark, 2000, keys=key), ["a", "b", "c"], "y", "id", block_rows=100).frame.collect()
        assert sum(r["n"] for r in packed) == 2000 and max(r["n"] for r in packed) < 200


def test_jobs_do_not_grow_with_the_rounds(spark):
    """All rounds up to a test grow in the same passes."""
    df, tracker = _frame(spark, 300).cache(), spark.sparkContext.statusTracker()

    def jobs(rounds):
        before = max(tracker.getJobIdsForGroup(None))
        shadow_selection(df, ["a", "b", "c"], "y", "id", num_trees=3, max_depth=2, max_rounds=rounds).collect()
        return max(tracker.getJobIdsForGroup(None)) - before

    jobs(1)
    assert jobs(6) <= jobs(1) + 2


@pytest.mark.parametrize("classes", [1, 2, 3, 8])
def test_masks_count_what_lookups_count(classes):
    """A level counted by masks, with nodes that were not split, against the counts row by row."""
    rng = np.random.default_rng(classes)
    wide, y, copies = rng.integers(0, fo.BINS, (9, 700)).astype(np.uint8), rng.integers(0, classes, 700).astype(np.uint8), rng.poisson(1, 700)
    for depth in range(5):
        levels = [(rng.integers(-1, 9, 1 << d), rng.integers(4, 26, 1 << d)) for d in range(depth)]
        for above, below in zip(levels, levels[1:]):
            below[0][np.repeat(above[0] < 0, 2)] = -1
        tried, weight = np.array([rng.permutation(9)[:4] for _ in range(1 << depth)]), copies.astype(np.uint8)
        want = fo.histogram((wide.astype(np.int64) * classes + y).reshape(-1), wide, weight, levels, tried, classes)
        got = fo.masked_histogram(list(wide * np.uint8(classes) + y), list(wide), weight, levels, tried, classes)
        assert (want is None) == (got is None) and (want is None or (want == got).all())


def test_copies_follow_the_table():
    copies = fo.drawn(np.zeros(999, np.uint8), np.zeros((1, 999), np.uint8), fo.Forest(1, (0,), 2), 4, 2, 30)[1]
    rng = np.random.Generator(np.random.PCG64([4, 1, 2]))
    for _ in range(2):
        rng.permuted(np.zeros((1, 999), np.uint8), axis=1)
    assert (copies == fo._COPIES[rng.integers(0, 1 << 16, (30, 999), np.uint16)]).all()


def test_folds_are_packed_in_the_same_passes(spark):
    """Blocks of several folds, also of other sizes, are those of each fold alone; the jobs do not grow with the folds."""
    df, tracker = _frame(spark, 900).withColumn("m", F.pmod(F.col("id"), F.lit(7))).cache(), spark.sparkContext.statusTracker()
    df.count()
    folds = [F.col("m") != 1, F.col("m") != 2, F.col("m") == 3, F.when(F.col("m") < 4, True)]

    def packed(b):
        return sorted((r["block"], r["n"], bytes(r["y"]), bytes(r["x"])) for r in b.frame.collect())

    for cond, b in zip(folds, fo.pack_folds(df, ["a", "b", "c"], "y", "id", folds, block_rows=100)):
        alone = fo.pack(df.where(cond), ["a", "b", "c"], "y", "id", block_rows=100)
        assert packed(b) == packed(alone) and (b.rows, b.classes, b.cuts) == (alone.rows, alone.classes, alone.cuts)

    def jobs(conditions):
        before = max(tracker.getJobIdsForGroup(None))
        fo.pack_folds(df, ["a", "b", "c"], "y", "id", conditions, block_rows=1000)
        return max(tracker.getJobIdsForGroup(None)) - before

    jobs(folds[:1])
    assert jobs(folds[:2] * 3) <= jobs(folds[:1]) + 1


def test_cut_points(spark):
    rng = np.random.default_rng(2)
    many = np.concatenate([rng.normal(size=3000), [math.inf, -math.inf, -0.0, math.nan]])
    few = np.where(np.isnan(many), math.nan, rng.integers(0, 31, len(many)).astype(float))
    df = spark.createDataFrame([(float(a), float(b), math.nan) for a, b in zip(many, few)], "a double, b double, c double").repartition(3)
    a, b, c = fo.cut_points(df, ["a", "b", "c"])
    assert b == tuple(map(float, range(30))) and c == () and len(a) == 30
    share = [(many <= v).mean() for v in a]
    assert share == pytest.approx(np.arange(1, 31) / 31, abs=2e-3)


def test_labels_that_are_no_classes(spark):
    with pytest.raises(ValueError):
        fo.pack(spark.createDataFrame([(1, 0.5, 0.5)], "id int, a double, y double"), ["a"], "y", "id")
