"""Importance and attribution of boosted symmetric trees.

``tree_shap`` gives exact path-dependent Shapley values in log-odds.  The value of a set S of
features for a row is the expectation of the tree where levels of S follow the row and every
other level is averaged by the training rows on its two sides.  In a symmetric tree this
depends on the row's leaf alone, so a tree turns into a table (leaf, feature) by going
through the subsets of its at most ``depth`` features once; a row adds up the entries of its
leaves.  No sampling, no background rows: attributions and the mean of the model add up to the
row's log-odds.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.boosting import Boosted, ByCell, Tree, features_array, leaves, to_matrix


def _cover_tensors(tree: Tree) -> list[np.ndarray]:
    """Per level, the share of its rows on either side: axis k is level k's side."""
    d = len(tree.features)
    cover = tree.covers.reshape((2,) * d).transpose(range(d)[::-1]) if d else tree.covers
    shares = []
    for level in range(d):
        rows = cover.sum(axis=tuple(range(level + 1, d)))
        whole = rows.sum(axis=level, keepdims=True)
        shares.append(np.where(whole > 0, rows / np.where(whole > 0, whole, 1), 0.5))
    return shares


def _expectation(tree: Tree, shares: list[np.ndarray], known: set[int]) -> np.ndarray:
    """Expected value by the sides of the known features; averaged axes have length 1."""
    d = len(tree.features)
    t = tree.values.reshape((2,) * d).transpose(range(d)[::-1])
    for level in range(d - 1, -1, -1):
        if tree.features[level] not in known:
            share = shares[level].reshape(shares[level].shape + (1,) * (d - level - 1))
            t = (t * share).sum(axis=level, keepdims=True)
    return t


def shap_table(tree: Tree, k: int) -> tuple[np.ndarray, float]:
    """((leaves, k) attributions, expectation) of one tree."""
    d = len(tree.features)
    out = np.zeros((1 << d, k))
    if not d:
        return out, float(tree.values[0])
    shares, present = _cover_tensors(tree), sorted(set(tree.features))
    value = {}
    for size in range(len(present) + 1):
        for s in itertools.combinations(present, size):
            value[frozenset(s)] = _expectation(tree, shares, set(s))
    n = len(present)
    for f in present:
        phi = np.zeros((2,) * d)
        for s, v in value.items():
            if f not in s:
                weight = math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n)
                phi += weight * (value[s | {f}] - v)
        out[:, f] = phi.transpose(range(d)[::-1]).reshape(-1)
    return out, float(value[frozenset()].ravel()[0])


def expected_raw(model: Boosted) -> float:
    """Mean log-odds of the model over its training rows, as the trees' covers tell it."""
    return float(sum(_expectation(t, _cover_tensors(t), set()).ravel()[0] if t.features else t.values[0] for t in model.trees))


def tree_shap(model: Boosted, rows: DataFrame, key: str) -> DataFrame:
    """(key, feature, value, phi) of every row and feature of the model, in log-odds.

    The phi of a row and ``expected_raw`` add up to the row's log-odds.  One Arrow function over
    the rows, no shuffle; NULL values go with the lowest bin and come back as NULL."""
    k, names = len(model.features), list(model.features)
    if not k:
        return rows.select(key, F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("value"),
                           F.lit(None).cast("double").alias("phi")).where("false")
    tables = [shap_table(t, k)[0] for t in model.trees]

    def phis(x: np.ndarray) -> np.ndarray:
        phi = np.zeros((len(x), k))
        for t, table in zip(model.trees, tables):
            phi += table[leaves(x, t.features, t.cuts, range(k))]
        return phi

    by_cell = ByCell(model.edges, k, phis)

    @F.arrow_udf("array<double>")
    def attribute(values: pa.Array) -> pa.Array:
        x = model.bins(to_matrix(values, k))
        phi = by_cell(x)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, k), pa.int32()), pa.array(phi.ravel()))

    d = rows.select(F.col(key).alias("_key"), F.array(*[F.col(c).cast("double") for c in names]).alias("_v"),
                    attribute(features_array(names)).alias("_phi"))
    long = d.select("_key", F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("feature"),
                                                   F.col("_v").alias("value"), F.col("_phi").alias("phi"))).alias("s"))
    return long.select(F.col("_key").alias(key), "s.feature", "s.value", "s.phi")


def attribution_summary(phi: DataFrame) -> DataFrame:
    """Mean |phi| per feature (the bar-summary table)."""
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"), F.count(F.lit(1)).alias("rows"))


def importances(model: Boosted) -> list[float]:
    """Per feature, how much the prediction changes when a split of it changes side: over all
    trees, levels and pairs of leaves on its two sides, the squared distances of the two values
    from their mean, each weighted by its training rows; in per cent of the whole."""
    out = np.zeros(len(model.features))
    for t in model.trees:
        leaf = np.arange(len(t.values))
        for level, f in enumerate(t.features):
            a = leaf[(leaf >> level) & 1 == 0]
            b = a | (1 << level)
            n = t.covers[a] + t.covers[b]
            mean = np.divide(t.values[a] * t.covers[a] + t.values[b] * t.covers[b], n, out=np.zeros(len(a)), where=n > 0)
            out[f] += ((t.values[a] - mean) ** 2 * t.covers[a] + (t.values[b] - mean) ** 2 * t.covers[b]).sum()
    return (out / out.sum() * 100 if out.sum() > 0 else out).tolist()


def feature_importance(model: Boosted, spark) -> DataFrame:
    """(feature, importance, rank) sorted by importance (M15).  k rows."""
    df = spark.createDataFrame(list(zip(model.features, importances(model))), "feature string, importance double")
    return df.withColumn("rank", F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy(F.col("importance").desc(), F.col("feature"))))
