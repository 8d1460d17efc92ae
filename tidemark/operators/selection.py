"""Feature selection: information value, correlation pruning, shadow selection (M1-M4, M6).

All features are handled in one pass: a task counts its rows per (feature, bin),
strings in long form (feature, value, label) with ``stack``, and every statistic is a
grouped aggregate over ``feature``; only k x k correlation numbers and per-feature IVs
(bounded by the schema width) ever reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.binning import equal_width_edges, quantile_probs
from tidemark.operators.forest import Blocks, Forest, importances, pack
from tidemark.operators.ranking import wide_quantiles

_INF = float("inf")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns in schema order (``select_dtypes([float, int])``, P18)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def to_long(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (),
            value_type: str = "double") -> DataFrame:
    """(keep..., feature, value) via ``stack``: one row per (input row, feature)."""
    if not features:
        raise ValueError("no features")
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS {value_type})" for c in features)
    return df.select(*keep, F.expr(f"stack({len(features)}, {pairs}) AS (feature, value)"))


def information_value(df: DataFrame, label: str, features: Sequence[str] | None = None,
                      bins: int = 10) -> DataFrame:
    """(feature, iv) with weight of evidence over quantile bins, no smoothing.

    Numeric features are binned on exact quantiles (``wide_quantiles``); string features use their
    values as bins.  Rows with a NULL or NaN feature value or a NULL label are skipped for that
    feature; a feature without two distinct quantiles gets bins of equal width.  A bin without events or without non-events makes IV +inf; a label
    with only one class gives IV 0."""
    if features is None:
        features = [c for c in df.columns if c != label]
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in features if isinstance(types[c], T.NumericType)]
    text = [c for c in features if c not in set(numeric)]
    y = F.col(label).cast("double")
    parts = []
    if numeric:
        # per feature at most bins + 1 edges: bounded by the schema width
        kept = {c: F.when(y.isNotNull() & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numeric}
        quantiles = wide_quantiles(df, kept, quantile_probs(bins))
        edges = {c: sorted(set(q)) for c, q in quantiles.items() if q and q[0] is not None}
        # quantiles that leave no bin (one distinct value): bins of equal width around it
        edges = {c: e if len(e) > 1 else equal_width_edges(e[0], e[0], bins) for c, e in edges.items()}
        wide = df.where(y.isNotNull()).select(y.alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(numeric)])
        parts.append(wide.mapInArrow(_bin_counts(numeric, [edges.get(c, []) for c in numeric]), "feature string, bin string, cnt long, ev double"))
    if text:
        lt = to_long(df.withColumn("_y", y), text, ["_y"], "string").where(
            F.col("value").isNotNull() & F.col("_y").isNotNull())
        parts.append(lt.groupBy("feature", F.col("value").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"), F.sum("_y").alias("ev")))
    # features whose rows all dropped out still get a row (IV 0)
    names = df.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    per_bin = u.groupBy("feature", "bin").agg(F.sum("cnt").alias("cnt"), F.sum("ev").alias("ev"))
    per_bin = per_bin.withColumn("ne", F.col("cnt") - F.col("ev"))
    tot = per_bin.groupBy("feature").agg(F.sum("ev").alias("ev_total"),
                                         F.sum("ne").alias("ne_total"))
    j = per_bin.join(tot, "feature")
    er, ner = F.col("ev") / F.col("ev_total"), F.col("ne") / F.col("ne_total")
    iv_bin = (F.when((F.col("ev_total") == 0) | (F.col("ne_total") == 0), F.lit(None).cast("double"))
              .when((F.col("ev") == 0) | (F.col("ne") == 0), F.lit(_INF))
              .otherwise((er - ner) * F.ln(er / ner)))
    iv = j.groupBy("feature").agg(F.sum(iv_bin).alias("iv"))
    return (names.join(iv, "feature", "left")
            .select("feature", F.coalesce(F.col("iv"), F.lit(0.0)).alias("iv")))


def _bin_counts(names: Sequence[str], edges: Sequence[Sequence[float]]) -> Callable:
    """(feature, bin, cnt, ev) of a task's rows (label, values...): ``binning.bin_index``'s bins, counted column by column."""
    points = [np.asarray(e, float) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnt, ev = [np.zeros(len(e), np.int64) for e in points], [np.zeros(len(e)) for e in points]
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            for i, e in enumerate(points):
                if len(e) < 2:
                    continue
                x = b.column(1 + i).to_numpy(zero_copy_only=False)
                use = (x >= e[0]) & (x <= e[-1])                              # neither NULL nor NaN
                at = np.maximum(np.searchsorted(e, x[use], side="left"), 1)
                cnt[i] += np.bincount(at, minlength=len(e))
                ev[i] += np.bincount(at, weights=y[use], minlength=len(e))
        some = [(names[i], str(k), cnt[i][k], ev[i][k]) for i in range(len(names)) for k in np.flatnonzero(cnt[i])]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (
                pa.string(), pa.string(), pa.int64(), pa.float64()))], names=["feature", "bin", "cnt", "ev"])

    return run


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """k x k Pearson matrix from ONE distributed pass (Spark ML ``Correlation``, centred
    covariance).  Only the k x k numbers come back (bounded by the schema width);
    zero-variance columns give NaN.  Rows with a NULL feature must be filled first."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    va = VectorAssembler(inputCols=list(features), outputCol="_fv", handleInvalid="error")
    vec = va.transform(df.select(*[F.col(c).cast("double").alias(c) for c in features]))
    m = Correlation.corr(vec.select("_fv"), "_fv", "pearson").head()[0]
    return m.toArray().tolist()


def correlation_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature_i, feature_j, corr) for every pair i < j in the given order."""
    m = correlation_matrix(df, features)
    k = len(features)
    rows = [(features[i], features[j], float(m[i][j])) for i in range(k) for j in range(i + 1, k)]
    return df.sparkSession.createDataFrame(
        rows, "feature_i string, feature_j string, corr double")


def correlated_to_drop(features: Sequence[str], matrix: list[list[float]],
                       threshold: float) -> list[str]:
    """Column j is dropped when corr(i, j) > threshold for some earlier i (signed; i
    itself may have been dropped; NaN never exceeds)."""
    drop = set()
    for j in range(len(features)):
        for i in range(j):
            v = matrix[i][j]
            if not math.isnan(v) and v > threshold:
                drop.add(features[j])
    return [c for c in features if c in drop]


def binomial_tail(hits: int, n: int, p: float = 0.5) -> float:
    """P(X >= hits) for X ~ Binomial(n, p)."""
    return float(sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(hits, n + 1)))


def rounds_needed(k: int, alpha: float = 0.05) -> int:
    """Rounds after which winning or losing every one of them is below alpha / k: the first
    number at which any of k features can be decided."""
    return max(1, math.floor(math.log2(max(k, 1) / alpha)) + 1)


def decide(hits: int, rounds: int, level: float) -> str:
    """accepted or rejected where the binomial tail of the hits (or of the misses) is below the
    level, else tentative."""
    if binomial_tail(hits, rounds) < level:
        return "accepted"
    return "rejected" if binomial_tail(rounds - hits, rounds) < level else "tentative"


def shadow_selection(df: DataFrame, features: Sequence[str], label: str, key: str, seed: int = 0, num_trees: int = 50,
                     max_depth: int = 5, alpha: float = 0.05, max_rounds: int = 100, batch: int = 4,
                     parallelism: int = 4, block_rows: int = 8192) -> DataFrame:
    """All-relevant selection against permuted "shadow" copies, one after the other (M6).

    A round grows a random forest on the features still in play and their shadows (at least five)
    and counts a hit for every feature more important than the best shadow.  Features are
    tested on both sides, P(X >= hits) and P(X <= hits) for Binomial(rounds, 1/2) against
    alpha / k: accepted ones stay in the forest as company, rejected ones leave
    with their shadows, the others are tentative and go on, until none is left or
    ``max_rounds`` are over.  The first test comes after as many rounds as can decide
    anything, later ones every ``batch`` rounds.

    Rows lie in blocks by a hash of the row; a shadow is permuted inside its block, so a
    round moves no row, and all rounds up to the next test grow in the same passes (``forest``).  Rows with a NULL label are left out, NULL features count as NaN.
    Returns (feature, hits, rounds, p_value, state, accepted); ``p_value`` is that of
    P(X >= hits), ``rounds`` those in which the feature was tested."""
    schema = "feature string, hits int, rounds int, p_value double, state string, accepted boolean"
    feats = list(features)
    if not feats:
        return df.sparkSession.createDataFrame([], schema)
    rows = selected(pack(df, feats, label, key, block_rows), feats, seed, num_trees, max_depth, alpha, max_rounds, batch, parallelism)
    return df.sparkSession.createDataFrame(rows, schema)


def selected(blocks: Blocks, feats: Sequence[str], seed: int = 0, num_trees: int = 50, max_depth: int = 5, alpha: float = 0.05,
             max_rounds: int = 100, batch: int = 4, parallelism: int = 4) -> list[tuple]:
    """The rows of ``shadow_selection`` from packed rows, one a feature."""
    k = len(feats)
    hits, rounds, state = [0] * k, [0] * k, ["tentative"] * k
    done, step = 0, min(rounds_needed(k, alpha), max_rounds)
    while blocks.rows and done < max_rounds and "tentative" in state:
        active = tuple(i for i in range(k) if state[i] != "rejected")
        open_ = [i for i in active if state[i] == "tentative"]
        forests = [Forest(turn, active, -(-5 // len(active))) for turn in range(done, done + step)]
        for imp in importances(blocks, forests, seed, num_trees, max_depth, parallelism):
            best = imp[len(active):].max()
            for i, v in zip(active, imp):
                hits[i] += int(i in open_ and v > best)
        done += step
        for i in open_:
            rounds[i] = done
            state[i] = decide(hits[i], done, alpha / k)
        step = min(batch, max_rounds - done)
    return [(f, hits[i], rounds[i], binomial_tail(hits[i], rounds[i]), state[i], state[i] == "accepted")
            for i, f in enumerate(feats)]
