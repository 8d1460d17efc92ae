import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators.profile import percentile_name, univariate_profile
from tidemark.operators.sketches import (merge_statistics, merged_profile, part_statistics, rank_error, sketch_edges,
                                         sketch_quantiles)

PROBS = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def _frame(spark, n=20_000):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"id": np.arange(n), "normal": rng.normal(size=n), "skewed": rng.lognormal(0, 3, n), "few": rng.integers(0, 4, n).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("none", F.lit(None).cast("double"))
    return df.withColumn("skewed", F.when(F.col("id") % 10 != 0, F.col("skewed"))).withColumn(
        "normal", F.when(F.col("id") == 3, F.lit(float("nan"))).otherwise(F.col("normal"))), pdf


def test_merged_quantiles_keep_the_rank_error(spark):
    df, pdf = _frame(spark)
    parts = part_statistics(df, ["normal", "skewed", "few", "none"], F.col("id") % 7, positive_only=False)
    assert parts.count() == 28
    merged = merge_statistics(parts)
    for r in sketch_quantiles(merged, PROBS).collect():
        if r.feature == "none":
            assert r["count"] == 0 and r.q == [None] * len(PROBS) and r.rows == 20_000
            continue
        x = pdf[r.feature].to_numpy()
        x = np.sort(x[(pdf.id % 10 != 0) if r.feature == "skewed" else (pdf.id != 3) if r.feature == "normal" else slice(None)])
        assert r["count"] == len(x)
        for p, q in zip(PROBS, r.q):
            low, high = np.searchsorted(x, q, "left") / len(x), np.searchsorted(x, q, "right") / len(x)
            assert low - 2 * rank_error(800) <= p <= high + 2 * rank_error(800), (r.feature, p, q)


def test_exact_columns_equal_the_profile(spark):
    df, _ = _frame(spark, 3000)
    cols = ["normal", "skewed", "few", "none"]
    got = {r.feature: r for r in merged_profile(merge_statistics(part_statistics(df, cols, F.col("id") % 3)), [0.5]).collect()}
    for r in univariate_profile(df, cols, percentiles=[0.5]).collect():
        g = got[r.feature]
        assert (g["count"], g["min"], g["max"], g.missing_count) == (r["count"], r["min"], r["max"], r.missing_count)
        for c in ("mean", "std", "missing_rate"):
            assert (g[c] is None and r[c] is None) or abs(g[c] - r[c]) <= 1e-9 * max(1, abs(r[c])), c
        assert percentile_name(0.5) in g.asDict()


def test_parts_may_come_in_any_order_and_number(spark):
    df, _ = _frame(spark, 2000)
    whole = merge_statistics(part_statistics(df, ["few"], positive_only=False))
    parts = merge_statistics(part_statistics(df, ["few"], F.col("id"), positive_only=False))
    assert sketch_edges(whole, 3) == sketch_edges(parts, 3) == {"few": [0.0, 1.0, 2.0, 3.0]}
    assert merge_statistics(part_statistics(df.where("false"), ["few"])).count() == 0
