import math

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.profile import univariate_profile
from tidemark.operators.ranking import dense_codes, exact_quantiles, global_cumsum
from tidemark.operators.selection import (correlated_to_drop, correlation_matrix,
                                          information_value)


def _ref_iv(x, y, bins=10):
    if pd.api.types.is_numeric_dtype(x):
        x = pd.qcut(x, bins, duplicates="drop")
    t = pd.DataFrame({"x": x, "y": y}).dropna().groupby("x", observed=False)["y"].agg(["count", "sum"])
    t["ne"] = t["count"] - t["sum"]
    with np.errstate(all="ignore"):
        er, ner = t["sum"] / t["sum"].sum(), t["ne"] / t["ne"].sum()
        return float(((er - ner) * np.log(er / ner)).sum())


def test_iv_matches_reference_rules(spark):
    rng = np.random.default_rng(7)
    n = 400
    y = rng.integers(0, 2, n)
    pdf = pd.DataFrame({
        "y": y,
        "signal": y * 2.0 + rng.normal(0, 1, n),
        "zeros": np.where(rng.random(n) < 0.8, 0.0, rng.random(n)),
        "const": np.full(n, 3.0),
        "two": rng.integers(0, 2, n).astype(float),
        "txt": np.where(y == 1, "a", "b"),
    })
    pdf.loc[::17, "signal"] = np.nan
    got = {r.feature: r.iv for r in information_value(
        spark.createDataFrame(pdf), "y", ["signal", "zeros", "const", "two", "txt"]).collect()}
    for f in ["signal", "zeros", "const", "two"]:
        assert got[f] == pytest.approx(_ref_iv(pdf[f], pdf["y"]), rel=1e-9, abs=1e-12), f
    assert got["const"] == 0.0
    assert got["txt"] == math.inf          # a bin with no non-events -> +inf


def test_correlation_rule(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=300)
    pdf = pd.DataFrame({"a": a, "b": a * 0.9 + rng.normal(0, 0.2, 300),
                        "neg": -a + rng.normal(0, 0.2, 300), "c": np.ones(300),
                        "d": rng.normal(size=300)})
    feats = list(pdf.columns)
    m = correlation_matrix(spark.createDataFrame(pdf), feats)
    ref = pdf.corr().to_numpy()
    for i in range(len(feats)):
        for j in range(i + 1, len(feats)):     # the rule reads the upper triangle only
            if math.isnan(ref[i][j]):
                assert math.isnan(m[i][j])
            else:
                assert m[i][j] == pytest.approx(ref[i][j], abs=1e-9)
    assert correlated_to_drop(feats, m, 0.7) == ["b"]      # signed rule: 'neg' kept, constant kept


def test_cumsum_quantiles_codes(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "v": rng.integers(0, 50, 500).astype(float)})
    qs = exact_quantiles(spark.createDataFrame(pdf), "v", [0.0, 0.1, 0.5, 0.77, 1.0], ["g"]).collect()
    for r in qs:
        assert r.q == pytest.approx(np.quantile(pdf[pdf.g == r.g].v, r.p), abs=1e-12)
    d = pdf.drop_duplicates().assign(one=1)
    c = global_cumsum(spark.createDataFrame(d), ["v"], ["one"], ["g"]).toPandas()
    for g, part in c.groupby("g"):
        assert sorted(part.cum_one) == list(range(1, len(part) + 1))
    codes = {r.v: r.code for r in dense_codes(spark.createDataFrame(pdf), "v", "code").collect()}
    assert [codes[v] for v in sorted(codes)] == list(range(len(codes)))


def test_profile_counts(spark):
    pdf = pd.DataFrame({"a": [0.0, 1.0, 2.0, None, 4.0], "b": [-1.0, -2.0, 0.0, 0.0, 0.0]})
    prof = {r.feature: r for r in univariate_profile(spark.createDataFrame(pdf), ["a", "b"]).collect()}
    assert prof["a"]["count"] == 3 and prof["a"].missing_count == 2
    assert prof["a"].p50 == 2.0 and prof["a"].p100 == 4.0 and prof["a"]["min"] == 1.0
    assert prof["b"]["count"] == 0 and prof["b"].missing_rate == 1.0


def test_wide_quantiles_match_numpy(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.ranking import wide_quantiles
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": rng.normal(size=5000), "b": rng.integers(0, 4, 5000).astype(float),
                        "c": np.where(rng.random(5000) < 0.97, np.nan, rng.random(5000)), "d": np.full(5000, np.nan)})
    df = spark.createDataFrame(pdf).repartition(5)
    probs = [0.0, 0.01, 0.1, 0.5, 0.77, 0.99, 1.0]
    got = wide_quantiles(df, {c: F.when(~F.isnan(c), F.col(c)) for c in pdf.columns}, probs, accuracy=100)
    for c in "abc":
        assert got[c] == pytest.approx(np.nanquantile(pdf[c], probs), abs=1e-12)
    assert got["d"] == [None] * len(probs)


def test_profile_ignores_nan(spark):
    x = [float("nan"), 1.0, 2.0, 4.0, None, -1.0]
    r = univariate_profile(spark.createDataFrame([(v,) for v in x], "a double"), ["a"]).first()
    ref = pd.Series([1.0, 2.0, 4.0]).describe()
    assert r["count"] == ref["count"] == 3 and r.missing_count == 3
    assert r["min"] == 1.0 and r.p50 == ref["50%"] and r.max == 4.0 and r["std"] == pytest.approx(ref["std"])


def test_equal_width_edges_match_cut():
    from tidemark.operators.binning import equal_width_edges
    for x in ([0.0, 10.0, 3.0], [-5.0, 5.0, 1.0], [2.0, 2.0, 2.0]):
        _, ref = pd.cut(pd.Series(x), 4, retbins=True)
        assert equal_width_edges(min(x), max(x), 4) == pytest.approx(list(ref))


def test_cumsum_with_a_null_group(spark):
    rows = [(None if i % 2 else "a", i, 1) for i in range(400)]
    c = global_cumsum(spark.createDataFrame(rows, "g string, v int, one int"), ["v"], ["one"], ["g"], num_partitions=7)
    for g in (None, "a"):
        assert [r.cum_one for r in sorted((r for r in c.collect() if r.g == g), key=lambda r: r.v)] == list(range(1, 201))


def test_quantiles_and_bins_move_no_long_rows(spark):
    """Columns of few and many values and NULLs; what the quantiles count and what the bins group are counts of a task,
    not a row per value."""
    from pyspark.sql import functions as F

    from tidemark.operators.ranking import wide_quantiles
    rng = np.random.default_rng(9)
    n = 6000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 3, n) - 1.0, "c": np.where(rng.random(n) < 0.9, 0.0, rng.random(n)),
                        "d": np.where(rng.random(n) < 0.3, -0.0, rng.normal(size=n).round(1)), "y": rng.integers(0, 2, n)})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf).repartition(4).cache()
    probs = [i / 10 for i in range(11)]
    got = wide_quantiles(df, {c: F.when(~F.isnan(c), F.col(c)) for c in "abcd"}, probs, accuracy=50)
    for c in "abcd":
        assert got[c] == pytest.approx(np.nanquantile(pdf[c], probs), abs=1e-12)
    iv = information_value(df, "y", list("abcd"))
    assert {r.feature: r.iv for r in iv.collect()} == pytest.approx({c: _ref_iv(pdf[c], pdf["y"]) for c in "abcd"}, rel=1e-9)
    assert "Generate" not in iv._jdf.queryExecution().optimizedPlan().toString()
