import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.evaluate import ks_statistic, ks_table, roc_auc


def _brute(y, s):
    pos, neg = s[y == 1], s[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    auc = gt / (len(pos) * len(neg))
    ks = max([((s >= t) & (y == 1)).sum() / len(pos) - ((s >= t) & (y == 0)).sum() / len(neg)
              for t in np.unique(s)] + [0.0])
    return auc, ks


def test_auc_ks_vs_brute_force(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 600)
    s = np.round(rng.random(600) * 0.5 + y * 0.3, 2)        # many ties
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    auc, ks = _brute(y, s)
    assert roc_auc(df, "y", "s").first().auc == pytest.approx(auc, abs=1e-12)
    assert ks_statistic(df, "y", "s").first().ks == pytest.approx(ks, abs=1e-12)
    flipped = roc_auc(df.withColumn("s", -F.col("s")), "y", "s").first().auc
    assert flipped == pytest.approx(1 - auc, abs=1e-12)


def test_ks_table_properties(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 1000)
    p = rng.random(1000)
    t = ks_table(spark.createDataFrame(pd.DataFrame({"y": y, "p": p})), "y", "p").toPandas()
    t = t.sort_values("decile")
    assert list(t.decile) == list(range(1, 11))
    assert t["pop"].sum() == 1000 and t.events.sum() == y.sum()
    assert t.cum_eventrate.iloc[-1] == pytest.approx(1.0) and t.cum_noneventrate.iloc[-1] == pytest.approx(1.0)
    assert (t.min_prob.diff().dropna() < 0).all()            # highest scores first
    _, ks = _brute(y, p)
    assert t.ks.max() / 100 <= ks + 1e-3
