"""Outputs per segment on a small frame and a grid of one point."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.plans import constants as K
from tidemark.plans import ml_queries as M


def test_every_output_of_the_reference_per_segment(spark):
    rng = np.random.default_rng(5)
    n = 500
    x1, x2, x3 = rng.normal(size=(3, n))
    seg = np.where(np.arange(n) % 2, "small", "large")
    y = ((np.where(seg == "small", x1, x2) + rng.normal(0, 0.4, n)) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x1": x1, "x2": x2, "x3": x3, "y": y, "segment": seg}))
    grid = {"iterations": [4], "learning_rate": [0.3], "depth": [2], "l2_leaf_reg": [1]}
    st = M.segment_studies(df, ["x1", "x2", "x3"], "y", "id", grid)

    top = {"small": "x1", "large": "x2"}
    rows = {r["segment"]: r for r in M.segment_summary(spark, st, "id").collect()}
    imp = M.segment_importances(spark, st).toPandas()
    phi = M.segment_phi(spark, st, "id").toPandas()
    for name in ("small", "large"):
        r, mine = rows[name], phi[phi.segment == name]
        assert r["rows"] == 250 and r["top_feature"] == top[name] and 0 < r["test_ks"] <= 1 and 0 < r["train_ks"] <= 1
        assert set(imp[imp.segment == name].feature) == set(st[name].features) == set(mine.feature)
        assert mine.id.nunique() == st[name].rows.where("part = 'test'").count()
        assert abs(mine[mine.feature == top[name]].phi.abs().mean() - r["top_mean_abs_phi"]) < 1e-9

    ks = M.segment_ks(st, "id").groupBy("segment", "part").agg(F.sum("pop").alias("n")).toPandas()
    assert {(a, b): int(c) for a, b, c in ks.itertuples(index=False)} == {
        (s, p): st[s].rows.where("true" if p == "all" else f"part = '{p}'").count()
        for s in top for p in ("train", "test", "all")}
    cuts = M.segment_cuts(st, "id").toPandas()
    assert len(cuts) == n
    for s, name in ((K.CUTS_SMALL_PAYMENT, "small"), (K.CUTS_LARGE_PAYMENT, "large")):
        mine = cuts[cuts.segment == name]
        assert [K.DECILE_LABELS[int(np.searchsorted(s, v, side="left"))] for v in mine.score] == mine.decile.tolist()
