import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators.trailing import AnchorSpec, FactSpec, Feature, trailing_features

A = dt.datetime(2024, 3, 10, 9, 30)      # anchor with a time of day
M = dt.datetime(2024, 3, 10)             # anchor at midnight


def _facts(spark):
    rows = [
        (1, 1, dt.datetime(2024, 3, 2, 23, 0), 1),   # anchor - N - 1 day (N = 7): out for all windows
        (1, 2, dt.datetime(2024, 3, 3, 0, 0), 2),    # day anchor-7, midnight
        (1, 3, dt.datetime(2024, 3, 3, 10, 0), 4),   # day anchor-7, 10:00 (after 09:30)
        (1, 4, dt.datetime(2024, 3, 3, 9, 0), 8),    # day anchor-7, 09:00 (before 09:30)
        (1, 5, dt.datetime(2024, 3, 10, 0, 0), 16),  # anchor day, midnight
        (1, 6, dt.datetime(2024, 3, 10, 15, 0), 32), # anchor day, 15:00
        (1, 7, dt.datetime(2024, 3, 11, 0, 0), 64),  # anchor + 1 day
        (2, 8, dt.datetime(2024, 3, 9, 0, 0), 5),      # other entity
    ]
    return spark.createDataFrame(rows, "e long, fid long, ts timestamp_ntz, v long")


def _feats():
    out = []
    for rule in ("DD", "TT", "DT", "OPEN", "OPEN_TS"):
        days = None if rule.startswith("OPEN") else 7
        out += [Feature(f"sum_{rule}", "sum", "v", None, days, rule),
                Feature(f"cnt_{rule}", "count", "fid", None, days, rule)]
    return out


# Expected sums per rule for each anchor; values are powers of two, so the bits
# of a sum name the facts inside the window and their number is the count.
EXPECTED = {
    A: {"DD": 2 + 4 + 8 + 16 + 32, "TT": 4 + 16, "DT": 16 + 32,
        "OPEN": 1 + 2 + 4 + 8 + 16 + 32, "OPEN_TS": 1 + 2 + 4 + 8 + 16},
    M: {"DD": 2 + 4 + 8 + 16 + 32, "TT": 2 + 4 + 8 + 16, "DT": 2 + 4 + 8 + 16 + 32,
        "OPEN": 1 + 2 + 4 + 8 + 16 + 32, "OPEN_TS": 1 + 2 + 4 + 8 + 16},
}


@pytest.mark.parametrize("strategy", ["bucketed", "prefix", "direct"])
@pytest.mark.parametrize("anchor_ts", [A, M])
def test_window_edges(spark, strategy, anchor_ts):
    anchors = spark.createDataFrame([(1, anchor_ts, 10)], "e long, ts timestamp_ntz, k long")
    out = trailing_features(anchors, _facts(spark), AnchorSpec("e", "ts", ("k",)),
                            FactSpec("e", "ts"), _feats(), strategy=strategy).first()
    for rule, want in EXPECTED[anchor_ts].items():
        assert out[f"sum_{rule}"] == want, (rule, out[f"sum_{rule}"], want)
        assert out[f"cnt_{rule}"] == bin(want).count("1"), rule


@pytest.mark.parametrize("strategy", ["bucketed", "prefix", "direct"])
def test_empty_window_and_null_entity(spark, strategy):
    anchors = spark.createDataFrame([(3, M, 1), (None, M, 2)], "e long, ts timestamp_ntz, k long")
    feats = [Feature("s", "sum", "v", None, 7, "DD"), Feature("a", "avg", "v", None, 7, "DD"),
             Feature("c", "count", "fid", None, 7, "DD"), Feature("x", "exists", None, None, None, "OPEN")]
    rows = {r.k: r for r in trailing_features(anchors, _facts(spark), AnchorSpec("e", "ts", ("k",)),
                                              FactSpec("e", "ts"), feats, strategy=strategy).collect()}
    for k in (1, 2):   # no facts / NULL entity never matches (SQL equality)
        assert rows[k].s is None and rows[k].a is None and rows[k].c == 0 and rows[k].x == 0


def test_duplicate_anchors_deduped(spark):
    anchors = spark.createDataFrame([(1, M, 1), (1, M, 1)], "e long, ts timestamp_ntz, k long")
    out = trailing_features(anchors, _facts(spark), AnchorSpec("e", "ts", ("k",)),
                            FactSpec("e", "ts"), [Feature("s", "sum", "v", None, 7, "DD")]).collect()
    assert len(out) == 1 and out[0].s == EXPECTED[M]["DD"]


def test_filters_scale_and_avg(spark):
    anchors = spark.createDataFrame([(1, M, 1)], "e long, ts timestamp_ntz, k long")
    feats = [Feature("big", "sum", "v", F.col("v") >= 16, 7, "DD", scale=100),
             Feature("avg_big", "avg", "v", F.col("v") >= 16, 7, "DD", scale=100)]
    r = trailing_features(anchors, _facts(spark), AnchorSpec("e", "ts", ("k",)),
                          FactSpec("e", "ts"), feats).first()
    assert r.big == pytest.approx(0.48) and r.avg_big == pytest.approx(0.24)


def test_fused_equals_direct_on_fixture(spark):
    from tests.conftest import SF
    from tidemark.plans.feature_queries import trailing_fused
    a = trailing_fused(spark, SF, strategy="bucketed")
    b = trailing_fused(spark, SF, strategy="direct")
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hot_entity_matches_direct(spark):
    base = dt.datetime(2023, 1, 1)
    # entity 0 holds ~90% of facts and anchors (skew); others are light
    facts = [(0 if i % 10 else i % 7 + 1, i, base + dt.timedelta(hours=7 * i), i % 13)
             for i in range(3000)]
    anchors = [(0 if i % 10 else i % 7 + 1, base + dt.timedelta(days=3 * i, hours=5), i)
               for i in range(300)]
    fdf = spark.createDataFrame(facts, "e long, fid long, ts timestamp_ntz, v long")
    adf = spark.createDataFrame(anchors, "e long, ts timestamp_ntz, k long")
    spec = (AnchorSpec("e", "ts", ("k",)), FactSpec("e", "ts"), _feats())
    direct = sorted(map(tuple, trailing_features(adf, fdf, *spec, strategy="direct").collect()))
    for strategy in ("bucketed", "prefix"):
        assert sorted(map(tuple, trailing_features(adf, fdf, *spec, strategy=strategy).collect())) == direct
    # anchors without a time of day, said so: shorter plans, the same numbers
    days = adf.withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    direct = sorted(map(tuple, trailing_features(days, fdf, *spec, strategy="direct").collect()))
    whole = (AnchorSpec("e", "ts", ("k",), midnight=True), *spec[1:])
    for strategy in ("bucketed", "prefix"):
        assert sorted(map(tuple, trailing_features(days, fdf, *whole, strategy=strategy).collect())) == direct
        with pytest.raises(Exception, match="time of day"):
            trailing_features(adf, fdf, *whole, strategy=strategy).collect()


def test_hot_entity_day_stays_linear(spark):
    """10^4 facts and 10^3 anchors on one entity-day: no operator emits their pairs."""
    day = dt.datetime(2023, 5, 5)
    facts = spark.createDataFrame([(1, i, day + dt.timedelta(seconds=8 * i), i % 5) for i in range(10_000)],
                                  "e long, fid long, ts timestamp_ntz, v long")
    anchors = spark.createDataFrame(
        [(1, day + dt.timedelta(days=d, seconds=11 + 80 * i), i) for i in range(500) for d in (0, 1)],
        "e long, ts timestamp_ntz, k long")
    feats = [Feature("upto", "sum", "v", None, None, "OPEN_TS"), Feature("tt", "sum", "v", None, 1, "TT"),
             Feature("n", "count", "fid", None, 1, "TT")]
    spec = (AnchorSpec("e", "ts", ("k",)), FactSpec("e", "ts"), feats)
    direct = sorted(map(tuple, trailing_features(anchors, facts, *spec, strategy="direct").collect()))
    for strategy in ("bucketed", "prefix"):
        df = trailing_features(anchors, facts, *spec, strategy=strategy)
        assert sorted(map(tuple, df.collect())) == direct
        assert max(_output_rows(df)) <= 50_000


def test_prefix_cost_does_not_follow_the_window(spark):
    """A fact on each of 2,000 days, anchors on 200: no operator's rows grow with the window."""
    base = dt.datetime(2018, 1, 1)
    facts = spark.createDataFrame([(1, i, base + dt.timedelta(days=i), i) for i in range(2000)], "e long, fid long, ts timestamp_ntz, v long")
    anchors = spark.createDataFrame([(1, base + dt.timedelta(days=1500 + i), i) for i in range(200)], "e long, ts timestamp_ntz, k long")
    for days in (7, 1400):
        df = trailing_features(anchors, facts, AnchorSpec("e", "ts", ("k",), midnight=True), FactSpec("e", "ts"),
                               [Feature("s", "sum", "v", None, days, "DD")], strategy="prefix")
        assert {r.k: r.s for r in df.collect()} == {i: sum(range(1500 + i - days, 1500 + i + 1)) for i in range(200)}
        assert max(_output_rows(df)) <= 2400
    with pytest.raises(ValueError):
        trailing_features(anchors, facts, AnchorSpec("e", "ts", ("k",)), FactSpec("e", "ts"),
                          [Feature("s", "sum", F.col("v").cast("double"), None, 7, "DD")], strategy="prefix")


def test_facts_outside_open_windows_are_read_once(spark, tmp_path):
    """Two kinds of facts, one of them in open windows alone: the others are neither read nor moved again for these."""
    base = dt.datetime(2023, 1, 1)
    spark.createDataFrame([(i % 5, i, base + dt.timedelta(days=i % 400), i) for i in range(2000)],
                          "e long, fid long, ts timestamp_ntz, v long").write.parquet(f"{tmp_path}/moves")
    spark.createDataFrame([(i % 5, "F" if i % 3 else None, base + dt.timedelta(days=i % 900), i) for i in range(500)],
                          "e long, status string, ts timestamp_ntz, b long").write.parquet(f"{tmp_path}/states")
    facts = spark.read.parquet(f"{tmp_path}/moves").unionByName(spark.read.parquet(f"{tmp_path}/states"), allowMissingColumns=True)
    anchors = spark.createDataFrame([(i % 6, base + dt.timedelta(days=7 * i), i) for i in range(150)], "e long, ts timestamp_ntz, k long")
    feats = [Feature("s", "sum", "v", F.col("v") % 2 == 0, 30, "DD"), Feature("a", "avg", "v", None, 90, "TT"),
             Feature("o", "sum", "b", F.col("status") == "F", None, "OPEN"), Feature("x", "exists", None, F.col("status") == "F", None, "OPEN")]
    spec = (AnchorSpec("e", "ts", ("k",), unique=True, midnight=True), FactSpec("e", "ts"), feats)
    df = trailing_features(anchors, facts, *spec)
    direct = sorted(map(str, trailing_features(anchors, facts, *spec, strategy="direct").collect()))
    assert sorted(map(str, df.collect())) == direct
    assert len(re.findall(r"FileScan[^\n]*/moves", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])) == 1


@pytest.mark.parametrize("strategy", ["bucketed", "prefix", "direct"])
def test_rows_with_further_columns(spark, strategy):
    """Rows of a key that anchors share, and several rows of a key: each with the sums of all its anchors."""
    base = dt.datetime(2023, 1, 1)
    facts = spark.createDataFrame([(i % 4, i, base + dt.timedelta(days=i), 10 + i) for i in range(500)], "e long, fid long, ts timestamp_ntz, v long")
    keys = [(i % 5 if i % 7 else None, base + dt.timedelta(days=9 * i) if i % 11 else None, i) for i in range(60)]
    anchors = spark.createDataFrame(keys + keys[:10], "e long, ts timestamp_ntz, k long")
    rows = spark.createDataFrame([(*key, tag, 2 if key[2] < 10 else 1) for key in keys for tag in ("a", "b")],
                                 "e long, ts timestamp_ntz, k long, tag string, n long")
    feats = [Feature("s", "sum", "v", None, 30, "DD"), Feature("c", "count", "fid", None, 90, "TT"), Feature("a", "avg", "v", None, 90, "DT"),
             Feature("o", "sum", "v", F.col("v") % 3 == 0, None, "OPEN"), Feature("x", "exists", None, None, None, "OPEN")]
    spec = (AnchorSpec("e", "ts", ("k",), unique=True, midnight=True), FactSpec("e", "ts"), feats)
    want = {r.k: (r.s, r.c, r.a, r.o, r.x) for r in trailing_features(anchors, facts, *spec, strategy="direct").collect()}
    got = trailing_features(anchors, facts, *spec, strategy=strategy, rows=rows, times="n")
    assert got.columns == ["e", "ts", "k", "tag", "n", "s", "c", "a", "o", "x"]
    assert sorted((r.k, r.tag) for r in got.collect()) == sorted((i, tag) for i in range(60) for tag in ("a", "b"))
    for r in got.collect():
        assert (r.s, r.c, r.a, r.o, r.x) == want[r.k], r.k


def _output_rows(df):
    """'number of output rows' of every operator of the executed plan."""
    out = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        m = node.metrics().get("numOutputRows")
        if m.isDefined():
            out.append(m.get().value())
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))
    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return out or [0]
