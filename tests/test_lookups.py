import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.asof import asof_latest, first_rows, latest_per_key, not_in, top_ties
from tidemark.operators.sessions import next_event_time


def test_not_in_null_semantics(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "x long")
    with_null = spark.createDataFrame([(1,), (None,)], "y long")
    no_null = spark.createDataFrame([(1,)], "y long")
    empty = spark.createDataFrame([], "y long")
    assert not_in(left, "x", with_null, "y").count() == 0
    assert sorted(r.x for r in not_in(left, "x", no_null, "y").collect()) == [2]
    assert not_in(left, "x", empty, "y").count() == 3


def test_top_ties_keeps_ties_and_nulls_first(spark):
    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(1, "a", d), (1, "b", d), (1, "c", dt.date(2023, 1, 1)),
                                (2, "d", None), (2, "e", d)], "k long, v string, t date")
    got = sorted((r.k, r.v) for r in top_ties(df, ["k"], "t").collect())
    assert got == [(1, "a"), (1, "b"), (2, "d")]


def test_latest_per_key_and_first_rows(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (2, 1, "z"), (2, 1, "w")],
                               "k long, t long, v string")
    assert {(r.k, r.v) for r in latest_per_key(df, ["k"], ["t"]).collect()} == {(1, "y"), (2, "z")}
    assert sorted(r.v for r in first_rows(df, ["k"], "t").where("k = 2").collect()) == ["w", "z"]


def test_asof_before_on_after(spark):
    left = spark.createDataFrame([(1, dt.date(2024, 1, 10)), (2, dt.date(2024, 1, 10)),
                                  (3, dt.date(2024, 1, 10))], "k long, d date")
    right = spark.createDataFrame([
        (1, dt.datetime(2024, 1, 5), 100.0), (1, dt.datetime(2024, 1, 9), 200.0),
        (1, dt.datetime(2024, 1, 11), 300.0),                 # after: ignored
        (2, dt.datetime(2024, 1, 10, 18), 400.0),             # same day, later time: counts (date grain)
        (3, dt.datetime(2023, 1, 1), 500.0),                  # far earlier bucket
    ], "k long, ts timestamp_ntz, v double")
    got = {r.k: r.v for r in asof_latest(left, right, "k", "k", "d", "ts", ["v"], bucket_days=30).collect()}
    assert got == {1: 200.0, 2: 400.0, 3: 500.0}
    ts_left = spark.createDataFrame([(2, dt.datetime(2024, 1, 10, 12))], "k long, d timestamp_ntz")
    got = asof_latest(ts_left, right, "k", "k", "d", "ts", ["v"], grain="timestamp").first()
    assert got.v is None


def test_next_event_time(spark):
    t = dt.datetime(2024, 1, 1, 10)
    df = spark.createDataFrame([("u1", t), ("u2", t), ("u2", t + dt.timedelta(days=3)),
                                ("u3", t), ("u3", t)], "u string, ts timestamp_ntz")
    rows = next_event_time(df, "u", "ts", "nxt").collect()
    by = {}
    for r in rows:
        by.setdefault(r.u, []).append((r.ts, r.nxt))
    assert by["u1"] == [(t, None)]
    assert sorted(by["u2"], key=lambda x: x[0]) == [(t, t + dt.timedelta(days=3)),
                                                    (t + dt.timedelta(days=3), None)]
    assert sorted(x[1] is None for x in by["u3"]) == [False, True]   # equal timestamps


def test_asof_keeps_repeated_left_rows_and_null_payloads(spark):
    import datetime as dt
    d = dt.date(2023, 1, 10)
    left = spark.createDataFrame([("a", d, 1), ("a", d, 1), ("a", d, 2), ("b", d, 3), (None, d, 4)], "k string, d date, n int")
    right = spark.createDataFrame([("a", dt.datetime(2023, 1, 9), None), ("a", dt.datetime(2023, 1, 1), 5)],
                                  "k string, ts timestamp_ntz, v int")
    got = sorted((r.k or "", r.n, r.v, r.found) for r in asof_latest(left, right, "k", "k", "d", "ts", ["v"], flag="found").collect())
    assert got == [("", 4, None, False), ("a", 1, None, True), ("a", 1, None, True), ("a", 2, None, True), ("b", 3, None, False)]


def test_asof_timestamp_grain_and_ties(spark):
    import datetime as dt
    t = dt.datetime(2023, 1, 10, 12)
    left = spark.createDataFrame([("a", t - dt.timedelta(hours=h), h) for h in (0, 1, 5, 30)], "k string, t timestamp_ntz, h int")
    right = spark.createDataFrame([("a", t, 1), ("a", t, 7), ("a", t - dt.timedelta(hours=3), 2), ("a", t - dt.timedelta(days=200), 3)],
                                  "k string, ts timestamp_ntz, v int")
    got = {r.h: r.v for r in asof_latest(left, right, "k", "k", "t", "ts", ["v"], grain="timestamp").collect()}
    assert got == {0: 7, 1: 2, 5: 3, 30: 3}          # equal times: the larger payload
