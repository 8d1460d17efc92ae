import math

from pyspark.sql import functions as F

from tidemark.functions import (contains_flags, finite_or_zero, ilike_any, ilike_none,
                                json_fields, ratio, select_first)
from tidemark.operators.evaluate import cut_labels


def test_ratio_float_semantics(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (None, 2.0), (-3.0, 0.0), (6.0, 3.0)],
                               "n double, d double")
    got = [r.r for r in df.select(ratio("n", "d").alias("r")).collect()]
    assert got[0] == math.inf and math.isnan(got[1]) and got[2] is None
    assert got[3] == -math.inf and got[4] == 2.0
    z = [r.z for r in df.select(finite_or_zero(ratio("n", "d")).alias("z")).collect()]
    assert z == [0.0, 0.0, 0.0, 0.0, 2.0]


def test_patterns(spark):
    df = spark.createDataFrame([("new-device seen",), ("NEW_DEVICE",), (None,), ("Blue Ring",)], "t string")
    flags = [r[0] for r in df.select(*contains_flags("t", {"f": "new_device"})).collect()]
    assert flags == [1, 1, 0, 0]        # '_' is a one-character wildcard; NULL -> 0
    inc = df.where(ilike_any("t", ["%ring%"]) & ilike_none("t", ["%blue%"])).count()
    assert inc == 0
    assert df.where(ilike_none("t", ["%x%"])).count() == 3   # NULL text fails the filter


def test_cut_labels_edges(spark):
    cuts = [0.1, 0.2]
    df = spark.createDataFrame([(0.1,), (0.15,), (0.2,), (0.25,), (None,), (0.05,)], "p double")
    closed = [r[0] for r in df.select(cut_labels("p", cuts, ["lo", "mid", "hi"])).collect()]
    assert closed == ["lo", "mid", "mid", "hi", None, "lo"]
    opened = [r[0] for r in df.select(cut_labels("p", cuts, ["lo", "mid", "hi"], first_open=True)).collect()]
    assert opened == ["mid", "mid", "mid", "hi", None, "lo"]


def test_select_first_and_json(spark):
    df = spark.createDataFrame([('{"a": {"b": "1.5"}, "c": 2}',), ("not json",)], "j string")
    out = json_fields(df, "j", {"ab": ("a.b", "double"), "c": ("c", "string"), "z": ("a.z", "string")})
    r = out.collect()
    assert r[0].ab == 1.5 and r[0].c == "2" and r[0].z is None
    assert r[1].ab is None
    s = df.select(select_first([F.lit(False), F.lit(True)], ["x", "y"], "d").alias("s")).first().s
    assert s == "y"


def test_replace_value(spark):
    from tidemark.functions import replace_value
    df = spark.createDataFrame([("0", 0), ("x", 5)], "s string, n long")
    assert [r.s for r in replace_value(df, "s", 0, 100).collect()] == ["0", "x"]   # text: no-op
    assert [r.n for r in replace_value(df, "n", 0, 100).collect()] == [100, 5]
