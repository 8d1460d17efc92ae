import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir
from tidemark.sources import append_once, append_table, read_committed, write_attempt


@pytest.fixture
def path(spark):
    return f"{checkpoint_dir(spark)}/test-sinks/{uuid.uuid4().hex}"


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_batches_count_once(spark, path):
    a, b = spark.range(5), spark.range(5, 8)
    assert append_once(a, path, "a") and append_once(b, path, "b")
    assert not append_once(a, path, "a")                       # a re-run adds nothing
    assert _ids(read_committed(spark, path)) == list(range(8))
    assert {r["_run"] for r in read_committed(spark, path, with_run=True).collect()} == {"a", "b"}


def test_nothing_of_a_failed_writer_is_seen(spark, path):
    append_once(spark.range(3), path, "first")
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 90, F.col("id")).otherwise(
        F.raise_error(F.lit("lost")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        append_once(bad, path, "second")
    write_attempt(spark.range(50, 60), path, "second", "lost-before-commit")
    assert _ids(read_committed(spark, path)) == [0, 1, 2]
    assert append_once(spark.range(10, 13), path, "second")     # the run may be written again
    assert _ids(read_committed(spark, path)) == [0, 1, 2, 10, 11, 12]


def test_two_writers_of_one_run(spark, path):
    """Both got through to the commit: one of them counts, whole."""
    for attempt in ("x", "y"):
        write_attempt(spark.range(4), path, "r", attempt)
        spark.createDataFrame([("r", attempt)], "_run string, _attempt string").write.mode("append").parquet(f"{path}/commits")
    assert _ids(read_committed(spark, path)) == [0, 1, 2, 3]


def test_run_ids_are_text_and_reserved_names(spark, path):
    assert append_once(spark.range(1), path, "001") and append_once(spark.range(1, 2), path, "1")
    assert _ids(read_committed(spark, path)) == [0, 1]
    with pytest.raises(ValueError):
        append_once(spark.range(1).withColumn("_run", F.lit(1)), path, "2")


def test_plain_append_repeats(spark, path):
    append_table(spark.range(2), path)
    append_table(spark.range(2), path)
    assert _ids(spark.read.parquet(path)) == [0, 0, 1, 1]


def test_stored_feature_table_is_built_once_and_joined_in_place(spark):
    from tests.conftest import SF
    from tidemark.plans.model_queries import feature_table_cut, feature_table_df, stored_table
    t = feature_table_cut(spark, SF)
    assert t.exceptAll(feature_table_df(spark, SF).select(t.columns)).count() == 0
    again = stored_table(spark, SF, "features", "o_orderkey", lambda: pytest.fail("built twice"))
    other = spark.range(2000).withColumnRenamed("id", "o_orderkey").hint("merge")
    plan = again.select("o_orderkey", "y").join(other, "o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1      # the other side only
    assert "ReadSchema: struct<o_orderkey:bigint,y:int>" in plan
