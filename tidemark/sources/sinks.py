"""Table sinks.

``append_table`` keeps the append behaviour (every run adds rows).
``overwrite_partitions`` is the idempotent variant: a re-run replaces only the
partitions it writes, so repeated runs do not inflate later counts.
``append_once`` adds every batch exactly once: rows carry the batch's run id and the id of
the attempt that wrote them, and count only when the table of commits names that attempt.
Types are kept; nothing is stringified on the way out.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("append").format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    (df.write.mode("overwrite").format("parquet").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).save(path))


_RUN, _ATTEMPT = "_run", "_attempt"


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """(_run, _attempt): the attempt that counts for every committed run.  Of two writers of one run
    that both got through, the smaller attempt id counts, so its rows are there once."""
    try:
        commits = spark.read.parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], f"{_RUN} string, {_ATTEMPT} string")
    return commits.groupBy(_RUN).agg(F.min(_ATTEMPT).alias(_ATTEMPT))


def append_once(df: DataFrame, path: str, run_id: str) -> bool:
    """Append a batch under its run id; False, and nothing written, if that run is committed already.

    The rows are written first and one small commit file last.  A writer that fails on the way, or
    whose driver is lost between the two, leaves files that no reader sees; the same run may
    be written again.  Batches of other runs stay, whatever the order."""
    spark = df.sparkSession
    if committed_runs(spark, path).where(F.col(_RUN) == run_id).limit(1).count():
        return False
    attempt = uuid.uuid4().hex
    write_attempt(df, path, run_id, attempt)
    spark.createDataFrame([(run_id, attempt)], f"{_RUN} string, {_ATTEMPT} string").coalesce(1).write.mode(
        "append").parquet(f"{path}/commits")
    return True


def write_attempt(df: DataFrame, path: str, run_id: str, attempt: str) -> None:
    """The rows of a batch, without the commit."""
    for c in (_RUN, _ATTEMPT):
        if c in df.columns:
            raise ValueError(f"the column name {c} is taken")
    df.withColumn(_RUN, F.lit(run_id)).withColumn(_ATTEMPT, F.lit(attempt)).write.mode("append").parquet(f"{path}/rows")


def read_committed(spark: SparkSession, path: str, with_run: bool = False) -> DataFrame:
    """The rows of all committed runs (``with_run``: with ``_run``); an error before the first commit."""
    rows = spark.read.parquet(f"{path}/rows")
    out = rows.join(committed_runs(spark, path), [_RUN, _ATTEMPT], "left_semi")
    return out.drop(_ATTEMPT) if with_run else out.drop(_RUN, _ATTEMPT)
