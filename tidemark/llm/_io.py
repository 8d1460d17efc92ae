"""Reading the given tables, and the size of Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Smaller Arrow batches for whole texts, unless the session has a size of its own.

    Spark's 10,000 rows are tens of MB of text, held several times over by the JVM's
    off-heap buffers and by Python.  The setting touches batch sizes only, never results."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(rows))
