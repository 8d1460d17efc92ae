"""Table scans and column hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Full scan of a named table: a catalog table if ``root`` is empty, else
    ``{root}/{name}.parquet``.  Catalyst prunes columns and pushes filters into
    the scan, so callers select/filter afterwards instead of reading narrow copies."""
    if not root:
        return spark.table(name)
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case every column name (a metadata-only projection)."""
    return df.toDF(*[c.lower() for c in df.columns])


def copy_column(df: DataFrame, source: str, target: str) -> DataFrame:
    """Duplicate a column under a new name."""
    return df.withColumn(target, F.col(source))


def keep_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep a column list, in the given order."""
    return df.select(*columns)
