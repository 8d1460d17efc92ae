"""Delimited-file scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str,
             timestamp_columns: tuple[str, ...] = (),
             timestamp_format: str | None = None) -> DataFrame:
    """CSV with a header and an explicit schema (no inference pass over the data).

    Columns listed in ``timestamp_columns`` may be declared as strings and are
    parsed with ``to_timestamp_ntz`` (the ``pd.to_datetime`` step)."""
    df = (spark.read.option("header", "true").option("mode", "FAILFAST")
          .schema(schema).csv(path))
    for c in timestamp_columns:
        parsed = (F.to_timestamp_ntz(F.col(c), F.lit(timestamp_format)) if timestamp_format
                  else F.to_timestamp_ntz(F.col(c)))
        df = df.withColumn(c, parsed)
    return df
