"""Univariate profile (M21, A10, A11, P15): one long table, one row per column.

For each numeric column: statistics of its positive, non-null values (count,
mean, sample std, min, exact percentiles, max) and the missing count / rate
against all rows.  All columns go through one ``stack`` + grouped aggregate and
one exact-quantile computation that sorts no data, not one job per column.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import wide_quantiles
from tidemark.operators.selection import numeric_columns, to_long
from tidemark.plans.constants import PROFILE_PERCENTILES


def percentile_name(p: float) -> str:
    return f"p{int(round(p * 100)):02d}" if p < 1 else "p100"


def univariate_profile(df: DataFrame, columns: Sequence[str] | None = None,
                       exclude: Sequence[str] = (), percentiles: Sequence[float] = tuple(PROFILE_PERCENTILES),
                       positive_only: bool = True) -> DataFrame:
    cols = list(columns) if columns is not None else numeric_columns(df, exclude)
    cols = [c for c in cols if c not in set(exclude)]
    total = df.select(F.count(F.lit(1)).alias("_rows"))
    lg = to_long(df, cols)
    # NaN is a missing value here, although NaN > 0 holds in SQL
    keep = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") > 0 if positive_only else F.lit(True))
    lg = lg.where(keep)
    stats = lg.groupBy("feature").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    value = lambda c: F.col(c).cast("double")
    kept = {c: F.when(~F.isnan(value(c)) & ((value(c) > 0) if positive_only else F.lit(True)), value(c)) for c in cols}
    q = wide_quantiles(df, kept, list(percentiles))           # columns x percentiles numbers
    wide = df.sparkSession.createDataFrame(
        [(c, *q[c]) for c in cols], "feature string, " + ", ".join(f"{percentile_name(p)} double" for p in percentiles))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    n_rows = total.first()["_rows"]  # one number
    out = (names.join(stats, "feature", "left").join(wide, "feature", "left")
           .withColumn("count", F.coalesce(F.col("count"), F.lit(0)))
           .withColumn("missing_count", F.lit(n_rows) - F.col("count"))
           .withColumn("missing_rate",
                       F.lit(1.0) - F.col("count").cast("double") / F.lit(float(n_rows))
                       if n_rows else F.lit(None).cast("double")))
    return out.select("feature", "count", "mean", "std", "min",
                      *[percentile_name(p) for p in percentiles], "max",
                      "missing_count", "missing_rate")
