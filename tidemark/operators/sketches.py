"""Mergeable column statistics (A10, M3, M21 for a growing table).

Every part of a table (a day, a batch) is read once and leaves one small row per column: rows,
kept values, mean, sum of squared distances, extremes and a KLL quantile sketch.  Such
rows merge: the profile and the bin edges of the whole table come from them without a
look at old parts.  Counts, mean, deviation and extremes are those of the exact
profile; quantiles are within ``rank_error(k)`` of their rank (``wide_quantiles`` stays the exact way).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.profile import percentile_name
from tidemark.operators.selection import to_long


def rank_error(k: int) -> float:
    """Normalised rank error of a KLL sketch of size k that 99 % of queries keep."""
    return 2.296 / k ** 0.9021


def part_statistics(df: DataFrame, columns: Sequence[str], part: Column | None = None, k: int = 800,
                    positive_only: bool = True) -> DataFrame:
    """(part, feature, rows, count, mean, m2, min, max, sketch): one row per part and column.

    ``part``: the part a row belongs to, NULL being one (default: one part).  NULL and NaN values,
    and with ``positive_only`` those not above 0, count as missing; a column of missing
    values only has count 0 and a NULL sketch."""
    marked = df.select((part if part is not None else F.lit("all")).cast("string").alias("part"), *columns)
    long = to_long(marked, list(columns), ["part"])
    keep = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") > 0 if positive_only else F.lit(True))
    x = F.when(keep, F.col("value"))
    got = long.groupBy("part", "feature").agg(
        F.count(F.lit(1)).alias("rows"), F.count(x).alias("count"), F.avg(x).alias("mean"),
        (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"))
    return got.withColumn("sketch", F.when(F.col("count") > 0, F.col("sketch")))


def merge_statistics(parts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The rows of many parts as one per (groups, feature), of the same columns without ``part``."""
    by = [*groups, "feature"]
    n, mean = F.sum("count"), F.sum(F.col("count") * F.col("mean")) / F.sum("count")
    shift = F.sum(F.col("count") * F.col("mean") * F.col("mean")) - n * mean * mean
    return parts.groupBy(*by).agg(
        F.sum("rows").alias("rows"), n.alias("count"), F.when(n > 0, mean).alias("mean"),
        F.when(n > 0, F.sum("m2") + F.greatest(shift, F.lit(0.0))).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch").alias("sketch")).withColumn("sketch", F.when(F.col("count") > 0, F.col("sketch")))


def sketch_quantiles(merged: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``merged`` with ``q`` in place of the sketch: a value per probability, NULL without values.  The
    extremes are exact."""
    def at(p: float) -> Column:
        if p <= 0 or p >= 1:
            return F.col("min" if p <= 0 else "max")
        return F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))))
    return merged.withColumn("q", F.array(*[at(p) for p in probs])).drop("sketch")


def sketch_edges(merged: DataFrame, bins: int = 10) -> dict[str, list[float]]:
    """Bin edges per feature from the merged rows: quantiles at multiples of 1 / bins, duplicates
    merged.  Columns x (bins + 1) numbers."""
    rows = sketch_quantiles(merged, [i / bins for i in range(bins + 1)]).select("feature", "q").collect()
    return {r["feature"]: sorted({v for v in r["q"] if v is not None}) for r in rows}


def merged_profile(merged: DataFrame, percentiles: Sequence[float]) -> DataFrame:
    """The columns of ``univariate_profile`` from merged rows; inner percentiles are the sketch's."""
    q = sketch_quantiles(merged, percentiles)
    n = F.col("count")
    return q.select(
        "feature", "count", "mean", F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("std"), "min",
        *[F.get("q", F.lit(i)).alias(percentile_name(p)) for i, p in enumerate(percentiles)], "max",
        (F.col("rows") - n).alias("missing_count"), (F.lit(1.0) - n.cast("double") / F.col("rows")).alias("missing_rate"))
