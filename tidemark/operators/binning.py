"""Quantile binning (M3): ``qcut(x, q, duplicates='drop')`` semantics.

Edges are the exact linear-interpolation quantiles at 0, 1/q, ..., 1 of the
non-null values, duplicates merged.  Bins are right-closed with the lowest edge
included: bin = max(1, #edges < x); a feature with a single distinct value has
no bins (every row falls out), as in the pandas reference behaviour.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import exact_quantiles


def quantile_probs(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def quantile_edges(df: DataFrame, value: str, bins: int = 10,
                   groups: Sequence[str] = ()) -> DataFrame:
    """(groups, edges array<double>) with duplicate edges merged."""
    probs = quantile_probs(bins)
    q = exact_quantiles(df, value, probs, groups)
    # at most bins+1 values per group: collecting them per group is bounded.
    return q.groupBy(*groups).agg(
        F.array_sort(F.array_distinct(F.collect_list("q"))).alias("edges"))


def bin_index(df: DataFrame, x: str, edges: Sequence[float], out: str) -> DataFrame:
    """Add ``out`` = 1-based right-closed bin of ``x`` for sorted ``edges``, as many as there
    are; NULL when out of range."""
    return df.withColumn(out, bin_of_literals(F.col(x).cast("double"), list(edges)))


def equal_width_edges(lo: float, hi: float, bins: int) -> list[float]:
    """Edges of ``bins`` equal-width bins over [lo, hi], the lowest widened by 0.1 % of the
    range so that the minimum falls in (the fallback where quantile bins fail)."""
    if lo == hi:
        pad = 0.001 * abs(lo) if lo else 0.001
        lo, hi = lo - pad, hi + pad
        return [lo + (hi - lo) * i / bins for i in range(bins + 1)]
    edges = [lo + (hi - lo) * i / bins for i in range(bins)] + [hi]
    edges[0] -= 0.001 * (hi - lo)
    return edges


def bin_of_literals(x: Column, edges: list[float]) -> Column:
    """Same rule as ``bin_index`` for edges known on the driver: a CASE chain of
    literal comparisons (small generated code, no array access per row)."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    out = F.when(x.isNull() | F.isnan(x) | (x < F.lit(edges[0])) | (x > F.lit(edges[-1])), F.lit(None).cast("int"))
    for b in range(1, len(edges)):
        out = out.when(x <= F.lit(edges[b]), F.lit(b))
    return out
