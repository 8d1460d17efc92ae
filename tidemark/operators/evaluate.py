"""Score evaluation: ROC AUC, KS, decile tables, fixed cut-off labels.

Scores are first reduced to distinct values with positive/negative counts
(partial aggregation), then ranked with ``global_cumsum`` (range-partitioned
prefix sums): no global window, no collect of row-level data.  AUC uses the
tie-aware rank-sum form, KS the maximum of TPR - FPR over distinct thresholds
(what the ROC curve's vertices give).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import select_first
from tidemark.operators.binning import bin_index, quantile_edges
from tidemark.operators.ranking import global_cumsum


def roc_auc(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row (per group): auc, positives, negatives."""
    return _auc(_grouped_distribution(df, label, score, groups), groups)


def auc_of_counts(counts: DataFrame, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """``roc_auc`` of rows counted already: (groups, score, pos, neg), scores may repeat."""
    d = counts.groupBy(*groups, F.col(score).cast("double").alias("score")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return _auc(global_cumsum(d, ["score"], ["pos", "neg"], groups), groups)


def _auc(sd: DataFrame, groups: Sequence[str]) -> DataFrame:
    contrib = F.col("pos").cast("double") * (
        (F.col("cum_neg") - F.col("neg")).cast("double") + F.col("neg").cast("double") / 2)
    agg = sd.groupBy(*groups).agg(F.sum(contrib).alias("_s"), F.sum("pos").alias("positives"),
                                  F.sum("neg").alias("negatives"))
    return agg.select(*groups, (F.col("_s") / (F.col("positives").cast("double")
                                               * F.col("negatives").cast("double"))).alias("auc"),
                      "positives", "negatives")


def ks_statistic(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row (per group): ks = max over thresholds t of TPR(score >= t) - FPR(score >= t)."""
    sd = _grouped_distribution(df, label, score, groups)
    if groups:
        tot = sd.groupBy(*groups).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
        j = sd.join(tot, list(groups))
    else:  # two scalar subqueries, evaluated once
        j = sd.withColumn("P", sd.select(F.sum("pos")).scalar()).withColumn(
            "N", sd.select(F.sum("neg")).scalar())
    tpr = (F.col("P") - (F.col("cum_pos") - F.col("pos"))).cast("double") / F.col("P")
    fpr = (F.col("N") - (F.col("cum_neg") - F.col("neg"))).cast("double") / F.col("N")
    return j.groupBy(*groups).agg(F.greatest(F.max(tpr - fpr), F.lit(0.0)).alias("ks"))


def _grouped_distribution(df, label, score, groups):
    y = F.col(label).cast("long")
    d = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
         .groupBy(*groups, F.col(score).cast("double").alias("score"))
         .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")))
    return global_cumsum(d, ["score"], ["pos", "neg"], groups)


def ks_table(df: DataFrame, label: str, score: str, bins: int = 10, groups: Sequence[str] = ()) -> DataFrame:
    """Decile table on score quantiles, highest scores first (M13), one per group.

    Columns: groups, decile, min_prob, max_prob, events, nonevents, pop, event_rate,
    nonevent_rate, cum_eventrate, cum_noneventrate, ks (half-even rounded to 3
    places, x100), cure_rate.  Tied quantile edges are merged (fewer rows)."""
    by = list(groups)
    base = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *by, F.col(score).cast("double").alias("p"), F.col(label).cast("double").alias("y"))
    edges = quantile_edges(base, "p", bins, by)
    if by:                                                    # bins + 1 numbers a group
        b = base.join(edges, by).withColumn("bucket", F.when(F.size("edges") > 1, F.greatest(
            F.lit(1), F.size(F.filter("edges", lambda e: e < F.col("p"))))))
    else:
        got = edges.first()
        b = bin_index(base, "p", got["edges"] if got else [], "bucket")
    g = b.groupBy(*by, "bucket").agg(F.min("p").alias("min_prob"), F.max("p").alias("max_prob"),
                                     F.sum("y").alias("events"), F.sum(1 - F.col("y")).alias("nonevents"))
    # at most ``bins`` rows a group from here on: windows over this table are bounded.
    whole = by or [F.lit(1)]
    w_all = Window.partitionBy(*whole)
    w_by = w_all.orderBy(F.col("min_prob").desc())
    w_cum = w_by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = (g.withColumn("pop", F.col("events") + F.col("nonevents"))
         .withColumn("event_rate", F.col("events") / F.sum("events").over(w_all))
         .withColumn("nonevent_rate", F.col("nonevents") / F.sum("nonevents").over(w_all))
         .withColumn("cum_eventrate", F.sum("event_rate").over(w_cum))
         .withColumn("cum_noneventrate", F.sum("nonevent_rate").over(w_cum))
         .withColumn("ks", F.bround(F.col("cum_eventrate") - F.col("cum_noneventrate"), 3) * 100)
         .withColumn("cure_rate", F.col("events") / F.col("pop"))
         .withColumn("decile", F.row_number().over(w_by)))
    return t.select(*by, "decile", "min_prob", "max_prob", "events", "nonevents", "pop", "event_rate",
                    "nonevent_rate", "cum_eventrate", "cum_noneventrate", "ks", "cure_rate")


def ks_peak(table: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Max KS of a decile table and the first decile where it occurs (O3), one row a group."""
    return table.groupBy(*groups).agg(F.max("ks").alias("max_ks"),
                     F.min_by("decile", F.struct(-F.col("ks"), F.col("decile"))).alias("at_decile"))


def cut_labels(score_col: str, cuts: Sequence[float], labels: Sequence[str],
               first_open: bool = False):
    """Label by fixed cut-offs, first match wins.

    Default: ``<= c1``, ``(c1, c2]``, ..., ``> c_last``.  ``first_open``: ``< c1``,
    ``[c1, c2]``, ``[c2, c3]``, ... (overlapping closed bins, first wins).  NULL -> NULL."""
    s = F.col(score_col)
    conds = []
    if first_open:
        conds.append(s < cuts[0])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            conds.append((s >= lo) & (s <= hi))
    else:
        conds.append(s <= cuts[0])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            conds.append((s > lo) & (s <= hi))
    conds.append(s > cuts[-1])
    return F.when(s.isNull(), F.lit(None).cast("string")).otherwise(
        select_first(conds, list(labels), None))
