"""Global order statistics without a single-partition window.

``global_cumsum`` gives inclusive running sums in (group, order) order over the
whole frame: the frame is range-partitioned on (group, order) and the partition
id fixed by a checkpoint, each partition gets its per-group totals, the offsets of earlier partitions come from a table
of (#partitions x #groups-per-partition) rows, and the running sum inside a
partition is a window over that partition's rows only.  Equal order values
always land in the same range partition, so ties are never split.

Everything exact built on it: dense ranks, exact quantiles (``exact_quantiles``),
ROC/KS cumulative counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def global_cumsum(df: DataFrame, order: Sequence[str], sums: Sequence[str],
                  groups: Sequence[str] = (), num_partitions: int | None = None,
                  prefix: str = "cum_") -> DataFrame:
    """Add ``{prefix}{c}`` = sum of ``c`` over rows with the same groups and an order
    key <= this row's (inclusive).  Rows must be unique on groups + order."""
    n = _partitions(df, num_partitions)
    g, o = list(groups), list(order)
    r = df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in g + o])
    # The partition id is read by two branches (totals and running sums).  Range
    # bounds come from sampling and AQE may coalesce each read differently, so the
    # ids are fixed once by a reliable checkpoint (shared directory, survives
    # executor loss) before branching.
    r = cut_lineage(r.withColumn("_pid", F.spark_partition_id()))
    totals = r.groupBy("_pid", *g).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    w_prev = (Window.partitionBy(*g).orderBy("_pid")
              .rowsBetween(Window.unboundedPreceding, -1)) if g else (
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("_pid", *g, *[
        F.coalesce(F.sum(f"_t_{c}").over(w_prev), F.lit(0)).alias(f"_o_{c}") for c in sums])
    w_in = (Window.partitionBy("_pid", *g).orderBy(*[F.col(c).asc_nulls_first() for c in o])
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = r.select("*", *[F.sum(c).over(w_in).alias(f"_in_{c}") for c in sums])
    # one row per (partition, group); a NULL group is a group like any other
    offsets = offsets.select(F.col("_pid").alias("_opid"), *[F.col(c).alias(f"_g_{c}") for c in g],
                             *[f"_o_{c}" for c in sums])
    same = F.col("_pid") == F.col("_opid")
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    r = r.join(offsets, same, "left")
    return r.select(*df.columns, *[
        (F.col(f"_in_{c}") + F.coalesce(F.col(f"_o_{c}"), F.lit(0))).alias(f"{prefix}{c}")
        for c in sums])


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = (),
                 extra: dict[str, Column] | None = None) -> DataFrame:
    """Distinct (groups, value) with ``n`` rows each (+ extra aggregates); NULL values dropped."""
    aggs = [F.count(F.lit(1)).alias("n")] + [c.alias(k) for k, c in (extra or {}).items()]
    return df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(*aggs)


def dense_codes(df: DataFrame, col: str, out: str, groups: Sequence[str] = ()) -> DataFrame:
    """0-based codes in sorted order of the distinct values (``LabelEncoder``); NULL -> NULL.

    Returns the mapping (groups, value, code), one row per distinct value."""
    d = df.where(F.col(col).isNotNull()).select(*groups, col).distinct().withColumn("_one", F.lit(1))
    m = global_cumsum(d, [col], ["_one"], groups)
    return m.select(*groups, col, (F.col("cum__one") - 1).cast("int").alias(out))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    groups: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles (``quantile_cont``) per group.

    Returns (groups, p, q) for every p; NULLs ignored.  Only the distinct-value
    table is ranked; the probability table (groups x len(probs) rows) is tiny."""
    g = list(groups)
    vc = value_counts(df, value, g)
    cum = global_cumsum(vc, [value], ["n"], g).withColumn("_lo_rank", F.col("cum_n") - F.col("n"))
    totals = vc.groupBy(*g).agg(F.sum("n").alias("_total"))
    targets = totals.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    targets = (targets.withColumn("_pos", (F.col("_total") - 1).cast("double") * F.col("p"))
               .withColumn("_lo", F.floor("_pos"))
               .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_total") - 1))
               .withColumn("_frac", F.col("_pos") - F.col("_lo")))
    t = targets.alias("t")
    c = cum.alias("c")
    has = lambda r: (F.col("c._lo_rank") <= F.col(f"t.{r}")) & (F.col(f"t.{r}") < F.col("c.cum_n"))
    cond = has("_lo") | has("_hi")
    for k in g:
        cond = cond & (F.col(f"t.{k}") == F.col(f"c.{k}"))
    # targets: groups x len(probs) rows, a proven bound -> broadcast
    m = c.join(t, cond).select(
        *[F.col(f"t.{k}").alias(k) for k in g], F.col("t.p").alias("p"), F.col("t._frac").alias("_frac"),
        F.when(has("_lo"), F.col(f"c.{value}").cast("double")).alias("_vlo"),
        F.when(has("_hi"), F.col(f"c.{value}").cast("double")).alias("_vhi"))
    q = m.groupBy(*g, "p").agg(F.max("_vlo").alias("_vlo"), F.max("_vhi").alias("_vhi"),
                               F.first("_frac").alias("_frac"))
    return q.select(*g, "p", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("q"))


def wide_quantiles(df: DataFrame, columns: dict[str, Column], probs: Sequence[float],
                   accuracy: int = 2000) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles of many columns without sorting the data.

    ``columns``: name -> double Column, NULL where a value is left out.  Returns
    name -> one quantile per p (None for a column without values); the result is bounded by
    the schema width, and so is everything that reaches the driver.

      1. one pass of ``percentile_approx`` gives a narrow bracket for every (column, p);
      2. one pass sorts each batch of a column and counts (column, place, value), place being a
         bracket or a gap between two, with the value kept inside brackets only, so a batch gives one row
         per gap, and only in-bracket values are shuffled;
      3. in-bracket values are ranked by distributed prefix sums over that count table.
    ``percentile_approx`` bounds its rank error, so a bracket holds its ranks; a column for
    which one did not is ranked as a whole by ``exact_quantiles``."""
    names = list(columns)
    if not names:
        return {}
    d = df.select(*[columns[c].cast("double").alias(f"_c{i}") for i, c in enumerate(names)])
    slack = 2.0 / accuracy
    cuts = [min(max(p + e, 0.0), 1.0) for p in probs for e in (-slack, slack)]
    row = d.agg(*[F.percentile_approx(f"_c{i}", cuts, accuracy).alias(f"_c{i}") for i in range(len(names))]).first()
    # brackets and the gaps between them, in order: odd places are brackets
    brackets: dict[int, np.ndarray] = {}
    for i, c in enumerate(names):
        got, merged = row[f"_c{i}"], []
        for j in range(len(probs) if got else 0):
            lo = -float("inf") if cuts[2 * j] == 0.0 else got[2 * j]
            hi = float("inf") if cuts[2 * j + 1] == 1.0 else got[2 * j + 1]
            merged.append([lo, hi])
        merged.sort()
        joint: list[list[float]] = []
        for lo, hi in merged:
            if joint and lo <= joint[-1][1]:
                joint[-1][1] = max(joint[-1][1], hi)
            else:
                joint.append([lo, hi])
        if joint:
            brackets[i] = np.array(joint)
    if not brackets:
        return {c: [None] * len(probs) for c in names}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []                       # feature, places, values, rows
            for i, spans in brackets.items():
                x = np.sort(b.column(i).drop_null().to_numpy(zero_copy_only=False))
                start, end = np.searchsorted(x, spans[:, 0], "left"), np.searchsorted(x, spans[:, 1], "right")
                gaps = np.append(start, len(x)) - np.append(0, end)
                some = np.flatnonzero(gaps)
                out.append((i, 2 * some, np.full(len(some), np.nan), gaps[some]))
                for k in np.flatnonzero(end > start):
                    v = x[start[k]:end[k]]
                    first = np.append(0, np.flatnonzero(v[1:] != v[:-1]) + 1)
                    out.append((i, np.full(len(first), 2 * k + 1), v[first], np.diff(np.append(first, len(v)))))
            places, values, rows = (np.concatenate([o[k] for o in out]) for k in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]), pa.int32()), pa.array(places, pa.int32()),
                pa.array(values, pa.float64(), mask=places % 2 == 0), pa.array(rows, pa.int64())], names=["feature", "place", "value", "n"])

    # columns x (2 probs + 1) rows at most, and the values inside brackets
    counts = d.mapInArrow(count, "feature int, place int, value double, n long").groupBy("feature", "place", "value").agg(F.sum("n").alias("n"))
    cum = global_cumsum(counts, ["place", "value"], ["n"], ["feature"])
    totals = counts.groupBy("feature").agg(F.sum("n").alias("_total"))
    t = totals.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(p)).alias("p"))
                                                    for j, p in enumerate(probs)])))
    t = (t.withColumn("_pos", (F.col("_total") - 1).cast("double") * F.col("_p.p"))
          .withColumn("_lo", F.floor("_pos")).withColumn("_frac", F.col("_pos") - F.col("_lo"))
          .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_total") - 1)))
    c = cum.withColumn("_from", F.col("cum_n") - F.col("n"))
    has = lambda r: (F.col("_from") <= F.col(r)) & (F.col(r) < F.col("cum_n"))
    m = c.join(t, "feature").where(has("_lo") | has("_hi")).select(
        "feature", F.col("_p.j").alias("j"), "_frac", F.when(has("_lo"), F.col("value")).alias("a"),
        F.when(has("_hi"), F.col("value")).alias("b"))
    m = m.groupBy("feature", "j").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.first("_frac").alias("f"))
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in names}
    missed = set()
    for r in m.collect():                                     # columns x probs rows
        if r["a"] is None or r["b"] is None:
            missed.add(r["feature"])
            continue
        a, b = r["a"], r["b"]
        out[names[r["feature"]]][r["j"]] = a if a == b else a + (b - a) * r["f"]
    for i in missed:
        whole = {r["p"]: r["q"] for r in exact_quantiles(d, f"_c{i}", list(probs)).collect()}
        out[names[i]] = [whole.get(float(p)) for p in probs]
    return out
