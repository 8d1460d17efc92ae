"""Latest / first rows per key and as-of lookups.

Skew rules followed throughout: per-key reductions are aggregates (``max_by`` /
``min``) so they combine map-side before the shuffle; nothing places a whole key
in one window partition; joins back to the detail rows are equi-joins that AQE
can split when one key is hot.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _epoch():
    return F.lit("1970-01-01").cast("date")


def _order_struct(cols: Sequence[str | Column], nulls_first_desc: bool) -> Column:
    """Struct whose max is the first row of ``ORDER BY cols DESC``.

    With ``nulls_first_desc`` a NULL in the leading column ranks highest, as in
    dialects where DESC puts NULLs first."""
    parts = []
    for c in cols:
        col = F.col(c) if isinstance(c, str) else c
        if nulls_first_desc:
            parts.append(col.isNull())
        parts.append(col)
    return F.struct(*parts)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   nulls_first_desc: bool = True, as_of=None) -> DataFrame:
    """``row_number() over (partition by keys order by order DESC) = 1``.

    ``as_of``: only rows whose first order column is at or before this instant count.
    Computed as ``max_by`` in an aggregate, so a hot key is reduced map-side.  Ties
    on ``order`` are broken by the remaining columns (deterministic)."""
    if as_of is not None:
        df = df.where(F.col(order[0]) <= F.lit(as_of).cast(df.schema[order[0]].dataType))
    rest = [c for c in df.columns if c not in keys]
    tie = [c for c in rest if c not in order]
    o = _order_struct(list(order) + tie, nulls_first_desc)
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), o).alias("_row"))
    return agg.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def top_ties(df: DataFrame, keys: Sequence[str], order: str,
             nulls_first_desc: bool = True) -> DataFrame:
    """``rank() over (partition by keys order by order DESC) = 1``: all tied rows kept."""
    o = _order_struct([order], nulls_first_desc)
    best = df.groupBy(*keys).agg(F.max(o).alias("_best"))
    j = df.withColumn("_o", o).join(best, list(keys))
    return j.where(F.col("_o") == F.col("_best")).drop("_o", "_best")


def first_rows(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows at the minimum ``ts`` per key, ties kept (A4 + J5 self-join on the min)."""
    m = df.groupBy(*keys).agg(F.min(ts).alias("_min"))
    j = df.join(m, list(keys))
    return j.where(F.col(ts) == F.col("_min")).drop("_min")


def not_in(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """SQL ``left_col NOT IN (SELECT right_col FROM right)``, null-aware.

    Empty subquery -> every left row; a NULL in the subquery -> no rows; a NULL
    left value -> dropped when the subquery is non-empty.  Both counts come from one
    scalar subquery, not a join."""
    c = right.agg(F.struct(F.count(F.lit(1)).alias("all"), F.count(F.col(right_col)).alias("known")).alias("c"))
    counts = c.select("c").scalar()              # one aggregate, read once
    r = right.select(F.col(right_col).alias("_r")).where(F.col("_r").isNotNull())
    out = left.join(r, F.col(left_col) == F.col("_r"), "left_anti")
    return out.where((counts["all"] == 0) | ((counts["known"] == counts["all"]) & F.col(left_col).isNotNull()))


def asof_latest(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                left_time: str, right_time: str, payload: Sequence[str],
                order: Sequence[str] = (), grain: str = "date",
                bucket_days: int = 64, prefix: str = "", flag: str | None = None) -> DataFrame:
    """For every left row: payload of the latest right row with the same key and
    ``right_time <= left_time`` (compared as dates when ``grain='date'``), else NULLs.

    Plan (exact; no all-pairs, no whole-key window):
      0. left reduced to its distinct (key, time) pairs; the result joins back to the
         left rows at the end, so repeated left rows are all kept;
      1. right reduced to its latest row per (key, day) with ``max_by`` (map-side);
      2. left x daily rows of the same (key, bucket) up to the left day
         (fan-out <= bucket_days);
      3. left x per-(key, bucket) latest rows of earlier buckets
         (fan-out <= number of buckets);
      4. ``grain='timestamp'``: same-day right rows, reduced to distinct times, are
         merged with the left times of that (key, day) and carried forward in time
         order (linear in rows, no pairs);
      5. one aggregate per (key, time) keeps the latest candidate.
    ``order`` adds tie-breakers after ``right_time``; right rows tied on all of these
    are ranked by the payload, so one of them is returned and reruns agree.  ``flag``
    names a boolean column that is true where a right row was found, which tells a
    found row with NULL payload from none."""
    width = max(1, bucket_days)
    o_cols = [right_time, *order]
    r = (right.where(F.col(right_key).isNotNull() & F.col(right_time).isNotNull())
         .select(F.col(right_key).alias("_k"),
                 F.struct(*[F.col(c) for c in [*o_cols, *payload]]).alias("_o"),
                 F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in payload]).alias("_p"),
                 F.col(right_time).alias("_rt"))
         .withColumn("_rdn", F.datediff(F.to_date("_rt"), _epoch()))
         .withColumn("_rb", F.floor(F.col("_rdn") / width)))
    lx = (left.select(F.col(left_key).alias("_lk"), F.col(left_time).alias("_lt"))
              .where("_lk is not null and _lt is not null").distinct()
              .withColumn("_ldn", F.datediff(F.to_date("_lt"), _epoch()))
              .withColumn("_lb", F.floor(F.col("_ldn") / width)))
    daily = r.groupBy("_k", "_rdn", "_rb").agg(F.max_by("_p", "_o").alias("_p"),
                                               F.max("_o").alias("_o"))
    buckets = daily.groupBy("_k", "_rb").agg(F.max_by("_p", "_o").alias("_p"),
                                             F.max("_o").alias("_o"))
    same_day_ok = F.lit(True) if grain == "date" else F.lit(False)
    b1 = lx.join(daily, (F.col("_lk") == F.col("_k")) & (F.col("_lb") == F.col("_rb"))
                 & ((F.col("_rdn") < F.col("_ldn")) | (same_day_ok & (F.col("_rdn") == F.col("_ldn")))))
    b2 = lx.join(buckets, (F.col("_lk") == F.col("_k")) & (F.col("_rb") < F.col("_lb")))
    u = b1.select("_lk", "_lt", "_p", "_o").unionByName(b2.select("_lk", "_lt", "_p", "_o"))
    if grain != "date":
        at = r.groupBy("_k", "_rdn", "_rt").agg(F.max_by("_p", "_o").alias("_p"), F.max("_o").alias("_o"))
        seq = at.select("_k", F.col("_rdn").alias("_day"), F.col("_rt").alias("_t"),
                        F.struct("_p", "_o").alias("_c"), F.lit(False).alias("_is"))
        seq = seq.unionByName(lx.select(F.col("_lk").alias("_k"), F.col("_ldn").alias("_day"), F.col("_lt").alias("_t"),
                                        F.lit(None).cast(seq.schema["_c"].dataType).alias("_c"), F.lit(True).alias("_is")))
        # at equal times the right row (false) stands first
        w = Window.partitionBy("_k", "_day").orderBy("_t", "_is").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        seq = seq.withColumn("_c", F.last("_c", ignorenulls=True).over(w)).where("_is and _c is not null")
        u = u.unionByName(seq.select(F.col("_k").alias("_lk"), F.col("_t").alias("_lt"), "_c._p", "_c._o"))
    best = u.groupBy("_lk", "_lt").agg(F.max_by("_p", "_o").alias("_p"))
    out = left.join(best, (F.col(left_key) == F.col("_lk")) & (F.col(left_time) == F.col("_lt")), "left")
    extra = [F.col("_lk").isNotNull().alias(flag)] if flag else []
    return out.select(*left.columns, *[F.col(f"_p.{prefix}{c}").alias(f"{prefix}{c}") for c in payload], *extra)
