"""Login sessions and the login base.

A session starts at a successful login and ends at the user's next login, or one
day later when there is none (``LAG`` over descending time = ``LEAD`` ascending).
This is not ``session_window`` (which merges events closer than a gap).

``next_event_time`` avoids one window partition per user: the ``lead`` runs per
(user, day); the last event of a day takes the first event of the user's next
active day from a per-(user, day) summary, whose window holds at most one row
per active day of the user.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import as_flag, split_part
from tidemark.operators.asof import not_in, top_ties


def next_event_time(df: DataFrame, key: str, ts: str, out: str,
                    tie_breakers: Sequence[str] = ()) -> DataFrame:
    """Add ``out`` = the key's next ``ts`` after this row (NULL for the last)."""
    d = df.withColumn("_day", F.to_date(F.col(ts)))
    w_day = Window.partitionBy(key, "_day").orderBy(F.col(ts), *[F.col(c) for c in tie_breakers])
    d = d.withColumn("_nxt", F.lead(F.col(ts)).over(w_day))
    days = d.groupBy(key, "_day").agg(F.min(ts).alias("_first"))
    w_days = Window.partitionBy(key).orderBy("_day")
    days = days.withColumn("_next_first", F.lead("_first").over(w_days)).drop("_first")
    d = d.join(days, [key, "_day"], "left")
    return d.withColumn(out, F.coalesce(F.col("_nxt"), F.col("_next_first"))).drop(
        "_day", "_nxt", "_next_first")


def segment_ids(flagged: DataFrame, users: DataFrame, far_future: str) -> DataFrame:
    """Entities with their users, flagged ones first.

    flagged: (business_id, flagged_at)   users: (business_id, user_id, segment_user_id)
    Flagged branch: users of flagged entities at the latest flag date per entity
    (ties kept, NULL dates rank first), confirmed 1, date = flag date or ``far_future``.
    Other branch: users whose entity is NOT IN the flagged list (null-aware), confirmed 0."""
    j = flagged.alias("a").join(users.alias("b"), F.col("a.business_id") == F.col("b.business_id"))
    j = j.select(F.col("a.business_id").alias("business_id"), "b.user_id", "b.segment_user_id",
                 F.col("a.flagged_at").alias("flagged_at"))
    top = top_ties(j, ["business_id"], "flagged_at", nulls_first_desc=True)
    first = top.select("business_id", "user_id", "segment_user_id",
                       F.lit(1).alias("confirmed_ato"),
                       F.coalesce(F.to_date("flagged_at"), F.lit(far_future).cast("date")).alias("ato_date"),
                       F.lit(1).alias("rnk")).distinct()
    rest = not_in(users, "business_id", flagged, "business_id").select(
        "business_id", "user_id", "segment_user_id", F.lit(0).alias("confirmed_ato"),
        F.lit(far_future).cast("date").alias("ato_date"), F.lit(0).alias("rnk"))
    return first.unionByName(rest)


def login_sessions(logins: DataFrame, segments: DataFrame, risky_threshold: float,
                   language_flags: dict[str, str], success_pattern: str = "%succeeded%",
                   platform_delim: str = "-") -> DataFrame:
    """Successful logins of known users with session start/end and 0/1 flags.

    logins: (external_user_id, created_at, status, risk_score, languages, client_name, ...)"""
    j = logins.alias("a").join(segments.alias("b"),
                               F.col("a.external_user_id") == F.col("b.segment_user_id"))
    j = j.where(F.col("a.status").ilike(success_pattern))
    flags = [as_flag(F.col("a.languages").ilike(f"%{code}%")).alias(name)
             for name, code in language_flags.items()]
    s = j.select("b.business_id", "a.external_user_id", "b.user_id", "b.ato_date", "a.created_at",
                 as_flag(F.col("a.risk_score") > F.lit(risky_threshold)).alias("is_risky_session"),
                 *flags,
                 split_part(F.col("a.client_name"), platform_delim, 2).alias("platform"))
    s = s.withColumn("session_start_time", F.col("created_at"))
    s = next_event_time(s, "user_id", "created_at", "_next", ("external_user_id",))
    return s.withColumn(
        "session_end_time",
        F.coalesce(F.col("_next"), F.col("created_at") + F.make_dt_interval(F.lit(1)))).drop("_next")


def login_base(sessions: DataFrame, responses: DataFrame, users: DataFrame,
               cutoff_date: str) -> DataFrame:
    """Sessions up to a cut-off date UNION (distinct) JSON login responses mapped to
    their entity (R9).  responses: (external_user_id, created_at) already filtered."""
    b1 = (sessions.where(F.to_date("created_at") <= F.lit(cutoff_date).cast("date"))
          .select("business_id", "external_user_id", "created_at"))
    b2 = (responses.alias("d").join(users.alias("su"),
                                    F.col("d.external_user_id") == F.col("su.segment_user_id"),
                                    "left")
          .select(F.col("su.business_id").alias("business_id"), "d.external_user_id",
                  "d.created_at"))
    return b1.unionByName(b2).distinct()
