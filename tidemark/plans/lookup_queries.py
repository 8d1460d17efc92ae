"""Registered queries: patterns, JSON, as-of / latest / first lookups, sessions (steps 3-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import (as_flag, contains_flags, ilike_any, ilike_none, json_fields,
                                not_deleted, ordinal_map, ratio)
from tidemark.operators.asof import asof_latest, first_rows, latest_per_key, not_in, top_ties
from tidemark.operators.sessions import login_base, login_sessions, segment_ids
from tidemark.operators.trailing import AnchorSpec, FactSpec, Feature, trailing_features
from tidemark.plans import constants as K
from tidemark.plans import fixtures as fx
from tidemark.plans.feature_queries import EVENT_ANCHOR
from tidemark.plans.registry import register


def _in_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _ilike_or(col: str, patterns) -> str:
    return "(" + " OR ".join(f"{col} ILIKE '{p}'" for p in patterns) + ")"


# --------------------------------------------------------------------------- step 3

SQL_PATTERNS = fx.with_views(f"""
SELECT entity_id, CAST(SUM(amount) AS DOUBLE) AS signed_amount, COUNT(*) AS matched_rows
FROM transactions
WHERE {_ilike_or('description', K.FX_DEPOSIT_INCLUDE)}
  AND NOT {_ilike_or('description', K.FX_DEPOSIT_EXCLUDE)}
GROUP BY entity_id
""", "transactions")


@register("pattern_include_exclude", SQL_PATTERNS)
def pattern_include_exclude(spark, root):
    """ILIKE ANY include list and NOT ILIKE ANY exclude list (P3-P5), signed sum per entity."""
    t = fx.transactions(spark, root)
    t = t.where(ilike_any("description", K.FX_DEPOSIT_INCLUDE)
                & ilike_none("description", K.FX_DEPOSIT_EXCLUDE))
    return t.groupBy("entity_id").agg((F.sum("amount") / 100.0).alias("signed_amount"),
                                      F.count(F.lit(1)).alias("matched_rows"))


SQL_SIGNAL_FLAGS = fx.with_views(f"""
SELECT event_id, external_user_id, created_at,
       CASE WHEN risk_score > {K.FX_RISKY_SCORE} THEN 1 ELSE 0 END AS is_risky_session,
       {", ".join(f"CASE WHEN languages ILIKE '%{code}%' THEN 1 ELSE 0 END AS {name}"
                  for name, code in K.FX_LANGUAGE_FLAGS.items())},
       {", ".join(f"CASE WHEN languages ILIKE '%{sig}%' THEN 1 ELSE 0 END AS {name}"
                  for name, sig in K.FX_SIGNALS.items())},
       split_part(client_name, '-', 2) AS platform
FROM login_events
WHERE status ILIKE '%succeeded%'
""", "login_events")


@register("signal_flags", SQL_SIGNAL_FLAGS)
def signal_flags(spark, root):
    """Threshold flag, ILIKE membership flags (``_`` is a one-character wildcard) and
    SPLIT_PART on successful logins (P1, P3, P10, P11, F6)."""
    e = fx.login_events(spark, root).where(F.col("status").ilike("%succeeded%"))
    return e.select(
        "event_id", "external_user_id", "created_at",
        as_flag(F.col("risk_score") > K.FX_RISKY_SCORE).alias("is_risky_session"),
        *contains_flags("languages", K.FX_LANGUAGE_FLAGS),
        *contains_flags("languages", K.FX_SIGNALS),
        F.split_part(F.col("client_name"), F.lit("-"), F.lit(2)).alias("platform"))


SQL_JSON_FIELDS = """
SELECT event_id, user_id,
       json_extract_string(props, '$.k') AS k_text,
       TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_value,
       json_extract_string(props, '$.meta.type') AS meta_type
FROM events
WHERE json_extract_string(props, '$.k') = '7' OR event_type = 'signup'
"""


@register("json_fields", SQL_JSON_FIELDS)
def json_fields_query(spark, root):
    """Typed JSON paths from one parse per row, and a JSON-path equality filter."""
    e = fx.table(spark, root, "events")
    out = json_fields(e, "props", {"k_text": ("k", "string"), "k_value": ("k", "double"),
                                   "meta_type": ("meta.type", "string")})
    return (out.where((F.col("k_text") == "7") | (F.col("event_type") == "signup"))
            .select("event_id", "user_id", "k_text", "k_value", "meta_type"))


# --------------------------------------------------------------------------- step 4

_DRAW_OK = "description ILIKE '%MCA DRAW%' AND (deleted IS NULL OR deleted = FALSE)"
SQL_FIRST_EVENT = fx.with_views(f"""
SELECT DISTINCT a.business_id, a.lending_business_id,
       CAST(a.created_at AS DATE) AS first_draw_date,
       CAST(a.amount AS DOUBLE) / 100 AS first_draw_amount
FROM draws a JOIN first_dt b USING (business_id, lending_business_id, created_at)
WHERE a.{_DRAW_OK.replace(' AND (', ' AND (a.').replace('OR deleted', 'OR a.deleted')}
""", "draws", extra=(("first_dt", f"""
SELECT business_id, lending_business_id, MIN(created_at) AS created_at
FROM draws WHERE {_DRAW_OK} GROUP BY 1, 2"""),))


def _first_draw(spark, root):
    d = fx.draws(spark, root).where(F.col("description").ilike("%MCA DRAW%")
                                    & not_deleted("deleted"))
    first = first_rows(d, ["business_id", "lending_business_id"], "created_at")
    return first.select("business_id", "lending_business_id",
                        F.to_date("created_at").alias("first_draw_date"),
                        (F.col("amount").cast("double") / 100).alias("first_draw_amount")).distinct()


@register("first_event", SQL_FIRST_EVENT)
def first_event(spark, root):
    """First qualifying event per key with its attributes, ties kept."""
    return _first_draw(spark, root)


_OVERRIDE_SQL = " ".join(f"WHEN a.lending_business_id = {k} THEN {v}"
                         for k, v in K.FX_LIMIT_OVERRIDES.items())
SQL_ASOF = fx.with_views(f"""
SELECT business_id, lending_business_id, first_draw_date, first_draw_amount, credit_limit,
       first_draw_amount / credit_limit AS first_draw_utilisation
FROM (
  SELECT b.business_id, b.lending_business_id, b.first_draw_date, b.first_draw_amount,
         CASE {_OVERRIDE_SQL} ELSE CAST(a.new_limit AS DOUBLE) / 100 END AS credit_limit,
         ROW_NUMBER() OVER (PARTITION BY a.lending_business_id ORDER BY a.created_at DESC) AS rn
  FROM decisions a JOIN first_draw b
    ON a.lending_business_id = b.lending_business_id
   AND CAST(a.created_at AS DATE) <= b.first_draw_date
   AND (a.deleted IS NULL OR a.deleted = FALSE)
   AND a.trigger_event NOT IN ({_in_list(K.EXCLUDED_DECISION_EVENTS)})
) WHERE rn = 1
""", "draws", "decisions", extra=(
    ("first_dt", f"""SELECT business_id, lending_business_id, MIN(created_at) AS created_at
                     FROM draws WHERE {_DRAW_OK} GROUP BY 1, 2"""),
    ("first_draw", f"""SELECT DISTINCT a.business_id, a.lending_business_id,
                              CAST(a.created_at AS DATE) AS first_draw_date,
                              CAST(a.amount AS DOUBLE) / 100 AS first_draw_amount
                       FROM draws a JOIN first_dt b USING (business_id, lending_business_id, created_at)
                       WHERE a.description ILIKE '%MCA DRAW%'
                         AND (a.deleted IS NULL OR a.deleted = FALSE)""")))


@register("asof_latest", SQL_ASOF)
def asof_latest_query(spark, root):
    """Limit as of the first draw: latest decision on or before the draw date, one event
    type excluded, with an id override and a utilisation ratio (J3, P6, P8, P12, P13, R5)."""
    fd = _first_draw(spark, root)
    dec = fx.decisions(spark, root).where(
        not_deleted("deleted") & ~F.col("trigger_event").isin(K.EXCLUDED_DECISION_EVENTS))
    dec = dec.withColumn(
        "limit_value",
        F.coalesce(ordinal_map("lending_business_id", K.FX_LIMIT_OVERRIDES),
                   F.col("new_limit").cast("double") / 100))
    j = asof_latest(fd, dec, "lending_business_id", "lending_business_id", "first_draw_date",
                    "created_at", ["limit_value"], grain="date", flag="decided")
    j = j.where("decided").drop("decided").withColumnRenamed("limit_value", "credit_limit")
    return j.withColumn("first_draw_utilisation", ratio("first_draw_amount", "credit_limit"))


SQL_LATEST_PROFILE = fx.with_views("""
SELECT lending_business_id,
       json_extract_string(aggregate_kpis, '$.k') AS kpi_k,
       TRY_CAST(json_extract_string(aggregate_kpis, '$.k') AS DOUBLE) AS kpi_k_value,
       updated_at
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lending_business_id ORDER BY updated_at DESC) AS rn
      FROM credit_profiles
      WHERE aggregate_kpis IS NOT NULL AND fico_score IS NOT NULL)
WHERE rn = 1
""", "credit_profiles")


@register("latest_profile", SQL_LATEST_PROFILE)
def latest_profile(spark, root):
    """Latest non-null profile per key, JSON fields extracted."""
    p = fx.credit_profiles(spark, root).where(
        F.col("aggregate_kpis").isNotNull() & F.col("fico_score").isNotNull())
    latest = latest_per_key(p, ["lending_business_id"], ["updated_at"])
    out = json_fields(latest, "aggregate_kpis", {"kpi_k": ("k", "string"),
                                                 "kpi_k_value": ("k", "double")})
    return out.select("lending_business_id", "kpi_k", "kpi_k_value", "updated_at")


SQL_EVENT_TOTALS = fx.with_views(f"""
SELECT a.user_id, a.ts, a.event_id,
       COUNT(d.transaction_id) AS total_draw_count,
       CAST(COALESCE(SUM(d.amount), 0) AS BIGINT) AS total_amount_drawn
FROM purchase_anchors a
LEFT JOIN draws d
  ON a.user_id = d.business_id AND a.ts >= d.created_at AND {_DRAW_OK.replace('description', 'd.description').replace('deleted', 'd.deleted')}
GROUP BY a.user_id, a.ts, a.event_id
""", "purchase_anchors", "draws")


@register("event_totals", SQL_EVENT_TOTALS)
def event_totals(spark, root, strategy: str = "bucketed"):
    """Event-to-date count and amount per anchor, 0 when none.

    Keyed on the anchor (the windowed-aggregate form keyed on the fact side is not
    reproduced: it merges unmatched anchors into one group)."""
    d = fx.draws(spark, root)
    ok = F.col("description").ilike("%MCA DRAW%") & not_deleted("deleted")
    out = trailing_features(
        fx.purchase_anchors(spark, root), d, EVENT_ANCHOR,
        FactSpec("business_id", "created_at"),
        [Feature("total_draw_count", "count", "transaction_id", ok, None, "OPEN_TS"),
         Feature("total_amount_drawn", "sum", "amount", ok, None, "OPEN_TS")],
        strategy=strategy, as_double=False)
    return out.withColumn("total_amount_drawn",
                          F.coalesce(F.col("total_amount_drawn"), F.lit(0)).cast("bigint"))


SQL_NOT_IN = fx.with_views("""
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT business_id FROM flagged_accounts)
""", "flagged_accounts")


@register("null_aware_anti", SQL_NOT_IN)
def null_aware_anti(spark, root):
    """``NOT IN (subquery)`` with SQL NULL semantics."""
    c = fx.table(spark, root, "customer").select("c_custkey", "c_name")
    return not_in(c, "c_custkey", fx.flagged_accounts(spark, root), "business_id")


_LABELS1 = ("SELECT o_orderkey AS transaction_id, o_orderpriority AS category FROM orders "
            "WHERE o_orderstatus = 'F'")
_LABELS2 = ("SELECT o_orderkey AS transaction_id, o_orderpriority AS category FROM orders "
            "WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 100000")
SQL_LABELLED = fx.with_views(f"""
SELECT DISTINCT t.entity_id AS business_id, t.txn_id AS transaction_id,
       CAST(ABS(t.amount) AS DOUBLE) AS amount, t.txn_type, t.description,
       t.txn_ts AS transaction_date,
       l.category AS txn_category
FROM transactions t
LEFT JOIN ({_LABELS1} UNION {_LABELS2}) l ON t.txn_id = l.transaction_id
WHERE CAST(t.txn_ts AS DATE) >= DATE '{K.FX_LABEL_FROM}'
  AND CAST(t.txn_ts AS DATE) < DATE '{K.FX_LABEL_TO}'
  AND l.category IS NOT NULL
  AND t.entity_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > {K.FX_LABEL_ENTITY_PRICE})
UNION ALL
SELECT t.entity_id AS business_id, t.txn_id AS transaction_id,
       CAST(ABS(t.amount) AS DOUBLE) AS amount,
       t.txn_type, t.description, t.txn_ts AS transaction_date, t.category AS txn_category
FROM transactions t
WHERE CAST(t.txn_ts AS DATE) >= DATE '{K.FX_LABEL_FROM}'
  AND CAST(t.txn_ts AS DATE) < DATE '{K.FX_LABEL_TO}'
  AND t.txn_id NOT IN (SELECT transaction_id FROM ({_LABELS1} UNION {_LABELS2}))
""", "transactions")


@register("labelled_transactions", SQL_LABELLED)
def labelled_transactions(spark, root):
    """Transactions with a category from the UNION of two label sources, a date range, a
    semi-join on the anchor entities, then the unlabelled rows with a predicted category
    appended by column name (J6, J8, U1, U3, A5, P2, R4)."""
    o = fx.table(spark, root, "orders")
    l1 = o.where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_orderpriority").alias("category"))
    l2 = o.where(F.col("o_orderstatus").isin("F", "O") & (F.col("o_totalprice") > 100000)).select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_orderpriority").alias("category"))
    labels = l1.union(l2).distinct()
    t = fx.transactions(spark, root)
    lo, hi = F.lit(K.FX_LABEL_FROM).cast("date"), F.lit(K.FX_LABEL_TO).cast("date")
    t = t.where((F.to_date("txn_ts") >= lo) & (F.to_date("txn_ts") < hi))
    anchors = o.where(F.col("o_totalprice") > K.FX_LABEL_ENTITY_PRICE).select(
        F.col("o_custkey").alias("_ent"))
    lab = (t.join(labels, t.txn_id == labels.transaction_id, "left")
            .where(labels.category.isNotNull())
            .join(anchors, t.entity_id == anchors._ent, "left_semi")
            .select(t.entity_id.alias("business_id"), t.txn_id.alias("transaction_id"),
                    (F.abs(t.amount) / 100.0).alias("amount"), "txn_type", "description",
                    t.txn_ts.alias("transaction_date"), labels.category.alias("txn_category"))
            .distinct())
    predicted = (not_in(t, "txn_id", labels, "transaction_id")
                 .select(F.col("entity_id").alias("business_id"),
                         F.col("txn_id").alias("transaction_id"),
                         (F.abs("amount") / 100.0).alias("amount"),
                         "txn_type", "description", F.col("txn_ts").alias("transaction_date"),
                         F.col("category").alias("txn_category")))
    return lab.unionByName(predicted, allowMissingColumns=True)


SQL_RANK_TIES = fx.with_views("""
SELECT business_id, user_id, segment_user_id, flagged_at FROM (
  SELECT a.business_id, b.user_id, b.segment_user_id, a.flagged_at,
         RANK() OVER (PARTITION BY a.business_id ORDER BY a.flagged_at DESC NULLS FIRST) AS rnk
  FROM flagged_accounts a JOIN segment_users b ON a.business_id = b.business_id)
WHERE rnk = 1
""", "flagged_accounts", "segment_users")


@register("rank_ties", SQL_RANK_TIES)
def rank_ties(spark, root):
    """``rank() = 1`` per key with ties kept, NULL dates first in DESC order."""
    f = fx.flagged_accounts(spark, root).alias("a")
    u = fx.segment_users(spark, root).alias("b")
    j = f.join(u, F.col("a.business_id") == F.col("b.business_id")).select(
        "a.business_id", "b.user_id", "b.segment_user_id", "a.flagged_at")
    return top_ties(j, ["business_id"], "flagged_at", nulls_first_desc=True)


_SEGMENT_SQL = f"""
SELECT DISTINCT business_id, user_id, segment_user_id, 1 AS confirmed_ato,
       COALESCE(CAST(flagged_at AS DATE), DATE '{K.FAR_FUTURE_DATE}') AS ato_date, 1 AS rnk
FROM (SELECT a.business_id, b.user_id, b.segment_user_id, a.flagged_at,
             RANK() OVER (PARTITION BY a.business_id ORDER BY a.flagged_at DESC NULLS FIRST) AS r
      FROM flagged_accounts a JOIN segment_users b ON a.business_id = b.business_id)
WHERE r = 1
UNION ALL
SELECT business_id, user_id, segment_user_id, 0 AS confirmed_ato,
       DATE '{K.FAR_FUTURE_DATE}' AS ato_date, 0 AS rnk
FROM segment_users
WHERE business_id NOT IN (SELECT business_id FROM flagged_accounts)"""

SQL_SEGMENT_IDS = fx.with_views("SELECT * FROM segment_id", "flagged_accounts", "segment_users",
                                extra=(("segment_id", _SEGMENT_SQL),))


@register("segment_ids", SQL_SEGMENT_IDS)
def segment_ids_query(spark, root):
    """Flagged users (latest flag date) UNION ALL the users NOT IN the flagged list, with
    constant branch markers (U2, J7, W2, P19, F4)."""
    return segment_ids(fx.flagged_accounts(spark, root), fx.segment_users(spark, root),
                       K.FAR_FUTURE_DATE)


# --------------------------------------------------------------------------- step 5

_SESSIONS_SQL = f"""
SELECT *, COALESCE(session_end_time_temp, created_at + INTERVAL 1 DAY) AS session_end_time
FROM (
  SELECT b.business_id, a.external_user_id, b.user_id, b.ato_date, a.created_at,
         CASE WHEN a.risk_score > {K.FX_RISKY_SCORE} THEN 1 ELSE 0 END AS is_risky_session,
         {", ".join(f"CASE WHEN a.languages ILIKE '%{code}%' THEN 1 ELSE 0 END AS {name}"
                    for name, code in K.FX_LANGUAGE_FLAGS.items())},
         split_part(a.client_name, '-', 2) AS platform,
         a.created_at AS session_start_time,
         LAG(a.created_at) OVER (PARTITION BY b.user_id ORDER BY a.created_at DESC)
           AS session_end_time_temp
  FROM login_events a JOIN segment_id b ON a.external_user_id = b.segment_user_id
  WHERE a.status ILIKE '%succeeded%')"""

SQL_LOGIN_SESSIONS = fx.with_views(
    "SELECT * EXCLUDE (session_end_time_temp) FROM sessions",
    "flagged_accounts", "segment_users", "login_events",
    extra=(("segment_id", _SEGMENT_SQL), ("sessions", _SESSIONS_SQL)))


def _sessions(spark, root):
    seg = segment_ids(fx.flagged_accounts(spark, root), fx.segment_users(spark, root),
                      K.FAR_FUTURE_DATE)
    return login_sessions(fx.login_events(spark, root), seg, K.FX_RISKY_SCORE,
                          K.FX_LANGUAGE_FLAGS)


@register("login_sessions", SQL_LOGIN_SESSIONS)
def login_sessions_query(spark, root):
    """Successful logins of known users; session end = next login of the user, else
    start + 1 day (R8, W3, F3, F4)."""
    return _sessions(spark, root)


_LOGIN_BASE_SQL = f"""
SELECT business_id, external_user_id, created_at FROM sessions
WHERE CAST(created_at AS DATE) <= DATE '{K.FX_LOGIN_CUTOFF}'
UNION
SELECT su.business_id, d.external_user_id, d.created_at
FROM login_responses d LEFT JOIN segment_users su ON d.external_user_id = su.segment_user_id"""

SQL_LOGIN_BASE = fx.with_views(
    "SELECT * FROM login_base", "flagged_accounts", "segment_users", "login_events",
    "login_responses",
    extra=(("segment_id", _SEGMENT_SQL), ("sessions", _SESSIONS_SQL),
           ("login_base", _LOGIN_BASE_SQL)))


def _login_base(spark, root):
    return login_base(_sessions(spark, root), fx.login_responses(spark, root),
                      fx.segment_users(spark, root), K.FX_LOGIN_CUTOFF)


@register("login_base", SQL_LOGIN_BASE)
def login_base_query(spark, root):
    """Sessions up to a cut-off UNION JSON login responses mapped to entities."""
    return _login_base(spark, root)


def _dd_count(n):
    return (f"COUNT(CASE WHEN CAST(t.created_at AS DATE) >= CAST(a.ts AS DATE) - {n} "
            f"AND CAST(t.created_at AS DATE) <= CAST(a.ts AS DATE) THEN t.business_id END)")


SQL_LOGIN_COUNTS = fx.with_views(f"""
SELECT a.user_id, a.ts, a.event_id,
       {_dd_count(7)} AS count_login_l7d,
       {_dd_count(15)} AS count_login_l15d,
       {_dd_count(30)} AS count_login_l30d
FROM purchase_anchors a
LEFT JOIN login_base t ON a.user_id = t.business_id
GROUP BY a.user_id, a.ts, a.event_id
""", "purchase_anchors", "flagged_accounts", "segment_users", "login_events", "login_responses",
    extra=(("segment_id", _SEGMENT_SQL), ("sessions", _SESSIONS_SQL),
           ("login_base", _LOGIN_BASE_SQL)))


def login_count_features() -> list[Feature]:
    return [Feature(f"count_login_l{n}d", "count", "business_id", None, n, "DD")
            for n in (7, 15, 30)]


@register("login_counts", SQL_LOGIN_COUNTS)
def login_counts(spark, root, strategy: str = "bucketed"):
    """7/15/30-day login counts per anchor from the login base, fused in one pass."""
    return trailing_features(fx.purchase_anchors(spark, root), _login_base(spark, root),
                             EVENT_ANCHOR,
                             FactSpec("business_id", "created_at"), login_count_features(),
                             strategy=strategy)
