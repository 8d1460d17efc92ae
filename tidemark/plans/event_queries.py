"""Registered queries on the event anchors: the login and lending part of the feature
table, and the remaining small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import contains_flags, ilike_any, ilike_none, json_fields, not_deleted, percent_text, \
    normalised_ratio, ordinal_map, ratio
from tidemark.operators.asof import asof_latest, latest_per_key
from tidemark.operators.binning import bin_of_literals, equal_width_edges
from tidemark.operators.evaluate import ks_table
from tidemark.operators.trailing import FactSpec, Feature, trailing_features
from tidemark.plans import constants as K
from tidemark.plans import fixtures as fx
from tidemark.plans.feature_queries import EVENT_ANCHOR
from tidemark.plans.io_queries import read_once, scratch_path
from tidemark.plans.lookup_queries import (_DRAW_OK, _LOGIN_BASE_SQL, _OVERRIDE_SQL, _SEGMENT_SQL, _SESSIONS_SQL,
                                           SQL_LOGIN_BASE, _dd_count, _first_draw, _ilike_or, _in_list, _login_base,
                                           login_count_features)
from tidemark.plans.model_queries import SQL_KS_DECILES, _sql_ratio
from tidemark.plans.registry import register
from tidemark.sources import append_table

# (name, short window in days, long window in days)
LOGIN_RATIOS = [("l7d_l15d", 7, 15), ("l7d_l30d", 7, 30), ("l15d_l30d", 15, 30)]


def login_ratio_columns():
    plain = [ratio(f"count_login_l{a}d", f"count_login_l{b}d").alias(f"ratio_login_{n}") for n, a, b in LOGIN_RATIOS]
    return plain + [normalised_ratio(f"count_login_l{a}d", a, f"count_login_l{b}d", b).alias(
        f"ratio_login_{n}_normalised") for n, a, b in LOGIN_RATIOS]


def _sql_login_ratios() -> str:
    out = [f"{_sql_ratio(f'count_login_l{a}d', f'count_login_l{b}d')} AS ratio_login_{n}" for n, a, b in LOGIN_RATIOS]
    out += [f"{_sql_ratio(f'(CAST(count_login_l{a}d AS DOUBLE) / {float(a)})', f'(CAST(count_login_l{b}d AS DOUBLE) / {float(b)})')}"
            f" AS ratio_login_{n}_normalised" for n, a, b in LOGIN_RATIOS]
    return ", ".join(out)


_D = _DRAW_OK.replace("description", "d.description").replace("deleted", "d.deleted")
SQL_EVENT_FEATURES = fx.with_views(f"""
SELECT l.user_id, l.ts, l.event_id, count_login_l7d, count_login_l15d, count_login_l30d, {_sql_login_ratios()},
       total_draw_count, total_amount_drawn, first_draw_date, first_draw_amount, credit_limit,
       {_sql_ratio('first_draw_amount', 'credit_limit')} AS first_draw_utilisation,
       CAST(date_diff('day', first_draw_date, CAST(l.ts AS DATE)) AS INTEGER) AS days_from_first_draw,
       kpi_k_value
FROM (SELECT a.user_id, a.ts, a.event_id, {_dd_count(7)} AS count_login_l7d, {_dd_count(15)} AS count_login_l15d,
             {_dd_count(30)} AS count_login_l30d
      FROM purchase_anchors a LEFT JOIN login_base t ON a.user_id = t.business_id GROUP BY 1, 2, 3) l
JOIN (SELECT a.event_id, COUNT(d.transaction_id) AS total_draw_count,
             CAST(COALESCE(SUM(d.amount), 0) AS BIGINT) AS total_amount_drawn
      FROM purchase_anchors a LEFT JOIN draws d
        ON a.user_id = d.business_id AND a.ts >= d.created_at AND {_D} GROUP BY 1) t ON t.event_id = l.event_id
LEFT JOIN first_draw f ON f.business_id = l.user_id
LEFT JOIN (SELECT lending_business_id, credit_limit FROM (
             SELECT a.lending_business_id,
                    CASE {_OVERRIDE_SQL} ELSE CAST(a.new_limit AS DOUBLE) / 100 END AS credit_limit,
                    ROW_NUMBER() OVER (PARTITION BY a.lending_business_id ORDER BY a.created_at DESC) AS rn
             FROM decisions a JOIN first_draw b ON a.lending_business_id = b.lending_business_id
              AND CAST(a.created_at AS DATE) <= b.first_draw_date AND (a.deleted IS NULL OR a.deleted = FALSE)
              AND a.trigger_event NOT IN ({_in_list(K.EXCLUDED_DECISION_EVENTS)})) WHERE rn = 1) m
  ON m.lending_business_id = f.lending_business_id
LEFT JOIN (SELECT lending_business_id, TRY_CAST(json_extract_string(aggregate_kpis, '$.k') AS DOUBLE) AS kpi_k_value
           FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lending_business_id ORDER BY updated_at DESC) AS rn
                 FROM credit_profiles WHERE aggregate_kpis IS NOT NULL AND fico_score IS NOT NULL) WHERE rn = 1) p
  ON p.lending_business_id = l.user_id
""", "purchase_anchors", "flagged_accounts", "segment_users", "login_events", "login_responses", "draws", "decisions",
    "credit_profiles", extra=(
        ("segment_id", _SEGMENT_SQL), ("sessions", _SESSIONS_SQL), ("login_base", _LOGIN_BASE_SQL),
        ("first_draw", f"""
SELECT business_id, lending_business_id, first_draw_date, first_draw_amount FROM (
  SELECT business_id, lending_business_id, CAST(created_at AS DATE) AS first_draw_date,
         CAST(amount AS DOUBLE) / 100 AS first_draw_amount,
         ROW_NUMBER() OVER (PARTITION BY lending_business_id ORDER BY created_at, amount, business_id) AS rn
  FROM draws WHERE {_DRAW_OK}) WHERE rn = 1""")))


@register("event_feature_table", SQL_EVENT_FEATURES)
def event_feature_table(spark, root):
    """Login counts and their six ratios, draw totals, first draw, limit and utilisation, age
    from first draw and the latest profile, per event anchor (R1, R2, R5-R7, R10, J10).

    Logins and draws are one set of facts, so the anchors are joined once.  Of tied first
    draws of a lending id the smallest amount counts, so a lending id has one row."""
    logins = _login_base(spark, root).select("business_id", "created_at", F.lit(True).alias("is_login"))
    draws = fx.draws(spark, root).where(F.col("description").ilike("%MCA DRAW%") & not_deleted("deleted")).select(
        "business_id", "created_at", "transaction_id", "amount", F.lit(False).alias("is_login"))
    counts = [Feature(f.name, "count", None, F.col("is_login"), f.days, f.rule) for f in login_count_features()]
    feats = trailing_features(
        fx.purchase_anchors(spark, root), logins.unionByName(draws, allowMissingColumns=True), EVENT_ANCHOR,
        FactSpec("business_id", "created_at"),
        counts + [Feature("total_draw_count", "count", "transaction_id", ~F.col("is_login"), None, "OPEN_TS"),
                  Feature("total_amount_drawn", "sum", "amount", ~F.col("is_login"), None, "OPEN_TS")], as_double=False)
    first = _first_draw(spark, root).groupBy("lending_business_id").agg(
        F.min(F.struct("first_draw_date", "first_draw_amount", "business_id")).alias("f")).select("lending_business_id", "f.*")
    dec = fx.decisions(spark, root).where(
        not_deleted("deleted") & ~F.col("trigger_event").isin(K.EXCLUDED_DECISION_EVENTS)).withColumn(
        "credit_limit", F.coalesce(ordinal_map("lending_business_id", K.FX_LIMIT_OVERRIDES),
                                   F.col("new_limit").cast("double") / 100))
    lending = asof_latest(first, dec, "lending_business_id", "lending_business_id", "first_draw_date", "created_at",
                          ["credit_limit"], grain="date").drop("lending_business_id")
    profile = latest_per_key(fx.credit_profiles(spark, root).where("aggregate_kpis is not null and fico_score is not null"),
                             ["lending_business_id"], ["updated_at"])
    profile = json_fields(profile, "aggregate_kpis", {"kpi_k_value": ("k", "double")}).select(
        F.col("lending_business_id").alias("_p"), "kpi_k_value")
    out = feats.join(lending, F.col("user_id") == F.col("business_id"), "left").join(
        profile, F.col("user_id") == F.col("_p"), "left")
    return out.select(
        "user_id", "ts", "event_id", *[f.name for f in counts], *login_ratio_columns(), "total_draw_count",
        F.coalesce("total_amount_drawn", F.lit(0)).cast("bigint").alias("total_amount_drawn"), "first_draw_date",
        "first_draw_amount", "credit_limit", ratio("first_draw_amount", "credit_limit").alias("first_draw_utilisation"),
        F.datediff(F.to_date("ts"), F.col("first_draw_date")).alias("days_from_first_draw"), "kpi_k_value")


SQL_PROFILE_AS_OF = fx.with_views(f"""
SELECT lending_business_id, updated_at, fico_score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY lending_business_id ORDER BY updated_at DESC) AS rn
  FROM credit_profiles WHERE fico_score IS NOT NULL AND updated_at <= TIMESTAMP '{K.FX_PROFILE_AS_OF}')
WHERE rn = 1""", "credit_profiles")


@register("latest_profile_as_of", SQL_PROFILE_AS_OF)
def latest_profile_as_of(spark, root):
    """Latest profile per key as it stood at an instant."""
    p = fx.credit_profiles(spark, root).where("fico_score is not null")
    return latest_per_key(p, ["lending_business_id"], ["updated_at"], as_of=K.FX_PROFILE_AS_OF).select(
        "lending_business_id", "updated_at", "fico_score")


SQL_PATTERN_LISTS = f"""
SELECT p_partkey, p_name,
       {", ".join(f"CASE WHEN p_name ILIKE '%{s}%' THEN 1 ELSE 0 END AS is_{s}" for s in K.FX_PART_SIGNALS)}
FROM part WHERE {_ilike_or('p_name', K.FX_PART_INCLUDE)} AND NOT {_ilike_or('p_name', K.FX_PART_EXCLUDE)}"""


@register("pattern_lists", SQL_PATTERN_LISTS)
def pattern_lists(spark, root):
    """Any-of and none-of pattern lists of realistic length, inner ``%`` included, and a flag per
    signal of a list (P4, P5, P11)."""
    p = fx.table(spark, root, "part")
    p = p.where(ilike_any("p_name", K.FX_PART_INCLUDE) & ilike_none("p_name", K.FX_PART_EXCLUDE))
    return p.select("p_partkey", "p_name", *contains_flags("p_name", K.FX_PART_SIGNALS))


SQL_NESTED = """
SELECT conv_id, turn, role AS who, CAST(turn AS DOUBLE) AS depth
FROM conversations"""


@register("nested_json", SQL_NESTED)
def nested_json(spark, root):
    """Nested JSON paths with values: a document built from the row, text leaves cast."""
    c = fx.table(spark, root, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.struct(
        "role", F.struct(F.col("turn").cast("string").alias("at")).alias("place")).alias("meta"))).alias("doc"))
    return json_fields(c, "doc", {"who": ("meta.role", "string"), "depth": ("meta.place.at", "double")}, drop_source=True)


SQL_APPEND_TWICE = SQL_LOGIN_BASE.replace(
    "SELECT * FROM login_base",
    "SELECT CAST(created_at AS DATE) AS login_date, 2 * COUNT(*) AS n FROM login_base GROUP BY 1")


@register("append_twice", SQL_APPEND_TWICE)
def append_twice(spark, root):
    """The plain append: two runs double every count on reading back."""
    lb = _login_base(spark, root).withColumn("login_date", F.to_date("created_at"))
    path = scratch_path(spark, "append")
    append_table(lb, path, ["login_date"])
    append_table(lb, path, ["login_date"])
    return read_once(spark.read.parquet(path).groupBy(F.col("login_date").cast("date").alias("login_date")).agg(
        F.count(F.lit(1)).alias("n")), path)


SQL_KS_TEXT = SQL_KS_DECILES.replace(
    "SELECT * FROM ks_table", "SELECT decile, printf('%.2f%%', event_rate * 100) AS event_rate, "
                              "printf('%.2f%%', cum_eventrate * 100) AS cum_eventrate FROM ks_table")


@register("ks_deciles_text", SQL_KS_TEXT)
def ks_deciles_text(spark, root):
    """The decile table's rates as percent text with two decimals."""
    t = ks_table(fx.scored_orders(spark, root), "y", "p")
    return t.select("decile", percent_text("event_rate").alias("event_rate"),
                    percent_text("cum_eventrate").alias("cum_eventrate"))


SQL_EQUAL_WIDTH = """
SELECT bin, COUNT(*) AS n FROM (
  SELECT LEAST(10, GREATEST(1, CAST(CEIL((o_totalprice - lo) / (hi - lo) * 10) AS INTEGER))) AS bin
  FROM orders, (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders))
GROUP BY bin"""


@register("equal_width_bins", SQL_EQUAL_WIDTH)
def equal_width_bins(spark, root):
    """Rows per equal-width bin, the fallback of the quantile binning (M3)."""
    o = fx.table(spark, root, "orders")
    lo, hi = o.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()          # two numbers
    return o.select(bin_of_literals(F.col("o_totalprice"), equal_width_edges(lo, hi, 10)).alias("bin")).groupBy(
        "bin").agg(F.count(F.lit(1)).alias("n"))
