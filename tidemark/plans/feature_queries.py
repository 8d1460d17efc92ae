"""Registered queries: trailing windows and their fusion (build steps 1-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import ilike_any, ilike_none
from tidemark.operators.trailing import AnchorSpec, FactSpec, Feature, trailing_features
from tidemark.plans import constants as K
from tidemark.plans import fixtures as fx
from tidemark.plans.registry import register

ORDER_ANCHOR = AnchorSpec("o_custkey", "o_orderdate", ("o_orderkey",), unique=True, midnight=True)  # o_orderkey is the key
EVENT_ANCHOR = AnchorSpec("user_id", "ts", ("event_id",), unique=True)  # event_id is the key
TXN = FactSpec("entity_id", "txn_ts")
BAL = FactSpec("entity_id", "created_at")
CENTS = 100  # money columns of the fixtures are integer cents

# --------------------------------------------------------------------------- step 1

SQL_TRAILING_SUM_90D = fx.with_views("""
SELECT a.o_custkey, a.o_orderdate, a.o_orderkey,
       CAST(SUM(ABS(t.amount)) AS DOUBLE) AS credit_sum_90d,
       CASE WHEN COUNT(t.amount) > 0
            THEN CAST(SUM(ABS(t.amount)) AS DOUBLE) / COUNT(t.amount) END AS credit_avg_90d,
       COUNT(t.txn_id) AS credit_cnt_90d
FROM order_anchors a
LEFT JOIN transactions t
  ON a.o_custkey = t.entity_id AND t.txn_type = 'credit'
 AND CAST(t.txn_ts AS DATE) >= CAST(a.o_orderdate AS DATE) - 90
 AND CAST(t.txn_ts AS DATE) <= CAST(a.o_orderdate AS DATE)
GROUP BY a.o_custkey, a.o_orderdate, a.o_orderkey
""", "order_anchors", "transactions")


def credit_90d_features() -> list[Feature]:
    credit = F.col("txn_type") == "credit"
    return [Feature("credit_sum_90d", "sum", F.abs("amount"), credit, 90, "DD", CENTS),
            Feature("credit_avg_90d", "avg", F.abs("amount"), credit, 90, "DD", CENTS),
            Feature("credit_cnt_90d", "count", "txn_id", credit, 90, "DD")]


@register("trailing_sum_90d", SQL_TRAILING_SUM_90D)
def trailing_sum_90d(spark, root, strategy: str = "bucketed"):
    """Credit sum/avg/count over 90 calendar days (rule DD) per order anchor."""
    return trailing_features(fx.order_anchors(spark, root), fx.transactions(spark, root),
                             ORDER_ANCHOR, TXN, credit_90d_features(), strategy=strategy)


SQL_TRAILING_FOUR_RULES = fx.with_views("""
SELECT a.user_id, a.ts, a.event_id,
  COUNT(CASE WHEN CAST(f.ts AS DATE) >= CAST(a.ts AS DATE) - 7
              AND CAST(f.ts AS DATE) <= CAST(a.ts AS DATE) THEN f.event_id END) AS views_dd_7d,
  COUNT(CASE WHEN f.ts >= a.ts - INTERVAL 7 DAY
              AND f.ts <= CAST(CAST(a.ts AS DATE) AS TIMESTAMP) THEN f.event_id END) AS views_tt_7d,
  COUNT(CASE WHEN CAST(CAST(f.ts AS DATE) AS TIMESTAMP) >= a.ts - INTERVAL 7 DAY
              AND CAST(f.ts AS DATE) <= CAST(a.ts AS DATE) THEN f.event_id END) AS views_dt_7d,
  COUNT(CASE WHEN CAST(f.ts AS DATE) <= CAST(a.ts AS DATE) THEN f.event_id END) AS views_open,
  CAST(SUM(CASE WHEN CAST(f.ts AS DATE) >= CAST(a.ts AS DATE) - 7
              AND CAST(f.ts AS DATE) <= CAST(a.ts AS DATE)
              THEN CAST(f.value AS DECIMAL(18,2)) END) AS DOUBLE) AS value_dd_7d,
  CAST(SUM(CASE WHEN f.ts >= a.ts - INTERVAL 7 DAY
              AND f.ts <= CAST(CAST(a.ts AS DATE) AS TIMESTAMP)
              THEN CAST(f.value AS DECIMAL(18,2)) END) AS DOUBLE) AS value_tt_7d,
  CAST(SUM(CASE WHEN CAST(CAST(f.ts AS DATE) AS TIMESTAMP) >= a.ts - INTERVAL 7 DAY
              AND CAST(f.ts AS DATE) <= CAST(a.ts AS DATE)
              THEN CAST(f.value AS DECIMAL(18,2)) END) AS DOUBLE) AS value_dt_7d,
  CAST(SUM(CASE WHEN CAST(f.ts AS DATE) <= CAST(a.ts AS DATE)
              THEN CAST(f.value AS DECIMAL(18,2)) END) AS DOUBLE) AS value_open
FROM purchase_anchors a
LEFT JOIN events f ON f.event_type = 'view' AND f.user_id = a.user_id
GROUP BY a.user_id, a.ts, a.event_id
""", "purchase_anchors")


@register("trailing_four_rules", SQL_TRAILING_FOUR_RULES)
def trailing_four_rules(spark, root, strategy: str = "bucketed"):
    """The four boundary rules side by side on time-of-day data (views before purchases)."""
    anchors = fx.purchase_anchors(spark, root)
    views = (fx.table(spark, root, "events").where(F.col("event_type") == "view")
             .select("event_id", "user_id", "ts",
                     F.round(F.col("value") * 100).cast("bigint").alias("value")))
    feats = []
    for rule in ("DD", "TT", "DT", "OPEN"):
        suffix = "open" if rule == "OPEN" else f"{rule.lower()}_7d"
        days = None if rule == "OPEN" else 7
        feats += [Feature(f"views_{suffix}", "count", "event_id", None, days, rule),
                  Feature(f"value_{suffix}", "sum", "value", None, days, rule, CENTS)]
    feats = [f for f in feats if f.agg == "count"] + [f for f in feats if f.agg == "sum"]
    return trailing_features(anchors, views, EVENT_ANCHOR,
                             FactSpec("user_id", "ts"), feats, strategy=strategy)


# --------------------------------------------------------------------------- step 2


TRANSACTION_FEATURE_NAMES = [
    "total_credit_l3m", "avg_credit_l3m", "credit_txn_count_l3m",
    "total_debit_l3m", "avg_debit_l3m", "debit_txn_count_l3m",
    "total_credit_l1m", "avg_credit_l1m", "credit_txn_count_l1m",
    "total_debit_l1m", "avg_debit_l1m", "debit_txn_count_l1m",
    "card_total_l3m", "card_avg_l3m", "deposits_total_l3m", "deposits_avg_l3m",
    "loan_repayment_l3m", "loan_repayment_l1m", "recurring_credit_l1m", "recurring_credit_l3m",
]


def transaction_features() -> list[Feature]:
    """All transaction-table windows of the feature set, fused into one join."""
    credit = F.col("txn_type") == "credit"
    debit = F.col("txn_type") == "debit"
    card = debit & (F.col("medium") == K.FX_CARD_MEDIUM)
    deposits = (credit & (F.col("medium") == K.FX_DEPOSIT_MEDIUM)
                & ilike_any("description", K.FX_DEPOSIT_INCLUDE)
                & ilike_none("description", K.FX_DEPOSIT_EXCLUDE))
    loans = debit & (F.col("category") == K.FX_LOAN_CATEGORY)
    recurring = credit & F.col("category").isin(K.FX_RECURRING_CATEGORIES)
    amt = F.abs("amount")
    return [
        Feature("total_credit_l3m", "sum", amt, credit, 90, "DD", CENTS),
        Feature("avg_credit_l3m", "avg", amt, credit, 90, "DD", CENTS),
        Feature("credit_txn_count_l3m", "count", "txn_id", credit, 90, "DD"),
        Feature("total_debit_l3m", "sum", amt, debit, 90, "TT", CENTS),
        Feature("avg_debit_l3m", "avg", amt, debit, 90, "TT", CENTS),
        Feature("debit_txn_count_l3m", "count", "txn_id", debit, 90, "TT"),
        Feature("total_credit_l1m", "sum", amt, credit, 30, "TT", CENTS),
        Feature("avg_credit_l1m", "avg", amt, credit, 30, "TT", CENTS),
        Feature("credit_txn_count_l1m", "count", "txn_id", credit, 30, "TT"),
        Feature("total_debit_l1m", "sum", amt, debit, 30, "TT", CENTS),
        Feature("avg_debit_l1m", "avg", amt, debit, 30, "TT", CENTS),
        Feature("debit_txn_count_l1m", "count", "txn_id", debit, 30, "TT"),
        Feature("card_total_l3m", "sum", amt, card, 90, "TT", CENTS),
        Feature("card_avg_l3m", "avg", amt, card, 90, "TT", CENTS),
        Feature("deposits_total_l3m", "sum", amt, deposits, 90, "TT", CENTS),
        Feature("deposits_avg_l3m", "avg", amt, deposits, 90, "TT", CENTS),
        Feature("loan_repayment_l3m", "sum", amt, loans, 90, "DD", CENTS),
        Feature("loan_repayment_l1m", "sum", amt, loans, 30, "DD", CENTS),
        Feature("recurring_credit_l1m", "sum", amt, recurring, 30, "DD", CENTS),
        Feature("recurring_credit_l3m", "sum", amt, recurring, 90, "DD", CENTS),
    ]


def _sql_sum(name, cond, window):
    return (f"CAST(SUM(CASE WHEN {cond} AND {window} THEN ABS(t.amount) END) AS DOUBLE) AS {name}")


def _sql_avg(name, cond, window):
    x = f"CASE WHEN {cond} AND {window} THEN ABS(t.amount) END"
    return (f"CASE WHEN COUNT({x}) > 0 THEN CAST(SUM({x}) AS DOUBLE) / COUNT({x}) END AS {name}")


def _sql_cnt(name, cond, window):
    return f"COUNT(CASE WHEN {cond} AND {window} THEN t.txn_id END) AS {name}"


def _dd(n):
    return (f"CAST(t.txn_ts AS DATE) >= CAST(a.o_orderdate AS DATE) - {n} "
            f"AND CAST(t.txn_ts AS DATE) <= CAST(a.o_orderdate AS DATE)")


def _tt(n):
    return (f"t.txn_ts >= a.o_orderdate - INTERVAL {n} DAY "
            f"AND t.txn_ts <= CAST(CAST(a.o_orderdate AS DATE) AS TIMESTAMP)")


_CREDIT = "t.txn_type = 'credit'"
_DEBIT = "t.txn_type = 'debit'"
_CARD = f"t.txn_type = 'debit' AND t.medium = '{K.FX_CARD_MEDIUM}'"
_DEPOSITS = (f"t.txn_type = 'credit' AND t.medium = '{K.FX_DEPOSIT_MEDIUM}' AND ("
             + " OR ".join(f"t.description ILIKE '{p}'" for p in K.FX_DEPOSIT_INCLUDE)
             + ") AND NOT (" + " OR ".join(f"t.description ILIKE '{p}'" for p in K.FX_DEPOSIT_EXCLUDE)
             + ")")
_LOANS = f"t.txn_type = 'debit' AND t.category = '{K.FX_LOAN_CATEGORY}'"
_RECUR = ("t.txn_type = 'credit' AND t.category IN ("
          + ", ".join(f"'{c}'" for c in K.FX_RECURRING_CATEGORIES) + ")")

FUSED_BODY = f"""
SELECT a.o_custkey, a.o_orderdate, a.o_orderkey,
  {_sql_sum('total_credit_l3m', _CREDIT, _dd(90))},
  {_sql_avg('avg_credit_l3m', _CREDIT, _dd(90))},
  {_sql_cnt('credit_txn_count_l3m', _CREDIT, _dd(90))},
  {_sql_sum('total_debit_l3m', _DEBIT, _tt(90))},
  {_sql_avg('avg_debit_l3m', _DEBIT, _tt(90))},
  {_sql_cnt('debit_txn_count_l3m', _DEBIT, _tt(90))},
  {_sql_sum('total_credit_l1m', _CREDIT, _tt(30))},
  {_sql_avg('avg_credit_l1m', _CREDIT, _tt(30))},
  {_sql_cnt('credit_txn_count_l1m', _CREDIT, _tt(30))},
  {_sql_sum('total_debit_l1m', _DEBIT, _tt(30))},
  {_sql_avg('avg_debit_l1m', _DEBIT, _tt(30))},
  {_sql_cnt('debit_txn_count_l1m', _DEBIT, _tt(30))},
  {_sql_sum('card_total_l3m', _CARD, _tt(90))},
  {_sql_avg('card_avg_l3m', _CARD, _tt(90))},
  {_sql_sum('deposits_total_l3m', _DEPOSITS, _tt(90))},
  {_sql_avg('deposits_avg_l3m', _DEPOSITS, _tt(90))},
  {_sql_sum('loan_repayment_l3m', _LOANS, _dd(90))},
  {_sql_sum('loan_repayment_l1m', _LOANS, _dd(30))},
  {_sql_sum('recurring_credit_l1m', _RECUR, _dd(30))},
  {_sql_sum('recurring_credit_l3m', _RECUR, _dd(90))}
FROM order_anchors a
LEFT JOIN transactions t
  ON a.o_custkey = t.entity_id
 AND CAST(t.txn_ts AS DATE) >= CAST(a.o_orderdate AS DATE) - 91
 AND CAST(t.txn_ts AS DATE) <= CAST(a.o_orderdate AS DATE)
GROUP BY a.o_custkey, a.o_orderdate, a.o_orderkey
"""
SQL_TRAILING_FUSED = fx.with_views(FUSED_BODY, "order_anchors", "transactions")


@register("trailing_fused", SQL_TRAILING_FUSED)
def trailing_fused(spark, root, strategy: str = "bucketed"):
    """Twenty transaction windows (three rules, two lengths, six filters) in one pass."""
    return trailing_features(fx.order_anchors(spark, root), fx.transactions(spark, root),
                             ORDER_ANCHOR, TXN, transaction_features(), strategy=strategy)


SQL_OPEN_BALANCE = fx.with_views(f"""
SELECT a.o_custkey, a.o_orderdate, a.o_orderkey,
       CAST(SUM(b.balance) AS DOUBLE) AS reserves_balance_sum
FROM order_anchors a
LEFT JOIN account_balances b
  ON a.o_custkey = b.entity_id AND b.status = '{K.FX_RESERVE_STATUS}'
 AND CAST(b.created_at AS DATE) <= CAST(a.o_orderdate AS DATE)
GROUP BY a.o_custkey, a.o_orderdate, a.o_orderkey
""", "order_anchors", "account_balances")


@register("open_balance_to_date", SQL_OPEN_BALANCE)
def open_balance_to_date(spark, root, strategy: str = "bucketed"):
    """Open-ended past sum (rule OPEN): balance of all earlier active rows."""
    return trailing_features(
        fx.order_anchors(spark, root), fx.account_balances(spark, root), ORDER_ANCHOR, BAL,
        [Feature("reserves_balance_sum", "sum", "balance",
                 F.col("status") == K.FX_RESERVE_STATUS, None, "OPEN", CENTS)], strategy=strategy)


_USAGE_IN = ", ".join(f"'{s}'" for s in K.FX_USAGE_STATUSES)
SQL_USAGE_FLAG = fx.with_views(f"""
SELECT DISTINCT a.o_custkey, a.o_orderdate, a.o_orderkey,
       CASE WHEN b.entity_id IS NOT NULL THEN 1 ELSE 0 END AS invoice_usage_flag
FROM order_anchors a
LEFT JOIN account_balances b
  ON a.o_custkey = b.entity_id AND b.status IN ({_USAGE_IN})
 AND CAST(b.created_at AS DATE) <= CAST(a.o_orderdate AS DATE)
""", "order_anchors", "account_balances")


@register("usage_flag", SQL_USAGE_FLAG)
def usage_flag(spark, root, strategy: str = "bucketed"):
    """0/1 existence of any earlier qualifying row (A3)."""
    return trailing_features(
        fx.order_anchors(spark, root), fx.account_balances(spark, root), ORDER_ANCHOR, BAL,
        [Feature("invoice_usage_flag", "exists", None,
                 F.col("status").isin(K.FX_USAGE_STATUSES), None, "OPEN")], strategy=strategy)


_INV_IN = ", ".join(f"'{s}'" for s in K.FX_INVOICE_STATUSES)
SQL_INVOICE_WINDOW = fx.with_views(f"""
SELECT a.o_custkey, a.o_orderdate, a.o_orderkey,
       CAST(SUM(b.balance) AS DOUBLE) AS invoice_amount_sum_l3m,
       CASE WHEN COUNT(b.balance) > 0
            THEN CAST(SUM(b.balance) AS DOUBLE) / COUNT(b.balance) END AS invoice_avg_txn_amt_l3m
FROM order_anchors a
LEFT JOIN account_balances b
  ON a.o_custkey = b.entity_id AND b.status IN ({_INV_IN})
 AND CAST(CAST(b.created_at AS DATE) AS TIMESTAMP) >= a.o_orderdate - INTERVAL 90 DAY
 AND CAST(b.created_at AS DATE) <= CAST(a.o_orderdate AS DATE)
GROUP BY a.o_custkey, a.o_orderdate, a.o_orderkey
""", "order_anchors", "account_balances")


@register("invoice_window", SQL_INVOICE_WINDOW)
def invoice_window(spark, root, strategy: str = "bucketed"):
    """Plain sum/avg over a date-vs-timestamp window (rule DT, A2)."""
    cond = F.col("status").isin(K.FX_INVOICE_STATUSES)
    return trailing_features(
        fx.order_anchors(spark, root), fx.account_balances(spark, root), ORDER_ANCHOR, BAL,
        [Feature("invoice_amount_sum_l3m", "sum", "balance", cond, 90, "DT", CENTS),
         Feature("invoice_avg_txn_amt_l3m", "avg", "balance", cond, 90, "DT", CENTS)],
        strategy=strategy)
