"""Role views over the driver tables (FIXTURES.md part 2).

Each Spark view has a SQL twin (``SQL_VIEWS``) used by the DuckDB oracle, so the
oracle queries start from the same inputs.  Money is held exactly: integer cents
in Spark (primitive long sums, exact and independent of partitioning), DECIMAL(18,2)
in the SQL twin; both give the same double once divided at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import read_table


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_table(spark, root, name)


def order_anchors(spark: SparkSession, root: str) -> DataFrame:
    """Anchors at day grain: one per order (entity o_custkey, as-of o_orderdate)."""
    return table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderdate")


def purchase_anchors(spark: SparkSession, root: str) -> DataFrame:
    """Anchors with time of day: purchase events."""
    return (table(spark, root, "events").where(F.col("event_type") == "purchase")
            .select("event_id", "user_id", "ts"))


def transactions(spark: SparkSession, root: str) -> DataFrame:
    """Labelled transactions: lineitem x orders x part."""
    li = table(spark, root, "lineitem")
    o = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, root, "part").select("p_partkey", "p_type", "p_name")
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")  # cents
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(p, li.l_partkey == p.p_partkey)
              .select(F.col("l_orderkey").alias("txn_id"),
                      F.col("o_custkey").alias("entity_id"),
                      F.col("l_shipdate").alias("txn_ts"),
                      F.when(F.col("l_returnflag") == "R", -price).otherwise(price).alias("amount"),
                      F.when(F.col("l_linestatus") == "F", "credit").otherwise("debit").alias("txn_type"),
                      F.col("l_returnflag").alias("medium"),
                      F.col("p_type").alias("category"),
                      F.col("p_name").alias("description")))


def account_balances(spark: SparkSession, root: str) -> DataFrame:
    """Reserves / invoices stand-in: orders of the customer, booked a day later (an
    anchor's own order is not part of its balances)."""
    return table(spark, root, "orders").select(
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderstatus").alias("status"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("balance"),  # cents
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(1))).alias("created_at"))


def flagged_accounts(spark: SparkSession, root: str) -> DataFrame:
    """Flagged-account sheet: users with an 'error' event of value > 200."""
    return (table(spark, root, "events")
            .where((F.col("event_type") == "error") & (F.col("value") > 200))
            .select(F.col("user_id").alias("business_id"), F.col("ts").alias("flagged_at")))


def segment_users(spark: SparkSession, root: str) -> DataFrame:
    """User map: one internal and one external user per customer."""
    return table(spark, root, "customer").select(
        F.col("c_custkey").alias("business_id"),
        (F.col("c_custkey") * 10).alias("user_id"),
        F.col("c_custkey").alias("segment_user_id"))


def login_events(spark: SparkSession, root: str) -> DataFrame:
    """Login events: 'view' events with a status, a risk score, a languages text and
    a client name."""
    e = table(spark, root, "events").where(F.col("event_type") == "view")
    return e.select(
        "event_id",
        F.col("user_id").alias("external_user_id"),
        F.col("ts").alias("created_at"),
        F.when(F.col("value") > 5, "login_succeeded").otherwise("login_failed").alias("status"),
        (F.col("value") / 100.0).alias("risk_score"),
        F.col("props").alias("languages"),
        F.concat(F.lit("sdk-"), F.col("event_type"), F.lit("-v1")).alias("client_name"))


def login_responses(spark: SparkSession, root: str) -> DataFrame:
    """JSON login responses: 'click' events whose JSON ``k`` is below 50."""
    e = table(spark, root, "events").where(F.col("event_type") == "click")
    k = F.get_json_object(F.col("props"), "$.k").try_cast("int")
    return e.where(k < 50).select(F.col("user_id").alias("external_user_id"),
                                  F.col("ts").alias("created_at"))


def draws(spark: SparkSession, root: str) -> DataFrame:
    """Lending transactions: purchase events, amount in cents, soft-delete flag."""
    e = table(spark, root, "events").where(F.col("event_type") == "purchase")
    return e.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("business_id"),
        F.col("user_id").alias("lending_business_id"),
        F.col("ts").alias("created_at"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount"),
        F.when(F.col("value") > 10, "mca draw payout").otherwise("fee").alias("description"),
        F.when(F.col("value") > 300, F.lit(True)).when(F.col("value") < 20, F.lit(None))
         .otherwise(F.lit(False)).alias("deleted"))


def decisions(spark: SparkSession, root: str) -> DataFrame:
    """Decision history: signup events, limit in cents, trigger and soft-delete flag."""
    e = table(spark, root, "events").where(F.col("event_type") == "signup")
    return e.select(
        F.col("user_id").alias("lending_business_id"),
        F.col("ts").alias("created_at"),
        F.round(F.col("value") * 1000).cast("bigint").alias("new_limit"),
        F.when(F.col("value") < 10, "Lending Application Denied").otherwise("Limit Update")
         .alias("trigger_event"),
        F.when(F.col("value") > 340, F.lit(True)).alias("deleted"))


def credit_profiles(spark: SparkSession, root: str) -> DataFrame:
    """Credit profiles: signup events carry a JSON document and an update time."""
    e = table(spark, root, "events").where(F.col("event_type") == "signup")
    return e.select(F.col("user_id").alias("lending_business_id"),
                    F.col("props").alias("aggregate_kpis"),
                    F.col("value").alias("fico_score"),
                    F.col("ts").alias("updated_at"))


def label_expr():
    """Deterministic label: account balance, business type and price shares plus a
    pseudo-random share, above a threshold."""
    kind = (F.when(F.col("c_mktsegment") == "AUTOMOBILE", 1.0).when(F.col("c_mktsegment") == "BUILDING", 0.66)
            .when(F.col("c_mktsegment") == "FURNITURE", 0.33).otherwise(0.0))
    share = ((F.coalesce(F.col("c_acctbal"), F.lit(0.0)) + F.lit(1000.0)) / F.lit(11000.0) * F.lit(0.4)
             + kind * F.lit(0.25) + F.col("o_totalprice") / F.lit(500000.0) * F.lit(0.15)
             + (F.col("o_orderkey") * 7919 % 1000) / F.lit(1000.0) * F.lit(0.2))
    return F.when(share > 0.5, 1).otherwise(0)


def score_expr():
    return F.round(F.col("o_totalprice") / F.lit(500000.0), 3)


def scored_orders(spark: SparkSession, root: str) -> DataFrame:
    """Scored rows: one per order with label y and score p."""
    o = table(spark, root, "orders")
    c = table(spark, root, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(
        "o_orderkey", "o_custkey", "o_totalprice", label_expr().alias("y"),
        score_expr().alias("p"))


def businesses(spark: SparkSession, root: str) -> DataFrame:
    """Entity attributes: customer x nation (state, business type, a text flag)."""
    c = table(spark, root, "customer")
    n = table(spark, root, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        F.col("c_custkey"), F.col("c_acctbal"), F.col("n_name").alias("state"),
        F.col("c_mktsegment").alias("business_type"),
        F.when(F.col("c_name").like("%0"), 1).otherwise(0).alias("email_flag"))


SQL_VIEWS = {
    "order_anchors": "SELECT o_orderkey, o_custkey, o_orderdate FROM orders",
    "purchase_anchors": ("SELECT event_id, user_id, ts FROM events "
                         "WHERE event_type = 'purchase'"),
    "transactions": """
        SELECT l.l_orderkey AS txn_id, o.o_custkey AS entity_id, l.l_shipdate AS txn_ts,
               CASE WHEN l.l_returnflag = 'R' THEN -CAST(l.l_extendedprice AS DECIMAL(18,2))
                    ELSE CAST(l.l_extendedprice AS DECIMAL(18,2)) END AS amount,
               CASE WHEN l.l_linestatus = 'F' THEN 'credit' ELSE 'debit' END AS txn_type,
               l.l_returnflag AS medium, p.p_type AS category, p.p_name AS description
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                        JOIN part p ON l.l_partkey = p.p_partkey""",
    "account_balances": """
        SELECT o_custkey AS entity_id, o_orderstatus AS status,
               CAST(o_totalprice AS DECIMAL(18,2)) AS balance,
               o_orderdate + INTERVAL 1 DAY AS created_at
        FROM orders""",
    "flagged_accounts": ("SELECT user_id AS business_id, ts AS flagged_at FROM events "
                         "WHERE event_type = 'error' AND value > 200"),
    "segment_users": ("SELECT c_custkey AS business_id, c_custkey * 10 AS user_id, "
                      "c_custkey AS segment_user_id FROM customer"),
    "login_events": """
        SELECT event_id, user_id AS external_user_id, ts AS created_at,
               CASE WHEN value > 5 THEN 'login_succeeded' ELSE 'login_failed' END AS status,
               value / 100.0 AS risk_score, props AS languages,
               'sdk-' || event_type || '-v1' AS client_name
        FROM events WHERE event_type = 'view'""",
    "login_responses": """
        SELECT user_id AS external_user_id, ts AS created_at FROM events
        WHERE event_type = 'click' AND TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) < 50""",
    "draws": """
        SELECT event_id AS transaction_id, user_id AS business_id, user_id AS lending_business_id,
               ts AS created_at, CAST(ROUND(value * 100) AS BIGINT) AS amount,
               CASE WHEN value > 10 THEN 'mca draw payout' ELSE 'fee' END AS description,
               CASE WHEN value > 300 THEN TRUE WHEN value < 20 THEN NULL ELSE FALSE END AS deleted
        FROM events WHERE event_type = 'purchase'""",
    "decisions": """
        SELECT user_id AS lending_business_id, ts AS created_at,
               CAST(ROUND(value * 1000) AS BIGINT) AS new_limit,
               CASE WHEN value < 10 THEN 'Lending Application Denied' ELSE 'Limit Update' END
                 AS trigger_event,
               CASE WHEN value > 340 THEN TRUE END AS deleted
        FROM events WHERE event_type = 'signup'""",
    "credit_profiles": """
        SELECT user_id AS lending_business_id, props AS aggregate_kpis, value AS fico_score,
               ts AS updated_at
        FROM events WHERE event_type = 'signup'""",
    "scored_orders": """
        SELECT o_orderkey, o_custkey, o_totalprice,
               CASE WHEN (coalesce(c_acctbal, 0.0) + 1000.0) / 11000.0 * 0.4
                         + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN CAST(1.0 AS DOUBLE) WHEN 'BUILDING' THEN 0.66
                                WHEN 'FURNITURE' THEN 0.33 ELSE 0.0 END * 0.25
                         + o_totalprice / 500000.0 * 0.15
                         + ((o_orderkey * 7919) % 1000) / CAST(1000.0 AS DOUBLE) * 0.2 > 0.5 THEN 1 ELSE 0 END AS y,
               ROUND(o_totalprice / 500000.0, 3) AS p
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "businesses": """
        SELECT c.c_custkey, c.c_acctbal, n.n_name AS state, c.c_mktsegment AS business_type,
               CASE WHEN c.c_name LIKE '%0' THEN 1 ELSE 0 END AS email_flag
        FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
}


def with_views(sql: str, *names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """Prefix ``sql`` with the CTEs of the named fixture views, then ``extra`` CTEs."""
    parts = [f"{n} AS ({SQL_VIEWS[n]})" for n in names]
    parts += [f"{n} AS ({body})" for n, body in extra]
    return "WITH " + ",\n".join(parts) + "\n" + sql
