"""Registered queries: feature table, encodings, model matrix, selection and evaluation
(build steps 6-8)."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from tidemark.functions import day_diff, normalised_ratio, ordinal_map, ratio, replace_value
from tidemark.operators.encode import label_encode, model_matrix
from tidemark.operators.evaluate import cut_labels, ks_peak, ks_statistic, ks_table, roc_auc
from tidemark.operators.profile import percentile_name, univariate_profile
from tidemark.operators.selection import correlation_pairs, information_value
from tidemark.operators.sketches import merge_statistics, merged_profile, part_statistics
from tidemark.operators.trailing import Feature, trailing_features
from tidemark.plans import constants as K
from tidemark.plans import fixtures as fx
from tidemark.plans.feature_queries import (CENTS, FUSED_BODY, ORDER_ANCHOR, TXN,
                                            TRANSACTION_FEATURE_NAMES, transaction_features)
from tidemark.plans.registry import register
from tidemark.session import checkpoint_dir, cut_lineage, drop_path
from tidemark.sources import append_once, read_committed

KEYS = ["o_custkey", "o_orderdate", "o_orderkey"]

# Ratio definitions: (name, numerator, numerator units, denominator, denominator units)
RATIOS = [
    ("ratio_tot_debit_l1m_l3m", "total_debit_l1m", None, "total_debit_l3m", None),
    ("ratio_tot_credit_l1m_l3m", "total_credit_l1m", None, "total_credit_l3m", None),
    ("ratio_debit_txn_count_l1m_l3m", "debit_txn_count_l1m", None, "debit_txn_count_l3m", None),
    ("ratio_credit_txn_count_l1m_l3m", "credit_txn_count_l1m", None, "credit_txn_count_l3m", None),
    ("ratio_loan_repay_l1m_l3m", "loan_repayment_l1m", None, "loan_repayment_l3m", None),
    ("ratio_loan_repay_l1m_l3m_normalised", "loan_repayment_l1m", 1, "loan_repayment_l3m", 3),
    ("ratio_recurring_credit_l1m_l3m", "recurring_credit_l1m", None, "recurring_credit_l3m", None),
    ("ratio_recurring_credit_l1m_l3m_normalised", "recurring_credit_l1m", 1,
     "recurring_credit_l3m", 3),
]


BALANCE_FEATURE_NAMES = ["reserves_balance_sum", "invoice_usage_flag", "invoice_amount_sum_l3m"]


def balance_features() -> list[Feature]:
    return [
        Feature("reserves_balance_sum", "sum", "balance",
                F.col("status") == K.FX_RESERVE_STATUS, None, "OPEN", CENTS),
        Feature("invoice_usage_flag", "exists", None,
                F.col("status").isin(K.FX_USAGE_STATUSES), None, "OPEN"),
        Feature("invoice_amount_sum_l3m", "sum", "balance",
                F.col("status").isin(K.FX_INVOICE_STATUSES), 90, "DT", CENTS),
    ]


def ratio_columns():
    out = []
    for name, num, nu, den, du in RATIOS:
        expr = ratio(num, den) if nu is None else normalised_ratio(num, nu, den, du)
        out.append(expr.alias(name))
    return out


def _sql_ratio(num: str, den: str) -> str:
    return (f"CASE WHEN {num} IS NULL OR {den} IS NULL THEN NULL "
            f"WHEN {den} <> 0 THEN CAST({num} AS DOUBLE) / {den} "
            f"WHEN {num} = 0 THEN 'NaN'::DOUBLE WHEN {num} > 0 THEN 'Infinity'::DOUBLE "
            f"ELSE '-Infinity'::DOUBLE END")


def _sql_ratio_cols() -> str:
    parts = []
    for name, num, nu, den, du in RATIOS:
        if nu is None:
            parts.append(f"{_sql_ratio(num, den)} AS {name}")
        else:
            parts.append(f"{_sql_ratio(f'(CAST({num} AS DOUBLE) / {float(nu)})',
                                       f'(CAST({den} AS DOUBLE) / {float(du)})')} AS {name}")
    return ",\n  ".join(parts)


# --------------------------------------------------------------------------- step 6

def _anchor_rows(spark, root):
    """Narrow rows that the features are added to: key, payment, label, score, entity attributes and
    first order, with the number of orders of that key (``_times``) and of such rows (``_rows``)."""
    keys = fx.order_anchors(spark, root).repartition("o_orderkey").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_times"))
    orders = fx.scored_orders(spark, root).select("o_orderkey", "o_totalprice", "y", "p")
    first_order = (fx.table(spark, root, "orders").groupBy("o_custkey")
                   .agg(F.min("o_orderdate").alias("first_order_date")))
    # state 0 -> 100 replacement of the source: a no-op on the text state column
    biz, _ = label_encode(replace_value(fx.businesses(spark, root), "state", 0, 100),
                          "state", "state_encoded")
    t = keys.join(orders, "o_orderkey")
    t = (t.join(biz, t.o_custkey == biz.c_custkey, "left").drop("c_custkey")
         .join(first_order, "o_custkey", "left"))
    return t.groupBy(*t.columns).agg(F.count(F.lit(1)).alias("_rows"))


def feature_table_df(spark, root, strategy: str = "bucketed"):
    """Anchors + every trailing feature (transactions and balances fused into ONE join
    and ONE aggregation), entity attributes, encodings, account age and ratios.  The
    attributes are joined to the bare keys; the wide rows are not moved again."""
    txn = fx.transactions(spark, root)
    bal = fx.account_balances(spark, root).withColumnRenamed("created_at", "txn_ts")
    facts = txn.unionByName(bal, allowMissingColumns=True)
    feats = transaction_features() + balance_features()
    rows = _anchor_rows(spark, root)
    t = trailing_features(fx.order_anchors(spark, root), facts, ORDER_ANCHOR, TXN, feats, strategy=strategy,
                          rows=rows, times="_times")
    t = t.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    return t.select("o_custkey", "o_orderkey", "o_orderdate", *[f.name for f in feats], "o_totalprice", "y", "p",
                    "state", "c_acctbal", "business_type", "email_flag", "state_encoded",
                    ordinal_map("business_type", K.FX_BUSINESS_TYPE_ORDER).alias("business_type_mapped"),
                    day_diff("o_orderdate", "first_order_date").alias("days_from_first_order"), *ratio_columns())


_BAL_BODY = f"""
SELECT a.o_custkey, a.o_orderdate, a.o_orderkey,
  CAST(SUM(CASE WHEN b.status = '{K.FX_RESERVE_STATUS}'
                 AND CAST(b.created_at AS DATE) <= CAST(a.o_orderdate AS DATE)
                THEN b.balance END) AS DOUBLE) AS reserves_balance_sum,
  MAX(CASE WHEN b.status IN ({", ".join(f"'{s}'" for s in K.FX_USAGE_STATUSES)})
                 AND CAST(b.created_at AS DATE) <= CAST(a.o_orderdate AS DATE)
           THEN 1 ELSE 0 END) AS invoice_usage_flag,
  CAST(SUM(CASE WHEN b.status IN ({", ".join(f"'{s}'" for s in K.FX_INVOICE_STATUSES)})
                 AND CAST(CAST(b.created_at AS DATE) AS TIMESTAMP) >= a.o_orderdate - INTERVAL 90 DAY
                 AND CAST(b.created_at AS DATE) <= CAST(a.o_orderdate AS DATE)
                THEN b.balance END) AS DOUBLE) AS invoice_amount_sum_l3m
FROM order_anchors a LEFT JOIN account_balances b ON a.o_custkey = b.entity_id
GROUP BY a.o_custkey, a.o_orderdate, a.o_orderkey"""

_CODES_BODY = """
SELECT state, CAST(DENSE_RANK() OVER (ORDER BY state) - 1 AS INTEGER) AS state_encoded
FROM (SELECT DISTINCT state FROM businesses WHERE state IS NOT NULL)"""

_BT_CASE = ("CASE " + " ".join(f"WHEN b.business_type = '{k}' THEN {v}"
                               for k, v in K.FX_BUSINESS_TYPE_ORDER.items()) + " END")

_FT_BODY = f"""
SELECT f.*, x.reserves_balance_sum, x.invoice_usage_flag, x.invoice_amount_sum_l3m,
  s.o_totalprice, s.y, s.p, b.c_acctbal, b.state, b.business_type, b.email_flag,
  c.state_encoded, {_BT_CASE} AS business_type_mapped,
  CAST(date_diff('day', CAST(fo.first_order_date AS DATE), CAST(f.o_orderdate AS DATE)) AS INTEGER)
    AS days_from_first_order,
  {_sql_ratio_cols()}
FROM fused f
JOIN bal x USING (o_custkey, o_orderdate, o_orderkey)
JOIN scored_orders s ON s.o_orderkey = f.o_orderkey
LEFT JOIN businesses b ON f.o_custkey = b.c_custkey
LEFT JOIN codes c ON b.state = c.state
LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_order_date FROM orders GROUP BY 1) fo
  ON f.o_custkey = fo.o_custkey"""

FT_VIEWS = ("order_anchors", "transactions", "account_balances", "scored_orders", "businesses")
FT_CTES = (("fused", FUSED_BODY), ("bal", _BAL_BODY), ("codes", _CODES_BODY),
           ("feature_table", _FT_BODY))

SQL_FEATURE_TABLE = fx.with_views("SELECT * FROM feature_table", *FT_VIEWS, extra=FT_CTES)


@register("feature_table", SQL_FEATURE_TABLE)
def feature_table(spark, root, strategy: str = "bucketed"):
    """The assembled one-row-per-anchor feature table."""
    return feature_table_df(spark, root, strategy)


SQL_RATIOS = fx.with_views(
    f"SELECT o_custkey, o_orderdate, o_orderkey,\n  {_sql_ratio_cols()}\nFROM fused",
    "order_anchors", "transactions", extra=(("fused", FUSED_BODY),))


@register("ratios", SQL_RATIOS)
def ratios(spark, root):
    """Short/long window ratios with float semantics: x/0 = +-inf, 0/0 = NaN."""
    feats = trailing_features(fx.order_anchors(spark, root), fx.transactions(spark, root),
                              ORDER_ANCHOR, TXN,
                              transaction_features())
    return feats.select(*KEYS, *ratio_columns())


SQL_AGE_DAYS = """
SELECT o.o_orderkey,
       CAST(date_diff('day', CAST(f.first_order_date AS DATE), CAST(o.o_orderdate AS DATE)) AS INTEGER)
         AS days_from_first_order,
       CAST(date_diff('day', CAST(o.o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER)
         AS days_to_cutoff
FROM orders o JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_order_date FROM orders GROUP BY 1) f
  ON o.o_custkey = f.o_custkey
"""


@register("age_days", SQL_AGE_DAYS)
def age_days(spark, root):
    """Whole calendar days between dates/timestamps."""
    o = fx.table(spark, root, "orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order_date"))
    return o.join(first, "o_custkey").select(
        "o_orderkey", day_diff("o_orderdate", "first_order_date").alias("days_from_first_order"),
        day_diff(F.lit("2002-01-01").cast("date"), "o_orderdate").alias("days_to_cutoff"))


SQL_LABEL_ENCODE = fx.with_views("SELECT state, state_encoded FROM codes", "businesses",
                                 extra=(("codes", _CODES_BODY),))


@register("label_encode", SQL_LABEL_ENCODE)
def label_encode_query(spark, root):
    """Codes 0..k-1 in sorted order and the inverse mapping table."""
    _, mapping = label_encode(fx.businesses(spark, root), "state", "state_encoded")
    return mapping


SQL_ORDINAL = fx.with_views(
    f"SELECT b.c_custkey, b.business_type, {_BT_CASE} AS business_type_mapped FROM businesses b",
    "businesses")


@register("ordinal_encode", SQL_ORDINAL)
def ordinal_encode_query(spark, root):
    """Dictionary encoding in a given order; unmapped -> NULL."""
    b = fx.businesses(spark, root)
    return b.select("c_custkey", "business_type",
                    ordinal_map("business_type", K.FX_BUSINESS_TYPE_ORDER).alias(
                        "business_type_mapped"))


# model matrix ----------------------------------------------------------------

MATRIX_DROP = ["o_custkey", "o_orderdate", "state", "business_type", "p", "o_totalprice"]
MATRIX_KEEP = ["o_orderkey"]


def model_matrix_df(spark, root):
    return model_matrix(feature_table_df(spark, root), "y", MATRIX_DROP, MATRIX_KEEP)


def stored_table(spark, root, name: str, key: str, build):
    """A derived table built once per application and input folder, stored as Parquet under the
    checkpoint folder in buckets of ``key``: later readers scan the columns they need, and joins
    and aggregates on the key take its buckets as they lie."""
    app = spark.conf.get("spark.app.id")
    table = f"tidemark_{name}_{hashlib.md5(f'{app}|{root}'.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(table):
        n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        build().repartition(n, key).write.bucketBy(n, key).sortBy(key).option(
            "path", f"{checkpoint_dir(spark)}/tidemark-tables/{app}/{table}").mode("overwrite").saveAsTable(table)
    return spark.table(table)


def feature_table_cut(spark, root):
    """The stored feature table: what M1, M2, M17 and M21 read."""
    return stored_table(spark, root, "features", "o_orderkey", lambda: feature_table_df(spark, root))


def model_matrix_cut(spark, root):
    """Model matrix of the stored feature table."""
    return model_matrix(feature_table_cut(spark, root), "y", MATRIX_DROP, MATRIX_KEEP)


def _matrix_features() -> list[str]:
    """Numeric feature columns of the model matrix, in feature-table order."""
    names = TRANSACTION_FEATURE_NAMES + BALANCE_FEATURE_NAMES
    names += ["c_acctbal", "email_flag", "state_encoded", "business_type_mapped",
              "days_from_first_order"] + [r[0] for r in RATIOS]
    return names


def _sql_finite(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)) OR isinf(CAST({c} AS DOUBLE)) "
            f"THEN 0.0 ELSE CAST({c} AS DOUBLE) END AS {c}")


_MM_BODY = ("SELECT o_orderkey, " + ", ".join(_sql_finite(c) for c in _matrix_features())
            + ", CAST(y AS INTEGER) AS y FROM feature_table")
MM_CTES = FT_CTES + (("model_matrix", _MM_BODY),)
SQL_MODEL_MATRIX = fx.with_views("SELECT * FROM model_matrix", *FT_VIEWS, extra=MM_CTES)


@register("model_matrix", SQL_MODEL_MATRIX)
def model_matrix_query(spark, root):
    """Drop list, non-finite -> 0, integer label."""
    return model_matrix_df(spark, root)


# --------------------------------------------------------------------------- step 7

def _unpivot(src: str, cols: list[str]) -> str:
    return (f"SELECT feature, value, y FROM (UNPIVOT {src} ON "
            + ", ".join(cols) + " INTO NAME feature VALUE value)")


_PROBS = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"
_IV_BODY = f"""
SELECT n.feature, ROUND(COALESCE(i.iv, 0.0), 10) AS iv
FROM (SELECT UNNEST({[c for c in _matrix_features()]}) AS feature) n
LEFT JOIN (
  SELECT feature, SUM(CASE WHEN ev_total = 0 OR ne_total = 0 THEN NULL
                           WHEN ev = 0 OR ne = 0 THEN 'Infinity'::DOUBLE
                           ELSE (ev / ev_total - ne / ne_total)
                                * ln((ev / ev_total) / (ne / ne_total)) END) AS iv
  FROM (
    SELECT feature, bin, CAST(ev AS DOUBLE) AS ev, CAST(ne AS DOUBLE) AS ne,
           CAST(SUM(ev) OVER (PARTITION BY feature) AS DOUBLE) AS ev_total,
           CAST(SUM(ne) OVER (PARTITION BY feature) AS DOUBLE) AS ne_total
    FROM (
      SELECT feature, bin, SUM(y) AS ev, COUNT(*) - SUM(y) AS ne
      FROM (
        SELECT l.feature, l.y, len(e.edges) AS n_edges,
               GREATEST(1, len(list_filter(e.edges, lambda x: x < l.value))) AS bin
        FROM long l JOIN edges e USING (feature)
      ) WHERE n_edges > 1 AND bin < n_edges
      GROUP BY feature, bin))
  GROUP BY feature) i USING (feature)"""

IV_CTES = MM_CTES + (
    ("long", _unpivot("model_matrix", _matrix_features())),
    ("edges", f"SELECT feature, list_sort(list_distinct(quantile_cont(value, {_PROBS}))) AS edges "
              "FROM long WHERE value IS NOT NULL GROUP BY feature"),
    ("iv_table", _IV_BODY))
SQL_IV = fx.with_views("SELECT * FROM iv_table", *FT_VIEWS, extra=IV_CTES)


@register("information_value", SQL_IV)
def information_value_query(spark, root):
    """IV of every model-matrix feature on 10 quantile bins, no smoothing."""
    mm = model_matrix_cut(spark, root)
    iv = information_value(mm, "y", _matrix_features(), bins=K.IV_BINS)
    return iv.select("feature", F.round("iv", 10).alias("iv"))


SQL_IV_FILTER = fx.with_views(
    f"SELECT feature FROM iv_table WHERE iv < {K.IV_THRESHOLD}", *FT_VIEWS, extra=IV_CTES)


@register("iv_filter", SQL_IV_FILTER)
def iv_filter_query(spark, root):
    """Features whose IV is below the threshold (+inf is kept) (M4)."""
    iv = information_value_query(spark, root)
    return iv.where(F.col("iv") < K.IV_THRESHOLD).select("feature")


def _corr_sql_body(cols: list[str]) -> str:
    exprs = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            a, b = cols[i], cols[j]
            exprs.append(f"CASE WHEN stddev_samp({a}) * stddev_samp({b}) = 0 THEN 'NaN'::DOUBLE "
                         f"ELSE covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) END "
                         f"AS \"{a}|{b}\"")
    one = "SELECT " + ", ".join(exprs) + " FROM model_matrix"
    return (f"SELECT split_part(pair, '|', 1) AS feature_i, split_part(pair, '|', 2) AS feature_j, "
            f"corr FROM (UNPIVOT ({one}) ON COLUMNS(*) INTO NAME pair VALUE corr)")


CORR_CTES = MM_CTES + (("pairs", _corr_sql_body(_matrix_features())),)
SQL_CORR_PAIRS = fx.with_views(
    "SELECT feature_i, feature_j, ROUND(corr, 10) AS corr FROM pairs", *FT_VIEWS, extra=CORR_CTES)


@register("correlation_pairs", SQL_CORR_PAIRS)
def correlation_pairs_query(spark, root):
    """Pearson correlation of every feature pair, one aggregate pass (M1)."""
    pairs = correlation_pairs(model_matrix_cut(spark, root), _matrix_features())
    return pairs.select("feature_i", "feature_j", F.round("corr", 10).alias("corr"))


SQL_CORR_PRUNE = fx.with_views(
    f"SELECT DISTINCT feature_j AS feature FROM pairs WHERE corr > {K.CORR_THRESHOLD}",
    *FT_VIEWS, extra=CORR_CTES)


@register("correlation_prune", SQL_CORR_PRUNE)
def correlation_prune(spark, root):
    """Columns dropped by the signed upper-triangle rule corr(i<j) > threshold (M1)."""
    pairs = correlation_pairs(model_matrix_cut(spark, root), _matrix_features())
    return pairs.where(F.col("corr") > K.CORR_THRESHOLD).select(
        F.col("feature_j").alias("feature")).distinct()


def _profile_columns() -> list[str]:
    return _matrix_features() + ["o_totalprice", "p"]


_PCTS = K.PROFILE_PERCENTILES
_PROFILE_BODY = f"""
SELECT n.feature, COALESCE(s.cnt, 0) AS count, ROUND(s.mean, 10) AS mean, ROUND(s.std, 10) AS std,
       s.min, {", ".join(f"ROUND(s.q[{i + 1}], 10) AS {percentile_name(p)}" for i, p in enumerate(_PCTS))},
       s.max, (SELECT COUNT(*) FROM feature_table) - COALESCE(s.cnt, 0) AS missing_count,
       1.0 - CAST(COALESCE(s.cnt, 0) AS DOUBLE) / (SELECT COUNT(*) FROM feature_table) AS missing_rate
FROM (SELECT UNNEST({_profile_columns()}) AS feature) n
LEFT JOIN (
  SELECT feature, COUNT(*) AS cnt, AVG(value) AS mean, STDDEV_SAMP(value) AS std, MIN(value) AS min,
         MAX(value) AS max, quantile_cont(value, {list(_PCTS)}) AS q
  FROM (SELECT feature, CAST(value AS DOUBLE) AS value
        FROM (UNPIVOT (SELECT {", ".join(_profile_columns())} FROM feature_table)
              ON {", ".join(_profile_columns())} INTO NAME feature VALUE value))
  WHERE value > 0 AND NOT isnan(value)
  GROUP BY feature) s USING (feature)"""

SQL_PROFILE = fx.with_views("SELECT * FROM profile", *FT_VIEWS,
                            extra=FT_CTES + (("profile", _PROFILE_BODY),))


@register("univariate_profile", SQL_PROFILE)
def univariate_profile_query(spark, root):
    """Positive-value percentiles, mean, std, min/max and missing rate per column."""
    prof = univariate_profile(feature_table_cut(spark, root), _profile_columns())
    rounded = ["mean", "std"] + [percentile_name(p) for p in _PCTS]
    return prof.select(*[F.round(c, 10).alias(c) if c in rounded else F.col(c)
                         for c in prof.columns])


_MERGED_PARTS = 4
SQL_MERGED_PROFILE = SQL_PROFILE.replace(
    "SELECT * FROM profile", "SELECT feature, count, ROUND(mean, 6) AS mean, ROUND(std, 6) AS std, min, max, missing_count, "
    "ROUND(missing_rate, 10) AS missing_rate FROM profile")


@register("merged_profile", SQL_MERGED_PROFILE)
def merged_profile_query(spark, root):
    """The profile of a table that grew by parts: each part's statistics are written once, one part
    runs again, and the profile comes from the stored rows (A10, M21, S6).  Its exact columns."""
    t = feature_table_cut(spark, root)
    path = f"{checkpoint_dir(spark)}/tidemark-io/profile-parts-{uuid.uuid4().hex}"
    for part in [*range(_MERGED_PARTS), 0]:
        mine = t.where(F.pmod("o_orderkey", F.lit(_MERGED_PARTS)) == part)
        append_once(part_statistics(mine, _profile_columns(), F.lit(part)), path, str(part))
    merged = cut_lineage(merge_statistics(read_committed(spark, path)))
    drop_path(spark, path)
    prof = merged_profile(merged, [])
    return prof.select("feature", "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max",
                       "missing_count", F.round("missing_rate", 10).alias("missing_rate"))


# --------------------------------------------------------------------------- step 8

_DIST = """
SELECT score, pos, neg,
       SUM(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
       SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg
FROM (SELECT CAST(p AS DOUBLE) AS score, SUM(y) AS pos, SUM(1 - y) AS neg
      FROM scored_orders GROUP BY 1)"""

SQL_ROC_AUC = fx.with_views("""
SELECT ROUND(SUM(CAST(pos AS DOUBLE) * (CAST(cum_neg - neg AS DOUBLE) + CAST(neg AS DOUBLE) / 2))
             / (CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE)), 10) AS auc,
       CAST(SUM(pos) AS BIGINT) AS positives, CAST(SUM(neg) AS BIGINT) AS negatives
FROM dist""", "scored_orders", extra=(("dist", _DIST),))


@register("roc_auc", SQL_ROC_AUC)
def roc_auc_query(spark, root):
    """Tie-aware ROC AUC from distinct-score counts and distributed prefix sums."""
    r = roc_auc(fx.scored_orders(spark, root), "y", "p")
    return r.select(F.round("auc", 10).alias("auc"), "positives", "negatives")


SQL_KS = fx.with_views("""
SELECT ROUND(GREATEST(MAX(CAST(P - (cum_pos - pos) AS DOUBLE) / P
                      - CAST(N - (cum_neg - neg) AS DOUBLE) / N), 0.0), 10) AS ks
FROM dist, (SELECT SUM(pos) AS P, SUM(neg) AS N FROM dist) t""", "scored_orders",
    extra=(("dist", _DIST),))


@register("ks_curve", SQL_KS)
def ks_curve(spark, root):
    """KS = max(TPR - FPR) over the ROC thresholds."""
    return ks_statistic(fx.scored_orders(spark, root), "y", "p").select(
        F.round("ks", 10).alias("ks"))


_KS_TABLE = f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY min_prob DESC) AS INTEGER) AS decile, min_prob, max_prob,
       events, nonevents, events + nonevents AS pop,
       ROUND(events / SUM(events) OVER (), 10) AS event_rate,
       ROUND(nonevents / SUM(nonevents) OVER (), 10) AS nonevent_rate,
       ROUND(SUM(events / E) OVER (ORDER BY min_prob DESC ROWS UNBOUNDED PRECEDING), 10) AS cum_eventrate,
       ROUND(SUM(nonevents / NE) OVER (ORDER BY min_prob DESC ROWS UNBOUNDED PRECEDING), 10)
         AS cum_noneventrate,
       ROUND_EVEN(SUM(events / E) OVER (ORDER BY min_prob DESC ROWS UNBOUNDED PRECEDING)
             - SUM(nonevents / NE) OVER (ORDER BY min_prob DESC ROWS UNBOUNDED PRECEDING), 3) * 100 AS ks,
       ROUND(events / (events + nonevents), 10) AS cure_rate
FROM (
  SELECT bucket, MIN(p) AS min_prob, MAX(p) AS max_prob, SUM(y) AS events,
         SUM(1 - y) AS nonevents,
         SUM(SUM(y)) OVER () AS E, SUM(SUM(1 - y)) OVER () AS NE
  FROM (SELECT CAST(s.p AS DOUBLE) AS p, CAST(s.y AS DOUBLE) AS y,
               GREATEST(1, len(list_filter(e.edges, lambda x: x < s.p))) AS bucket
        FROM scored_orders s,
             (SELECT list_sort(list_distinct(quantile_cont(CAST(p AS DOUBLE), {_PROBS}))) AS edges
              FROM scored_orders) e)
  GROUP BY bucket)"""

SQL_KS_DECILES = fx.with_views("SELECT * FROM ks_table", "scored_orders",
                               extra=(("ks_table", _KS_TABLE),))


def _round_table(t, cols):
    return t.select(*[F.round(c, 10).alias(c) if c in cols else F.col(c) for c in t.columns])


_KS_ROUND = ["event_rate", "nonevent_rate", "cum_eventrate", "cum_noneventrate", "cure_rate"]


@register("ks_deciles", SQL_KS_DECILES)
def ks_deciles(spark, root):
    """KS decile table on score quantiles."""
    return _round_table(ks_table(fx.scored_orders(spark, root), "y", "p"), _KS_ROUND)


SQL_KS_PEAK = fx.with_views(
    "SELECT MAX(ks) AS max_ks, CAST(MIN(decile) FILTER (WHERE ks = (SELECT MAX(ks) FROM ks_table)) "
    "AS INTEGER) AS at_decile FROM ks_table", "scored_orders", extra=(("ks_table", _KS_TABLE),))


@register("ks_peak", SQL_KS_PEAK)
def ks_peak_query(spark, root):
    """Largest KS of the decile table and its first decile (O3)."""
    return ks_peak(ks_table(fx.scored_orders(spark, root), "y", "p"))


def _sql_cut(score: str, cuts, labels, first_open: bool) -> str:
    parts = []
    if first_open:
        parts.append(f"WHEN {score} < {cuts[0]} THEN '{labels[0]}'")
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            parts.append(f"WHEN {score} >= {lo} AND {score} <= {hi} THEN '{labels[k + 1]}'")
    else:
        parts.append(f"WHEN {score} <= {cuts[0]} THEN '{labels[0]}'")
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            parts.append(f"WHEN {score} > {lo} AND {score} <= {hi} THEN '{labels[k + 1]}'")
    parts.append(f"WHEN {score} > {cuts[-1]} THEN '{labels[-1]}'")
    return "CASE " + " ".join(parts) + " END"


SQL_CUT_DECILES = fx.with_views(f"""
SELECT o_orderkey, p,
       {_sql_cut('p', K.CUTS_OVERALL, K.DECILE_LABELS, False)} AS decile_overall,
       {_sql_cut('p', K.CUTS_SMALL_PAYMENT, K.DECILE_LABELS, False)} AS decile_small,
       {_sql_cut('p', K.CUTS_LARGE_PAYMENT, K.DECILE_LABELS, True)} AS decile_large
FROM scored_orders""", "scored_orders")


@register("cut_deciles", SQL_CUT_DECILES)
def cut_deciles(spark, root):
    """Fixed score cut-offs to decile labels, first match wins."""
    s = fx.scored_orders(spark, root)
    return s.select("o_orderkey", "p",
                    cut_labels("p", K.CUTS_OVERALL, K.DECILE_LABELS).alias("decile_overall"),
                    cut_labels("p", K.CUTS_SMALL_PAYMENT, K.DECILE_LABELS).alias("decile_small"),
                    cut_labels("p", K.CUTS_LARGE_PAYMENT, K.DECILE_LABELS, first_open=True)
                    .alias("decile_large"))
