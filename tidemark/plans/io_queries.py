"""Registered queries: CSV source and table sinks (build step 11: S2-S6, F9).

Scratch output goes under the shared checkpoint directory named by the session
(``spark.checkpoint.dir``), never a machine-local folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir, cut_lineage, drop_path
from tidemark.sources import (append_once, append_table, copy_column, keep_columns, lower_columns, overwrite_partitions,
                              read_committed, read_csv, write_attempt)
from tidemark.plans import constants as K
from tidemark.plans import fixtures as fx
from tidemark.plans.lookup_queries import SQL_LABELLED, _login_base, SQL_LOGIN_BASE
from tidemark.plans.registry import register
from tidemark.operators.asof import not_in


def scratch_path(spark, name: str) -> str:
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tidemark-io/{name}-{uuid.uuid4().hex}"


def read_once(back, path: str):
    """What was read back from a scratch path, which is removed."""
    kept = cut_lineage(back)
    drop_path(back.sparkSession, path)
    return kept


CSV_SCHEMA = ("BUSINESS_ID long, TRANSACTION_ID long, AMOUNT double, TYPE string, "
              "DESCRIPTION string, TRANSACTION_DATE string, PREDICTED_TARGET string")

_PRED_SQL = SQL_LABELLED[SQL_LABELLED.index("UNION ALL") + len("UNION ALL"):]
SQL_CSV = SQL_LABELLED[:SQL_LABELLED.index("SELECT DISTINCT")] + _PRED_SQL


@register("csv_roundtrip", SQL_CSV)
def csv_roundtrip(spark, root):
    """Unlabelled transactions with a predicted category written as CSV (upper-case
    header, text dates), read back with an explicit schema, timestamps parsed,
    names lower-cased, the prediction copied to the category column and a column
    list kept (S2, S3, S4, S5, F9)."""
    o = fx.table(spark, root, "orders")
    labels = (o.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("transaction_id"))
              .union(o.where(F.col("o_orderstatus").isin("F", "O") & (F.col("o_totalprice") > 100000))
                     .select(F.col("o_orderkey").alias("transaction_id"))))
    t = fx.transactions(spark, root)
    lo, hi = F.lit(K.FX_LABEL_FROM).cast("date"), F.lit(K.FX_LABEL_TO).cast("date")
    t = t.where((F.to_date("txn_ts") >= lo) & (F.to_date("txn_ts") < hi))
    pred = not_in(t, "txn_id", labels, "transaction_id").select(
        F.col("entity_id").alias("BUSINESS_ID"), F.col("txn_id").alias("TRANSACTION_ID"),
        (F.abs("amount") / 100.0).alias("AMOUNT"), F.col("txn_type").alias("TYPE"),
        F.col("description").alias("DESCRIPTION"),
        F.date_format("txn_ts", "yyyy-MM-dd HH:mm:ss").alias("TRANSACTION_DATE"),
        F.col("category").alias("PREDICTED_TARGET"))
    path = scratch_path(spark, "predictions-csv")
    pred.write.mode("overwrite").option("header", "true").csv(path)
    back = lower_columns(read_csv(spark, path, CSV_SCHEMA, ("TRANSACTION_DATE",),
                                  "yyyy-MM-dd HH:mm:ss"))
    back = copy_column(back, "predicted_target", "txn_category").withColumnRenamed("type", "txn_type")
    return read_once(keep_columns(back, ["business_id", "transaction_id", "amount", "txn_type", "description",
                                         "transaction_date", "txn_category"]), path)


SQL_APPEND = SQL_LOGIN_BASE.replace(
    "SELECT * FROM login_base", "SELECT *, CAST(created_at AS DATE) AS login_date FROM login_base")


@register("append_table", SQL_APPEND)
def append_table_query(spark, root):
    """Login base written to a date-partitioned table twice (a re-run): the idempotent
    sink replaces the partitions it writes, so the read-back holds each row once (S6).
    ``append_table`` is the plain append of the original (each run adds rows)."""
    lb = _login_base(spark, root).withColumn("login_date", F.to_date("created_at"))
    path = scratch_path(spark, "login-base")
    overwrite_partitions(lb, path, ["login_date"])
    overwrite_partitions(lb, path, ["login_date"])      # re-run: no duplicates
    back = spark.read.parquet(path)
    return read_once(back.select("business_id", "external_user_id", "created_at",
                                 F.col("login_date").cast("date").alias("login_date")), path)


@register("append_exactly_once", SQL_LOGIN_BASE.replace(
    "SELECT * FROM login_base", "SELECT *, CASE WHEN business_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run FROM login_base"))
def append_exactly_once(spark, root):
    """Login base appended in two batches, the first of them run again and one attempt lost before its
    commit: the read-back holds each row once, with the run that brought it (S6)."""
    lb = cut_lineage(_login_base(spark, root))
    even, odd = lb.where("business_id % 2 = 0"), lb.where("business_id % 2 <> 0")
    path = scratch_path(spark, "login-batches")
    append_once(even, path, "even")
    write_attempt(odd, path, "odd", "lost")             # a writer that died before the commit
    append_once(odd, path, "odd")
    append_once(even, path, "even")                     # a re-run: nothing is added
    return read_once(read_committed(spark, path, with_run=True).withColumnRenamed("_run", "run"), path)


__all__ = ["append_table", "csv_roundtrip", "append_table_query", "append_exactly_once"]
