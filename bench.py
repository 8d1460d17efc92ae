"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is executed in full through the ``noop`` sink (every row computed,
nothing collected to the driver).  A warm-up over the same code paths on sf0.001
runs first and is not timed (JVM start, code generation, JIT).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "trailing_sum_90d",
    "trailing_fused",
    "trailing_four_rules",
    "login_counts",
    "asof_latest",
    "feature_table",
    "information_value",
    "correlation_pairs",
    "univariate_profile",
    "roc_auc",
    "ks_deciles",
    "event_feature_table",
    "stratified_split",
    "shadow_selection",
    "model_search",
]
# the same 16 trailing features one query at a time, to set against trailing_fused
UNFUSED = "trailing_unfused"


def unfused(spark, sf_dir):
    """One query per trailing transaction feature, as the source runs them."""
    from tidemark.operators.trailing import trailing_features
    from tidemark.plans import fixtures as fx
    from tidemark.plans.feature_queries import ORDER_ANCHOR, TXN, transaction_features
    for f in transaction_features():
        yield trailing_features(fx.order_anchors(spark, sf_dir), fx.transactions(spark, sf_dir), ORDER_ANCHOR, TXN, [f])


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or [*HEADLINE, UNFUSED]
    from tidemark.plans.catalog import QUERIES
    from tidemark.session import build_session
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8), app="tidemark-bench")
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        for n in ("trailing_sum_90d", "trailing_fused", "information_value", "roc_auc"):
            QUERIES[n](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        for df in unfused(spark, sf_dir) if n == UNFUSED else [QUERIES[n](spark, sf_dir)]:
            df.write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
