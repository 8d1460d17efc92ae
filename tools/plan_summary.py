"""Summarise physical plans of registered queries (shuffles, joins, scans, pushdown).

    python tools/plan_summary.py [sf_dir] [name ...]  > PLANS.md

Each query is executed once (noop sink) so the AQE final plan is summarised.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

COUNTED = ["ShuffleExchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin",
           "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "Generate"]


def _final(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _final(plan.finalPhysicalPlan())
    return plan


def _walk(plan, acc):
    plan = _final(plan)
    cls = plan.getClass().getSimpleName()
    name = plan.nodeName()
    key = {"ShuffleExchangeExec": "ShuffleExchange", "BroadcastExchangeExec": "BroadcastExchange"}.get(cls, name)
    acc["nodes"][key] = acc["nodes"].get(key, 0) + 1
    if cls == "FileSourceScanExec":
        md = plan.metadata()

        def get(k):
            v = md.get(k)
            return v.get() if v.isDefined() else ""
        table = re.search(r"/([A-Za-z_]+)\.parquet", get("Location"))
        schema = re.search(r"struct<(.*)>", get("ReadSchema"))
        ncols = len(re.findall(r"(?:^|,)([A-Za-z_0-9]+):", schema.group(1))) if schema else 0
        acc["scans"].append((table.group(1) if table else "?", ncols, get("PushedFilters")[:100]))
    it = plan.children().iterator()
    while it.hasNext():
        _walk(it.next(), acc)
    if cls.endswith("QueryStageExec"):
        _walk(plan.plan(), acc)


def summarise(df) -> dict:
    acc = {"nodes": {}, "scans": []}
    _walk(df._jdf.queryExecution().executedPlan(), acc)
    return acc


def main():
    from tidemark.plans.catalog import QUERIES
    from tidemark.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or ["trailing_sum_90d", "trailing_fused", "login_counts", "asof_latest",
                             "feature_table", "roc_auc", "ks_deciles", "labelled_transactions",
                             "information_value", "univariate_profile", "correlation_pairs", "stratified_split",
                             "event_feature_table"]
    spark = build_session()
    print(f"# Executed plans at {sf} (AQE final plans)\n")
    print("| query | jobs | stages | tasks | " + " | ".join(COUNTED) + " | scans: table(read columns) pushed filters |")
    print("|" + " --- |" * (len(COUNTED) + 5))
    sc = spark.sparkContext
    for n in names:
        sc.setJobGroup(n, n)                       # jobs run while the query is built count too
        df = QUERIES[n](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        tracker = sc.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup(n) for s in tracker.getJobInfo(j).stageIds]
        tasks = sum(i.numTasks for i in map(tracker.getStageInfo, stages) if i)
        all_jobs = f"{len(tracker.getJobIdsForGroup(n))} | {len(stages)} | {tasks}"
        acc = summarise(df)
        scans = "; ".join(f"{t}({c}) [{p}]" for t, c, p in acc["scans"])
        print(f"| {n} | {all_jobs} | " + " | ".join(str(acc["nodes"].get(k, 0)) for k in COUNTED) + f" | {scans} |")


if __name__ == "__main__":
    main()
