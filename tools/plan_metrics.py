"""Print the executed (AQE final) plan tree with row counts and timing metrics.

Usage from Python after an action on ``df``::

    from tools.plan_metrics import dump
    dump(df)
"""

from __future__ import annotations


def _final(plan):
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _final(plan.finalPhysicalPlan())
    return plan


def _walk(plan, depth, out):
    plan = _final(plan)
    name = plan.nodeName()
    ms = plan.metrics()
    keys = ms.keys().iterator()
    vals = {}
    while keys.hasNext():
        k = keys.next()
        if k in ("numOutputRows", "aggTime", "buildTime", "sortTime", "spillSize", "dataSize",
                 "shuffleBytesWritten", "pipelineTime", "scanTime"):
            vals[k] = ms.apply(k).value()
    out.append("  " * depth + f"{name} {vals}")
    kids = plan.children()
    it = kids.iterator()
    while it.hasNext():
        _walk(it.next(), depth + 1, out)
    # query stages wrap their plan
    if hasattr(plan, "plan") and name.endswith("QueryStage"):
        try:
            _walk(plan.plan(), depth + 1, out)
        except Exception:  # noqa: BLE001
            pass


def dump(df, limit: int = 200) -> str:
    out: list[str] = []
    _walk(df._jdf.queryExecution().executedPlan(), 0, out)
    text = "\n".join(out[:limit])
    print(text)
    return text
