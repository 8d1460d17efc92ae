"""Connected components of an edge table, as joins and aggregates.

Each round maps every node to the smallest node among itself and its
neighbours, relabels both ends of every edge by that map and drops loops.  The
edge table shrinks by at least a constant factor of its nodes a round, so a
star needs one round and a path a logarithmic number.  Nodes, edges and labels
stay distributed; only one count a round reaches the driver.  A hub is one key
of an aggregate (combined map-side) and of equi joins (split by the adaptive
skew join).  Each round is cut by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs -> (node, component): one row per node that has an
    edge to another node, with the smallest node reachable.  Loops and NULLs are
    ignored; an empty table gives an empty table."""
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct()
    e = cut_lineage(e)
    labels = None
    while True:
        if labels is not None and e.isEmpty():
            return labels
        both = e.union(e.select("b", "a").toDF("a", "b"))
        m = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        if labels is None:
            labels = m.select(F.col("a").alias("node"), F.col("to").alias("component"))
            if m.isEmpty():
                return labels
        else:
            labels = cut_lineage(
                labels.join(m, labels["component"] == m["a"], "left")
                .select("node", F.coalesce("to", "component").alias("component")))
        s = m.select(F.col("a"), F.col("to").alias("x"))
        t = m.select(F.col("a").alias("b"), F.col("to").alias("y"))
        e = cut_lineage(e.join(s, "a").join(t, "b").where("x <> y")
                        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def local_components(n: int, a, b):
    """Smallest index reachable for the indices 0..n-1 over numpy edge arrays a, b (in a task)."""
    import numpy as np

    lab = np.arange(n)
    while len(a):
        lo = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, lo)
        np.minimum.at(new, b, lo)
        np.minimum.at(new, lab[a], lo)
        np.minimum.at(new, lab[b], lo)
        new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    return lab
