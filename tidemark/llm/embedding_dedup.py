"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

1. Vectors of equal label, length and content are one class (smallest id stands
   for it); copies are counted, never paired.
2. Each table rotates the unit vector ``axes`` times by three rounds of random signs
   and a fast Hadamard transform, and takes the nearest signed axis of each result: a
   bucket is a tuple of axes, (2 d) ** axes buckets in all.  A vector lives in its home bucket and also visits
   the next likely buckets of the table (multiprobe), those whose axes lose least
   against the nearest ones.
3. Vectors shuffle on (label, length, table, bucket).  Buckets above ``block``
   members are taken apart into pairs of hash blocks, so no task holds an
   unbounded group.
4. A task compares, in double precision, residents of a bucket with one another
   and with its visitors.  A pair counts only in the first (table, bucket) in
   which it meets, which both vectors' bucket lists tell, so none counts twice.
   It returns a row per vector (links, smallest member of its local component).
5. Link counts are added up and local components joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._blocks import block_pairs
from tidemark.llm._components import connected_components, local_components
from tidemark.session import cut_lineage


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        h *= 2
        x = x.reshape(n, d)
    return x / np.sqrt(d)


def bucket_lists(unit: np.ndarray, tables: int, probes: int, seed: int, axes: int = 3) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket numbers: home first, then the likeliest others."""
    n, d = unit.shape
    size = 1 << max(0, (d - 1).bit_length())
    x = np.zeros((n, size))
    x[:, :d] = unit
    rng = np.random.Generator(np.random.PCG64([seed, size]))
    out = np.empty((n, tables, 1 + probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        cost, code = np.zeros((n, 1)), np.zeros((n, 1), np.int64)
        for _ in range(axes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            mag = np.abs(y)
            top = np.argsort(-mag, axis=1, kind="stable")[:, :min(1 + probes, size)]
            best = mag[rows[:, None], top]
            axis = top * 2 + (y[rows[:, None], top] < 0)
            # the likeliest prefixes extended by the likeliest axes; the home stays first
            cost = (cost[:, :, None] + ((best[:, :1] - best) ** 2)[:, None, :]).reshape(n, -1)
            code = (code[:, :, None] * (2 * size) + axis[:, None, :]).reshape(n, -1)
            pick = np.argsort(cost, axis=1, kind="stable")[:, :1 + probes]
            cost, code = cost[rows[:, None], pick], code[rows[:, None], pick]
        found = code
        if found.shape[1] < 1 + probes:                       # short vectors have fewer buckets
            found = np.pad(found, ((0, 0), (0, 1 + probes - found.shape[1])), mode="edge")
        out[:, t] = found
    return out


def _prepare(tables: int, probes: int, seed: int, axes: int):
    """(id, label, vec) -> (id, label, dims, vec, buckets) of the rows that can link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, vecs = [], [], []
            for i, l, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if l is None or not v or None in v:
                    continue
                a = np.array(v, np.float64)
                if not np.isfinite(a).all() or not a.any():
                    continue
                ids.append(i)
                labels.append(l)
                vecs.append(a / np.abs(a).max())               # keeps squares in range
            order: dict[int, list[int]] = {}
            for k, a in enumerate(vecs):
                order.setdefault(len(a), []).append(k)
            for dims, at in order.items():
                m = np.stack([vecs[k] for k in at])
                unit = m / np.linalg.norm(m, axis=1)[:, None]
                lists = bucket_lists(unit, tables, probes, seed, axes)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[k] for k in at], pa.int64()),
                    pa.array([labels[k] for k in at]).cast(pa.string()),
                    pa.array([dims] * len(at), pa.int32()),
                    pa.array(list(unit), pa.list_(pa.float64())),
                    pa.array(list(lists.reshape(len(at), -1)), pa.list_(pa.int64()))],
                    names=["id", "label", "dims", "vec", "buckets"])
    return run


def _verify(threshold: float, tables: int, probes: int):
    """Grouped function over one unit of block_pairs rows."""
    def one(g: pd.DataFrame, cross: bool):
        v = np.stack(g["vec"].to_numpy())
        sim = v @ v.T
        link = sim >= threshold
        # products may round across the threshold by the order of summation: settle those exactly
        a, b = np.nonzero(np.triu(np.abs(sim - threshold) < 1e-12, 1))
        for i, j in zip(a, b):
            link[i, j] = link[j, i] = float(np.dot(v[i], v[j])) >= threshold
        np.fill_diagonal(link, False)
        visit = g["visit"].to_numpy()
        link &= ~(visit[:, None] & visit[None, :])
        if cross:                            # pairs inside a block belong to the unit (i, i)
            mine = g["mine"].to_numpy()
            link &= mine[:, None] != mine[None, :]
        a, b = np.nonzero(np.triu(link, 1))
        if len(a):
            lists = np.stack(g["buckets"].to_numpy()).reshape(len(g), tables, 1 + probes)
            table, bucket = int(g["table"].iloc[0]), int(g["bucket"].iloc[0])
            x, y = lists[a], lists[b]
            # the pair meets in table t where one's home is in the other's list; take the
            # first such table, and there the home of a if b reaches it, else the home of b
            at_a = (y == x[:, :, :1]).any(2)
            at_b = (x == y[:, :, :1]).any(2)
            first = np.argmax(at_a | at_b, axis=1)
            rows = np.arange(len(a))
            where = np.where(at_a[rows, first], x[rows, first, 0], y[rows, first, 0])
            own = (first == table) & (where == bucket)
            a, b = a[own], b[own]
        ids, copies = g["id"].to_numpy(), g["copies"].to_numpy()
        low = ids[local_components(len(g), a, b)]
        weight = np.zeros(len(g), np.int64)
        np.add.at(weight, a, copies[b])
        np.add.at(weight, b, copies[a])
        keep = np.zeros(len(g), bool)
        keep[a] = keep[b] = True
        return pd.DataFrame({"id": ids[keep], "links": weight[keep], "low": low[keep]})

    def run(unit: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("id", "links", "low")})]
        for _, g in unit.groupby(["key", "bi", "bj"], sort=False):
            if len(g) > 1 and not g["visit"].all():
                g = g.sort_values("id", kind="stable")
                parts.append(one(g, int(g["bi"].iloc[0]) != int(g["bj"].iloc[0])))
        return pd.concat(parts, ignore_index=True)

    return run


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.98, tables: int = 8, probes: int = 5,
                         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                         block: int = 256, seed: int = 7, axes: int = 3) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors are compared when their labels are equal and not NULL and their lengths
    are equal.  ``n_links``: other rows of cosine >= ``threshold``; ``component_id``:
    smallest id reachable by links; ``kept``: id = component_id.

    NULL, empty and zero vectors, vectors with NULL or non-finite components and
    rows without a label or id link with nothing.  Rows of a repeated id count as rows.
    Extra columns are not read; an empty table gives an empty one.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                         F.col(vec_col).cast("array<double>").alias("vec"))
    # copies: equal label and content, NULL components told apart; -0.0 and 0.0 are told apart, which costs nothing but a link
    named = src.withColumn("digest", F.md5(F.concat_ws(
        "\x1f", "label", F.array_join(F.col("vec").cast("array<string>"), ",", "null")).cast("binary")))
    named = named.withColumn("digest", F.when(F.col("id").isNotNull() & F.col("label").isNotNull(), F.col("digest")))
    classes = named.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("vec").alias("vec"),
        F.any_value("label").alias("label"))
    shared = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("texts"))
    # the node of a class is its smallest id; classes whose id names other vectors too get a hash
    classes = cut_lineage(classes.join(shared, "rep").select(
        F.when(F.col("texts") == 1, F.col("rep")).otherwise(F.xxhash64("digest")).alias("id"),
        "rep", "digest", "copies", "label", "vec"))
    hashed = cut_lineage(classes.select("id", "label", "vec").mapInArrow(
        _prepare(tables, probes, seed, axes),
        "id long, label string, dims int, vec array<double>, buckets array<long>"))
    step = 1 + probes
    places = hashed.select("id", "label", "dims", F.posexplode("buckets").alias("at", "bucket"))
    places = places.select(
        "id", F.floor(F.col("at") / step).cast("int").alias("table"), "bucket",
        (F.col("at") % step != 0).alias("visit"), "label", "dims")
    places = places.groupBy("id", "table", "bucket", "label", "dims").agg(F.min("visit").alias("visit"))
    places = places.select("id", F.xxhash64("label", "dims", "table", "bucket").alias("key"),
                           "table", "bucket", "visit")
    # a bucket without a resident pair or a resident and a visitor has nothing to compare
    busy = places.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("visit").alias("none")).where(
        "n > 1 and not none").select("key")
    members = block_pairs(places.join(busy, "key"), block)
    links = cut_lineage(
        members.join(hashed.select("id", "vec", "buckets"), "id")
        .join(classes.select("id", "copies"), "id")
        .groupBy("unit").applyInPandas(_verify(threshold, tables, probes), "id long, links long, low long"))
    comps = connected_components(links.select(F.col("id").alias("a"), F.col("low").alias("b")))
    count = links.groupBy("id").agg(F.sum("links").alias("links"))
    able = hashed.select("id", F.lit(1).alias("able"))
    found = cut_lineage(classes.select("id", "rep", "digest", "copies").join(able, "id")
                        .join(count, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
                        .withColumn("component", F.coalesce("component", "id")))
    first = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = found.join(first, "component").select(
        "digest", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = named.select("id", "digest").join(found, "digest", "left")
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      comp.alias("component_id"), (comp == F.col("id")).alias("kept"))
