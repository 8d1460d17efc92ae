import numpy as np
import pytest

from tests.llm.helpers import components
from tidemark.llm.embedding_dedup import bucket_lists, embedding_near_dedup, hadamard

SCHEMA = "vec_id long, embedding array<float>, label int"


def corpus():
    rng = np.random.default_rng(3)
    rows, base = [], rng.normal(size=(10, 16))
    for i in range(160):
        v = base[i % 10] + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.06, 0.12, 1.0])
        rows.append((1000 - i, [float(np.float32(x)) for x in v * rng.choice([0.1, 1, 30])], int(rng.integers(0, 3))))
    rows += [(1, None, 1), (2, [], 1), (3, [0.0] * 16, 1), (4, [1.0, None] + [0.0] * 14, 1), (5, [float("nan")] * 16, 1),
             (6, [float("inf")] + [0.0] * 15, 1), (7, rows[0][1], None), (8, rows[0][1][:8], rows[0][2]), (9, [1.0], 0),
             (10, [2.0], 0), (11, [-1.0], 0), (12, rows[0][1], rows[0][2]), (13, rows[0][1], rows[0][2])]
    return rows


def brute(rows, t):
    def unit(v):
        if not v or None in v:
            return None
        a = np.array(v, float)
        return a / np.linalg.norm(a) if np.isfinite(a).all() and a.any() else None
    units = [unit(r[1]) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a)
             if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b])
             and rows[a][2] == rows[b][2] is not None and rows[a][2] is not None and units[a] @ units[b] >= t]
    deg = [0] * len(rows)
    for a, b in links:
        deg[a] += 1
        deg[b] += 1
    comp = components([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in links])
    return {r[0]: (d, comp[r[0]], comp[r[0]] == r[0]) for r, d in zip(rows, deg)}


def collect(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_matches_brute_force(spark):
    rows = corpus()
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("bucket", F.lit(1)).repartition(3)
    want = brute(rows, 0.98)
    assert sum(d for d, *_ in want.values()) > 100
    assert collect(embedding_near_dedup(df)) == want
    assert collect(embedding_near_dedup(df, block=2)) == want       # every bucket in pairs of blocks


def test_repeated_ids_and_empty_table(spark):
    v, w = [1.0, 0.0, 0.0, 0.5], [0.0, 1.0, 0.0, 0.0]
    df = spark.createDataFrame([(1, v, 0), (1, v, 0), (1, w, 0), (2, v, 0), (None, v, 0)], SCHEMA)
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in embedding_near_dedup(df).collect())
    assert got == [("1", 0, 1), ("1", 2, 1), ("1", 2, 1), ("2", 2, 1), ("None", 0, None)]
    assert embedding_near_dedup(df.where("false")).collect() == []


def test_recall_of_buckets():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    n = rng.normal(size=x.shape)
    n -= (n * x).sum(1)[:, None] * x
    n /= np.linalg.norm(n, axis=1)[:, None]
    y = 0.98 * x + np.sqrt(1 - 0.98 ** 2) * n                        # cosine 0.98, the hardest link
    a, b = bucket_lists(x, 8, 5, 7), bucket_lists(y, 8, 5, 7)
    meet = ((b == a[:, :, :1]).any(2) | (a == b[:, :, :1]).any(2)).any(1)
    assert meet.mean() > 0.999
    z = rng.normal(size=(5, 8))
    assert hadamard(hadamard(z)) == pytest.approx(z)


def test_a_null_component_is_no_copy_of_a_shorter_vector(spark):
    df = spark.createDataFrame([(1, [1.0, None, 2.0], 1), (2, [1.0, 2.0], 1), (3, [1.0, 2.0], 1)],
                               "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_near_dedup(df).collect()}
    assert got == {1: (0, 1), 2: (1, 2), 3: (1, 2)}
