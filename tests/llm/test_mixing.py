import random

from tests.llm.helpers import WORD, docs_frame, random_text, vocabulary
from tidemark.llm.mixing import mix_sources, source_targets


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by rounds of resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if unit * w[s] > most * sizes[s]}
        if not over:
            target.update({s: unit * w[s] for s in free})
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_targets_and_budgets(spark):
    rng, words = random.Random(1), vocabulary()
    rows = [(i, random_text(rng, words, rng.randint(0, 30)), rng.choice(["a", "b", "b", "b", "c", "d", None, "é", "Z"])) for i in range(300)]
    rows += [(900, None, "a"), (901, "", "only empty"), (902, "w " * 3000, "b"), (3, rows[3][1], rows[3][2]), (None, "x y", "c")]
    df = docs_frame(spark, rows, extra=("size", "target", "_key"))
    out = mix_sources(df).collect()
    assert len(out) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    want, taken = fill(size), {}
    for r in out:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["epochs"] * r["size"] + r["cut"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in size:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6          # cut at the exact budget
    again = mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_edges(spark):
    assert mix_sources(docs_frame(spark, [])).collect() == []
    out = mix_sources(docs_frame(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in out] == [(0, 0, 0.0)] * 2
    one = mix_sources(docs_frame(spark, [(1, "a b c", None)])).first()
    assert (one["size"], one["taken"], one["target"]) == (3, 3, 3.0)
    df = spark.createDataFrame([("a", 100), ("b", 1), (None, 50)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == fill({"a": 100, "b": 1, None: 50})
