import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators.boosting import Boosted, Spec, Tree, fit_many, score, score_by, score_counts
from tidemark.operators.evaluate import auc_of_counts, ks_table, roc_auc
from tidemark.operators.explain import expected_raw, importances, shap_table, tree_shap
from tidemark.operators.selection import binomial_tail, decide, information_value, rounds_needed, shadow_selection
from tidemark.operators.train import Search, Study, grid_points, model_pipeline, pipelines, search_many, stratified_split
from tidemark.plans import constants as K


def _frame(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x1 = rng.normal(size=n)
    noise = rng.normal(size=n)
    y = (x1 + rng.normal(0, 0.3, n) > 0).astype(int)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x1": x1, "noise": noise, "y": y}))


def test_split_exact_and_deterministic(spark):
    df = _frame(spark)
    a = stratified_split(df, "y", "id", 3, 0.2).toPandas()
    b = stratified_split(df, "y", "id", 3, 0.2).toPandas()
    assert a.sort_values("id").is_test.tolist() == b.sort_values("id").is_test.tolist()
    for cls, part in a.groupby("y"):
        assert part.is_test.sum() == round(len(part) * 0.2)
    assert len(a) == 400 and a.id.nunique() == 400


def test_every_grid_point_counts():
    assert len(grid_points(K.MODEL_GRID)) == 36 and len(grid_points(K.SEED_GRID)) == 24


def _shaped(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    pdf = pd.DataFrame(x, columns=list("abc"))
    pdf["y"] = (x[:, 0] + x[:, 1] ** 2 + rng.normal(0, 0.8, n) > 0.7).astype(int)
    pdf["id"], pdf["fold"] = np.arange(n), (np.arange(n) % 5 == 0).astype(int)
    return spark.createDataFrame(pdf).withColumn("a", F.when(F.col("id") != 5, F.col("a"))).repartition(5)


def _same(p, q):
    return all(a.features == b.features and a.cuts == b.cuts and np.array_equal(a.values, b.values) and np.array_equal(a.covers, b.covers)
               for m, o in zip(p, q) for a, b in zip(m.trees, o.trees)) and [len(m.trees) for m in p] == [len(m.trees) for m in q]


def test_models_grow_alike_in_a_task_and_level_by_level(spark):
    df = _shaped(spark)
    specs = [Spec(("a", "b", "c"), 2, 0.3, 10.0, 3), Spec(("c", "a"), 3, 0.1, 0.0, 2)]
    one = fit_many(df, specs, "y", "id")[0]
    assert _same(one, fit_many(df, specs, "y", "id", task_cells=0, trees_per_state=2)[0])
    assert _same(one, fit_many(df.repartition(2), specs, "y", "id")[0])            # whatever the partitions
    assert _same([one[0].first(2)], fit_many(df, [Spec(("a", "b", "c"), 2, 0.3, 10.0, 2)], "y", "id")[0])


def _plain_tree(x, y, edges, depth, rate, l2):
    """One symmetric tree by trying every cut on plain arrays."""
    g, h, leaf = y - 0.5, np.full(len(y), 0.25), np.zeros(len(y), int)
    for level in range(depth):
        best = (-1.0, None, None)
        for f, cuts in enumerate(edges):
            for c, e in enumerate(cuts):
                high = np.nan_to_num(x[:, f], nan=-np.inf) > e
                gain = 0.0
                for v in range(1 << level):
                    at = leaf == v
                    for side, sign in ((at & high, 1), (at & ~high, 1), (at, -1)):
                        gain += sign * (g[side].sum() ** 2 / (h[side].sum() + l2) if side.any() else 0.0)
                if gain > best[0] + 1e-9:
                    best = (gain, f, c)
        leaf |= (np.nan_to_num(x[:, best[1]], nan=-np.inf) > edges[best[1]][best[2]]).astype(int) << level
    return leaf, [rate * g[leaf == v].sum() / (h[leaf == v].sum() + l2) for v in range(1 << depth)]


def test_tree_equals_a_plain_search(spark):
    df = _shaped(spark, 400, 3)
    m = fit_many(df, [Spec(("a", "b", "c"), 2, 0.1, 5.0, 1)], "y", "id", bins=16)[0][0]
    pdf = df.toPandas()
    train = pdf[pdf.fold == 0]
    leaf, values = _plain_tree(train[["a", "b", "c"]].to_numpy(float), train.y.to_numpy(), m.edges, 2, 0.1, 5.0)
    assert np.allclose(m.trees[0].values, values) and m.trees[0].covers.tolist() == np.bincount(leaf, minlength=4).tolist()


def test_l2_and_rate_matter(spark):
    df = _shaped(spark, 500)
    soft, hard = fit_many(df, [Spec(("a",), 1, 0.1, l2, 1) for l2 in (0.0, 50.0)], "y", "id")[0]
    assert np.abs(soft.trees[0].values).max() > np.abs(hard.trees[0].values).max()


def test_degenerate_training_rows(spark):
    df = _shaped(spark, 60).withColumn("flat", F.lit(1.0)).withColumn("none", F.lit(2))
    specs = [Spec(("flat",), 3, 0.1, 1.0, 2), Spec(("a",), 2, 0.1, 1.0, 2, "none")]
    for cells in (1 << 20, 0):
        flat, empty = fit_many(df, specs, "y", "id", task_cells=cells)[0]
        assert [t.features for t in flat.trees] == [(), ()] and len(empty.trees) == 2
        assert {round(r.score, 12) for r in score(empty, df).collect()} == {0.5}
    assert fit_many(df.where("false"), specs[:1], "y", "id")[0][0].trees
    one_class = df.withColumn("y", F.lit(1))
    assert score(fit_many(one_class, specs[:1], "y", "id")[0][0], one_class).where("score <= 0.5").count() == 0


def test_candidates_are_rated_by_their_scores(spark):
    df = _shaped(spark, 800)
    grid = {"iterations": [1, 3], "learning_rate": [0.3], "depth": [1, 2], "l2_leaf_reg": [1, 20]}
    found = search_many(df, [Search(("a", "b"), "fold", grid), Search(("c",), "fold", grid)], "y", "id")
    assert [len(f.candidates) for f in found] == [8, 8]
    for f in found:
        for c, m in zip(f.candidates, f.models):
            assert len(m.trees) == c.params["iterations"]
            auc = {r.fold: r.auc for r in roc_auc(score(m, df), "y", "score", ["fold"]).collect()}
            assert abs(auc[0] - c.train_auc) < 1e-12 and abs(auc[1] - c.test_auc) < 1e-12
        assert f.candidates[f.best].score == max(c.score for c in f.candidates)


def test_scores_by_group(spark):
    df = _shaped(spark, 300).withColumn("g", F.when(F.col("id") % 3 == 0, "u").when(F.col("id") % 3 == 1, "v").otherwise("w"))
    u, v = fit_many(df, [Spec(("a", "b"), 2, 0.3, 1.0, 2), Spec(("c",), 1, 0.3, 1.0, 2)], "y", "id")[0]
    got = {r.id: (r.g, r.score) for r in score_by({"u": u, "v": v}, df, "g").collect()}
    want = {"u": {r.id: r.score for r in score(u, df).collect()}, "v": {r.id: r.score for r in score(v, df).collect()}}
    assert all(s is None if g == "w" else s == want[g][i] for i, (g, s) in got.items())


def _expectation(tree, bits, known):
    def go(level, at):
        if level == len(tree.features):
            return tree.values[at[0]]
        low, high = [v for v in at if not v >> level & 1], [v for v in at if v >> level & 1]
        if tree.features[level] in known:
            return go(level + 1, high if bits[level] else low)
        a, b = tree.covers[low].sum(), tree.covers[high].sum()
        return (a * go(level + 1, low) + b * go(level + 1, high)) / (a + b)
    return go(0, list(range(len(tree.values))))


def test_attributions_equal_all_subsets():
    rng = np.random.default_rng(1)
    for depth in (1, 2, 3, 4, 5):
        t = Tree(tuple(int(v) for v in rng.integers(0, 4, depth)), (0,) * depth, rng.normal(size=1 << depth), rng.integers(1, 6, 1 << depth).astype(float))
        table, mean = shap_table(t, 4)
        for leaf in range(1 << depth):
            bits = [leaf >> k & 1 for k in range(depth)]
            for f in range(4):
                others = [o for o in range(4) if o != f]
                phi = sum(math.factorial(r) * math.factorial(3 - r) / 24 * (_expectation(t, bits, {*s, f}) - _expectation(t, bits, set(s)))
                          for r in range(4) for s in itertools.combinations(others, r))
                assert abs(phi - table[leaf, f]) < 1e-12
            assert abs(table[leaf].sum() + mean - t.values[leaf]) < 1e-12


def test_attributions_of_rows_add_up(spark):
    df = _shaped(spark, 300)
    m = fit_many(df, [Spec(("a", "b", "c"), 4, 0.3, 1.0, 5)], "y", "id")[0][0]
    phi = tree_shap(m, df, "id")
    assert phi.count() == 900 and phi.where("id = 5 and feature = 'a' and value is null").count() == 1
    raw = {r.id: math.log(r.score / (1 - r.score)) for r in score(m, df).collect()}
    for r in phi.groupBy("id").agg(F.sum("phi").alias("s")).collect():
        assert abs(r.s + expected_raw(m) - raw[r.id]) < 1e-9
    imp = importances(m)
    assert abs(sum(imp) - 100) < 1e-9 and imp[2] < imp[0] and imp[2] < imp[1]
    assert tree_shap(Boosted((), (), ()), df, "id").count() == 0


def test_counts_give_the_same_auc(spark):
    df = _shaped(spark, 300)
    models, blocks, folds, names = fit_many(df, [Spec(("a", "b"), 2, 0.3, 1.0, 2)], "y", "id")
    got = {r.fold: r.auc for r in auc_of_counts(score_counts(blocks, folds, names, [(models[0], "fold")]), "score", ["cand", "fold"]).collect()}
    want = {r.fold: r.auc for r in roc_auc(score(models[0], df), "y", "score", ["fold"]).collect()}
    assert got == want


def test_decile_tables_by_group(spark):
    df = _shaped(spark, 400).withColumn("g", F.col("id") % 2).withColumn("p", F.round("b", 1))
    cols = ["decile", "min_prob", "max_prob", "events", "nonevents", "pop", "ks", "cure_rate"]
    both = ks_table(df, "y", "p", groups=["g"]).collect()
    for g in (0, 1):
        assert sorted(tuple(r[c] for c in cols) for r in both if r.g == g) == sorted(
            tuple(r[c] for c in cols) for r in ks_table(df.where(F.col("g") == g), "y", "p").collect())


def test_constant_feature_falls_back_to_equal_width(spark):
    df = _shaped(spark, 60).withColumn("flat", F.lit(3.0))
    assert {r.feature: r.iv for r in information_value(df, "y", ["flat"]).collect()} == {"flat": 0.0}


def test_study_survives_json(spark):
    st = model_pipeline(_frame(spark, 300), ["x1", "noise"], "y", "id",
                        {"iterations": [2], "learning_rate": [0.1], "depth": [2], "l2_leaf_reg": [1]}, 1, iv_threshold=0.0, num_trees=10)
    again = Study.from_json(st.to_json(), st.rows)
    assert again.candidates == st.candidates and again.chosen == st.chosen and again.selection == st.selection
    assert sorted(map(tuple, again.scored("id").collect())) == sorted(map(tuple, st.scored("id").collect()))


def test_groups_and_seeds_in_one_chain(spark):
    df = _frame(spark, 400).withColumn("g", F.col("id") % 2)
    grid = {"iterations": [2], "learning_rate": [0.1], "depth": [2], "l2_leaf_reg": [1]}
    groups = {"even": F.col("g") == 0, "odd": F.col("g") == 1}
    both = pipelines(df, groups, ["x1", "noise"], "y", "id", grid, [1, 2], iv_threshold=0.0, num_trees=10)
    assert sorted(both) == [("even", 1), ("even", 2), ("odd", 1), ("odd", 2)]
    alone = model_pipeline(df.where("g = 0"), ["x1", "noise"], "y", "id", grid, 2, iv_threshold=0.0, num_trees=10)
    st = both["even", 2]
    assert st.features == alone.features and st.rows.count() == 200
    assert {tuple(r) for r in st.rows.select("id", "part").collect()} == {tuple(r) for r in alone.rows.select("id", "part").collect()}
    lists = pipelines(df, groups, ["x1", "noise"], "y", "id", grid, [1, 2], iv_threshold=0.0, num_trees=10, fit=False)
    assert {k: v.features for k, v in lists.items()} == {k: v.features for k, v in both.items()}
    assert all(v.model is None for v in lists.values())


def test_rounds_allow_acceptance_for_many_features():
    for k in (1, 2, 60, 1000, 100_000):
        n = rounds_needed(k)
        assert binomial_tail(n, n) < 0.05 / k <= binomial_tail(n - 1, n - 1)
        assert decide(n, n, 0.05 / k) == "accepted" and decide(0, n, 0.05 / k) == "rejected" and decide(n // 2, n, 0.05 / k) == "tentative"


def test_shadow_selection_with_sixty_features(spark):
    rng = np.random.default_rng(3)
    n = 600
    y = rng.integers(0, 2, n)
    pdf = pd.DataFrame({"id": np.arange(n), "y": y, "planted": y + rng.normal(0, 0.2, n)})
    pdf["copy"] = pdf.planted + rng.normal(0, 0.05, n)
    for i in range(58):
        pdf[f"n{i}"] = rng.normal(size=n)
    feats = [c for c in pdf.columns if c not in ("id", "y")]
    sel = {r.feature: r for r in shadow_selection(spark.createDataFrame(pdf), feats, "y", "id", seed=2,
                                                  num_trees=15, max_depth=3, max_rounds=16).collect()}
    assert sel["planted"].state == "accepted" and sel["copy"].state == "accepted"
    assert sum(r.state == "rejected" for r in sel.values()) > 50
    # rejected features left at the test that rejected them
    assert {r.rounds for r in sel.values() if r.state == "rejected"} <= {11, 15, 16}


def test_three_states(spark):
    """A clear feature, noise, and one whose signal is a matter of the round."""
    rng = np.random.default_rng(5)
    n = 400
    y = rng.integers(0, 2, n)
    pdf = pd.DataFrame({"id": np.arange(n), "y": y, "clear": y + rng.normal(0, 0.5, n), "weak": y * 0.17 + rng.normal(size=n)})
    for i in range(6):
        pdf[f"n{i}"] = rng.normal(size=n)
    feats = [c for c in pdf.columns if c not in ("id", "y")]
    sel = {r.feature: r for r in shadow_selection(spark.createDataFrame(pdf), feats, "y", "id", seed=1, num_trees=15,
                                                  max_depth=3, max_rounds=12).collect()}
    assert sel["clear"].state == "accepted" and sel["clear"].accepted
    assert "rejected" in {sel[f"n{i}"].state for i in range(6)}
    assert all(r.accepted == (r.state == "accepted") for r in sel.values())
    assert {r.state for r in sel.values()} == {"accepted", "rejected", "tentative"}, sel


def test_pipeline_without_accepted_features(spark):
    df = _frame(spark, 200).withColumn("y", (F.pmod(F.xxhash64("id"), F.lit(2))).cast("int"))
    st = model_pipeline(df, ["x1", "noise"], "y", "id",
                        {"iterations": [3], "learning_rate": [0.1], "depth": [2], "l2_leaf_reg": [1]}, 1,
                        iv_threshold=0.0, num_trees=10)
    if not st.features:                      # nothing is reported as selected, nothing fitted
        assert st.model is None and st.chosen is None and not st.candidates and st.scored("id").count() == 0
    assert all(not r[5] or r[0] in st.features for r in st.selection)


def test_pipeline_with_validation_rows(spark):
    st = model_pipeline(_frame(spark, 400), ["x1", "noise"], "y", "id",
                        {"iterations": [3, 6], "learning_rate": [0.1], "depth": [2], "l2_leaf_reg": [1]}, 1, iv_threshold=0.0,
                        validation_share=0.25, num_trees=10)
    parts = {r["part"]: r["count"] for r in st.rows.groupBy("part").count().collect()}
    assert set(parts) == {"train", "valid", "test"} and sum(parts.values()) == 400
    assert st.features == ["x1"] and len(st.candidates) == 2 and st.chosen in st.candidates


def test_shadow_selection_finds_signal(spark):
    df = _frame(spark, 400, 2)
    sel = {r.feature: r for r in shadow_selection(df, ["x1", "noise"], "y", "id", seed=1, num_trees=20).collect()}
    assert sel["x1"].accepted and sel["x1"].hits == sel["x1"].rounds
    assert not sel["noise"].accepted
    assert shadow_selection(df.where("false"), ["x1"], "y", "id").first().state == "tentative"


def test_rows_with_few_features_do_not_grow_in_one_task(spark, monkeypatch):
    """Memory of a task follows its rows, not only rows x features; the trees are the same."""
    from tidemark.operators import boosting
    assert not boosting.fits_task(9_000_000, 4, 1 << 26) and boosting.fits_task(900_000, 18, 1 << 26)
    df = _shaped(spark, n=600)
    specs = [Spec(("a", "b"), 2, 0.1, 1, 3)]
    one = fit_many(df, specs, "y", "id")[0]

    def fail(*_):
        raise AssertionError("grown in one task")

    monkeypatch.setattr(boosting, "TASK_BYTES", 600 * 80)
    monkeypatch.setattr(boosting, "_in_tasks", fail)
    assert _same(one, fit_many(df, specs, "y", "id")[0])


def test_a_level_follows_from_the_one_above():
    """Counting one side of a cut and taking it from the level above gives the whole histograms."""
    from tidemark.operators import boosting
    rng = np.random.default_rng(5)
    n = 70_001                                            # several chunks of rows
    x = rng.integers(0, 32, (n, 3)).astype(np.uint8)
    g, h = boosting.gradients(rng.integers(0, 2, n).astype(float), rng.normal(0, 3, n))
    columns, leaf = [x[:, j] for j in range(3)], rng.integers(0, 4, n)
    above = boosting.histograms(columns, leaf, 4, g, h, 32)
    for j in range(3):
        plain = [np.bincount(leaf * 32 + x[:, j], weights=w, minlength=128).astype(np.int64) for w in (g, h, np.ones(n))]
        assert (above[j].reshape(3, -1) == np.stack(plain)).all()
    for cut in (1, 30, 31):                               # the rows above the cut are many, few and none
        deeper = leaf | (x[:, 0] > cut).astype(np.int64) << 2
        assert (boosting.grown(above, columns, deeper, 8, g, h, 32) == boosting.histograms(columns, deeper, 8, g, h, 32)).all()
    flat, (g, h) = np.zeros(n, np.uint8), boosting.gradients(np.ones(n), np.zeros(n))      # the largest hessians, all in one bin
    one = boosting.histogram(flat, np.zeros(n, np.int64), 1, g, h, 32)
    assert one[:, 0, 0].tolist() == [n << 23, n << 22, n] and not one[:, 0, 1:].any()


def test_rows_that_agree_in_their_bins_are_merged(spark, monkeypatch):
    """Equal trees and AUC from merged rows, in a task and level by level, for folds of their own
    features; blocks hold a row per cell, not per row."""
    from tidemark.operators import boosting
    df = _shaped(spark, 4000).withColumn("a", F.round("a")).withColumn("b", F.round("b")).withColumn(
        "half", F.when(F.col("id") % 2 == 0, F.col("fold")))
    specs = [Spec(("a", "b"), 3, 0.3, 1.0, 4), Spec(("b", "c"), 2, 0.1, 5.0, 3, "half"), Spec(("a",), 2, 0.3, 0.0, 2)]
    auc = lambda models, blocks, folds, names: {
        (r.cand, r.fold): (r.auc, r.positives, r.negatives) for r in auc_of_counts(
            score_counts(blocks, folds, names, [(m, s.fold) for m, s in zip(models, specs)]), "score", ["cand", "fold"]).collect()}
    got = fit_many(df, specs, "y", "id")
    levels = fit_many(df, specs, "y", "id", task_cells=0, trees_per_state=2)
    sizes = {r.fold: r.n for r in got[1].groupBy("fold").agg(F.sum("n").alias("n")).collect()}
    assert sizes[got[2].index("fold")] < 400
    monkeypatch.setattr(boosting, "MERGE_CELLS", 0)
    plain = fit_many(df, specs, "y", "id")
    assert plain[1].agg(F.sum("n")).first()[0] == 4000
    assert _same(plain[0], got[0]) and _same(plain[0], levels[0])
    assert _same(plain[0], fit_many(df, specs, "y", "id", task_cells=0, trees_per_state=2)[0])
    assert auc(*plain) == auc(*got) == auc(*levels) and len(auc(*got)) == 6


def test_merged_rows_are_counted_exactly_however_many():
    from tidemark.operators.boosting import histograms, times
    rng = np.random.default_rng(6)
    col, leaf = rng.integers(0, 8, 50), rng.integers(0, 2, 50)
    g, h, w = rng.integers(-(1 << 24), 1 << 24, 50).astype(float), rng.integers(0, 1 << 22, 50).astype(float), rng.integers(1, 4, 50)
    at = np.repeat(np.arange(50), w)
    assert np.array_equal(histograms([col], leaf, 2, *times(g, h, w), 8, w), histograms([col[at]], leaf[at], 2, g[at], h[at], 8))
    many = w * (1 << 33)                                    # past what a double holds exactly
    assert np.array_equal(histograms([col], leaf, 2, *times(g, h, many), 8, many),
                          histograms([col], leaf, 2, *times(g, h, w), 8, w) * (1 << 33))


def test_scores_by_cell_equal_scores_by_row(spark, monkeypatch):
    from tidemark.operators import boosting
    df = _shaped(spark, 500)
    m = fit_many(df, [Spec(("a", "b", "c"), 3, 0.3, 1.0, 4)], "y", "id")[0][0]
    x = np.random.default_rng(1).normal(size=(300, 3))
    cells, want = m.by_cell(), boosting.probability(m.raw(x))
    assert cells.table is None and np.array_equal(cells(m.bins(x[:200]))[:, 0], want[:200])
    assert cells.table is not None and np.array_equal(cells(m.bins(x))[:, 0], want)
    phi = tree_shap(m, df, "id").orderBy("id", "feature").collect()
    monkeypatch.setattr(boosting, "TABLE_CELLS", 0)
    assert np.array_equal(m.by_cell()(m.bins(x))[:, 0], want) and phi == tree_shap(m, df, "id").orderBy("id", "feature").collect()


def test_splits_of_all_seeds_in_the_same_passes(spark):
    """The parts of several groups and seeds, with keys that repeat or are NULL and NULL labels, against one split each;
    the jobs do not grow with the seeds."""
    from tidemark.operators import train
    rows = [(None if i % 41 == 0 else i if i % 17 else 17 * (i // 34), None if i % 29 == 0 else i * 7 % 3 % 2, i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, label int, kind int").repartition(3).cache()
    groups = [F.col("kind") < 3, F.coalesce(F.col("kind") == 4, F.lit(False))]
    marked = df.select("id", "label", "kind", *[g.alias(f"_g{i}") for i, g in enumerate(groups)])
    for share in (0.0, 0.25):
        names = {f"_p{i}_{j}": (i, seed) for i in range(2) for j, seed in enumerate((3, 8, 11))}
        got = train._parts(marked, "id", names, 0.2, share).collect()
        assert len(got) == 600
        for name, (i, seed) in names.items():
            sp = train.stratified_split(marked.where(f"_g{i}"), "label", "id", seed, 0.2)
            held = train.stratified_split(sp.where("is_test = 0"), "label", "id", seed + 7919, share, "_v").where("_v = 1 and id is not null")
            valid, want = {r["id"] for r in held.collect()} if share else set(), {}
            for r in sp.where("id is not null").collect():
                part = "test" if r["is_test"] else "valid" if r["id"] in valid else "train"
                want[r["id"]] = max(want.get(r["id"], ""), part)
            assert all(r[name] == want.get(r["id"]) for r in got) and set(want.values()) == {"test", "train"} | ({"valid"} if share else set())

    tracker = spark.sparkContext.statusTracker()

    def jobs(seeds):
        before = max(tracker.getJobIdsForGroup(None))
        train._parts(marked, "id", {f"_p0_{j}": (0, j) for j in range(seeds)}, 0.2, 0.0)
        return max(tracker.getJobIdsForGroup(None)) - before

    jobs(1)
    assert jobs(6) <= jobs(1) + 1
