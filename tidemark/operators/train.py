"""Split, candidate search and the whole chain.

The model is ``boosting.Boosted`` (a documented substitution for the original boosted-tree
library: symmetric Newton trees with L2 on the leaves, not numerically equal).  Everything runs as
Spark jobs; the driver only holds parameters, metrics, names and trees.
"""

from __future__ import annotations

import itertools
import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.boosting import Boosted, Spec
from tidemark.operators.evaluate import auc_of_counts
from tidemark.operators.forest import pack_folds
from tidemark.operators.selection import (correlated_to_drop, correlation_matrix, information_value,
                                          selected)
from tidemark.session import cut_lineage


def split_key(key: str, seed: int):
    """Deterministic per-row hash (hex md5 of ``key:seed``), the same in any engine."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def stratified_split(df: DataFrame, label: str, key: str, seed: int,
                     test_share: float = 0.2, out: str = "is_test") -> DataFrame:
    """Add ``is_test`` (0/1): per label class, the round(share x n_class) rows with the
    smallest hash of (key, seed) go to test (M5).  Exact class shares, no sampling.

    The rows are neither sorted nor moved: hashes are counted by their first four hex digits
    per class (at most 65,536 rows a class), the digits in which the share is reached
    are found by a running sum over that table, only the rows with these digits are
    ranked, and the hash and key of the last test row decide for all."""
    h = split_key(key, seed)
    last = _last_tests(df.select(F.lit(0).alias("_s"), F.col(label).alias("_y"), F.col(key).alias("_k"), h.alias("_h")), test_share, 4).drop("_s")
    test = F.struct(h.alias("_h"), F.col(key).alias("_k")) <= F.col("_last")
    return df.join(last, F.col(label).eqNullSafe(F.col("_y_")), "left").withColumn(
        out, F.coalesce(test, F.lit(False)).cast("int")).drop("_y_", "_last")


def _last_tests(d: DataFrame, test_share: float, digits: int) -> DataFrame:
    """(_s, _y_, _last): hash and key of the last test row of every split and class, from rows (_s, _y, _k, _h)."""
    d = d.withColumn("_pre", F.substring("_h", 1, digits))
    counts = d.groupBy("_s", "_y", "_pre").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy("_s", "_y")
    counts = counts.select("_s", "_y", "_pre", "_n", F.sum("_n").over(by.orderBy("_pre")).alias("_cum"),
                           F.round(F.sum("_n").over(by) * F.lit(test_share)).cast("long").alias("_want"))
    edge = counts.where("_cum - _n < _want and _want <= _cum").select(
        F.col("_s").alias("_es"), F.col("_y").alias("_ey"), F.col("_pre").alias("_ep"), (F.expr("_want - _cum + _n")).alias("_left"))
    # one row a split and class
    near = d.join(F.broadcast(edge), (F.col("_s") == F.col("_es")) & F.col("_y").eqNullSafe(F.col("_ey")) & (F.col("_pre") == F.col("_ep")))
    near = near.withColumn("_rank", F.row_number().over(by.orderBy("_h", "_k")))
    return near.where("_rank = _left").select("_s", F.col("_y").alias("_y_"), F.struct("_h", "_k").alias("_last"))


def stratified_splits(df: DataFrame, label: str, key: str, splits: dict[str, tuple[Column, int]], test_share: float = 0.2) -> DataFrame:
    """A column per split (a name: the condition on its rows and its seed), 1 where ``stratified_split`` of
    these rows gives 1, 0 on the others of its rows, NULL outside.  The rows are read three times for all splits."""
    # as many digits as give at most 65,536 counted rows a class
    digits = max(1, 4 - math.ceil(math.log(len(splits), 16)))
    each = F.array(*[F.when(where, F.struct(F.lit(s).alias("_s"), split_key(key, seed).alias("_h")))
                     for s, (where, seed) in enumerate(splits.values())])
    d = df.select(F.col(label).alias("_y"), F.col(key).alias("_k"), F.explode(each).alias("_e")).where("_e is not null").select(
        "_e._s", "_y", "_k", "_e._h")
    last = _last_tests(d, test_share, digits).groupBy("_y_").agg(
        *[F.max(F.when(F.col("_s") == s, F.col("_last"))).alias(f"_last{s}") for s in range(len(splits))])
    test = [F.struct(split_key(key, seed).alias("_h"), F.col(key).alias("_k")) <= F.col(f"_last{s}") for s, (_, seed) in enumerate(splits.values())]
    return df.join(F.broadcast(cut_lineage(last)), F.col(label).eqNullSafe(F.col("_y_")), "left").select(
        *df.columns, *[F.when(where, F.coalesce(t, F.lit(False)).cast("int")).alias(name) for t, (name, (where, _)) in zip(test, splits.items())])


@dataclass
class Candidate:
    params: dict
    train_auc: float
    test_auc: float

    @property
    def score(self) -> float:
        """Test AUC penalised by the train/test gap (the original selection rule)."""
        return self.test_auc - abs(self.train_auc - self.test_auc)


def grid_points(grid: dict) -> list[dict]:
    """Cartesian product of a grid, in its order."""
    return [dict(zip(grid, combo)) for combo in itertools.product(*grid.values())]


@dataclass(frozen=True)
class Search:
    """One grid search: its features, and the column that is 0 on training rows and 1 on the
    rows that judge."""
    features: tuple[str, ...]
    fold: str
    grid: dict


@dataclass
class Found:
    """What a search found: every candidate in the grid's order, its model, and the best."""
    candidates: list[Candidate]
    models: list[Boosted]

    @property
    def best(self) -> int:
        return max(range(len(self.candidates)), key=lambda i: self.candidates[i].score)


def search_many(df: DataFrame, searches: Sequence[Search], label: str, key: str) -> list[Found]:
    """Every candidate of every search by AUC(judge) - |AUC(train) - AUC(judge)|.

    Candidates that differ only in the number of iterations are one fit, scored at each number;
    all fits of all searches grow together (``boosting.fit_many``) and one grouped AUC rates them."""
    specs: list[Spec] = []
    place: list[list[tuple[int, dict]]] = []
    for s in searches:
        family: dict[tuple, int] = {}
        mine = []
        most = max(s.grid["iterations"])
        for p in grid_points(s.grid):
            k = (p["depth"], p["learning_rate"], p["l2_leaf_reg"])
            if k not in family:
                family[k] = len(specs)
                specs.append(Spec(s.features, p["depth"], p["learning_rate"], p["l2_leaf_reg"], most, s.fold))
            mine.append((family[k], p))
        place.append(mine)
    fitted, blocks, folds, names = boosting.fit_many(df, specs, label, key)
    models = [[fitted[i].first(p["iterations"]) for i, p in mine] for mine in place]
    flat = [(m, s.fold) for s, mine in zip(searches, models) for m in mine]
    counts = boosting.score_counts(blocks, folds, names, flat)
    auc = {(r["cand"], r["fold"]): r["auc"]
           for r in auc_of_counts(counts, "score", ["cand", "fold"]).collect()}      # a row a candidate and fold
    out, at = [], 0
    for mine, fits in zip(place, models):
        cands = [Candidate(p, auc.get((at + i, 0)), auc.get((at + i, 1))) for i, (_, p) in enumerate(mine)]
        out.append(Found(cands, fits))
        at += len(mine)
    return out


@dataclass
class Study:
    """What ``model_pipeline`` chose.  Without an accepted feature there is no model:
    ``features`` and ``candidates`` are empty, ``model`` and ``chosen`` None."""
    model: Boosted | None
    features: list[str]
    candidates: list[Candidate]
    chosen: Candidate | None
    rows: DataFrame               # key, label, part, the filtered features and the kept columns
    selection: list[tuple]        # (feature, hits, rounds, p_value, state, accepted)

    def scored(self, key: str, *more: str) -> DataFrame:
        """(key, part, label, more..., score) of every row; no rows without a model."""
        if self.model is None:
            return self.rows.select(key, "part", "label", *more, F.lit(None).cast("double").alias("score")).where("false")
        return boosting.score(self.model, self.rows).select(key, "part", "label", *more, "score")

    def to_json(self) -> str:
        cands = [[c.params, c.train_auc, c.test_auc] for c in self.candidates]
        m = self.model
        model = m and [m.features, m.edges, [[t.features, t.cuts, t.values.tolist(), t.covers.tolist()] for t in m.trees]]
        return json.dumps([model, self.features, cands, self.candidates.index(self.chosen) if self.chosen else None, self.selection])

    @staticmethod
    def from_json(text: str, rows: DataFrame) -> Study:
        model, features, cands, chosen, selection = json.loads(text)
        if model:
            trees = tuple(boosting.Tree(tuple(f), tuple(c), np.array(v), np.array(w)) for f, c, v, w in model[2])
            model = Boosted(tuple(model[0]), tuple(map(tuple, model[1])), trees)
        cands = [Candidate(*c) for c in cands]
        return Study(model, features, cands, None if chosen is None else cands[chosen], rows, [tuple(r) for r in selection])


def model_pipeline(df: DataFrame, features: Sequence[str], label: str, key: str, grid: dict, seed: int,
                   corr_threshold: float = 0.7, iv_threshold: float = 0.01, bins: int = 10,
                   test_share: float = 0.2, validation_share: float = 0.0, num_trees: int = 50,
                   prefiltered: bool = False, keep: Sequence[str] = ()) -> Study:
    """Correlation filter, IV filter, stratified split, shadow selection on the training rows,
    candidate search, chosen model (M17).

    ``validation_share`` > 0 holds out that share of the training rows to choose the
    candidate, so the test rows stay untouched; with 0 the test rows choose (the original
    rule)."""
    return pipelines(df, {"": F.lit(True)}, features, label, key, grid, [seed], corr_threshold, iv_threshold, bins,
                     test_share, validation_share, num_trees, prefiltered, keep)[("", seed)]


def pipelines(df: DataFrame, groups: dict[str, Column], features: Sequence[str], label: str, key: str, grid: dict,
              seeds: Sequence[int], corr_threshold: float = 0.7, iv_threshold: float = 0.01, bins: int = 10,
              test_share: float = 0.2, validation_share: float = 0.0, num_trees: int = 50,
              prefiltered: bool = False, keep: Sequence[str] = (), fit: bool = True,
              parallelism: int = 4) -> dict[tuple[str, int], Study]:
    """The chain for every group of rows (a name and its condition) and every seed, all models
    fitted in the same passes (M17, M18, M20).  Selections run side by side; ``fit`` False
    stops after them."""
    feats = list(features)
    kept = {name: feats if prefiltered else prefilter(df.where(F.coalesce(c, F.lit(False))), feats, label, corr_threshold, iv_threshold, bins)
            for name, c in groups.items()}
    used = [f for f in feats if any(f in k for k in kept.values())]
    marked = df.select(key, F.col(label).alias("label"), *[F.coalesce(c, F.lit(False)).alias(f"_g{i}") for i, c in enumerate(groups.values())],
                       *used, *[c for c in keep if c not in used])
    names = {f"_p{i}_{j}": (i, seed) for i in range(len(groups)) for j, seed in enumerate(seeds)}
    rows = _parts(marked, key, names, test_share, validation_share)

    studies, searches = {}, []
    judge = "valid" if validation_share else "test"

    packs = {}
    for i, name in enumerate(groups):                    # the rows of a group are packed once for all of its seeds
        if kept[name]:
            packs[i] = pack_folds(rows, kept[name], "label", key, [F.col(f"_p{i}_{j}") == "train" for j in range(len(seeds))])

    def select(what):
        i, name, j, seed = what
        return selected(packs[i][j], kept[name], seed, num_trees) if kept[name] else []             # one row per feature

    cases = [(i, name, j, seed) for i, name in enumerate(groups) for j, seed in enumerate(seeds)]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        selections = dict(zip(cases, ex.map(select, cases)))
    for i, name in enumerate(groups):
        for j, seed in enumerate(seeds):
            column, sel = f"_p{i}_{j}", selections[i, name, j, seed]
            chosen = [r[0] for r in sel if r[5]]
            view = rows.where(F.col(column).isNotNull()).select(
                key, "label", F.col(column).alias("part"), *kept[name], *[c for c in keep if c not in kept[name]])
            studies[name, seed] = Study(None, chosen, [], None, view, sel)
            if chosen and fit:
                searches.append(((name, seed), Search(tuple(chosen), f"_f{i}_{j}", grid)))
    if searches:
        for n in names:
            rows = rows.withColumn(n.replace("_p", "_f"), F.when(F.col(n) == "train", 0).when(F.col(n) == judge, 1).when(
                F.col(n).isNotNull(), 2))
        for (k, s), found in zip(searches, search_many(rows, [s for _, s in searches], "label", key)):
            st = studies[k]
            st.candidates, st.chosen, st.model = found.candidates, found.candidates[found.best], found.models[found.best]
    return studies


def _parts(marked: DataFrame, key: str, names: dict[str, tuple[int, int]], test_share: float, validation_share: float) -> DataFrame:
    """``marked`` with a column per split (a name: its group and its seed) that tells a row's part, NULL outside the
    group.  Rows of one key are in the same part of a split, the last by name; rows without a key in none."""
    splits = {n: (F.col(f"_g{i}"), seed) for n, (i, seed) in names.items()}
    rows = stratified_splits(marked, "label", key, splits, test_share)
    part = {n: F.when(F.col(n) == 1, "test").otherwise("train") for n in names}
    if validation_share:
        # the split of the training rows again
        held = {f"_v{n}": (F.coalesce(F.col(n) == 0, F.lit(False)), seed + 7919) for n, (_, seed) in splits.items()}
        rows = stratified_splits(rows, "label", key, held, validation_share)
        part = {n: F.when(F.col(f"_v{n}") == 1, "valid").otherwise(p) for n, p in part.items()}
    rows = cut_lineage(rows.select(*marked.columns, *[
        F.when(F.col(n).isNotNull() & F.col(key).isNotNull(), p).alias(n) for n, p in part.items()]))
    again = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_times"), *[F.max(n).alias(f"_q{n}") for n in names]).where("_times > 1")
    again = cut_lineage(again)
    if again.isEmpty():
        return rows
    return cut_lineage(rows.join(again, F.col(key) == F.col("_key"), "left").select(
        *marked.columns, *[F.coalesce(f"_q{n}", n).alias(n) for n in names]))


def prefilter(df: DataFrame, features: Sequence[str], label: str, corr_threshold: float,
              iv_threshold: float, bins: int) -> list[str]:
    """Features kept by the correlation and the information-value filters, in their order."""
    dropped = set(correlated_to_drop(features, correlation_matrix(df, features), corr_threshold))
    kept = [f for f in features if f not in dropped]
    low = {r.feature for r in information_value(df, label, kept, bins=bins)
           .where(F.col("iv") < iv_threshold).collect()}                     # one row per feature
    return [f for f in kept if f not in low]
