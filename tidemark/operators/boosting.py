"""Newton-boosted symmetric trees: many models trained in the same passes.

Rows are binned once (quantile cuts per feature) and packed into blocks.  A level of a
symmetric tree has one split for all its leaves, chosen by the largest sum over the leaves of
``G^2 / (H + l2)``, G and H being sums of the log-loss gradients and hessians; a leaf's value is
``rate * G / (H + l2)``; scores start at 0.

``fit_many`` grows a list of models (grid points, seeds, segments: each names its features and
the column that tells its training rows) side by side.  One scan per tree level counts
(model, leaf, feature, bin) histograms of all models in the tasks, and one grouped aggregate
per (model, feature) adds them up and picks the best cut; the driver holds one split per
model.  Every few trees the scores go to a checkpoint, so a scan applies only the trees
since then and a lost task repeats one scan.  Where the packed table has a known size below
``task_cells`` cells and ``TASK_BYTES`` of working memory a model's rows fit one task, and the same
steps run there without a job per level.

A tree sees a row only by its bins, label and fold, so rows that agree in these are merged first
(``merged``: one grouped count per fold) and counted with their number: the work of a level is
bounded by the cells of the selected features, not by the rows.  With more than ``MERGE_CELLS``
possible cells the rows stay as they are.

Gradients are rounded to multiples of 2**-24 and summed as integers, so the trees depend
neither on the order or partitioning of the rows nor on which way they were grown.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import wide_quantiles
from tidemark.session import cut_lineage

_UNIT = float(1 << 24)
#: Working memory of a model that is grown inside one task: label, score, gradient, hessian, leaf and
#: the keys of a histogram take about 80 bytes a row beside its features, however few these are.
#: Merged rows hold their number, and the sums times it, beside these.
TASK_BYTES, ROW_BYTES, MERGED_BYTES = 192 << 20, 80, 128
#: Possible cells (products of the bins of a fold's features) up to which a cell has a 64-bit number
#: beside its fold code and label.  TABLE_CELLS: numbers that a task keeps to look up scores by cell.
MERGE_CELLS, TABLE_CELLS = 1 << 46, 1 << 21


@dataclass(frozen=True)
class Spec:
    """A model to fit; its training rows are those with ``fold`` = 0."""
    features: tuple[str, ...]
    depth: int
    rate: float
    l2: float
    iterations: int
    fold: str = "fold"


@dataclass(frozen=True)
class Tree:
    """One symmetric tree: bit k of a leaf's number tells whether its rows exceed cut k."""
    features: tuple[int, ...]
    cuts: tuple[int, ...]
    values: np.ndarray
    covers: np.ndarray                  # training rows per leaf


@dataclass(frozen=True)
class Boosted:
    """A fitted model: feature names, cut points per feature, trees."""
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    trees: tuple[Tree, ...]

    def first(self, n: int) -> Boosted:
        """The model of the first ``n`` trees: what a fit of n iterations gives."""
        return Boosted(self.features, self.edges, self.trees[:n])

    def bins(self, x: np.ndarray) -> np.ndarray:
        return bin_matrix(x, self.edges)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows given as a matrix in the order of ``features``."""
        return raw_scores(self.bins(x), self.trees, range(len(self.features)))

    def by_cell(self) -> ByCell:
        """Probabilities of binned rows (rows, 1)."""
        return ByCell(self.edges, 1, lambda bins: probability(raw_scores(bins, self.trees, range(len(self.features))))[:, None])


def bin_matrix(x: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Number of cut points below each value; NaN (and NULL) counts as lowest."""
    out = np.zeros(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(np.asarray(e, float), x[:, j], side="left"))
    return out


def leaves(bins: np.ndarray, features: Sequence[int], cuts: Sequence[int], columns: Sequence[int]) -> np.ndarray:
    return leaves_of(bins.T, features, cuts, columns)


def leaves_of(by_column: np.ndarray, features: Sequence[int], cuts: Sequence[int], columns: Sequence[int]) -> np.ndarray:
    """``leaves`` of binned features held column by column."""
    at = np.zeros(by_column.shape[1], np.uint8 if len(features) <= 8 else np.int64)
    for k, (f, c) in enumerate(zip(features, cuts)):
        at |= (by_column[columns[f]] > c).astype(at.dtype) << at.dtype.type(k)
    return at.astype(np.int64)


def raw_scores(bins: np.ndarray, trees: Sequence[Tree], columns: Sequence[int]) -> np.ndarray:
    out = np.zeros(len(bins))
    for t in trees:
        out += t.values[leaves(bins, t.features, t.cuts, columns)]
    return out


def probability(raw: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-raw))


def gradients(y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the log-loss in units of 2**-24, as whole numbers."""
    p = probability(raw)
    return np.rint((y - p) * _UNIT), np.rint(p * (1 - p) * _UNIT)


#: Rows of one count: 2**14 hessians of at most 2**22 each sum to 2**36 at most, and with the rows
#: counted above them, from bit 37 on, stay below 2**53, so one double holds both exactly.
_CHUNK, _ROW = 1 << 14, float(1 << 37)


def histogram(bins: np.ndarray, leaf: np.ndarray, n_leaves: int, g: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """(3, leaves, width) whole-number sums of gradient, hessian and rows of one feature."""
    return histograms([bins], leaf, n_leaves, g, h, width)[0]


def times(g: np.ndarray, h: np.ndarray, w: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of merged rows, whole numbers of 64 bits."""
    return (g, h) if w is None else (g.astype(np.int64) * w, h.astype(np.int64) * w)


def histograms(columns: Sequence[np.ndarray], leaf: np.ndarray, n_leaves: int, g: np.ndarray, h: np.ndarray, width: int,
               w: np.ndarray | None = None) -> np.ndarray:
    """(features, 3, leaves, width): the ``histogram`` of every column, counted in chunks of rows.
    ``w``: how many rows each stands for; ``g`` and ``h`` are then already ``times`` it."""
    size = n_leaves * width
    out = np.zeros((len(columns), 3, size), np.int64)
    if w is not None:
        exact = w.sum() < 1 << 28             # sums of doubles are exact below 2**53
        for j, bins in enumerate(columns):
            key = leaf * width + bins
            for k, x in enumerate((g, h, w)):
                if exact:
                    out[j, k] = np.bincount(key, weights=x, minlength=size).astype(np.int64)
                else:
                    np.add.at(out[j, k], key, x)
        return out.reshape(len(columns), 3, n_leaves, width)
    for lo in range(0, len(leaf), _CHUNK):
        part = slice(lo, lo + _CHUNK)
        base, gs, packed = leaf[part] * width, g[part], h[part] + _ROW
        for j, bins in enumerate(columns):
            key = base + bins[part]
            out[j, 0] += np.bincount(key, weights=gs, minlength=size).astype(np.int64)
            both = np.bincount(key, weights=packed, minlength=size).astype(np.int64)
            out[j, 1] += both & (int(_ROW) - 1)
            out[j, 2] += both >> 37
    return out.reshape(len(columns), 3, n_leaves, width)


def grown(parent: np.ndarray, columns: Sequence[np.ndarray], leaf: np.ndarray, n_leaves: int, g: np.ndarray, h: np.ndarray,
          width: int, w: np.ndarray | None = None) -> np.ndarray:
    """``histograms`` of a level from those of the level above: only the rows on the smaller side of the
    last cut are counted, the other side is what they leave of their parents (whole numbers, so exactly)."""
    half = n_leaves // 2
    high = leaf >= half
    upper = 2 * np.count_nonzero(high) <= len(leaf)
    at = np.flatnonzero(high if upper else ~high)
    few = histograms([c[at] for c in columns], leaf[at] & (half - 1), half, g[at], h[at], width,
                     None if w is None else w[at])
    return np.concatenate((parent - few, few) if upper else (few, parent - few), axis=2)


def leaf_score(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    den = h / _UNIT + l2
    return np.divide((g / _UNIT) ** 2, den, out=np.zeros(np.broadcast(g, den).shape), where=den > 0)


def best_cut(hist: np.ndarray, n_cuts: int, l2: float) -> tuple[float, int, np.ndarray] | None:
    """(gain, cut, sums of the children: 3 x 2 leaves) of the best cut of a feature, lowest cut
    first among equals; None where the feature has no cut."""
    if not n_cuts:
        return None
    low = np.cumsum(hist, axis=2)[:, :, :n_cuts]
    all_ = hist.sum(axis=2)[:, :, None]
    high = all_ - low
    gain = (leaf_score(low[0], low[1], l2) + leaf_score(high[0], high[1], l2)).sum(axis=0)
    gain -= leaf_score(all_[0], all_[1], l2).sum(axis=0)
    cut = int(np.argmax(gain))
    return float(gain[cut]), cut, np.concatenate((low[:, :, cut], high[:, :, cut]), axis=1)


class Growing:
    """One model under way; the same steps serve a task with all rows and the driver."""

    def __init__(self, spec: Spec):
        self.spec = spec
        self.trees: list[Tree] = []
        self.begin()

    def begin(self) -> None:
        self.features: list[int] = []
        self.cuts: list[int] = []
        self.sums: np.ndarray | None = None

    @property
    def done(self) -> bool:
        return len(self.trees) >= self.spec.iterations

    def split(self, best: tuple[float, int, int, np.ndarray] | None, total: Callable[[], np.ndarray]) -> None:
        """Take the level's best (gain, feature, cut, sums), or close the tree where none gains."""
        if best is not None and best[0] > 1e-9:
            self.features.append(best[1])
            self.cuts.append(best[2])
            self.sums = best[3]
            if len(self.features) < self.spec.depth:
                return
        sums = self.sums if self.sums is not None else total()
        den = sums[1] / _UNIT + self.spec.l2
        value = np.divide(sums[0] / _UNIT, den, out=np.zeros(len(den)), where=den > 0) * self.spec.rate
        self.trees.append(Tree(tuple(self.features), tuple(self.cuts), value, sums[2].astype(float)))
        self.begin()


def best_feature(found: list[tuple[int, tuple[float, int, np.ndarray] | None]]) -> tuple[float, int, int, np.ndarray] | None:
    """The feature of the largest gain, the first among equals."""
    best = None
    for f, cut in found:
        if cut is not None and (best is None or cut[0] > best[0]):
            best = (cut[0], f, cut[1], cut[2])
    return best


# ---------------------------------------------------------------- packed rows

def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int = 32) -> dict[str, tuple[float, ...]]:
    """Cut points per feature: its distinct inner quantiles at multiples of 1 / bins (bins <= 255),
    without those that no value exceeds."""
    finite = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    got = wide_quantiles(df, finite, [i / bins for i in range(1, bins + 1)])
    return {c: tuple(sorted({v for v in q if v is not None and v < q[-1]})) for c, q in got.items()}


def pack(df: DataFrame, edges: dict[str, tuple[float, ...]], label: str, key: str, folds: Sequence[str]) -> DataFrame:
    """Blocks of rows (one an Arrow batch): keys, labels, fold codes (0 training rows, others as
    given, NULL as -1) and binned features; ``fold`` -1: a block has the rows of all folds."""
    names = list(edges)
    cuts = [edges[c] for c in names]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(2 + len(folds) + j).to_numpy(zero_copy_only=False).astype(float)
                          for j in range(len(names))], axis=1) if names else np.zeros((b.num_rows, 0))
            marks = np.stack([b.column(2 + j).to_numpy(zero_copy_only=False) for j in range(len(folds))], axis=1)
            yield pa.RecordBatch.from_arrays([
                pa.array([b.num_rows], pa.int32()), pa.array([b.column(0).to_pylist()], pa.list_(b.schema.field(0).type)),
                pa.array([b.column(1).to_numpy(zero_copy_only=False).astype(np.int8).tobytes()], pa.binary()),
                pa.array([marks.astype(np.int8).tobytes()], pa.binary()),
                pa.array([bin_matrix(x, cuts).tobytes()], pa.binary()), pa.array([None], pa.binary())],
                names=["n", "keys", "y", "folds", "bins", "w"])

    rows = _labelled(df, names, label, [F.col(key)], folds)
    return cut_lineage(rows.mapInArrow(run, f"n int, keys array<{kind}>, y binary, folds binary, bins binary, w binary").withColumn(
        "fold", F.lit(-1)))


def _labelled(df: DataFrame, names: Sequence[str], label: str, more: Sequence[Column], folds: Sequence[str]) -> DataFrame:
    """Rows with a label: (more..., label, fold codes, features)."""
    rows = df.where(F.col(label).isNotNull()).select(
        *more, F.col(label).cast("int"), *[F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in folds],
        *[F.col(c).cast("double") for c in names])
    # positions, not names: a fold or the key may also be a feature
    return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])


def cell_sizes(edges: Sequence[Sequence[float]]) -> tuple[list[int], int]:
    """Bins of each feature, and their product."""
    sizes = [len(e) + 1 for e in edges]
    return sizes, math.prod(sizes)


def cell_codes(bins: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """One number per row of binned features, the same where all bins are."""
    code = np.zeros(len(bins), np.int64)
    for j, size in enumerate(sizes):
        code = code * size + bins[:, j]
    return code


class ByCell:
    """A function of binned rows, (rows, features) -> (rows, width), worked out once per cell of a
    task where the cells are few: a lookup in place of all trees."""

    def __init__(self, edges: Sequence[Sequence[float]], width: int, fn: Callable[[np.ndarray], np.ndarray]):
        self.sizes, self.cells = cell_sizes(edges)
        self.width, self.fn, self.table = width, fn, None

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        if self.cells * self.width > TABLE_CELLS:
            return self.fn(bins)
        if self.table is None:
            self.table, self.seen = np.empty((self.cells, self.width)), np.zeros(self.cells, bool)
        code = cell_codes(bins, self.sizes)
        new = np.flatnonzero(~self.seen[code])
        if len(new):
            codes, at = np.unique(code[new], return_index=True)
            self.table[codes] = self.fn(bins[new[at]])
            self.seen[codes] = True
        return self.table[code]


def merged(df: DataFrame, edges: dict[str, tuple[float, ...]], label: str, folds: Sequence[str],
           of_fold: Sequence[Sequence[int]]) -> DataFrame:
    """``pack`` with one row, and its number ``w``, for all rows of a fold that agree in label, fold code
    and the bins of the fold's features (``of_fold``, places in ``edges``).  A block (``fold``) holds
    rows of one fold: the codes of the others are -1 there, other features 0."""
    cuts, n_folds = list(edges.values()), len(folds)
    shape = [cell_sizes([cuts[j] for j in columns]) for columns in of_fold]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in folds]
        size = 0

        def add() -> None:
            for f, parts in enumerate(held):
                if len(parts) > 1:
                    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                    sums = np.zeros(len(codes), np.int64)
                    np.add.at(sums, at, np.concatenate([n for _, n in parts]))
                    held[f] = [(codes, sums)]

        def out() -> Iterator[pa.RecordBatch]:
            for f, parts in enumerate(held):
                for codes, sums in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), f, np.int32)), pa.array(codes), pa.array(sums)],
                                                     names=["fold", "code", "w"])

        for b in batches:
            col = lambda j: b.column(j).to_numpy(zero_copy_only=False)
            y = col(0).astype(np.int8).astype(np.int64) + 128
            x = np.stack([col(1 + n_folds + j).astype(float) for j in range(len(cuts))], axis=1) if cuts else np.zeros((b.num_rows, 0))
            bins = bin_matrix(x, cuts)
            for f, (columns, (sizes, cells)) in enumerate(zip(of_fold, shape)):
                mark = col(1 + f).astype(np.int8).astype(np.int64)
                use = mark >= 0
                code = (mark[use] * 256 + y[use]) * cells + cell_codes(bins[use][:, columns], sizes)
                found = np.unique(code, return_counts=True)
                held[f].append((found[0], found[1].astype(np.int64)))
                size += len(found[0])
            if size > 1 << 19:
                add()
                size = sum(len(c) for parts in held for c, _ in parts)
                if size > 1 << 18:
                    yield from out()
                    held, size = [[] for _ in folds], 0
        add()
        yield from out()

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, code, w = (b.column(j).to_numpy(zero_copy_only=False) for j in range(3))
            for f in np.unique(fold):
                at = fold == f
                sizes, cells = shape[f]
                head, rest = np.divmod(code[at], cells)
                bins, marks = np.zeros((len(head), len(cuts)), np.uint8), np.full((len(head), n_folds), -1, np.int8)
                for j, size in reversed(list(zip(of_fold[f], sizes))):
                    rest, bins[:, j] = np.divmod(rest, size)
                marks[:, f] = head // 256
                yield pa.RecordBatch.from_arrays([
                    pa.array([len(head)], pa.int32()), pa.array([(head % 256 - 128).astype(np.int8).tobytes()], pa.binary()),
                    pa.array([marks.tobytes()], pa.binary()), pa.array([bins.tobytes()], pa.binary()),
                    pa.array([w[at].astype(np.int64).tobytes()], pa.binary()), pa.array([f], pa.int32())],
                    names=["n", "y", "folds", "bins", "w", "fold"])

    counts = _labelled(df, list(edges), label, [], folds).mapInArrow(count, "fold int, code long, w long")
    whole = counts.groupBy("fold", "code").agg(F.sum("w").alias("w"))
    return cut_lineage(whole.mapInArrow(block, "n int, y binary, folds binary, bins binary, w binary, fold int"))


def unpack(row: dict, n_folds: int, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Labels, fold codes, binned features, and the rows that each row stands for (None: itself)."""
    n = row["n"]
    return (np.frombuffer(row["y"], np.int8).astype(float), np.frombuffer(row["folds"], np.int8).reshape(n, n_folds),
            np.frombuffer(row["bins"], np.uint8).reshape(n, n_features), None if row["w"] is None else np.frombuffer(row["w"], np.int64))


# ---------------------------------------------------------------- fitting

def fit_many(df: DataFrame, specs: Sequence[Spec], label: str, key: str, bins: int = 32,
             task_cells: int = 1 << 26, trees_per_state: int = 10) -> tuple[list[Boosted], DataFrame, list[str], list[str]]:
    """Fit every spec; (models, packed rows, names of their folds, names of their features).

    Rows with a NULL label take no part; NULL and NaN values go with the lowest bin.  A model
    without training rows or without a cut keeps trees of one leaf.  ``task_cells``: up to so many
    (merged) rows x features, and ``TASK_BYTES`` of memory, a model is grown inside one task."""
    folds = sorted({s.fold for s in specs})
    names = sorted({f for s in specs for f in s.features})
    edges = quantile_cuts(df, names, bins)
    edges = {c: edges[c] for c in names}
    of_fold = [sorted({names.index(c) for s in specs if s.fold == f for c in s.features}) for f in folds]
    mergeable = all(cell_sizes([edges[names[j]] for j in columns])[1] <= MERGE_CELLS for columns in of_fold)
    if mergeable:
        blocks = merged(df, edges, label, folds, of_fold)
    else:
        blocks = pack(df, edges, label, key, folds)
    n = max((r["n"] for r in blocks.groupBy("fold").agg(F.sum("n").alias("n")).collect()), default=0)     # a row a fold
    plan = _Plan(list(specs), folds, names, edges, bins)
    if fits_task(n, len(names), task_cells, MERGED_BYTES if mergeable else ROW_BYTES):
        trees = _in_tasks(blocks, plan)
    else:
        trees = _level_by_level(blocks, plan, trees_per_state)
    models = [Boosted(s.features, tuple(edges[c] for c in s.features), tuple(t)) for s, t in zip(specs, trees)]
    return models, blocks, folds, names


def fits_task(rows: int, features: int, task_cells: int, row_bytes: int = ROW_BYTES) -> bool:
    """Whether a model of all rows may grow inside one task, by cells and by bytes."""
    return rows * max(1, features) <= task_cells and rows * (features + row_bytes) <= TASK_BYTES


@dataclass(frozen=True)
class _Plan:
    specs: list[Spec]
    folds: list[str]
    names: list[str]
    edges: dict[str, tuple[float, ...]]
    bins: int

    def columns(self, m: int) -> list[int]:
        return [self.names.index(f) for f in self.specs[m].features]

    def cuts(self, m: int, f: int) -> int:
        return len(self.edges[self.specs[m].features[f]])

    def rows(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        return unpack(row, len(self.folds), len(self.names))

    def training(self, folds: np.ndarray, m: int) -> np.ndarray:
        return folds[:, self.folds.index(self.specs[m].fold)] == 0


def _in_tasks(blocks: DataFrame, plan: _Plan) -> list[list[Tree]]:
    """Each model grown in one task over its own training rows."""
    def run(table: pa.Table) -> pa.Table:
        m = table.column("model")[0].as_py()
        spec, columns = plan.specs[m], plan.columns(m)
        ys, xs, ws = [], [], []
        for row in table.to_pylist():
            y, folds, b, w = plan.rows(row)
            use = plan.training(folds, m)
            ys.append(y[use])
            xs.append(b[use][:, columns])
            if w is not None:
                ws.append(w[use])
        y, x, w = np.concatenate(ys), np.asfortranarray(np.concatenate(xs)), np.concatenate(ws) if ws else None
        raw, g_model = np.zeros(len(y)), Growing(spec)
        while not g_model.done:
            g, h = times(*gradients(y, raw), w)
            leaf, trees, hists = np.zeros(len(y), np.int64), len(g_model.trees), None
            while len(g_model.trees) == trees:
                depth = len(g_model.features)
                each = [x[:, f] for f in range(len(columns))]
                hists = histograms(each, leaf, 1, g, h, plan.bins, w) if hists is None else grown(
                    hists, each, leaf, 1 << depth, g, h, plan.bins, w)
                found = [(f, best_cut(hists[f], plan.cuts(m, f), spec.l2)) for f in range(len(columns))]
                g_model.split(best_feature(found), lambda: np.array([[g.sum()], [h.sum()], [len(y) if w is None else w.sum()]]))
                if len(g_model.features) > depth:
                    leaf |= (x[:, g_model.features[-1]] > g_model.cuts[-1]).astype(np.int64) << depth
                elif len(g_model.trees) > trees and len(g_model.trees[-1].features) > depth:
                    t = g_model.trees[-1]
                    leaf |= (x[:, t.features[-1]] > t.cuts[-1]).astype(np.int64) << depth
            raw += g_model.trees[-1].values[leaf]
        return _tree_rows(m, g_model.trees)

    n = len(plan.specs)
    # a merged block goes to the models of its fold only
    of_fold = F.array(*[F.array(*[F.lit(i) for i, s in enumerate(plan.specs) if s.fold == f]) for f in plan.folds])
    spread = blocks.drop("keys").withColumn("model", F.explode(
        F.when(F.col("fold") < 0, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.get(of_fold, F.greatest("fold", F.lit(0))))))
    out = spread.repartition(n, "model").groupBy("model").applyInArrow(run, _TREE_SCHEMA)
    trees: list[list[Tree]] = [[] for _ in plan.specs]
    # bounded by the specs: models x iterations rows of at most 2 ** depth leaves
    for r in sorted(out.collect(), key=lambda r: (r["model"], r["tree"])):
        trees[r["model"]].append(Tree(tuple(r["features"]), tuple(r["cuts"]), np.array(r["leaf_values"]), np.array(r["covers"])))
    return [t or [Tree((), (), np.zeros(1), np.zeros(1))] * s.iterations for t, s in zip(trees, plan.specs)]


_TREE_SCHEMA = "model int, tree int, features array<int>, cuts array<int>, leaf_values array<double>, covers array<double>"


def _tree_rows(m: int, trees: Sequence[Tree]) -> pa.Table:
    return pa.table({
        "model": pa.array([m] * len(trees), pa.int32()), "tree": pa.array(range(len(trees)), pa.int32()),
        "features": pa.array([list(t.features) for t in trees], pa.list_(pa.int32())),
        "cuts": pa.array([list(t.cuts) for t in trees], pa.list_(pa.int32())),
        "leaf_values": pa.array([t.values.tolist() for t in trees], pa.list_(pa.float64())),
        "covers": pa.array([t.covers.tolist() for t in trees], pa.list_(pa.float64()))})


def _level_by_level(blocks: DataFrame, plan: _Plan, trees_per_state: int) -> list[list[Tree]]:
    """All models grown together, one job per tree level."""
    models = [Growing(s) for s in plan.specs]
    state, kept = blocks.drop("keys").withColumn("raw", F.lit(None).cast("binary")), [0] * len(models)
    while not all(m.done for m in models):
        active = [i for i, m in enumerate(models) if not m.done]
        tree = min(len(models[i].trees) for i in active)
        if tree and tree % trees_per_state == 0 and any(kept[i] < tree for i in active):
            state = cut_lineage(_advance(state, plan, models, kept, tree))
            kept = [min(tree, len(m.trees)) for m in models]
        level = [i for i in active if len(models[i].trees) == tree]
        found: dict[int, list] = {i: [] for i in level}
        totals = {}
        for r in _level(state, plan, models, kept, level).collect():            # one row per model
            sums = np.frombuffer(r["sums"], np.int64).reshape(3, -1)
            if r["feature"] < 0:
                totals[r["model"]] = sums
            else:
                found[r["model"]].append((r["gain"], r["feature"], r["cut"], sums))
        for i in level:
            total = totals.get(i, np.zeros((3, 1), np.int64))
            models[i].split(found[i][0] if found[i] else None, lambda: total)
    return [m.trees for m in models]


def _scores(raw: bytes | None, n_models: int, n: int) -> np.ndarray:
    return np.zeros((n_models, n)) if raw is None else np.frombuffer(raw).reshape(n_models, n)


def _advance(state: DataFrame, plan: _Plan, models: list[Growing], kept: list[int], until: int) -> DataFrame:
    """The scores with the trees grown since the last state added."""
    fresh = [m.trees[k:until] for m, k in zip(models, kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in enumerate(b.to_pylist()):
                _, _, x, _ = plan.rows(row)
                raw = _scores(row["raw"], len(fresh), row["n"]).copy()
                for m, trees in enumerate(fresh):
                    for t in trees:
                        raw[m] += t.values[leaves(x, t.features, t.cuts, plan.columns(m))]
                one = b.slice(i, 1)
                yield one.set_column(one.schema.get_field_index("raw"), "raw", pa.array([raw.tobytes()], pa.binary()))

    return state.mapInArrow(run, state.schema)


def _level(state: DataFrame, plan: _Plan, models: list[Growing], kept: list[int], level: list[int]) -> DataFrame:
    """(model, feature, gain, cut, sums): the best split of the current level of each model;
    feature -1 holds the sums of all training rows for models without any cut."""
    work = [(i, plan.columns(i), models[i].trees[kept[i]:], tuple(models[i].features), tuple(models[i].cuts)) for i in level]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for row in b.to_pylist():
                y, folds, x, w = plan.rows(row)
                raw = _scores(row["raw"], len(plan.specs), row["n"])
                of_fold: dict[str, tuple] = {}               # the training rows of a fold, column by column
                for i, columns, fresh, features, cuts in work:
                    fold = plan.specs[i].fold
                    if fold not in of_fold:
                        use = plan.training(folds, i)
                        of_fold[fold] = use, y[use], np.ascontiguousarray(x[use].T), None if w is None else w[use]
                    use, labels, mine, weight = of_fold[fold]
                    if not len(labels):
                        continue
                    score = raw[i][use]
                    for t in fresh:
                        score = score + t.values[leaves_of(mine, t.features, t.cuts, columns)]
                    g, h = times(*gradients(labels, score), weight)
                    leaf = leaves_of(mine, features, cuts, columns)
                    able = [f for f in range(len(columns)) if plan.cuts(i, f)]
                    for f, hist in zip(able, histograms([mine[columns[f]] for f in able], leaf, 1 << len(features), g, h, plan.bins, weight)):
                        _add(sums, (i, f), hist)
                    _add(sums, (i, -1), np.array([[[g.sum()]], [[h.sum()]], [[len(g) if weight is None else weight.sum()]]]).astype(np.int64))
        if sums:
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()),
                pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["model", "feature", "hist"])

    def choose(table: pa.Table) -> pa.Table:
        m, f = table.column("model")[0].as_py(), table.column("feature")[0].as_py()
        total = sum(np.frombuffer(v, np.int64) for v in table.column("hist").to_pylist())
        if f < 0:
            gain, cut, sums = -1.0, -1, total
        else:
            gain, cut, sums = best_cut(total.reshape(3, -1, plan.bins), plan.cuts(m, f), plan.specs[m].l2)
        return pa.table({"model": pa.array([m], pa.int32()), "feature": pa.array([f], pa.int32()), "gain": [gain],
                         "cut": pa.array([cut], pa.int32()), "sums": [sums.tobytes()]})

    hists = state.mapInArrow(scan, "model int, feature int, hist binary")
    cuts = hists.groupBy("model", "feature").applyInArrow(choose, "model int, feature int, gain double, cut int, sums binary")
    best = F.max_by(F.struct("feature", "gain", "cut", "sums"), F.struct("gain", -F.col("feature"))).alias("s")
    return cuts.groupBy("model", F.col("feature") < 0).agg(best).select("model", "s.*")


def _add(sums: dict, key: tuple[int, int], hist: np.ndarray) -> None:
    if key in sums:
        sums[key] += hist
    else:
        sums[key] = hist


# ---------------------------------------------------------------- scoring

def score(model: Boosted, df: DataFrame, out: str = "score") -> DataFrame:
    """``df`` with the positive-class probability of each row."""
    by_cell = model.by_cell()

    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        return pa.array(by_cell(model.bins(to_matrix(values, len(model.features))))[:, 0], pa.float64())
    return df.withColumn(out, run(features_array(model.features)))


def score_by(models: dict[str, Boosted], df: DataFrame, group: str, out: str = "score") -> DataFrame:
    """``score`` with the model that the row's group names; NULL where there is none."""
    names = sorted({f for m in models.values() for f in m.features})
    by_cell = {name: m.by_cell() for name, m in models.items()}

    @F.arrow_udf("double")
    def run(which: pa.Array, values: pa.Array) -> pa.Array:
        x, which = to_matrix(values, len(names)), np.array(which.to_pylist(), object)
        p = np.full(len(x), np.nan)
        for name, m in models.items():
            at = which == name
            p[at] = by_cell[name](m.bins(x[at][:, [names.index(f) for f in m.features]]))[:, 0]
        return pa.array(p, pa.float64(), mask=np.isnan(p))
    return df.withColumn(out, run(F.col(group).cast("string"), features_array(names)))


def features_array(features: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features]) if features else F.array(F.lit(0.0))


def to_matrix(values: pa.Array, k: int) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1)[:, :k]


def score_counts(blocks: DataFrame, folds: Sequence[str], names: Sequence[str],
                 candidates: Sequence[tuple[Boosted, str]]) -> DataFrame:
    """(cand, fold, score, pos, neg): distinct scores of each candidate (model, its fold column)
    by the value of that column, with their labels counted per block."""
    cands, folds, names = list(candidates), list(folds), list(names)
    columns = [[names.index(f) for f in m.features] for m, _ in cands]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                y, marks, x, w = unpack(row, len(folds), len(names))
                w = np.ones(len(y), np.int64) if w is None else w
                for i, (m, fold) in enumerate(cands):
                    mark = marks[:, folds.index(fold)]
                    if not (mark >= 0).any():
                        continue
                    p = probability(raw_scores(x, m.trees, columns[i]))
                    for value in np.unique(mark[mark >= 0]):
                        use = mark == value
                        s, at = np.unique(p[use], return_inverse=True)
                        pos = np.bincount(at, weights=y[use] * w[use], minlength=len(s)).astype(np.int64)
                        rows = np.bincount(at, weights=w[use], minlength=len(s)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(s), i, np.int32)), pa.array(np.full(len(s), value, np.int32)), pa.array(s),
                            pa.array(pos), pa.array(rows - pos)],
                            names=["cand", "fold", "score", "pos", "neg"])

    return blocks.select("n", "y", "folds", "bins", "w").mapInArrow(run, "cand int, fold int, score double, pos long, neg long")
