"""Random forests for the importance of their features: many grown side by side (M6).

Rows are binned once and lie in packed blocks.  A forest draws its bootstrap, its shadow columns
and the features a node may split on from seeds, so a scan draws them again rather than keep
them: no row is moved or copied per forest or tree.  One scan per level counts the
(tree, node, feature, bin, class) histograms of all forests in the tasks, one grouped step per
tree adds them up and picks every node's best cut; the driver holds the trees.  Of shallow levels
a row's node and code are masked together byte by byte, whole columns at a time, in place of a lookup a row.
Forests of several sets of rows (``folds``) have their rows dealt and binned in the same passes.

A tree takes Poisson(1) copies of each row, a node the square root of the features, a split
the largest decrease of the Gini impurity; two leaves of one split with the same class become one.
The importance of a feature is the sum of its decreases times the node's rows, each tree's
importances adding up to 1.  Counts are whole numbers, so forests depend neither on
the order nor on the partitioning of the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

BINS = 32
#: Memory of a task for the histograms of the forests that it counts at once; bytes of blocks in a partition.
HIST_BYTES, PART_BYTES = 48 << 20, 32 << 20
#: Poisson(1) by 16 random bits: copies[u] of a row, and the numbers from which on it takes one more.
_COPIES = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(9)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)
_STEPS = np.searchsorted(_COPIES, np.arange(1, _COPIES[-1] + 1)).astype(np.uint16)
#: Rows that are counted at once; levels of up to so many nodes, and codes of a byte, are counted by masks.
CHUNK_ROWS, MASK_NODES = 16384, 16


@dataclass(frozen=True)
class Blocks:
    """Packed rows: ``frame`` (block, n, y, x) with classes as bytes and bins feature by feature."""
    frame: DataFrame
    rows: int
    classes: int
    cuts: list[tuple[float, ...]]


@dataclass(frozen=True)
class Forest:
    """A forest to grow: its number, the features in play and the shadows that each of them gets."""
    turn: int
    active: tuple[int, ...]
    copies: int

    @property
    def width(self) -> int:
        return len(self.active) * (1 + self.copies)

    @property
    def tried(self) -> int:
        return math.isqrt(self.width - 1) + 1            # the square root, rounded up


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles."""
    u = (v + 0.0).view(np.int64)
    return (u ^ ((u >> 63) & np.int64((1 << 63) - 1))).view(np.uint64) ^ np.uint64(1 << 63)


def of_bits(u: np.ndarray) -> np.ndarray:
    s = (u ^ np.uint64(1 << 63)).view(np.int64)
    return (s ^ ((s >> 63) & np.int64((1 << 63) - 1))).view(np.float64)


def cut_points(df: DataFrame, names: Sequence[str], bins: int = BINS) -> list[tuple[float, ...]]:
    """Per feature the values after which a bin ends, at most ``bins`` - 2 (the last bin is NaN's): all
    but the largest of few distinct values, else its quantiles, read off all rows digit by digit."""
    return fold_cut_points(df.select(*names, F.lit(True).alias("_f0")), names, ["_f0"], bins)[0]


def fold_cut_points(df: DataFrame, names: Sequence[str], folds: Sequence[str], bins: int = BINS) -> list[list[tuple[float, ...]]]:
    """``cut_points`` of the rows of every fold (a column that tells its rows), all in the same passes."""
    pairs = [(f, i) for f in range(len(folds)) for i in range(len(names))]           # numbered as they lie here
    width = len(names)

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = [np.zeros(0)] * len(pairs)
        count = np.zeros(len(pairs), np.int64)
        for b in batches:
            mine = [b.column(width + f).to_numpy(zero_copy_only=False) for f in range(len(folds))]
            for i in range(width):
                x = b.column(i).to_numpy(zero_copy_only=False)
                for f in range(len(folds)):
                    v, at = x[mine[f] & ~np.isnan(x)], f * width + i
                    count[at] += len(v)
                    # the largest value and the first others
                    found = np.unique(np.concatenate([seen[at], v]))
                    seen[at] = np.concatenate([found[:bins - 1], found[-1:]]) if len(found) > bins else found
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs)), pa.int32()), pa.array(count), pa.array([v.tolist() for v in seen], pa.list_(
            pa.float64()))], names=["at", "n", "v"])

    # at most ``bins`` values a feature and task, and all of them where there are fewer
    parts = df.select(*names, *folds).mapInArrow(few, "at int, n long, v array<double>")
    found = parts.groupBy("at").agg(F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))).alias("v"))
    known = {r["at"]: r for r in found.select("at", "n", F.slice("v", 1, bins).alias("v"), F.array_max("v").alias("top")).collect()}    # a row a feature and fold
    many = {i: r for i, r in known.items() if len(r["v"]) >= bins}
    wanted = {i: np.arange(1, bins - 1) * r["n"] // (bins - 1) for i, r in many.items()}         # ranks from 0
    prefix = {i: np.zeros(bins - 2, np.uint64) for i in many}
    for shift in (56, 48, 40, 32):
        if many:
            for r in _next_digit(df.select(*names, *folds), width, list(many), prefix, wanted, shift).collect():         # a row a feature and fold
                prefix[r["at"]], wanted[r["at"]] = np.array(r["prefix"], np.int64).view(np.uint64), np.array(r["rank"])
    cuts = {i: of_bits((p << np.uint64(32)) | np.uint64((1 << 32) - 1)) for i, p in prefix.items()}
    flat = [tuple(sorted({v for v in cuts[i].tolist() if v < many[i]["top"]})) if i in many else tuple(known[i]["v"][:-1]) if i in known else ()
            for i in range(len(pairs))]
    return [flat[f * width:(f + 1) * width] for f in range(len(folds))]


def _next_digit(df: DataFrame, width: int, at: list[int], prefix: dict[int, np.ndarray], wanted: dict[int, np.ndarray], shift: int) -> DataFrame:
    """(at, prefix, rank): the prefixes of the wanted ranks with one more byte, and the ranks inside these."""
    starts = {i: np.unique(prefix[i]) for i in at}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {i: np.zeros((len(starts[i]), 256), np.int64) for i in at}
        for b in batches:
            bits = {}
            for i in at:
                f, j = divmod(i, width)
                if j not in bits:
                    x = b.column(j).to_numpy(zero_copy_only=False)
                    bits[j] = ~np.isnan(x), ordered_bits(x) >> np.uint64(shift)
                known, u = bits[j]
                u = u[known & b.column(width + f).to_numpy(zero_copy_only=False)]
                place = np.minimum(np.searchsorted(starts[i], u >> np.uint64(8)), len(starts[i]) - 1)
                mine = starts[i][place] == u >> np.uint64(8)
                sums[i] += np.bincount(place[mine] * 256 + (u[mine] & np.uint64(255)).astype(np.int64), minlength=sums[i].size).reshape(-1, 256)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([sums[i].tobytes() for i in at], pa.binary())], names=["at", "n"])

    def choose(t: pa.Table) -> pa.Table:
        i = t.column("at")[0].as_py()
        upto = sum(np.frombuffer(n.as_buffer(), np.int64) for n in t.column("n")).reshape(-1, 256).cumsum(axis=1)
        place = np.searchsorted(starts[i], prefix[i])
        digit = (upto[place] <= wanted[i][:, None]).sum(axis=1)
        rank = wanted[i] - np.where(digit > 0, upto[place, np.maximum(digit, 1) - 1], 0)
        found = (prefix[i] << np.uint64(8)) | digit.astype(np.uint64)
        return pa.table({"at": pa.array([i], pa.int32()), "prefix": pa.array([found.astype(np.int64).tolist()], pa.list_(pa.int64())),
                         "rank": pa.array([rank.tolist()], pa.list_(pa.int64()))})

    return df.mapInArrow(count, "at int, n binary").groupBy("at").applyInArrow(choose, "at int, prefix array<long>, rank array<long>")


def pack(df: DataFrame, features: Sequence[str], label: str, key: str, block_rows: int = 8192) -> Blocks:
    """Rows with a label dealt to blocks of about ``block_rows`` by a hash of key, label and features,
    in its order inside, so that neither repeated nor NULL keys fill one block.  NULL features count as NaN."""
    return pack_folds(df, features, label, key, [F.lit(True)], block_rows)[0]


def pack_folds(df: DataFrame, features: Sequence[str], label: str, key: str, folds: Sequence[Column], block_rows: int = 8192) -> list[Blocks]:
    """``pack`` of the rows of every fold (a condition on the rows); each row is read and moved once for
    all folds of the same number of blocks."""
    names, marks = [f"_x{i}" for i in range(len(features))], [f"_f{i}" for i in range(len(folds))]
    base = df.where(F.col(label).isNotNull()).select(F.col(key).alias("_k"), F.col(label).cast("double").alias("_y"), *[
        F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(n) for f, n in zip(features, names)],
        *[F.coalesce(c, F.lit(False)).alias(m) for c, m in zip(folds, marks)]).where(F.greatest(*marks, F.lit(False)))
    base = cut_lineage(base.select(F.xxhash64("_k", "_y", *names, F.lit(29)).alias("_h"), "_y", *names, *marks))
    size = base.agg(*[x for m in marks for x in (
        F.count(F.when(F.col(m), 1)).alias(f"n{m}"), F.max(F.when(F.col(m), F.col("_y"))).alias(f"top{m}"),
        F.max((F.col(m) & ((F.col("_y") < 0) | (F.col("_y") != F.floor("_y")))).cast("int")).alias(f"bad{m}"))]).first()
    rows = [size[f"n{m}"] for m in marks]
    for n, m in zip(rows, marks):
        if n and (size[f"bad{m}"] or not size[f"top{m}"] < 256):
            raise ValueError(f"{label}: classes must be whole numbers from 0 to 255")
    cuts = fold_cut_points(base, names, marks)

    def packed(n: int, mine: list[int]) -> DataFrame:
        def block(t: pa.Table) -> pa.Table:
            y = t.column("_y").to_numpy().astype(np.uint8)
            order = np.lexsort((y, t.column("_h").to_numpy()))
            v = [t.column(name).to_numpy()[order] for name in names]
            out = []
            for f in mine:
                use = t.column(marks[f]).to_numpy()[order]
                if use.any():
                    x = np.empty((len(names), np.count_nonzero(use)), np.uint8)
                    for j, c in enumerate(cuts[f]):
                        w = v[j][use]
                        x[j] = np.where(np.isnan(w), len(c) + 1, np.searchsorted(np.asarray(c, float), w, side="left"))
                    out.append((f, x.shape[1], y[order][use].tobytes(), x.tobytes()))
            of = list(zip(*out)) if out else [(), (), (), ()]
            return pa.table({"fold": pa.array(of[0], pa.int32()), "block": pa.array([t.column("_block")[0].as_py()] * len(out), pa.int32()),
                             "n": pa.array(of[1], pa.int32()), "y": pa.array(of[2], pa.binary()), "x": pa.array(of[3], pa.binary())})

        dealt = base.withColumn("_block", F.pmod(F.xxhash64("_h", F.lit(31)), F.lit(n)).cast("int"))
        frame = dealt.groupBy("_block").applyInArrow(block, "fold int, block int, n int, y binary, x binary")
        parts = min(n, max(4 * df.sparkSession.sparkContext.defaultParallelism, n * len(mine) * block_rows * (len(names) + 1) // PART_BYTES))
        return cut_lineage(frame.repartition(parts))

    blocks = [max(1, -(-n // block_rows)) for n in rows]
    frames = {n: packed(n, [f for f, m in enumerate(blocks) if m == n]) for n in sorted(set(blocks))}
    return [Blocks(frames[blocks[f]].where(F.col("fold") == f).drop("fold"), rows[f], int(size[f"top{m}"] or 0) + 1, cuts[f])
            for f, m in enumerate(marks)]


def drawn(y: np.ndarray, x: np.ndarray, forest: Forest, seed: int, block: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's active features with their shadows, each permuted inside the block on its own, and
    the copies of every row that each tree takes."""
    rng = np.random.Generator(np.random.PCG64([seed, forest.turn, block]))
    own = x[list(forest.active)]
    wide = np.concatenate([own] + [rng.permuted(own, axis=1) for _ in range(forest.copies)])
    random = rng.integers(0, 1 << 16, (trees, len(y)), np.uint16)
    copies, some = np.zeros(random.shape, np.uint8), np.empty(len(y), bool)
    more = some.view(np.uint8)
    for u, out in zip(random, copies):                   # _COPIES[u], as a sum of comparisons
        for step in _STEPS:
            np.greater_equal(u, step, out=some)
            np.add(out, more, out=out)
    return wide, copies


def subsets(forest: Forest, seed: int, trees: int, depth: int) -> list[np.ndarray]:
    """Per level the features (trees, nodes, tried) that a node may split on."""
    rng = np.random.Generator(np.random.PCG64([seed, forest.turn, 1 << 32]))
    return [np.argsort(rng.random((trees, 1 << d, forest.width)), axis=2)[..., :forest.tried] for d in range(depth)]


@dataclass
class Level:
    """The splits of one level, a row a tree: feature (-1: none), cut, gain, and the class counts on both sides."""
    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    counts: np.ndarray                       # (trees, nodes, 2, classes)


def histogram(codes: np.ndarray, wide: np.ndarray, weight: np.ndarray, levels: Sequence[tuple[np.ndarray, np.ndarray]],
              tried: np.ndarray, classes: int) -> np.ndarray | None:
    """One tree's counts (nodes, tried, BINS, classes) of the rows that are still in play on this level.
    ``codes``: bin and class of every feature and row in one number."""
    n = wide.shape[1]
    rows = np.flatnonzero(weight)
    flat, node = wide.reshape(-1), np.zeros(len(rows), np.int64)
    for feature, cut in levels:
        f = feature.take(node)
        if (feature < 0).any():
            keep = f >= 0
            rows, node, f = rows[keep], node[keep], f[keep]
        node = 2 * node + (flat.take(f * n + rows) > cut.take(node))
    if not len(rows):
        return None
    nodes, slots = tried.shape
    w, cells = weight.take(rows).astype(float), BINS * classes
    at, starts = node * cells, np.ascontiguousarray(tried.T) * n
    out = np.empty((slots, nodes * cells))
    for s in range(slots):
        out[s] = np.bincount(at + codes.take(starts[s].take(node) + rows), w, nodes * cells)
    return out.astype(np.int64).reshape(slots, nodes, BINS, classes).transpose(1, 0, 2, 3)


def masked_histogram(codes: list[np.ndarray], wide: list[np.ndarray], weight: np.ndarray, levels: Sequence[tuple[np.ndarray, np.ndarray]],
                     tried: np.ndarray, classes: int) -> np.ndarray | None:
    """``histogram`` for few nodes and codes of a byte, ``codes`` and ``wide`` feature by feature: every live node has
    a mask of its rows (0 or 255), and a row's code is put together from the features that its node tries."""
    n, masks = len(weight), [np.full(len(weight), 255, np.uint8)]
    for feature, cut in levels:
        split = []
        for f, c, mask in zip(feature.tolist(), cut.tolist(), masks):
            if mask is None or f < 0:
                split += [None, None]
                continue
            high = np.greater(wide[f], np.uint8(c)).view(np.uint8)
            np.negative(high, out=high)
            high &= mask
            split += [np.bitwise_xor(mask, high, out=mask), high]
        masks = split
    live = [(v, m) for v, m in enumerate(masks) if m is not None]
    if not live:
        return None
    nodes, slots = tried.shape
    cells, choice, some = BINS * classes, tried.tolist(), np.empty(n, np.uint8)
    if len(live) < nodes:
        weight = weight & np.bitwise_or.reduce([m for _, m in live])
    w, out = weight.astype(float), np.empty((slots, nodes * cells))
    if nodes > 1:
        node, key, at = np.zeros(n, np.uint8), np.empty(n, np.uint8), np.empty(n, np.int64)
        for v, mask in live:
            node |= np.bitwise_and(mask, np.uint8(v), out=some)
        base = np.multiply(node, cells, dtype=np.int64)
    for s in range(slots):
        if nodes == 1:
            out[s] = np.bincount(codes[choice[0][s]], w, cells)
            continue
        key.fill(0)
        for v, mask in live:
            key |= np.bitwise_and(codes[choice[v][s]], mask, out=some)
        out[s] = np.bincount(np.add(base, key, out=at), w, nodes * cells)
    return out.astype(np.int64).reshape(slots, nodes, BINS, classes).transpose(1, 0, 2, 3)


def best_splits(hist: np.ndarray, tried: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, gain, counts on both sides) of every node of one tree."""
    left = hist.cumsum(axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    a, b, whole = left.sum(axis=3), right.sum(axis=3), total.sum(axis=3)

    def gini(counts, size):
        return 1 - ((counts / np.maximum(size, 1)[..., None]) ** 2).sum(axis=3)

    gain = gini(total, whole) - (a * gini(left, a) + b * gini(right, b)) / np.maximum(whole, 1)
    gain = np.where((a > 0) & (b > 0), gain, -1.0).reshape(len(hist), -1)
    at = gain.argmax(axis=1)
    nodes = np.arange(len(hist))
    slot, cut = np.divmod(at, hist.shape[2])
    best = gain[nodes, at]
    return (np.where(best > 1e-15, tried[nodes, slot], -1), cut, best,
            np.stack([left[nodes, slot, cut], right[nodes, slot, cut]], axis=1))


def tree_importance(levels: Sequence[Level], tree: int, width: int) -> np.ndarray:
    """Importances of one tree, adding up to 1; zeros for a tree without a split."""
    out = np.zeros(width)

    def walk(d: int, node: int, counts: np.ndarray) -> int | None:
        """The class of a leaf, None for a split."""
        if d == len(levels) or levels[d].feature[tree, node] < 0:
            return int(counts.argmax())
        at, sides = levels[d], levels[d].counts[tree, node]
        a, b = walk(d + 1, 2 * node, sides[0]), walk(d + 1, 2 * node + 1, sides[1])
        if a is not None and a == b:
            return a
        out[at.feature[tree, node]] += at.gain[tree, node] * sides.sum()
        return None

    walk(0, 0, np.zeros(1))
    return out / out.sum() if out.sum() > 0 else out


def importances(blocks: Blocks, forests: Sequence[Forest], seed: int, trees: int, depth: int, parallelism: int = 4) -> list[np.ndarray]:
    """Per forest the importances of its active features and, after them, of their shadows.  As many forests
    as a task's memory has room for grow together, such groups side by side."""
    size = max(trees * (1 << depth - 1) * f.tried * BINS * blocks.classes * 8 for f in forests)
    step = max(1, HIST_BYTES // size)
    groups = [forests[at:at + step] for at in range(0, len(forests), step)]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        return [imp for grown in ex.map(lambda g: _grow(blocks, g, seed, trees, depth), groups) for imp in grown]


def _grow(blocks: Blocks, forests: Sequence[Forest], seed: int, trees: int, depth: int) -> list[np.ndarray]:
    choices = [subsets(f, seed, trees, depth) for f in forests]
    grown: list[list[Level]] = [[] for _ in forests]
    for d in range(depth):
        tried = [c[d] for c in choices]
        found = _level(blocks, forests, [[(v.feature, v.cut) for v in g] for g in grown], tried, seed, trees).collect()    # a row a tree
        nodes = 1 << d
        new = [Level(np.full((trees, nodes), -1), np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes)),
                     np.zeros((trees, nodes, 2, blocks.classes), np.int64)) for _ in forests]
        for r in found:
            to, t = new[r["forest"]], r["tree"]
            to.feature[t], to.cut[t], to.gain[t] = r["feature"], r["cut"], r["gain"]
            to.counts[t] = np.reshape(r["counts"], to.counts[t].shape)
        for g, level in zip(grown, new):
            g.append(level)
        if all((level.feature < 0).all() for level in new):
            break
    return [sum(tree_importance(g, t, f.width) for t in range(trees)) for f, g in zip(forests, grown)]


def _level(blocks: Blocks, forests: Sequence[Forest], grown: list[list[tuple[np.ndarray, np.ndarray]]], tried: list[np.ndarray],
           seed: int, trees: int) -> DataFrame:
    """(forest, tree, feature, cut, gain, counts): the best split of every node of the next level."""
    classes = blocks.classes

    by_masks = BINS * classes <= 256

    def count(held: list[tuple[int, np.ndarray, np.ndarray]], sums: dict[tuple[int, int], np.ndarray]) -> None:
        """Adds the histograms of some blocks (number, classes, bins), whose rows are counted together."""
        y = np.concatenate([y for _, y, _ in held])
        for i, forest in enumerate(forests):
            each = [drawn(y, x, forest, seed, at, trees) for at, y, x in held]
            wide, copies = np.concatenate([w for w, _ in each], axis=1), np.concatenate([c for _, c in each], axis=1)
            if by_masks and len(tried[i][0]) <= MASK_NODES:
                tree, codes, x = masked_histogram, list(wide * np.uint8(classes) + y), list(wide)
            else:
                tree, codes, x = histogram, (wide.astype(np.int64) * classes + y).reshape(-1), wide
            for t in range(trees):
                h = tree(codes, x, copies[t], [(f[t], c[t]) for f, c in grown[i]], tried[i][t], classes)
                if h is not None:
                    if (i, t) in sums:
                        sums[i, t] += h
                    else:
                        sums[i, t] = h

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        held, size = [], 0
        for b in batches:
            for row in b.to_pylist():
                y = np.frombuffer(row["y"], np.uint8)
                if held and size + len(y) > CHUNK_ROWS + CHUNK_ROWS // 4:
                    count(held, sums)
                    held, size = [], 0
                held.append((row["block"], y, np.frombuffer(row["x"], np.uint8).reshape(-1, len(y))))
                size += len(y)
        if held:
            count(held, sums)
        if sums:
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()),
                pa.array([h.tobytes() for h in sums.values()], pa.binary())], names=["forest", "tree", "hist"])

    def choose(table: pa.Table) -> pa.Table:
        i, t = table.column("forest")[0].as_py(), table.column("tree")[0].as_py()
        total = sum(np.frombuffer(h.as_buffer(), np.int64) for h in table.column("hist"))
        feature, cut, gain, counts = best_splits(total.reshape(*tried[i][t].shape, BINS, classes), tried[i][t])
        return pa.table({"forest": pa.array([i], pa.int32()), "tree": pa.array([t], pa.int32()),
                         "feature": pa.array([feature.tolist()], pa.list_(pa.int32())), "cut": pa.array([cut.tolist()], pa.list_(pa.int32())),
                         "gain": pa.array([gain.tolist()], pa.list_(pa.float64())),
                         "counts": pa.array([counts.ravel().tolist()], pa.list_(pa.int64()))})

    hists = blocks.frame.mapInArrow(scan, "forest int, tree int, hist binary")
    return hists.groupBy("forest", "tree").applyInArrow(
        choose, "forest int, tree int, feature array<int>, cut array<int>, gain array<double>, counts array<long>")
