"""Hard-negative mining with rotated one-bit codes and deterministic intervals.

1. Vectors are scaled to integers and rotated at random (signs and a fast Hadamard
   transform, three rounds; inner products stay).  A row keeps a few one-bit codes, each
   the signs, in a rotation of its own, of what the codes before it left over, with the
   alignment of every code with that rest and the length of the last rest.
2. An anchor is rotated likewise and rounded to eight bits a component.  Popcounts of a row's
   code with the anchor's bit planes give the anchor's product with the code, and with the
   alignments an estimate of the product with the row.  By Cauchy-Schwarz the error is at
   most ``sum of |alignment| |anchor's rounding| + |row's rest| |anchor|``: an interval that
   holds the product for certain, not with some probability.
3. Rows whose interval cannot reach the wanted scores are dropped, and so are rows
   whose upper end lies below the k-th best lower end.  The integer product of the
   others decides, so the result is that of the full comparison (recall 1).
4. Anchors and rows meet in units of a block of anchors and a block of rows (blocks by
   hash, of a stated size), so no task holds a label, a group of copies or all
   anchors; each unit gives at most k rows per anchor and the best of these are taken.

Two passes run this way: the first finds each anchor's positives, the second, with their
scores as limits, its negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.embedding_dedup import hadamard
from tidemark.session import cut_lineage

_LONG = 1 << 63
_TILE = 1 << 18                     # estimates held at a time by a task
_SLACK = 1e-9                       # of the product of lengths, far above rounding


def _signs(size: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, size])).choice([-1.0, 1.0], (3, size))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    n, d = x.shape
    size = 1 << max(0, (d - 1).bit_length())
    y = np.zeros((n, size))
    y[:, :d] = x
    for sign in _signs(size, seed):
        y = hadamard(y * sign)
    return y


def rotate_back(y: np.ndarray, seed: int) -> np.ndarray:
    for sign in _signs(y.shape[1], seed)[::-1]:
        y = hadamard(y) * sign
    return y


def _bits(up: np.ndarray) -> np.ndarray:
    """Rows of booleans as words of 64 bits, the last one padded with zeros."""
    n, size = up.shape
    bits = np.zeros((n, -(-size // 64) * 64), np.uint8)
    bits[:, :size] = up
    return np.packbits(bits, axis=1).view(np.uint64)


def one_bit_codes(x: np.ndarray, levels: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes: rows x levels x words of 64 bits, numbers: rows x (levels + 2)): the alignments of
    the codes as unit vectors, the length of the rest, the length of the row."""
    codes, numbers, rest = [], [], x
    for k in range(levels):
        y = rotate(rest, seed + k)
        if rest.shape[1] < y.shape[1]:
            rest = np.pad(rest, ((0, 0), (0, y.shape[1] - rest.shape[1])))
        up, align = y >= 0, np.abs(y).sum(axis=1) / np.sqrt(y.shape[1])
        codes.append(_bits(up))
        numbers.append(align)
        unit = np.where(up, 1.0, -1.0) / np.sqrt(y.shape[1])
        rest = rest - align[:, None] * rotate_back(unit, seed + k)
    numbers += [np.linalg.norm(rest, axis=1), np.linalg.norm(x, axis=1)]
    return np.stack(codes, axis=1), np.stack(numbers, axis=1)


def bit_planes(y: np.ndarray, levels: int, seed: int) -> list[tuple]:
    """Per level: (planes: anchors x 8 x words, low end, step, length of the rounding error)."""
    out = []
    for k in range(levels):
        z = rotate(y, seed + k)
        low = z.min(axis=1)
        step = (z.max(axis=1) - low) / 255
        whole = np.rint((z - low[:, None]) / np.where(step > 0, step, 1)[:, None]).clip(0, 255)
        whole = np.where(np.isfinite(whole), whole, 0)
        off = np.linalg.norm(z - low[:, None] - whole * step[:, None], axis=1)
        q = whole.astype(np.uint8)
        out.append((np.stack([_bits((q >> j) & 1) for j in range(8)], axis=1), low, step, off))
    return out


def _count(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int64)


def intervals(rows: tuple[np.ndarray, np.ndarray], anchors: list[tuple], length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high), anchors x rows: bounds of the inner products; ``length`` is the anchors'."""
    codes, numbers = rows
    levels = codes.shape[1]
    est = np.zeros((len(length), len(codes)))
    width = numbers[None, :, levels] * length[:, None] + _SLACK * length[:, None] * numbers[None, :, levels + 1]
    for k, (planes, low, step, off) in enumerate(anchors):
        common = np.zeros(est.shape, np.int64)
        for j in range(8):
            both = np.bitwise_count(planes[:, None, j, 0] & codes[None, :, k, 0]).astype(np.int64)
            for w in range(1, codes.shape[2]):
                both += np.bitwise_count(planes[:, None, j, w] & codes[None, :, k, w])
            common += both << (j + 1)
        ones = (_count(planes) << np.arange(8)).sum(axis=1)
        product = (low[:, None] * (2 * _count(codes[:, k])[None, :] - size)
                   + step[:, None] * (common - ones[:, None])) / np.sqrt(size)
        est += product * numbers[None, :, k]
        width += off[:, None] * numbers[None, :, k]
    low, high = est - width, est + width
    lost = ~np.isfinite(est) | ~np.isfinite(width)          # lengths beyond the range of squares
    low[lost], high[lost] = -np.inf, np.inf
    return low, high


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of x with y, as Python or 64-bit integers."""
    if not len(x) or not len(y):
        return np.zeros(len(x), np.int64)
    if len(y) * float(np.abs(x).max()) * float(np.abs(y).max()) < 2.0 ** 53:
        return (x @ y).astype(np.int64)
    whole = [int(v) for v in y]
    return np.array([sum(int(a) * b for a, b in zip(r, whole)) for r in x], object)


def _prepare(levels: int, seed: int):
    """(id, label, vec, anchor) -> rows that take part, with a row number and their codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        for b in batches:
            by_size: dict[int, list[int]] = {}
            vecs = b.column(2).to_pylist()
            for i, v in enumerate(vecs):
                if None not in v and np.isfinite(v).all():
                    by_size.setdefault(len(v), []).append(i)
            for dims, at in by_size.items():
                x = np.array([vecs[i] for i in at], np.float64).reshape(len(at), dims)
                with np.errstate(over="ignore", invalid="ignore"):
                    codes, numbers = one_bit_codes(x, levels, seed)
                own = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(base, base + len(at))), own.column(0), own.column(1), own.column(3),
                    pa.array([dims] * len(at), pa.int32()), pa.array(list(x), pa.list_(pa.float64())),
                    pa.array(list(codes.reshape(len(at), -1).view(np.int64)), pa.list_(pa.int64())),
                    pa.array(list(numbers), pa.list_(pa.float64()))],
                    names=["rid", "id", "label", "anchor", "dims", "vec", "codes", "numbers"])
                base += len(at)
    return run


def _matrix(t: pa.Table, name: str, kind=None) -> np.ndarray:
    flat = t.column(name).combine_chunks()
    a = flat.flatten().to_numpy(zero_copy_only=False)
    a = a.reshape(t.num_rows, -1) if t.num_rows and len(a) else np.zeros((t.num_rows, 0))
    return a.view(kind) if kind and a.size else a


def _best(score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, then smaller id (both may hold big integers)."""
    return np.array(sorted(range(len(at)), key=lambda i: (-int(score[i]), int(ids[at[i]])))[:k], np.int64)


def _floor_of(low: np.ndarray, k: int) -> float:
    return np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf


def _search(levels: int, seed: int, k: int, share: tuple[int, int] | None):
    """One unit: positives (``share`` None) or negatives between share of a positive's score and it."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.rename_columns([c.removeprefix("a_") for c in left.column_names])
        out: dict[str, list] = {"arid": [], "limit": [], "score": [], "id": [], "rid": []}
        if left.num_rows and right.num_rows:
            vec, avec = _matrix(right, "vec"), _matrix(left, "vec")
            dims = vec.shape[1]
            size = 1 << max(0, (dims - 1).bit_length())
            codes = _matrix(right, "codes", np.uint64).reshape(right.num_rows, levels, -1)
            numbers = _matrix(right, "numbers")
            ids, rids = right.column("id").to_numpy(), right.column("rid").to_numpy()
            label = np.array(right.column("label").to_pylist(), object)
            aids, arids = left.column("id").to_pylist(), left.column("rid").to_pylist()
            alabel = left.column("label").to_pylist()
            limits = [[None]] * left.num_rows if share is None else left.column("limits").to_pylist()
            with np.errstate(over="ignore", invalid="ignore"):
                step = max(1, _TILE // right.num_rows)
                for lo in range(0, left.num_rows, step):
                    part = avec[lo:lo + step]
                    low, high = intervals((codes, numbers), bit_planes(part, levels, seed), np.linalg.norm(part, axis=1), size)
                    for i in range(len(low)):
                        a = lo + i
                        same = label == alabel[a]
                        able = same & (ids != aids[a]) if share is None else ~same
                        for limit in limits[a]:
                            at = _candidates(able, low[i], high[i], limit, share, k)
                            score = products(vec[at], avec[a])
                            ok = (score >= -_LONG) & (score < _LONG)
                            if limit is not None:
                                big = score.astype(object) * 100
                                ok &= (big >= share[0] * limit) & (big <= share[1] * limit)
                            ok = ok.astype(bool)
                            at, score = at[ok], score[ok]
                            pick = _best(score, ids, at, k)
                            out["arid"] += [arids[a]] * len(pick)
                            out["limit"] += [limit] * len(pick)
                            out["score"] += [int(s) for s in score[pick]]
                            out["id"] += ids[at[pick]].tolist()
                            out["rid"] += rids[at[pick]].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})
    return run


def _candidates(able: np.ndarray, low: np.ndarray, high: np.ndarray, limit: int | None,
                share: tuple[int, int] | None, k: int) -> np.ndarray:
    """Positions of the rows whose interval does not rule them out."""
    sure = able
    if limit is not None:
        least, most = share[0] / 100 * limit, share[1] / 100 * limit
        gap = _SLACK * abs(limit)
        able = able & (high >= least - gap) & (low <= most + gap)
        sure = able & (low >= least + gap) & (high <= most - gap)
    return np.flatnonzero(able & (high >= _floor_of(low[sure], k)))


def hard_negatives(vectors: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5,
                   share: tuple[int, int] = (80, 100), id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label", levels: int = 6, anchor_block: int = 4096,
                   row_block: int = 4096, seed: int = 11) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x becomes floor(scale x); a row's score is its integer inner product with the
    anchor, higher first, ties by smaller id.  ``is_anchor`` says which rows are anchors.  An
    anchor's positives are its first ``positives`` rows of its label and of another id; for each
    of them come the first ``negatives`` rows of other labels whose score lies between
    ``share`` percent of the positive's score, both ends in.

    Rows with a NULL id, label or vector, with a NULL or non-finite component, or with a
    component that the scaling takes beyond the doubles take no part.  Vectors of
    different lengths are not compared; an empty vector scores 0; pairs whose score does not
    fit in a long are left out.  Repeated rows count as rows (a repeated anchor gives
    repeated results, and rows of one id are never positives of each other).  Extra columns are not
    read; an empty table, or one without anchors, gives an empty one.
    """
    src = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    src = src.where("id is not null and label is not null and vec is not null")
    # floor() of a double is a long in SQL: components beyond it are whole numbers already
    scaled = F.transform("vec", lambda x: F.when(F.abs(x * scale) < 2.0 ** 53, F.floor(x * scale).cast("double")).otherwise(x * scale))
    rows = cut_lineage(src.select("id", "label", scaled.alias("vec"), "anchor").mapInArrow(
        _prepare(levels, seed), "rid long, id long, label string, anchor boolean, dims int, vec array<double>, "
                                "codes array<long>, numbers array<double>"))
    n, m = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("anchor"), 1))).first()
    row_blocks, anchor_blocks = -(-n // row_block) or 1, -(-m // anchor_block) or 1

    def spread(df: DataFrame, own: str, other: str, own_blocks: int, other_blocks: int) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64("rid"), F.lit(own_blocks)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))))

    keys = ["dims", "ai", "ri"]
    right = spread(rows.drop("anchor"), "ri", "ai", row_blocks, anchor_blocks).groupBy(*keys)

    def search(anchors: DataFrame, k: int, limits: tuple[int, int] | None) -> DataFrame:
        left = spread(anchors, "ai", "ri", anchor_blocks, row_blocks)
        left = left.select(*(F.col(c).alias("a_" + c) for c in left.columns))       # both come from `rows`
        found = left.groupBy(*("a_" + c for c in keys)).cogroup(right).applyInArrow(
            _search(levels, seed, k, limits), "arid long, limit long, score long, id long, rid long")
        order = Window.partitionBy("arid", "limit").orderBy(F.desc("score"), "id", "rid")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    anchors = rows.where("anchor").select("dims", "rid", "id", "label", "vec")
    best = cut_lineage(search(anchors, positives, None).select(
        "arid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")))
    limits = best.groupBy(F.col("arid").alias("rid")).agg(F.collect_set("positive_score").alias("limits"))
    worst = search(anchors.join(limits, "rid"), negatives, share).select(
        "arid", F.col("limit").alias("positive_score"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("rid").alias("arid"), F.col("id").alias("anchor_id"))
    return best.join(worst, ["arid", "positive_score"]).join(names, "arid").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
