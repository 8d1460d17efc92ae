"""Quality classifier: ordinal cumulative-link regression on hashed text.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector shared by all
grades, and ordered thresholds.  Features are counts of hashed byte trigrams
(case, digits, signs and layout included) and of hashed words, damped by a
logarithm and scaled to length one.  The fit runs on a bounded hash sample of the
rated texts in one task, by full-batch gradient steps with momentum on the
penalised likelihood; scoring is a matrix product per Arrow batch over whole texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import as_bytes, chunks, normal_words, slices, word_hashes


_TRI = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def hashed_features(texts: list[bytes], dims: int) -> np.ndarray:
    """(texts, dims) float32: byte trigrams in the lower half, words in the upper half."""
    half = dims // 2
    out = np.zeros((len(texts), dims), np.float32)
    buf = np.frombuffer(b"".join(b"  " + t for t in texts) + b"  ", np.uint8).astype(np.uint32)
    h = buf[:-2] * _TRI[0] + buf[1:-1] * _TRI[1] + buf[2:] * _TRI[2]
    h ^= h >> np.uint32(15)
    h = (h * np.uint32(0x27D4EB2F) >> np.uint32(9)) % np.uint32(half)
    at = 0
    for i, t in enumerate(texts):
        if t:
            out[i, :half] = np.bincount(h[at:at + len(t) + 2], minlength=half)
        at += len(t) + 2
    words, off = word_hashes([normal_words(t) for t in texts])
    slot = (words % np.uint64(dims - half)).astype(np.int64)
    for i in range(len(texts)):
        if off[i + 1] > off[i]:
            out[i, half:] = np.bincount(slot[off[i]:off[i + 1]], minlength=dims - half)
    np.log1p(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, penalty: float = 1e-4, steps: int = 400,
                rate: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) for grades 0..grades-1; the thresholds are a first
    value and positive gaps (their exponentials are fitted)."""
    n, d = x.shape
    w = np.zeros(d)
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / n, 1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    p = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    vw, vp = np.zeros_like(w), np.zeros_like(p)
    for _ in range(steps):
        theta = np.concatenate((p[:1], p[:1] + np.cumsum(np.exp(p[1:]))))
        z = (x @ w.astype(x.dtype)).astype(np.float64)
        hi = np.where(y < grades - 1, _sigmoid(theta[np.minimum(y, grades - 2)] - z), 1.0)
        lo = np.where(y > 0, _sigmoid(theta[np.maximum(y - 1, 0)] - z), 0.0)
        prob = np.maximum(hi - lo, 1e-9)
        dh, dl = hi * (1 - hi), lo * (1 - lo)
        # gradients of the mean negative log likelihood
        gw = x.T @ ((dh - dl) / prob / n).astype(x.dtype) + penalty * w
        gt = np.zeros(grades - 1)
        np.add.at(gt, np.minimum(y, grades - 2)[y < grades - 1], (-dh / prob)[y < grades - 1] / n)
        np.add.at(gt, (y - 1)[y > 0], (dl / prob)[y > 0] / n)
        gp = np.concatenate(([gt.sum()], np.exp(p[1:]) * np.cumsum(gt[::-1])[::-1][1:]))
        vw, vp = 0.9 * vw + gw, 0.9 * vp + gp
        w -= rate * vw
        p -= min(rate, 0.5) * vp
    return w, np.concatenate((p[:1], p[:1] + np.cumsum(np.exp(p[1:]))))


def grade_texts(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rating_col: str = "quality", keep_from: int | None = None, min_tail: float = 0.5,
                dims: int = 4096, max_fit_rows: int = 8192, max_grades: int = 64, seed: int = 3) -> DataFrame:
    """(id, expected_grade, tail_probability, keep), one row per row of ``docs``.

    Grades are the distinct integer ratings in order (at most ``max_grades``, else an
    error).  ``expected_grade``: the mean rating of the fitted distribution;
    ``tail_probability``: P(rating >= ``keep_from``), by default the highest
    rating for two grades and the upper half of them for more; ``keep``:
    tail_probability >= ``min_tail``.  ``max_fit_rows`` bounds the rated texts that
    are fitted on (a hash sample if there are more); every text is graded whole.

    NULL and empty texts have no features and get the distribution of the
    thresholds alone.  NULL ratings are not fitted on; of a repeated id the largest rating and
    the smallest text are taken; extra columns are not read; empty ``docs`` give an empty table.
    Without ratings grade, tail and keep are NULL; with one grade only every text
    has that grade and tail 1.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rated = ratings.select(F.col(id_col).alias("id"), F.col(rating_col).cast("int").alias("rating")).where(
        "id is not null and rating is not null")
    rated = rated.groupBy("id").agg(F.max("rating").alias("rating"))
    levels = [r[0] for r in rated.groupBy("rating").count().orderBy("rating").limit(max_grades + 1)
              .select("rating").collect()]
    if len(levels) > max_grades:
        raise ValueError(f"more than {max_grades} grades")
    if len(levels) < 2:
        one = float(levels[0]) if levels else None
        return src.select(F.col("id").alias(id_col), F.lit(one).cast("double").alias("expected_grade"),
                          F.lit(1.0 if levels else None).cast("double").alias("tail_probability"),
                          F.lit(True if levels else None).cast("boolean").alias("keep"))
    total = rated.count()
    if total > max_fit_rows:
        share = int(max_fit_rows / total * 1_000_000)
        rated = rated.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < share)
    # at most about max_fit_rows ids: a bound by parameter, so they are broadcast
    sample = src.join(F.broadcast(rated), "id").groupBy("id", "rating").agg(F.min("text").alias("text")).select("id", "text", "rating")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, ys = [], [], []
        for b in slices(batches, 1):
            texts = [t or b"" for t in as_bytes(b.column(1))]
            for lo, hi in chunks(texts, 1 << 20, 512):
                xs.append(hashed_features(texts[lo:hi], dims))
            ys.extend(b.column(2).to_pylist())
            ids.extend(b.column(0).to_pylist())
        if ys:
            order = np.argsort(np.array(ids, dtype=object).astype(str), kind="stable")   # reruns agree
            y = np.searchsorted(levels, np.array(ys)[order])
            w, theta = fit_ordinal(np.concatenate(xs)[order], y, len(levels))
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps([w.tolist(), theta.tolist()])])], names=["model"])

    found = sample.coalesce(1).mapInArrow(fit, "model string").collect()     # one row; bounded sample
    if found:
        weights, theta = (np.array(v) for v in json.loads(found[0]["model"]))
    else:                                                                    # no rated text
        weights, theta = np.zeros(dims), np.zeros(len(levels) - 1)
    cut = keep_from if keep_from is not None else levels[len(levels) // 2]
    grades = np.array(levels, float)
    below = int(np.searchsorted(levels, cut))                                # grades below the cut
    kind = src.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            texts = [t or b"" for t in as_bytes(b.column(1))]
            for lo, hi in chunks(texts, 1 << 20, 512):
                z = hashed_features(texts[lo:hi], dims) @ weights
                upto = np.hstack((_sigmoid(theta[None, :] - z[:, None]), np.ones((hi - lo, 1))))
                prob = np.diff(np.hstack((np.zeros((hi - lo, 1)), upto)), axis=1)
                tail = 1 - upto[:, below - 1] if below else np.ones(hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], pa.array(prob @ grades), pa.array(tail)],
                    names=["id", "expected_grade", "tail_probability"])

    out = src.mapInArrow(score, f"id {kind}, expected_grade double, tail_probability double")
    return out.select(F.col("id").alias(id_col), "expected_grade", "tail_probability",
                      (F.col("tail_probability") >= min_tail).alias("keep"))
