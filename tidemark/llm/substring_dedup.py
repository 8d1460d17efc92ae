"""Substring dedup: winnowed anchors as seeds, extended both ways to whole windows.

A word goes when a window of ``window`` consecutive words that covers it also
starts in a document with a smaller id.

1. One pass over the texts hashes every gram of ``gram`` words.  The anchor of a
   window is the smallest gram hash in it (winnowing with window - gram + 1 grams),
   so equal windows have equal anchors wherever they stand, and a text keeps
   about one anchor per (window - gram) / 2 words.
2. Documents meet on anchors: anchors of two or more documents are the seeds
   (an aggregate of smallest and largest id, combined map-side).
3. In a document every seed is extended both ways, to each of the windows
   around it that it is the anchor of; a window is its 64-bit hash.  The smallest
   document of each window comes from an aggregate, and windows of later
   documents find it by an equi join.  Both work on one row per window near a
   seed; a window that a third of all documents share is combined map-side in the
   aggregate and split by the adaptive join, and pairs of documents never appear.
4. The windows found in a document merge to maximal repeats of at least
   ``window`` words, which are cut out.

Documents of equal word sequence are settled first: all but the smallest id
lose all windows, and only the smallest goes through steps 2 to 4.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import as_bytes, chunks, gram_hashes, n_words, normal_words, slices, word_hashes
from tidemark.session import cut_lineage


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, in log2(width) passes."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def window_anchors(words: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, text, anchor) of all windows that lie within one text."""
    none = np.empty(0, np.int64)
    if len(words) < window:
        return none, none, np.empty(0, np.uint64)
    low = sliding_min(gram_hashes(words, gram), window - gram + 1)
    count = np.maximum(np.diff(off) - window + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    start = np.arange(len(text)) - first[text] + off[text]
    return start, text, low[start]


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            ids, texts = b.column(0), [t or b"" for t in as_bytes(b.column(1))]
            for lo, hi in chunks(texts):
                normals = [normal_words(t) for t in texts[lo:hi]]
                words, off = word_hashes(normals)
                _, text, low = window_anchors(words, off, window, gram)
                new = np.ones(len(low), bool)                   # runs of windows with one anchor
                new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
                bounds = np.searchsorted(text[new], np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([
                    ids[lo:hi], pa.array(np.diff(off), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in normals]),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()),
                                             pa.array(low[new].view(np.int64)))],
                    names=["id", "n_words", "digest", "anchors"])
    return run


def _tag(normal: bytes) -> int:
    """Tells apart the texts of a repeated id; sits above the 32 bits of a start."""
    return (zlib.crc32(normal) & 0x7FFFFFFF) << 32


def _windows(window: int, gram: int):
    """(id, text, seeds) -> (h, id, tag and start) of the windows whose anchor is a seed of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            ids, texts = b.column(0).to_numpy(), as_bytes(b.column(1))
            seeds, bounds = _lists(b.column(2))
            for lo, hi in chunks([t or b"" for t in texts]):
                normals = [normal_words(t) for t in texts[lo:hi]]
                words, off = word_hashes(normals)
                start, text, low = window_anchors(words, off, window, gram)
                if not len(start):
                    continue
                wanted = np.unique(seeds[bounds[lo]:bounds[hi]].view(np.uint64))
                near = wanted[np.minimum(np.searchsorted(wanted, low), len(wanted) - 1)] == low
                start, text = start[near], text[near]
                tags = np.fromiter(map(_tag, normals), np.int64, hi - lo)
                yield pa.RecordBatch.from_arrays([
                    pa.array(gram_hashes(words, window)[start].view(np.int64)),
                    pa.array(ids[lo:hi][text]), pa.array(start - off[text] + tags[text])],
                    names=["h", "id", "start"])
    return run


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without NULLs."""
    off = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False), off


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Mask of the words that windows at the given starts cover."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + window, n), -1)
    return np.cumsum(d[:n]) > 0


def _cut(window: int, with_text: bool):
    """(id, text, starts) -> (id, digest of the whole, n_removed, kept_sha256, spans[, kept])."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            texts = as_bytes(b.column(1))
            vals, off = _lists(b.column(2))
            whole, gone, sha, spans, kept = [], [], [], [], []
            for i, t in enumerate(texts):
                normal = normal_words(t)
                whole.append(hashlib.sha256(normal).hexdigest())
                n = n_words(normal)
                marks = vals[off[i]:off[i + 1]] - _tag(normal)
                mask = covered(n, marks[(marks >= 0) & (marks < 1 << 32)], window)
                words = normal.split(b" ") if n else []
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                left = b" ".join(w for w, m in zip(words, mask) if not m)
                gone.append(int(mask.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                spans.append([{"first": int(a), "last": int(z) - 1} for a, z in edge.reshape(-1, 2)])
                if with_text:
                    kept.append(left.decode())
            cols = [b.column(0), pa.array(whole), pa.array(gone, pa.int64()), pa.array(sha),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]
            names = ["id", "digest", "n_removed", "kept_sha256", "spans"]
            if with_text:
                cols.append(pa.array(kept, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def substring_dedup(docs: DataFrame, window: int = 50, gram: int = 20, id_col: str = "doc_id",
                    text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans[, kept]), one row per row of ``docs``.

    ``spans``: the removed maximal repeats as word positions (first, last); NULL for
    a copy of the whole of an earlier document, all of whose words go.  ``kept``
    (``with_text``): the kept words joined by one space, for the rows that lost words
    (NULL: the text is kept whole).

    Words are maximal runs of characters other than \\x20, \\x09-\\x0D, unchanged.
    NULL and empty texts and texts shorter than the window lose nothing.  Rows of
    one id are never compared with each other (no id is smaller), each is judged
    on its own text.  A NULL id is smaller than none and larger than none: its row loses
    nothing.  Extra columns are not read; an empty table gives an empty one.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = cut_lineage(src.mapInArrow(
        _anchors(window, gram), "id long, n_words long, digest string, anchors array<long>"))
    classes = sig.where("id is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    reps = sig.join(classes, "digest")
    anchors = reps.where("id = rep").select("id", F.explode("anchors").alias("h"))
    seeds = anchors.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    per_doc = cut_lineage(anchors.join(seeds.select("h"), "h").groupBy("id").agg(
        F.collect_set("h").alias("seeds")))                    # at most one per word of the text
    near = src.join(per_doc, "id").select("id", "text", "seeds").mapInArrow(
        _windows(window, gram), "h long, id long, start long")
    owner = near.groupBy("h").agg(F.min("id").alias("lo"))
    found = near.join(owner, "h").where("id > lo").groupBy("id").agg(F.collect_set("start").alias("starts"))
    hit = src.join(found, "id").select("id", "text", "starts")
    schema = ("id long, digest string, n_removed long, kept_sha256 string, "
              "spans array<struct<first:int,last:int>>" + (", kept string" if with_text else ""))
    cut = hit.mapInArrow(_cut(window, with_text), schema)
    # an id may name several texts: the digest tells whose spans these are
    cut = cut.dropDuplicates(["id", "digest"])
    base = sig.drop("anchors").join(classes, "digest", "left")
    out = base.join(cut.withColumnsRenamed({"n_removed": "_gone", "kept_sha256": "_sha"}), ["id", "digest"], "left")
    copy = F.col("id").isNotNull() & (F.col("id") > F.col("rep")) & (F.col("n_words") >= window)
    cols = [F.col("id").alias(id_col), "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("_gone", F.lit(0).cast("long"))).alias("n_removed"),
            F.when(copy, F.lit(hashlib.sha256(b"").hexdigest()))
             .otherwise(F.coalesce("_sha", "digest")).alias("kept_sha256"),
            F.when(~F.coalesce(copy, F.lit(False)),
                   F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>"))).alias("spans")]
    if with_text:
        cols.append(F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*cols)
