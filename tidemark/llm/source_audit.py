"""Source divergence audit: how far each source's term frequencies lie from the others'.

1. A task takes its texts as one Arrow buffer and keeps a pointer to the start of every
   term.  The pointers are sorted by what they point at: a multikey quicksort whose
   characters are eight bytes wide partitions all open slices at once, and slices of
   equal characters move eight bytes on.  The sort is stable and starts in the order of
   (lang, source, document), so a run of equal terms tells the term's occurrences and
   documents per source.  No term is copied before its run is counted.
2. The counts of all shards are added up per (lang, source, term); the terms that occur in
   enough documents of their language are kept.
3. Frequencies are integers in units of 1e-9, ``1 + floor(1e9 (count + 5) / (N + 5 V))``,
   worked out in decimals, so a term's value is exact at any size.
4. Sources of a language are compared over hash blocks of terms and tiles of sources.  A task
   holds one block of terms for two tiles; terms that occur in neither
   source have one known difference and are counted, not visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._text import slices
from tidemark.session import cut_lineage

_SCALE = 1_000_000_000
_LEVELS = 32                     # eight-byte characters before whole terms are compared

# bytes of terms: ASCII letters, lower-cased, and every byte above 0x7F; others become 0
_FOLD = np.zeros(256, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in range(ord("a"), ord("z") + 1):
    _FOLD[_c] = _FOLD[_c - 32] = _c


def term_pointers(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of every term of a folded buffer; ``starts`` are the texts' first bytes."""
    inside = buf != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = starts[starts < len(buf)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = starts[starts > 0] - 1
    last[edge] = inside[edge]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def sort_pointers(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): a stable order of the pointers by their terms, and whether each
    differs from the one before it.  ``buf`` ends with eight spare bytes."""
    n = len(first)
    order = np.arange(n)
    new = np.zeros(n, bool)
    new[:1] = True
    window = np.lib.stride_tricks.sliding_window_view(buf, 8)
    todo, run = np.arange(n), np.zeros(n, np.int64)            # positions in the order, and their slices
    for level in range(_LEVELS):
        if not len(todo):
            return order, new
        mine = order[todo]
        at = first[mine] + 8 * level
        left = last[mine] - at
        key = np.ascontiguousarray(window[np.minimum(at, len(window) - 1)]).view(">u8").ravel().astype(np.uint64)
        short = left < 8
        blank = ((8 - np.clip(left[short], 1, 8)) * 8).astype(np.uint64)
        key[short] = np.where(left[short] > 0, key[short] >> blank << blank, np.uint64(0))
        by = np.lexsort((key, run)) if level else np.argsort(key, kind="stable")
        order[todo] = mine[by]
        key, run, left = key[by], run[by], left[by]
        split = np.empty(len(todo), bool)
        split[:1] = True
        split[1:] = (key[1:] != key[:-1]) | (run[1:] != run[:-1])
        new[todo] |= split
        run = np.cumsum(split)
        # a slice is done when it has one pointer or its terms end before the next character
        size = np.bincount(run)
        more = (size[run] > 1) & (left >= 8)
        todo, run = todo[more], run[more]
    for lo, hi in _spans(run):                          # very long terms with a long common start
        mine = order[todo[lo:hi]]
        terms = [buf[first[p]:last[p]].tobytes() for p in mine]
        by = sorted(range(len(mine)), key=terms.__getitem__)
        order[todo[lo:hi]] = mine[by]
        for a, b in zip(range(lo, hi - 1), range(lo + 1, hi)):
            new[todo[b]] |= terms[by[a - lo]] != terms[by[b - lo]]
    return order, new


def _spans(run: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(run)) + 1
    if len(run):
        yield from zip([0, *cut], [*cut, len(run)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs) of every slice of texts."""
    for b in slices(batches, 2, 8 << 20):
        keys = pd.MultiIndex.from_arrays([b.column(0).to_pylist(), b.column(1).to_pylist()])
        group, groups = keys.factorize()
        by = np.argsort(group, kind="stable")
        text = b.column(2).take(pa.array(by)).cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = text.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.empty(0, np.uint8)
        starts = offsets[:-1] - offsets[0]
        buf = np.zeros(len(raw) + 8, np.uint8)
        np.take(_FOLD, raw, out=buf[:len(raw)])
        first, last = term_pointers(buf[:len(raw)], starts)
        if not len(first):
            continue
        doc = np.searchsorted(starts, first, "right") - 1
        order, new = sort_pointers(buf, first, last)
        doc = doc[order]
        own = group[by][doc]
        head = new.copy()
        head[1:] |= own[1:] != own[:-1]
        other = head.copy()
        other[1:] |= doc[1:] != doc[:-1]
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(order)))
        docs = np.add.reduceat(other.astype(np.int64), at)
        lead = order[at]
        blob = buf.tobytes()
        terms = [blob[i:j] for i, j in zip(first[lead].tolist(), last[lead].tolist())]
        lang, source = zip(*groups)
        yield pa.RecordBatch.from_arrays([
            pa.array(lang, pa.string()).take(pa.array(own[at])), pa.array(source, pa.string()).take(pa.array(own[at])),
            pa.array(terms, pa.binary()).cast(pa.string()), pa.array(size, pa.int64()), pa.array(docs, pa.int64())],
            names=["lang", "source", "term", "n", "docs"])


def _compare(unit: pd.DataFrame) -> pd.DataFrame:
    """One block of terms for one pair of tiles: what its terms add to every pair of sources
    beyond the difference that a term without occurrences has."""
    own = unit["term"].isna().to_numpy()
    heads, cells = unit[own], unit[~own]
    heads = heads.drop_duplicates("source")
    row = pd.Index(heads["source"]).get_indexer(cells["source"])
    col, terms = pd.factorize(cells["term"])
    base = heads["p"].to_numpy(np.int64)
    p = np.repeat(base[:, None], max(1, len(terms)), axis=1)
    if len(terms):
        p[row, col] = cells["p"].to_numpy(np.int64)
    names, tile = heads["source"].to_numpy(), heads["tile"].to_numpy()
    cross = unit["ti"].iloc[0] != unit["tj"].iloc[0]
    a, b, value = [], [], []
    for i in range(len(names)):
        other = np.flatnonzero(tile != tile[i]) if cross else np.arange(len(names))
        other = other[names[other] > names[i]]
        if len(other):
            gap = np.abs(base[other] - base[i])
            a += [names[i]] * len(other)
            b += list(names[other])
            value += (np.abs(p[other] - p[i]).sum(axis=1) - gap * p.shape[1]).tolist()
    text = {"lang": [unit["lang"].iloc[0]] * len(a), "a": a, "b": b}
    return pd.DataFrame({**{c: pd.Series(v, dtype=object) for c, v in text.items()}, "value": pd.Series(value, dtype="int64")})


def _p(count, total, kept):
    """1 + floor(scale (count + 5) / (total + 5 kept)), exact."""
    wide = "decimal(20,0)"
    return F.expr(f"1 + (({_SCALE}BD * CAST({count} + 5 AS {wide})) div CAST({total} + 5 * {kept} AS {wide}))")


def source_audit(docs: DataFrame, min_docs: int = 30, top_terms: int = 50, lang_col: str = "lang",
                 source_col: str = "source", text_col: str = "text", block_terms: int = 4096,
                 tile: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``docs``.

    Part ``pair``: the other sources of the language by the sum of |p - q| over the language's
    kept terms (those in at least ``min_docs`` of its rows), largest first.  Part ``term``: the
    ``top_terms`` occurring kept terms whose frequency exceeds the language's, by that excess.
    Ties go by the item's UTF-8 bytes.

    A term is a run of ASCII letters and characters beyond ASCII, with A-Z lower-cased.  NULL
    text, lang and source count as ''; a source without terms takes part with counts
    of 0; a language without kept terms has pairs of value 0; repeated rows and ids count as
    rows; very long texts are counted whole; an empty table gives an empty one; other
    columns are not read.
    """
    src = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in
                        ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = cut_lineage(
        src.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
    terms = cut_lineage(terms.where(F.col("docs") >= min_docs).drop("docs"))
    kept = cut_lineage(counts.drop("docs").join(terms, ["lang", "term"]))

    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("all_total"))
    sources = src.select("lang", "source").distinct()
    width = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("s"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = sources.join(width, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.na.fill(0, ["v", "all_total", "total"])
    groups = groups.withColumn("blocks", F.ceil(F.greatest("v", F.lit(1)) / block_terms).cast("int"))
    groups = groups.withColumn("tiles", F.ceil(F.col("s") / tile).cast("int"))
    groups = groups.withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int"))
    groups = cut_lineage(groups.withColumn("p0", F.when(F.col("v") > 0, _p("0L", "total", "v")).otherwise(F.lit(0).cast("long"))))

    cells = kept.join(groups, ["lang", "source"]).withColumn("p", _p("n", "total", "v")).withColumn(
        "q", _p("all_n", "all_total", "v"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                       (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)

    rows = cells.select("lang", "source", "term", "p", "tile", "tiles",
                        F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"))
    heads = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "tile", "tiles",
                          F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    units = rows.unionByName(heads).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    units = units.withColumn("ti", F.least("tile", "_j")).withColumn("tj", F.greatest("tile", "_j"))
    gaps = units.groupBy("lang", "block", "ti", "tj").applyInPandas(_compare, "lang string, a string, b string, value long")
    gaps = gaps.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    side = groups.select("lang", "source", "p0", "v")
    gaps = gaps.join(side.withColumnsRenamed({"source": "a", "p0": "pa"}), ["lang", "a"]).join(
        side.withColumnsRenamed({"source": "b", "p0": "pb"}).drop("v"), ["lang", "b"])
    gaps = gaps.select("lang", "a", "b", (F.col("value") + F.col("v") * F.abs(F.col("pa") - F.col("pb"))).alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e")
    pairs = gaps.select("lang", "value", both).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(over)
