"""Benchmark decontamination: an FM-index per training shard, searched for test phrases.

Words are maximal runs of ASCII letters and digits and of characters above
\\x7F, with A-Z in lower case.  The phrases are all windows of ``window``
consecutive words of a benchmark item; an item of fewer words, but not none, is
one phrase.

A task cuts its texts into shards of about ``shard_words`` words (a longer text is
cut into overlapping pieces), builds the FM-index of each whole shard, searches all
phrases backwards at once, locates the occurrences and merges them to removal
spans per text.  Memory is bounded by the shard, whatever the text lengths.

The benchmark comes to the tasks in blocks of about ``block_words`` words, so its
share of a task is bounded too; with more than one block the texts pass through one
function per block, which adds its spans to those found before.  No text is
shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import as_bytes, carried, slices, word_hashes
from tidemark.llm.fm_index import FMIndex

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
              for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BREAK = np.uint64(0x5EA4A7055EA4A705)           # between texts; no phrase holds it
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def folded(text: bytes | None) -> bytes:
    """The words of a text in lower case, joined by one space."""
    return b" ".join(text.translate(_FOLD).split()) if text else b""


@dataclass
class Phrases:
    rows: np.ndarray          # (phrases, window) hashes, padded at the end
    lengths: np.ndarray
    item_of: list[list[str]]  # items of each phrase


def phrases_of(items: list[tuple[str, bytes | None]], window: int) -> Phrases:
    """Distinct windows of the items and the items each belongs to."""
    found: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        h, _ = word_hashes([folded(text)])
        n = len(h)
        if not n:
            continue
        k = min(n, window)
        for s in range(n - k + 1):
            found.setdefault(h[s:s + k].tobytes(), (k, set()))[1].add(item)
    rows = np.zeros((len(found), window), np.uint64)
    for i, key in enumerate(found):
        rows[i, :len(key) // 8] = np.frombuffer(key, np.uint64)
    return Phrases(rows, np.array([k for k, _ in found.values()], np.int64),
                   [sorted(x) for _, x in found.values()])


def _find(normals: list[bytes], p: Phrases, shard_words: int) -> tuple[np.ndarray, list, list]:
    """(words per text, phrase occurrences per text as (starts, phrases))."""
    words, off = word_hashes(normals)
    count = np.diff(off)
    starts: list[list] = [[] for _ in normals]
    which: list[list] = [[] for _ in normals]
    width = int(p.lengths.max(initial=0))
    pieces, held = [], 0

    def flush():
        if not pieces:
            return
        parts = []
        for _, a, z in pieces:
            parts += [words[a:z], [_BREAK]]
        index = FMIndex(np.concatenate(parts).astype(np.uint64))
        phrase, pos = index.locate(*index.search(p.rows, p.lengths))
        begin = np.cumsum([0] + [z - a + 1 for _, a, z in pieces])
        piece = np.searchsorted(begin, pos, side="right") - 1
        order = np.argsort(piece, kind="stable")
        cuts = np.searchsorted(piece[order], np.arange(len(pieces) + 1))
        for k, (text, a, _) in enumerate(pieces):
            at = order[cuts[k]:cuts[k + 1]]
            if len(at):
                starts[text].append(pos[at] - begin[k] + a - off[text])
                which[text].append(phrase[at])
        pieces.clear()

    if width:
        for i, n in enumerate(count):
            for a in range(0, int(n), shard_words):
                z = min(int(n), a + shard_words + width - 1)
                if held and held + z - a > shard_words:
                    flush()
                    held = 0
                pieces.append((i, off[i] + a, off[i] + z))
                held += z - a
        flush()
    return count, starts, which


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of the word ranges [start, end) as maximal ranges."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist())):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the characters from the first to the last word of each span."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, prev = [], 0
    for s, e in spans:
        out.append(text[prev:at[s][0]])
        prev = at[e - 1][1]
    out.append(text[prev:])
    return b"".join(out)


def _search(phrases, shard_words: int, last: bool, with_text: bool, id_col: str, text_col: str):
    """One pass over (id, text[, row][, spans, items]): adds the spans and items of a block of phrases."""
    def emit(rows: list, held: list, types: dict, p: Phrases):
        normals = [folded(t) for _, t, _, _ in rows]
        count, starts, which = _find(normals, p, shard_words)
        spans, items, hits, cleaned = [], [], [], []
        for (_, t, old_spans, old_items), s, w in zip(rows, starts, which):
            found = set(old_items)
            ranges = [(x["first"], x["last"] + 1) for x in old_spans]
            if s:
                s, w = np.concatenate(s), np.concatenate(w)
                for k in np.unique(w):
                    found.update(p.item_of[k])
                merged = merge_spans(s, s + p.lengths[w])
                if ranges:
                    both = np.array(merged + ranges)
                    merged = merge_spans(both[:, 0], both[:, 1])
                ranges = merged
            spans.append([{"first": a, "last": b - 1} for a, b in ranges])
            items.append(sorted(found))
            hits.append(sum(b - a for a, b in ranges))
            if last and with_text:
                cleaned.append(cut_words(t, ranges).decode() if ranges else None)
        cols, names = [pa.array([r[0] for r in rows], types["id"])], ["id"]
        if not last and not held:
            cols.append(pa.array([None if r[1] is None else r[1].decode() for r in rows], pa.string()))
            names.append("text")
        if held:
            cols, names = [pa.concat_arrays(held)] + cols * last, ["row"] + names * last
        cols += [pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
        names += ["spans", "items"]
        if last:
            cols += [pa.array(count, pa.int64()), pa.array(hits, pa.int64())]
            names += ["n_words", "n_hit"]
            if with_text:
                cols.append(pa.array(cleaned, pa.string()))
                names.append("cleaned")
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = phrases.value
        rows, held, size, types = [], [], 0, {}
        for b in slices(carried(batches, id_col, text_col), 1):
            types = {f.name: f.type for f in b.schema}
            ids, texts = b.column("id").to_pylist(), as_bytes(b.column("text"))
            spans, items = (b.column(c).to_pylist() if c in types else [[]] * len(ids) for c in ("spans", "items"))
            begin = 0
            for i, row in enumerate(zip(ids, texts, spans, items)):
                rows.append(row)
                size += len(row[1] or b"")
                if size >= 7 * shard_words or i == len(ids) - 1:
                    if "row" in types:
                        held.append(b.column("row")[begin:i + 1])
                        begin = i + 1
                    if size >= 7 * shard_words:                 # about one shard of words
                        yield emit(rows, held, types, p)
                        rows, held, size = [], [], 0
        if rows:
            yield emit(rows, held, types, p)
        pa.default_memory_pool().release_unused()
    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  shard_words: int = 1 << 19, block_words: int = 4_000_000, with_text: bool = False,
                  carry: bool = False) -> DataFrame:
    """(id, n_words, n_hit, spans, items, contaminated[, cleaned]), one row per row of ``docs``;
    with ``carry`` the whole input row comes along as the struct ``row``.

    ``spans``: maximal runs of words (first, last) covered by occurrences of phrases;
    ``n_hit``: words in them; ``items``: sorted ids, as text, of the benchmark items with
    an occurring phrase; ``cleaned`` (``with_text``): the text without its spans, NULL
    if it has none.

    NULL and empty texts have no words, on either side.  Items with a NULL id count
    for spans but are not listed; repeated rows give repeated results; an item that occurs
    twice counts once.  An empty benchmark hits nothing; empty ``docs`` give an empty table.
    Extra columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    total = items.agg(F.sum(F.regexp_count(F.col("text"), F.lit(r"[^\s]+")))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    if carry:
        src = docs.select(F.struct("*").alias("row"))
        kind, texts = docs.schema[id_col].dataType.simpleString(), f"row {src.schema['row'].dataType.simpleString()}, "
    else:
        src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        kind, texts = src.schema["id"].dataType.simpleString(), "text string, "
    found = "spans array<struct<first:int,last:int>>, items array<string>"
    out = src
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()  # <= block_words
        # an id goes in with "=" before it, so that the empty id and a NULL one differ
        p = phrases_of([("" if r["item"] is None else "=" + r["item"], (r["text"] or "").encode()) for r in part], window)
        last = k == blocks - 1
        tail = ", n_words long, n_hit long" + (", cleaned string" if with_text else "")
        # passes hand on the texts, (id, text) or row; the last one hands on what was found
        between = (texts if carry else f"id {kind}, {texts}") + found
        end = (texts if carry else "") + f"id {kind}, " + found + tail
        out = out.mapInArrow(
            _search(spark.sparkContext.broadcast(p), shard_words, last, with_text, id_col, text_col),
            end if last else between)
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "spans",
                      F.transform(F.array_remove("items", ""), lambda x: F.substring(x, 2, 1 << 30)).alias("items"),
                      (F.col("n_hit") > 0).alias("contaminated"), *(["cleaned"] if with_text else []),
                      *(["row"] if carry else []))
