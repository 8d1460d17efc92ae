"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

1. One pass over the texts gives each document the digest of its word sequence
   and its band hashes.  Documents of equal word sequence are one class, which
   its smallest id stands for; copies are counted, never paired.
2. Representatives shuffle on band hashes.  Members of a shared band are tied to
   the band's smallest member (linear in the members), and the components of
   these ties are the candidate groups.
3. A group of at most ``block`` documents meets in one task, each text sent once.
   A larger group goes the way that sends fewer texts, by counts: all pairs of its hash
   blocks of ``wide`` documents, bands compared in the task (near copies, which share
   most bands), or its band buckets, those above ``block`` in pairs of hash blocks, where
   a pair counts in the first band it shares (loose chains).  Blocks are bounded in
   documents and bytes, so no task holds an unbounded group.  A text goes to its block once;
   what meets in pairs are whole blocks, a row each and compressed together, in which near copies
   take little more than what sets them apart.
4. A task computes the exact Jaccard similarity of the full n-gram sets of all
   pairs that share a band: the sizes of all intersections of a block pair are a
   matrix product over the n-grams that occur in two or more of its texts.  It
   returns a row per document (number of links, smallest member of its local
   component), never a row per pair.
5. Link counts are added up, local components are joined.

``choose_bands`` picks rows and bands for the target recall at the threshold:
a pair of similarity s shares a band with probability 1 - (1 - s^r)^b.
"""

from __future__ import annotations

import hashlib
import lzma
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._blocks import deal, paired
from tidemark.llm._components import connected_components, local_components
from tidemark.llm._text import as_bytes, chunks, gram_hashes, mix, normal_words, slices, word_hashes
from tidemark.session import cut_lineage


def choose_bands(threshold: float, recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows per band (fewest false candidates) whose recall at
    the threshold reaches the target within ``max_hashes`` hash functions."""
    best = (max_hashes, 1)
    for r in range(1, max_hashes + 1):
        p = threshold ** r
        b = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if b * r > max_hashes:
            break
        best = (b, r)
    return best


def gram_sets(normals: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): all n-grams of each text in order; a text of fewer words, but
    not none, has one gram, of all its words."""
    words, off = word_hashes(normals)
    if not len(words):
        return words, off
    # grams over the whole array; the ones that would cross texts are dropped
    grams = gram_hashes(words, n)
    count = np.diff(off)
    keep = np.maximum(count - n + 1, (count > 0).astype(np.int64))
    out_off = np.concatenate(([0], np.cumsum(keep)))
    short = np.flatnonzero((count > 0) & (count < n))
    text = np.repeat(np.arange(len(count)), keep)
    at = np.arange(out_off[-1]) - out_off[text] + off[text]
    out = np.empty(out_off[-1], np.uint64)
    long = count[text] >= n
    out[long] = grams[at[long]]
    for i in short:
        out[out_off[i]] = gram_hashes(words[off[i]:off[i + 1]], int(count[i]))[0] ^ np.uint64(count[i])
    return out, out_off


def _coefficients(k: int, seed: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 2**64, k, dtype=np.uint64) | np.uint64(1)


def _band_hashes(grams: np.ndarray, off: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """(texts, bands) of int64 for texts that have grams (off strictly increasing)."""
    coef = _coefficients(bands * rows, seed)
    out = np.empty((len(off) - 1, bands), np.uint64)
    for b in range(bands):
        h = np.full(len(off) - 1, b, np.uint64)
        for r in range(rows):
            x = grams * coef[b * rows + r]
            x >>= np.uint64(20)              # the low bits of a product are weak
            h = mix(h * np.uint64(31) + np.minimum.reduceat(x, off[:-1]))
        out[:, b] = h
    return out.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(id, digest, size, bands) per row of docs (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            ids, texts = b.column(0), as_bytes(b.column(1))
            for lo, hi in chunks([t or b"" for t in texts]):
                normals = [normal_words(t) for t in texts[lo:hi]]
                grams, off = gram_sets(normals, n)
                full = np.flatnonzero(np.diff(off) > 0)
                found: list = [None] * (hi - lo)
                if len(full):
                    starts = np.append(off[:-1][full], off[-1])
                    for i, row in zip(full, _band_hashes(grams, starts, bands, rows, seed)):
                        found[i] = row
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi], pa.array([hashlib.md5(x).hexdigest() if x else None for x in normals]),
                     pa.array([len(x) for x in normals], pa.int64()),
                     pa.array(found, pa.list_(pa.int64()))], names=["id", "digest", "size", "bands"])

    return docs.mapInArrow(run, "id long, digest string, size long, bands array<long>")


def word_digest(text: Column) -> Column:
    """``digest`` of a text as a Column: MD5 of its words joined by one space, NULL without words."""
    words = F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(" "))
    return F.when(words != "", F.md5(words.cast("binary")))


def _pack_block(g: pd.DataFrame) -> bytes:
    """The members of a block (id, copies, bands, normal) as compressed bytes."""
    bands = np.stack(g["bands"].to_numpy()).astype(np.int64)
    head = np.array(bands.shape, np.int64).tobytes() + g["id"].to_numpy(np.int64).tobytes() + g["copies"].to_numpy(np.int64).tobytes()
    # words hold no line feed
    return lzma.compress(head + bands.tobytes() + b"\n".join(g["normal"]), preset=1)


def _open_block(data: bytes) -> pd.DataFrame:
    data = lzma.decompress(data)
    m, k = np.frombuffer(data, np.int64, 2)
    ints = np.frombuffer(data, np.int64, m * (k + 2), 16)
    return pd.DataFrame({"id": ints[:m], "copies": ints[m:2 * m], "bands": list(ints[2 * m:].reshape(m, k)),
                         "normal": data[16 + 8 * m * (k + 2):].split(b"\n")})


#: About how many times smaller a packed block of near copies is than its texts (a careful
#: guess): only the choice between the two ways of a large group depends on it.
_PACKED = 8
_LINKS = "id long, links long, low long"
_FOUND = f"{_LINKS}, key long, mine int, blocks int, band int, block binary"


def _verify(threshold: float, n: int):
    """Two grouped functions, one row per linked member.  ``run``, over one unit of ``deal`` rows (key, id,
    copies, digest, bands, band, blocks, mine, text): exact links inside small keys, and the blocks of
    large ones packed.  ``meet``, over the packed blocks of a pair (key, band, bi, bj, mine, block):
    exact links inside a block (bi = bj) or across two."""
    def one(g: pd.DataFrame, cross: bool):
        m = len(g)
        grams, off = gram_sets(list(g["normal"]), n)
        owner = np.repeat(np.arange(m), np.diff(off))
        order = np.lexsort((owner, grams))
        gr, ow = grams[order], owner[order]
        first = np.ones(len(gr), bool)
        first[1:] = (gr[1:] != gr[:-1]) | (ow[1:] != ow[:-1])
        gr, ow = gr[first], ow[first]                              # sets: each (gram, text) once
        size = np.bincount(ow, minlength=m)
        code = np.concatenate(([0], np.cumsum(gr[1:] != gr[:-1]))) if len(gr) else np.empty(0, np.int64)
        shared = np.bincount(code)[code] > 1 if len(gr) else np.empty(0, bool)
        gr_code, ow = code[shared], ow[shared]
        inter = np.zeros((m, m))
        if len(ow):
            col = np.concatenate(([0], np.cumsum(gr_code[1:] != gr_code[:-1])))
            for lo in range(0, int(col[-1]) + 1, 4096):
                s, e = np.searchsorted(col, [lo, lo + 4096])
                a = np.zeros((m, min(4096, int(col[-1]) + 1 - lo)), np.float32)   # counts stay exact
                a[ow[s:e], col[s:e] - lo] = 1
                inter += a @ a.T
        union = size[:, None] + size[None, :] - inter
        link = inter >= threshold * union - 1e-9
        link &= inter > 0
        sig = np.stack(g["bands"].to_numpy())
        band = int(g["band"].iloc[0])
        meet = np.zeros((m, m), bool)
        for k in range(sig.shape[1]):
            if k == band:                    # pairs that share an earlier band count there
                meet = (sig[:, k][:, None] == sig[:, k][None, :]) & ~meet
                break
            meet |= sig[:, k][:, None] == sig[:, k][None, :]
        link &= meet
        np.fill_diagonal(link, False)
        if cross:                            # pairs inside a block belong to the unit (i, i)
            mine = g["mine"].to_numpy()
            link &= mine[:, None] != mine[None, :]
        a, b = np.nonzero(link)
        ids = g["id"].to_numpy()
        low = ids[local_components(m, a, b)]
        weight = np.zeros(m, np.int64)
        np.add.at(weight, a, g["copies"].to_numpy()[b])
        keep = np.zeros(m, bool)
        keep[a] = True
        return pd.DataFrame({"id": ids[keep], "links": weight[keep], "low": low[keep]})

    whole = {c: "Int64" for c in ("id", "links", "low", "key", "mine", "blocks", "band")}
    none = pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("id", "links", "low")})

    def run(unit: pd.DataFrame) -> pd.DataFrame:
        parts, packed = [none], []
        normals = [normal_words((t or "").encode()) for t in unit["text"]]
        unit = unit.drop(columns="text").assign(normal=normals)
        # an id may name other texts too: keep the text of the class, once
        own = [hashlib.md5(x).hexdigest() for x in normals] == unit["digest"]
        unit = unit[own].drop_duplicates(["key", "mine", "id"])
        for (key, mine), g in unit.groupby(["key", "mine"], sort=False):
            blocks = int(g["blocks"].iloc[0])
            if blocks > 1:
                packed.append((key, mine, blocks, int(g["band"].iloc[0]), _pack_block(g)))
            elif len(g) > 1:
                parts.append(one(g.sort_values("id", kind="stable"), False))
        links = pd.concat(parts, ignore_index=True)
        packed = pd.DataFrame(packed, columns=["key", "mine", "blocks", "band", "block"])
        # 64-bit keys and NULLs in one column
        return pd.concat([x.reindex(columns=list(whole) + ["block"]).astype(whole | {"block": object}) for x in (links, packed)])

    def meet(unit: pd.DataFrame) -> pd.DataFrame:
        parts = [none]
        for (_, bi, bj), g in unit.groupby(["key", "bi", "bj"], sort=False):
            if bi != bj and len(g) < 2:
                continue
            both = [_open_block(block).assign(mine=mine, band=band) for mine, band, block in zip(g["mine"], g["band"], g["block"])]
            both = pd.concat(both, ignore_index=True)
            if len(both) > 1:
                parts.append(one(both.sort_values("id", kind="stable"), bi != bj))
        return pd.concat(parts, ignore_index=True)

    return run, meet


def ngram_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999,
               id_col: str = "doc_id", text_col: str = "text", block: int = 192, wide: int = 512,
               seed: int = 11, with_digest: bool = False) -> DataFrame:
    """(id, n_links, class_id, kept[, digest]), one row per row of ``docs``; ``digest``
    (``with_digest``) is that of the row's words, see ``word_digest``, NULL without words or id.

    ``n_links``: other rows whose n-gram set has Jaccard similarity >= ``threshold``
    with this row's (copies included); pairs that share no band are missed with
    probability 1 - ``recall`` at the threshold and less above it.  ``class_id``:
    the smallest id reachable by links; ``kept``: id = class_id.

    Words are maximal runs of characters other than \\x20, \\x09-\\x0D, unchanged.  A
    text of fewer than n words is one gram.  NULL and empty texts, and texts
    without words, link with nothing.  Rows of a repeated id count as rows;
    each has the links of its own text.  A row with a NULL id is returned with no
    links and a NULL class.  Extra columns are not read; an empty table gives an empty one.
    """
    bands, rows = choose_bands(threshold, recall)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = cut_lineage(signatures(src, n, bands, rows, seed))
    real = sig.where("id is not null and digest is not null")
    classes = real.groupBy("digest").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("size").alias("bytes"),
        F.any_value("bands").alias("bands"))
    # the node of a class is its smallest id; classes whose id names other texts too get a hash
    named = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("texts"))
    classes = cut_lineage(classes.join(named, "rep").select(
        F.when(F.col("texts") == 1, F.col("rep")).otherwise(F.xxhash64("digest")).alias("id"),
        "rep", "digest", "copies", "bytes", "bands"))
    bucket = classes.select("id", F.posexplode("bands").alias("band", "value")).select(
        "id", F.xxhash64("band", "value").alias("key"), "band")
    lows = bucket.groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a tie of every member of a shared bucket to its smallest member
    ties = bucket.join(lows, "key").select(F.col("id").alias("a"), F.col("low").alias("b"))
    groups = connected_components(ties)                                     # (node, component)
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    groups = cut_lineage(groups.join(sizes, "component"))
    weights = classes.select("id", "bytes")
    large = groups.where(F.col("size") > block).select(F.col("node").alias("id"), "component", "size")
    # texts sent by either way; buckets of one member send none
    # (joined as classes and only then taken by bands: no join makes a row per band)
    crowd = classes.select("id", "bytes", "bands").join(large, "id")
    by_band = lambda df: df.select("id", "component", "bytes", F.posexplode("bands").alias("band", "value")).withColumn(
        "key", F.xxhash64("band", "value"))
    held = by_band(crowd).groupBy("component", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ways = cut_lineage(held.groupBy("component").agg(F.sum(F.col("n") * F.ceil(F.col("n") / F.lit(float(block)))).alias("apart")).join(
        large.groupBy("component").agg(F.max(F.col("size") * (F.ceil(F.col("size") / F.lit(float(wide))) / _PACKED + 1)).alias("whole")), "component"))
    whole = large.join(ways.where("whole <= apart"), "component", "left_semi")
    apart = by_band(crowd.join(ways.where("whole > apart"), "component", "left_semi")).select("key", "id", "band", "bytes")
    one = lambda df, c: df.select(F.xxhash64(F.lit("component"), "component").alias("key"), F.col(c).alias("id"), F.lit(-1).alias("band"))
    members = deal(one(groups.where(F.col("size") <= block), "node").join(weights, "id").unionByName(apart), block, weight="bytes")
    members = members.unionByName(deal(one(whole, "id").join(weights, "id"), wide, weight="bytes")).drop("bytes")
    grouped = classes.join(groups.select(F.col("node").alias("id")), "id")
    texts = grouped.join(src.withColumnRenamed("id", "rep"), "rep").drop("rep", "bytes")
    run, meet = _verify(threshold, n)
    done = cut_lineage(members.join(texts, "id").groupBy("unit").applyInPandas(run, _FOUND))
    pairs = paired(done.where("block is not null").select("key", "mine", "blocks", "band", "block", F.lit(0).cast("long").alias("unit")))
    links = cut_lineage(done.where("block is null").select("id", "links", "low").unionByName(
        pairs.groupBy("unit").applyInPandas(meet, _LINKS)))
    comps = connected_components(links.select(F.col("id").alias("a"), F.col("low").alias("b")))
    count = links.groupBy("id").agg(F.sum("links").alias("links"))
    found = cut_lineage(classes.select("id", "rep", "digest", "copies").join(count, "id", "left")
                        .join(comps.withColumnRenamed("node", "id"), "id", "left")
                        .withColumn("component", F.coalesce("component", "id")))
    first = found.groupBy("component").agg(F.min("rep").alias("class_id"))
    found = found.join(first, "component").select(
        "digest", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = sig.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(
        found, "digest", "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("class_id", "id").alias("class_id"),
        (F.coalesce("class_id", "id") == F.col("id")).alias("kept"), *(["digest"] if with_digest else []))
