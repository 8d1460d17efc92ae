"""Line dedup: a segment-partition edit join in DataFrame functions.

A line goes if it repeats an earlier line or lies within ``max_edits`` edits of
one; "earlier" is the order of (id, line number) of first occurrences.

1. Lines are grouped by a 128-bit hash; every distinct line is known by its first
   occurrence, and only these take part in the join.
2. A line of length l is cut into max_edits + 1 even segments.  Two lines within
   max_edits edits share one segment unchanged, at a position that the length
   difference and the edits to its left and right allow (the multi-match window).
   Every line is indexed under (length, segment number, content) of its segments
   and probes, for each length from its own down to max_edits less, the few
   substrings that window leaves (for two edits 5, 4 and 3).
3. Index and probes meet in an equi join on the key's hash; only hashes and line
   numbers are shuffled.  A key with more than ``crowded`` indexed lines emits no
   pairs: its lines are gathered in blocks of about ``block`` lines, and two blocks are
   compared inside one row, behind a bigram signature that rules out most pairs (an
   edit flips at most four of its bits).
4. The texts of the candidate lines, and of no others, are fetched: a bitmap of fixed
   size over the ids of their documents (8 MB, broadcast) thins the scan, an equi join
   on the line numbers makes it exact.
5. Candidates are verified by the banded edit distance with a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

BLANK = " \t\r"


def stripped(raw: Column) -> Column:
    """A line without blanks at its ends; ``btrim`` measures whole strings, so only lines that
    have some go through it."""
    some = F.lit(False)
    for c in BLANK:
        some = some | raw.startswith(c) | raw.endswith(c)
    return F.when(some, F.btrim(raw, F.lit(BLANK))).otherwise(raw)


def places(edits: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(own, more): where the segments of an equal or shorter line can lie in a line, as
    (characters less, segment 1..edits + 1, shift of its position).  A line's own segments,
    (0, i, 0), are what it is indexed under; they are probes too."""
    k, own, more = edits + 1, [], []
    for less in range(edits + 1):
        for i in range(1, k + 1):
            for shift in range(max(1 - i, less - (k - i)), min(i - 1, less + (k - i)) + 1):
                (more if less or shift else own).append((less, i, shift))
    return own, more


def with_keys(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """``lines`` (line, n, ...) + ``keys``: array of the hashed keys (length, segment, content)
    at the places above, the line's own ``edits`` + 1 first; NULL where a place does not exist.

    A string of length m has segments of m div k characters, the last m % k one longer.
    Texts are held at four bytes a character here, so that a segment is cut out without
    counting characters, and the arithmetic of a length is done once, in columns: spelled
    out for every key, the generated code would be too long to be compiled.  Read the
    array with ``explode_outer``: for ``explode`` the optimizer adds a filter on their
    size, pushes it down to the scan and so works every key out again, from the text on."""
    k, (own, more) = edits + 1, places(edits)
    out = lines.withColumn("_wide", F.encode("line", "UTF-32"))
    for d in range(edits + 1):
        out = out.withColumn(f"_m{d}", F.col("n") - d)
    for d in range(edits + 1):
        out = out.withColumn(f"_b{d}", F.expr(f"cast(_m{d} div {k} AS int)")).withColumn(f"_r{d}", F.col(f"_m{d}") % k)

    def keys(at):
        cols = []
        for d, i, shift in at:
            m, base, rest = F.col(f"_m{d}"), F.col(f"_b{d}"), F.col(f"_r{d}")
            start = F.lit(shift)
            if i > 1:
                start = base * (i - 1) + F.greatest(F.lit(0), rest - (k - i + 1)) + shift
            size = base + (rest > k - i).cast("int")
            fits = (m >= min_chars) & (start >= 0) & (start + size <= F.col("n"))
            cols.append(F.when(fits, F.xxhash64(m, F.lit(i), F.substring("_wide", start * 4 + 1, size * 4))))
        return F.array(*cols)

    return out.withColumn("keys", keys(own + more))


def within(a: Column, b: Column, edits: int) -> Column:
    return F.levenshtein(a, b, edits).between(0, edits)


def signature(chars: Column) -> Column:
    """Parity of the pairs of neighbours in an array of characters, hashed to 64 bits.  Pass a
    column: an expression would be worked out for every character."""
    bit = lambda x, y: F.when(y.isNotNull(), F.call_function(
        "shiftleft", F.expr("1L"), F.pmod(F.xxhash64(x, y), F.lit(64)).cast("int"))).otherwise(F.expr("0L"))
    bits = F.zip_with(chars, F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0))), bit)
    return F.aggregate(bits, F.expr("0L"), lambda acc, x: acc.bitwiseXOR(x))


def without(lines: Column, gone: Column) -> Column:
    """An array without the elements at the ascending positions ``gone``: the stretches between two
    of them, each cut out once, so the work is linear in the array.  The array goes in as a
    lambda's variable, as an expression it would be worked out for every stretch."""
    def cut(a: Column) -> Column:
        ends = F.concat(gone, F.array(F.size(a)))
        starts = F.concat(F.array(F.lit(-1)), gone)
        return F.flatten(F.zip_with(starts, ends, lambda p, q: F.slice(a, p + 2, q - p - 1)))
    return F.element_at(F.transform(F.array(lines), cut), 1)


def line_dedup(docs: DataFrame, max_edits: int = 2, min_chars: int = 24, id_col: str = "doc_id",
               text_col: str = "text", crowded: int = 16, block: int = 128, with_text: bool = False,
               carry: bool = False, exact_chars: int | None = None) -> DataFrame:
    """(id, n_lines, removed[, kept]), one row per row of ``docs``; with ``carry`` the whole
    input row comes along as the struct ``row``.

    Lines are the parts of a text between \\n, compared without blanks, tabs and
    carriage returns at their ends; lines of fewer than ``min_chars`` characters (at
    least max_edits + 1) take no part in the edit join.  Exact repeats go from ``exact_chars``
    characters on (1 to ``min_chars``; None: ``min_chars``); shorter lines and blank ones
    stay.  ``removed``: numbers, from 0, of the lines that go, ascending; ``kept``
    (``with_text``): the other lines joined by \\n.

    A NULL text has no lines and stays NULL, an empty one has one empty line.  Rows
    of one id are one document: they share the removed numbers, which are those of lines
    that repeat an earlier line in any of its rows.  A row with a NULL id loses
    nothing and removes nothing.  An empty table gives an empty one; extra columns are
    not read.
    """
    if min_chars <= max_edits:
        raise ValueError("min_chars must exceed max_edits")
    least = min_chars if exact_chars is None else exact_chars
    if not 1 <= least <= min_chars:
        raise ValueError("exact_chars must lie between 1 and min_chars")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    def lines_of(texts: DataFrame) -> DataFrame:
        cut = texts.where("id is not null and text is not null").select(
            "id", F.posexplode_outer(F.split("text", "\n")).alias("no", "raw"))
        return cut.select("id", "no", stripped(F.col("raw")).alias("line")).withColumn(
            "n", F.char_length("line")).where(F.col("n") >= least)

    lines = lines_of(src)
    line = F.col("line")

    # smallest line number in a document, then smallest document: aggregates of plain numbers
    h1, h2 = F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")
    first = lines.groupBy(h1, h2, "id").agg(F.min("no").alias("no")).groupBy("h1", "h2").agg(
        F.min("id").alias("id"), F.min_by("no", "id").alias("no"))
    first = cut_lineage(first.select("id", "no", "h1", F.monotonically_increasing_id().alias("lid")))

    # the lines that are no first occurrence keep a NULL lid, those too short for the edit join NULL keys
    every = cut_lineage(with_keys(lines, max_edits, min_chars).select("id", "no", "keys").join(
        first.select("id", "no", "lid"), ["id", "no"], "left").select(
        "id", "no", "lid", F.when(F.col("lid").isNotNull(), F.col("keys")).alias("keys")))
    keys = every.where("lid is not null")
    index = keys.select("lid", F.explode_outer(F.slice("keys", 1, max_edits + 1)).alias("key"))
    if least < min_chars:
        index = index.where("key is not null")
    probe = keys.select("lid", F.explode_outer("keys").alias("key")).where("key is not null")
    crowd = cut_lineage(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("key"))
    pairs = index.join(crowd, "key", "left_anti").select("key", F.col("lid").alias("x")).join(
        probe, "key").where("x <> lid").select(
        F.least("x", "lid").alias("a"), F.greatest("x", "lid").alias("b")).distinct()
    # one job for pairs and crowded keys
    none = F.lit(None).cast("long")
    met = cut_lineage(
        pairs.select(F.lit("pair").alias("kind"), "a", "b", none.alias("key"))
        .unionByName(index.join(crowd, "key", "left_semi").select(
            F.lit("index").alias("kind"), F.col("lid").alias("a"), none.alias("b"), "key").distinct())
        .unionByName(probe.join(crowd, "key", "left_semi").select(
            F.lit("probe").alias("kind"), F.col("lid").alias("a"), none.alias("b"), "key").distinct()))

    some = met.select(F.explode(F.array_compact(F.array("a", "b"))).alias("lid")).distinct()
    found = cut_lineage(_fetch(src, lines_of, first.join(some, "lid")))       # (lid, at, line)
    pairs = met.where("kind = 'pair'").select("a", "b")
    side = lambda c: found.select(
        F.col("lid").alias(c), F.col("at").alias(f"at_{c}"), F.col("line").alias(f"line_{c}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(within(F.col("line_a"), F.col("line_b"), max_edits))
    light = close.select(F.when(F.col("at_a") < F.col("at_b"), F.col("b")).otherwise(F.col("a")).alias("lid"))
    near = light.union(_crowded(met, found, max_edits, block)).distinct()
    gone = every.where("lid is null").select("id", "no").union(keys.join(near, "lid", "left_semi").select("id", "no"))
    gone = gone.groupBy("id").agg(F.sort_array(F.collect_set("no")).alias("removed"))
    n_lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_lines = F.coalesce(n_lines, F.lit(0).cast("long"))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       *([F.struct("*").alias("row")] if carry else []))
    base = base.select("id", n_lines.alias("n_lines"), *(["text"] if with_text else []),
                       *(["row"] if carry else []))
    out = base.join(gone, "id", "left").withColumn(
        "removed", F.coalesce("removed", F.array().cast("array<int>")))
    cols = [F.col("id").alias(id_col), "n_lines", "removed"]
    if with_text:
        cols.append(F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(without(
            F.split("text", "\n"), F.col("removed")), "\n")).alias("kept"))
    return out.select(*cols, *(["row"] if carry else []))


BITS = 1 << 26                 # of the bitmap that thins the scan for candidate documents: 8 MB


def _fetch(src: DataFrame, lines_of, refs: DataFrame) -> DataFrame:
    """(lid, at, line) of the lines that ``refs`` (lid, id, no, h1) names."""
    bit = F.pmod(F.xxhash64("id"), F.lit(BITS))
    spot = [F.shiftright(bit, 15).alias("bucket"), bit.bitwiseAND(F.lit(32767)).alias("bit")]
    maps = refs.select(*spot).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    byte = F.conv(F.hex(F.expr("substring(map, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    mask = F.call_function("shiftleft", F.lit(1), (F.col("bit") % 8).cast("int"))
    # at most BITS / 2**15 rows of 4 KB, by construction
    near = src.select("id", "text", *spot).join(F.broadcast(maps), "bucket").where(byte.bitwiseAND(mask) != 0)
    # an id may name several texts: the hash tells whose line is meant
    return lines_of(near.select("id", "text")).join(refs, ["id", "no"]).where(
        F.xxhash64("line") == F.col("h1")).select("lid", F.struct("id", "no").alias("at"), "line")


def _crowded(met: DataFrame, found: DataFrame, edits: int, block: int) -> DataFrame:
    """(lid) of the later lines of the close pairs under keys with many indexed lines."""
    crowd = met.where("kind <> 'pair'").select(F.col("a").alias("lid")).distinct()
    signed = found.join(crowd, "lid", "left_semi").withColumn("chars", F.split("line", "")).withColumn(
        "sig", signature(F.col("chars"))).drop("chars")

    def gather(kind: str, name: str) -> DataFrame:
        s = met.where(F.col("kind") == kind).select("key", F.col("a").alias("lid"))
        s = s.join(s.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
        blocks = F.ceil(F.col("n") / F.lit(float(block))).cast("int")
        s = s.withColumn("blk", F.pmod(F.xxhash64("lid"), blocks))
        s = s.join(signed, "lid")
        return s.groupBy("key", "blk").agg(
            F.collect_list(F.struct("lid", "at", "sig", "line")).alias(name)).drop("blk")

    both = gather("index", "xs").join(gather("probe", "ps"), "key")
    later = F.flatten(F.transform("ps", lambda p: F.transform(
        F.filter("xs", lambda x: (x["lid"] != p["lid"])
                 & (F.bit_count(x["sig"].bitwiseXOR(p["sig"])) <= 4 * edits)
                 & within(x["line"], p["line"], edits)),
        lambda x: F.when(x["at"] < p["at"], p["lid"]).otherwise(x["lid"]))))
    # outer: a filter that the optimizer adds otherwise would compare everything twice
    return both.select(F.explode_outer(F.array_distinct(later)).alias("lid")).where("lid is not null")
