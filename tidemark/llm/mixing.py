"""Mixing sources to target weights: hash-random order, prefix sums, exact cuts.

All steps are DataFrame functions:

1. The size of a document is its number of words.  Sources are ranked by code
   point, NULL last, and take the weights in turn.
2. Targets are filled like water: target = min(cap, level * weight) with
   cap = ``max_repeats`` * source size, and the level such that the targets add
   up to the total.  With the sources sorted by cap / weight, the capped ones are
   a prefix, so the level follows from one pair of running sums over the table
   of sources; no loop over rounds of resharing is needed and the result is the
   same.
3. Documents get a hash-random key, are range-sorted by (source, key) and take
   distributed prefix sums of their sizes (per-partition totals plus offsets),
   so a source that holds a third of all rows is spread over many partitions.
4. Each source takes whole epochs of all its documents, then the documents of
   the random order up to the exact budget; the document at the cut gives its
   leading words.  The key is a function of the id and the seed, so reruns agree.

The table of sources (one row each) is ordered by the same distributed prefix
sums and meets the documents in an equi join; neither side is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import global_cumsum
from tidemark.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words (maximal runs of other characters than \\x20, \\x09-\\x0D); NULL: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1),
                   max_repeats: int = 3) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target); one row per source."""
    k = len(weights)
    s = sizes.withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_one", F.lit(1))
    s = global_cumsum(s, ["_null", "source"], ["_one"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod(F.col("cum__one") - 1, F.lit(k)) + 1).cast("int"))
    s = (s.withColumn("weight", weight.cast("long"))
          .withColumn("_cap", F.col("source_size") * max_repeats))
    s = s.withColumn("_at", F.col("_cap") / F.col("weight"))           # level that fills this source
    s = s.withColumn("_rank", F.col("cum__one"))
    s = global_cumsum(s, ["_at", "_rank"], ["_cap", "weight"], prefix="up_to_")
    total = s.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    # level if exactly the sources before this one are capped; the first row whose
    # own fill level is not below it ends the capped prefix
    t = s.withColumns({"_all": total.select("all_size").scalar(),
                       "_w": total.select("all_weight").scalar()})
    t = t.withColumn("_level", (F.col("_all") - (F.col("up_to__cap") - F.col("_cap")))
                     / (F.col("_w") - (F.col("up_to_weight") - F.col("weight"))))
    free = t.where(F.col("_at") >= F.col("_level"))
    level = free.agg(F.min_by("_level", F.struct("_at", "_rank")).alias("level")).select("level").scalar()
    t = t.withColumn("_l", level)
    target = F.when(F.col("_at") < F.col("_l"), F.col("_cap").cast("double")).otherwise(
        F.col("_l") * F.col("weight"))
    return t.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3,
                seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """One row per document: (id, source, size, source_size, target, taken, epochs, cut).

    ``taken``: words the mix takes, repeats counted; ``epochs``: whole repeats;
    ``cut``: leading words of one more repeat that is cut by the budget (0 if none
    or if the whole text was taken once more, which counts as an epoch).

    NULL texts and texts without words have size 0 and take 0.  NULL is a source
    of its own, last in order.  Equal keys of repeated ids fall back to the size,
    and rows equal in both are interchangeable.  An empty table gives an empty one.
    Extra columns are not read.
    """
    d = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"),
                    word_count(F.col(text_col)).alias("size"))
    d = d.withColumn("_key", F.md5(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")),
                                            F.lit(":" + seed)).cast("binary")))
    d = cut_lineage(d)                                    # the texts are read once
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, weights, max_repeats))
    # repeated (key, id, size) rows are numbered apart so that prefix sums stay exact
    u = d.groupBy("source", "_key", "_id", "size").agg(F.count(F.lit(1)).alias("_copies"))
    u = u.withColumn("_mass", F.col("size") * F.col("_copies"))
    c = global_cumsum(u, ["_key", "size", "_id"], ["_mass"], ["source"])
    c = (c.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
          .withColumn("_before", F.col("cum__mass") - F.col("_mass") + F.col("size") * (F.col("_nth") - 1)))
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    m = c.join(t, c["source"].eqNullSafe(t["_s"]))
    budget = F.round("target").cast("long")
    m = m.withColumn("_full", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")))
                     .otherwise(F.lit(0)).cast("long"))
    m = m.withColumn("_rest", budget - F.col("_full") * F.col("source_size"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_rest") - F.col("_before")))
    m = m.withColumn("_part", part)
    whole = (F.col("_part") == F.col("size")) & (F.col("size") > 0)
    return m.select(
        F.col("_id").alias(id_col), F.col("source"), "size", "source_size", "target",
        (F.col("_full") * F.col("size") + F.col("_part")).alias("taken"),
        (F.col("_full") + whole.cast("long")).alias("epochs"),
        F.when(whole, F.lit(0).cast("long")).otherwise(F.col("_part")).alias("cut"))
