"""Groups cut into blocks, so that no task ever holds an unbounded group.

``block_pairs`` turns (key, id) memberships into work units.  A key with at
most ``size`` members is one unit.  A larger key is dealt into hash blocks of
about ``size`` members, and every pair of blocks (i <= j) is a unit; a member
is sent to each pair its block takes part in.  Small keys are packed many to a
unit (``unit`` = hash of the key), so that a grouped Arrow function is called on
a few thousand rows instead of two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(members: DataFrame, size: int, rows_per_unit: int = 2048, group: str = "key", member: str = "id",
         weight: str | None = None, weight_per_unit: int = 8 << 20) -> DataFrame:
    """Adds ``blocks`` (those of the key), ``mine`` (the member's own) and ``unit``: a pack of small
    keys, or a block of a large one; no member is repeated.  Keys with a single member are dropped.

    A block holds about ``size`` members and, where ``weight`` names a column (bytes), about
    ``weight_per_unit`` of it.  The number of packs of small keys follows from the counted
    members, so a unit stays of one size however many there are."""
    w = F.sum(weight) if weight else F.lit(0).cast("long")
    counts = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), w.alias("_w")).where("_n > 1")
    blocks = F.ceil(F.greatest(F.col("_n") / F.lit(float(size)), F.col("_w") / F.lit(float(weight_per_unit)))).cast("int")
    counts = counts.withColumn("_b", blocks)
    total = counts.where("_b = 1").agg(F.sum("_n"), F.sum("_w")).first()
    packs = max(1, -(-int(total[0] or 0) // rows_per_unit), -(-int(total[1] or 0) // weight_per_unit))
    m = members.join(counts, group)
    m = m.withColumn("mine", F.pmod(F.xxhash64(F.lit(17), member), F.col("_b")).cast("int"))
    unit = F.when(F.col("_b") == 1, F.pmod(F.xxhash64(group), F.lit(packs))).otherwise(F.xxhash64(group, "mine"))
    return m.withColumn("unit", unit).withColumnRenamed("_b", "blocks").drop("_n", "_w")


def paired(dealt: DataFrame, group: str = "key") -> DataFrame:
    """Each row (a member, or a whole block) once per pair ``bi`` <= ``bj`` of blocks that its own takes
    part in; a large key's ``unit`` is the pair."""
    m = dealt.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumn("bi", F.least("mine", "_j")).withColumn("bj", F.greatest("mine", "_j"))
    return m.withColumn("unit", F.when(F.col("blocks") == 1, F.col("unit")).otherwise(F.xxhash64(group, "bi", "bj"))).drop("blocks", "_j")


def block_pairs(members: DataFrame, size: int, rows_per_unit: int = 2048, group: str = "key", member: str = "id",
                weight: str | None = None, weight_per_unit: int = 8 << 20) -> DataFrame:
    """Adds ``unit`` (group rows by it), ``bi``, ``bj`` (the pair of blocks) and ``mine``
    (the member's own block), see ``deal`` and ``paired``."""
    return paired(deal(members, size, rows_per_unit, group, member, weight, weight_per_unit), group)
