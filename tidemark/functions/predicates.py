"""Predicate and flag builders.

All return Columns, so they stay inside whole-stage codegen and simple
equality/IN predicates reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ilike_any(col: Column | str, patterns: Iterable[str]) -> Column:
    """``col ILIKE ANY (p1, p2, ...)`` as an OR of ``ilike``.

    SQL LIKE wildcards keep their meaning: ``%`` any run, ``_`` one character
    (so ``'%new_device%'`` also matches ``'new-device'``).  NULL input -> NULL."""
    c = _c(col)
    pats = list(patterns)
    if not pats:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [c.ilike(p) for p in pats])


def ilike_none(col: Column | str, patterns: Iterable[str]) -> Column:
    """``NOT (col ILIKE ANY (...))``; NULL input stays NULL, so the row fails a filter."""
    return ~ilike_any(col, patterns)


def not_deleted(flag: Column | str) -> Column:
    """Soft-delete filter: ``flag IS NULL OR flag = false``."""
    return ~F.coalesce(_c(flag), F.lit(False))


def as_flag(cond: Column) -> Column:
    """``CASE WHEN cond THEN 1 ELSE 0 END``: NULL conditions map to 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def threshold_flag(col: Column | str, threshold: float) -> Column:
    return as_flag(_c(col) > F.lit(threshold))


def contains_flags(text: Column | str, names: Iterable[str] | dict[str, str],
                   prefix: str = "is_") -> list[Column]:
    """One 0/1 column per signal: ``text ILIKE '%signal%'``.

    ``names`` is a list of signals (column ``{prefix}{signal}``, lower-cased,
    spaces -> ``_``) or a dict {output column: signal}."""
    c = _c(text)
    pairs = (list(names.items()) if isinstance(names, dict)
             else [(f"{prefix}{n.lower().replace(' ', '_')}", n) for n in names])
    return [as_flag(c.ilike(f"%{sig}%")).alias(out) for out, sig in pairs]


def branch_marker(name: str, value) -> Column:
    """Constant column marking the branch of a union."""
    return F.lit(value).alias(name)
