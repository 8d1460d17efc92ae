"""Column-level helpers."""

from tidemark.functions.predicates import (
    as_flag, branch_marker, contains_flags, ilike_any, ilike_none, not_deleted, threshold_flag)
from tidemark.functions.scalars import (
    day_diff, finite_or_zero, json_fields, normalised_ratio, ordinal_map, percent_text, ratio,
    replace_value, round_doubles, select_first, split_part)

__all__ = [
    "as_flag", "branch_marker", "contains_flags", "ilike_any", "ilike_none", "not_deleted",
    "threshold_flag", "day_diff", "finite_or_zero", "json_fields", "normalised_ratio",
    "ordinal_map", "percent_text", "ratio", "replace_value", "round_doubles", "select_first", "split_part",
]
