"""Scalar Column helpers: ratios, day counts, JSON fields, cut labels."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


_INF = float("inf")


def ratio(num: Column | str, den: Column | str) -> Column:
    """Float-division ratio with IEEE results: x/0 = +-inf, 0/0 = NaN, NULL in -> NULL.

    Plain ``/`` raises under ANSI mode, ``try_divide`` gives NULL; this keeps the
    float64 semantics the model matrix later maps to 0 (see ``finite_or_zero``)."""
    n = _c(num).cast("double")
    d = _c(den).cast("double")
    return (F.when(n.isNull() | d.isNull(), F.lit(None).cast("double"))
            .when(d != 0, n / d)
            .when(n == 0, F.lit(float("nan")))
            .when(n > 0, F.lit(_INF))
            .when(n < 0, F.lit(-_INF))
            .otherwise(F.lit(float("nan"))))


def normalised_ratio(num: Column | str, num_units: float, den: Column | str,
                     den_units: float) -> Column:
    """``(num / num_units) / (den / den_units)`` with ``ratio`` semantics (R2)."""
    return ratio(_c(num).cast("double") / F.lit(float(num_units)),
                 _c(den).cast("double") / F.lit(float(den_units)))


def day_diff(later: Column | str, earlier: Column | str) -> Column:
    """Whole days between two dates/timestamps, counted on calendar dates."""
    return F.datediff(F.to_date(_c(later)), F.to_date(_c(earlier)))


def finite_or_zero(col: Column | str) -> Column:
    """+-inf and NaN -> NULL -> 0 (the model-matrix cleaning step, F13)."""
    c = _c(col).cast("double")
    return (F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(_INF)), F.lit(0.0))
            .otherwise(c))


def ordinal_map(col: Column | str, mapping: dict) -> Column:
    """Dictionary lookup; unmapped values -> NULL."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)[_c(col)]


def split_part(col: Column | str, delim: str, index_1based: int) -> Column:
    """``SPLIT_PART(s, delim, n)``: empty string when the part is absent."""
    return F.split_part(_c(col), F.lit(delim), F.lit(index_1based))


def select_first(conditions: Sequence[Column], choices: Sequence, default=None) -> Column:
    """First matching condition wins (``np.select``); no match -> ``default``."""
    out = None
    for cond, choice in zip(conditions, choices):
        out = F.when(cond, F.lit(choice)) if out is None else out.when(cond, F.lit(choice))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def json_fields(df: DataFrame, col: str, fields: dict[str, tuple[str, str]],
                drop_source: bool = False) -> DataFrame:
    """Extract nested JSON paths with ONE parse per row.

    ``fields`` maps output name -> (dotted path, Spark type).  Leaves are parsed as
    text and then cast, so numbers stored as JSON strings cast too (like ``::float``)."""
    tree: dict = {}
    for _, (path, _) in fields.items():
        node = tree
        parts = path.split(".")
        for p in parts[:-1]:
            node = node.setdefault(p, {})
            if not isinstance(node, dict):
                raise ValueError(f"path {path} conflicts with a leaf")
        node.setdefault(parts[-1], None)

    def to_struct(node: dict) -> T.StructType:
        return T.StructType([
            T.StructField(k, T.StringType() if v is None else to_struct(v), True)
            for k, v in node.items()])

    tmp = f"__json_{col}"
    out = df.withColumn(tmp, F.from_json(F.col(col), to_struct(tree)))
    out = out.select("*", *[F.col(f"{tmp}.{path}").try_cast(typ).alias(name)
                            for name, (path, typ) in fields.items()]).drop(tmp)
    return out.drop(col) if drop_source else out


def round_doubles(df: DataFrame, digits: int, columns: Iterable[str] | None = None) -> DataFrame:
    cols = set(columns) if columns is not None else {
        f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def percent_text(col: Column | str, digits: int = 2) -> Column:
    """A share as percent text, ``0.1234`` -> ``12.34%`` (F17); NULL stays NULL."""
    c = _c(col).cast("double")
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f%%", c * 100))


def replace_value(df: DataFrame, col: str, old, new) -> DataFrame:
    """Replace one value in a column (F14).  As in the source, a numeric ``old`` never
    matches a text column (no implicit cast), so the call is then a no-op."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.StringType) != isinstance(old, str):
        return df
    return df.withColumn(col, F.when(F.col(col) == F.lit(old), F.lit(new)).otherwise(F.col(col)))
