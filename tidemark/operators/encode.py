"""Encodings and the model matrix."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import finite_or_zero, ordinal_map
from tidemark.operators.ranking import dense_codes


def ordinal_encode(df: DataFrame, col: str, mapping: dict, out: str) -> DataFrame:
    """Given-order codes; unmapped values -> NULL."""
    return df.withColumn(out, ordinal_map(col, mapping))


def label_encode(df: DataFrame, col: str, out: str) -> tuple[DataFrame, DataFrame]:
    """0..k-1 codes in sorted value order (R12).  Returns (encoded frame, mapping).

    The mapping (one row per distinct value) is the inverse table; it is joined
    back on the value, so AQE broadcasts it only when its measured size allows."""
    mapping = dense_codes(df, col, out)
    return df.join(mapping, col, "left"), mapping


def model_matrix(df: DataFrame, label: str, drop: Sequence[str] = (),
                 keep: Sequence[str] = ()) -> DataFrame:
    """Numeric feature columns with +-inf/NaN/NULL -> 0, an int label, plus ``keep``
    columns (row ids) untouched (R13).  Names in ``drop`` that do not exist are ignored."""
    dropped = set(drop) | {label} | set(keep)
    feats = [f.name for f in df.schema.fields
             if f.name not in dropped and isinstance(f.dataType, T.NumericType)]
    return df.select(*keep, *[finite_or_zero(c).alias(c) for c in feats],
                     F.col(label).cast("int").alias(label))
