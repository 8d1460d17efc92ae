"""Readers, column hygiene and sinks."""

from tidemark.sources.tables import copy_column, keep_columns, lower_columns, read_table
from tidemark.sources.files import read_csv
from tidemark.sources.sinks import append_once, append_table, overwrite_partitions, read_committed, write_attempt

__all__ = [
    "read_table", "lower_columns", "copy_column", "keep_columns",
    "read_csv", "append_table", "overwrite_partitions", "append_once", "read_committed", "write_attempt",
]
