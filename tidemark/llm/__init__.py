"""Operators for large training-data corpora.

Each module holds one operator with a general interface; ``queries`` holds the
thin registered queries ``opN_<name>`` and their DuckDB SQL.  Nothing else in
the library imports this subpackage.
"""
