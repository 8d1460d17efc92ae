"""The registered queries on the smallest tables, with DuckDB where SQL can say it."""

import importlib

import pytest

from tests.conftest import SF


def test_one_query_per_operator():
    q = importlib.import_module("__spark_entry__").queries()
    assert [sum(k.startswith(f"op{n}_") for k in q) for n in range(1, 14)] == [1] * 13 and "pipeline" in q


@pytest.mark.parametrize("name", ["op4_mix_sources", "op10_line_dedup", "op11_hard_negatives", "op12_source_audit"])
def test_matches_duckdb(spark, name):
    from tools.oracle_check import compare
    report = compare(spark, SF, [name])[name]
    assert report["ok"], report


def test_contract_columns(spark):
    q = importlib.import_module("__spark_entry__").queries()
    want = {
        "op2_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
        "op4_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op5_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op6_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint",
                              "items_sha256": "string", "contaminated": "boolean"},
        "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op8_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
        "op9_embedding_near_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
        "op11_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
                                "positive_score": "bigint", "negative_score": "bigint"},
        "op12_source_audit": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
        "op13_piece_round_trip": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    }
    for name, types in want.items():
        df = q[name](spark, SF)
        assert dict(df.dtypes) == types, name
