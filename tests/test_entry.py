import importlib

from tests.conftest import SF


def test_entry_and_registry(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40


#: whole model searches: several minutes each, run by tools/oracle_check.py
LONG = {"train_and_score_check", "model_search_check", "attribution_check"}


def test_queries_match_duckdb(spark):
    """Every query of the reference's operators that has SQL."""
    from tidemark.plans.catalog import ORACLE
    from tools.oracle_check import compare
    rep = compare(spark, SF, [n for n in ORACLE if n not in LONG])
    bad = {k: v for k, v in rep.items() if not v.get("ok")}
    assert not bad, bad


def test_local_check_tells_nan_from_null():
    from tools.oracle_check import rows
    assert rows([(float("nan"),)], ["a"]) != rows([(None,)], ["a"])
    assert rows([(1, 2.0)], ["b", "a"]) == rows([(2, 1)], ["a", "b"])


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    import pytest

    from tidemark.session import checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())
