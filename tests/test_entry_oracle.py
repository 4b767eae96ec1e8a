"""Driver contract: entry(), and every registered query against its DuckDB
oracle (row count, column names, order-insensitive value hash) at sf0.001."""

import importlib.util
import os

import pytest

from conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry(spark):
    df = _entry_module().entry(spark)
    assert df.columns == ["column", "position", "inferred_type", "n_rows", "n_non_null", "n_distinct",
                          "n_numeric"]
    assert df.count() == 11


def test_every_oracle_has_a_query():
    mod = _entry_module()
    assert set(mod.oracle_sql()) <= set(mod.queries())


@pytest.fixture(scope="module")
def duck_con():
    from colsense.plans.verify import duck
    return duck(SF_SMALL)


def _names():
    from colsense.plans.catalog import QUERIES
    return sorted(QUERIES)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck_con, name):
    from colsense.plans.verify import compare
    r = compare(spark, name, SF_SMALL, duck_con)
    if r.get("oracle") is None and "oracle_rows" not in r:
        assert r["spark_rows"] >= 0
        return
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["hash_match"], r
