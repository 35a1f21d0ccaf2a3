"""Every registered query against its SQL counterpart in DuckDB."""

import os

import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("FLEETLENS_SF_DIR", "/root/testdata/sf0.001")

pytest.importorskip("duckdb")
compare = pytest.importorskip("compare")

if not os.path.isdir(SF_DIR):
    pytest.skip("no driver tables", allow_module_level=True)


@pytest.fixture(scope="module")
def oracle():
    return compare.oracle_connection(SF_DIR)


def test_every_query_has_a_counterpart():
    own = {n for n in entry.queries() if n not in entry.LLM_QUERIES}
    assert own == {n for n in entry.oracle_sql() if n not in entry.LLM_QUERIES}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, oracle, name):
    _, difference = compare.compare(spark, oracle, name, SF_DIR)
    assert difference is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "socket" in df.columns
