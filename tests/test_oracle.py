"""Every SQL-checkable query against its DuckDB oracle on sf0.001."""

import pytest

from conftest import SF_SMALL
from oracle_compare import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def _names():
    from __spark_entry__ import oracle_sql
    return list(oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    r = compare(spark, con, SF_SMALL, name, queries()[name], oracle_sql()[name])
    assert r["rows_spark"] == r["rows_duck"], r
    assert r["cols_match"] and r["types_match"], r
    assert r["hash_match"], r
