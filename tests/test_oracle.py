"""Every registered query against its DuckDB oracle on the smoke tables
(row count, column names, values); queries without an oracle must run."""

import pytest

from conftest import SMOKE
from tools.oracle_compare import compare, duck
from jobsift.plans.catalog import oracle_sql, queries

QUERIES = queries()
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, SMOKE, name, QUERIES[name], ORACLES.get(name))
    assert res["status"] in ("match", "no-oracle"), res
    assert "types" not in res, res  # column types agree too


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
