"""Every query that has SQL gives the SQL's rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connection, differs

SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith(("op", "pipeline"))} | {k: v for k, v in entry.oracle_sql().items() if k.startswith("pipeline_")}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, con, name):
    assert differs(entry.queries()[name](spark, sf_dir), con, SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["validation_status", "reason", "n"]
