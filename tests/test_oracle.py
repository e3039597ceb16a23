"""Every query with SQL, against DuckDB over the smallest tables."""

import pytest
import stipule.cases  # noqa: F401
from oracle import connect, difference
from stipule.queries import QUERIES, SQL, flagship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql(spark):
    assert QUERIES.keys() == SQL.keys() and flagship(spark, SF).columns == ["c_custkey", "path", "code"]


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert con.execute(f"SELECT count(*) FROM ({SQL[name]})").fetchone()[0] > 0
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) == ""


def test_entry_imports_and_lists():
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
