import duckdb
import pytest

from caudal.llm import queries
from compare import canonical, open_tables


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, folder, name):
    con = duckdb.connect()
    open_tables(con, folder)
    got, want = queries.QUERIES[name](spark, folder).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, folder, name):
    assert queries.QUERIES[name](spark, folder).count() >= 0
