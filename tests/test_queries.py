"""Every core query beside its SQL on the smallest tables."""

import duckdb
import pytest

from caudal.plans import core_problems, network
from compare import canonical, open_tables

QUERIES, SQL = core_problems.QUERIES | network.QUERIES, core_problems.SQL | network.SQL


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    open_tables(c, folder)
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, folder, name):
    got, want = QUERIES[name](spark, folder).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_the_core_does_not_need_llm():
    from pathlib import Path

    import caudal

    for p in Path(caudal.__file__).parent.rglob("*.py"):
        assert p.parent.name == "llm" or "llm" not in p.read_text()
