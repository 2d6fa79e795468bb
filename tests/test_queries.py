"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from rows import counted
from siltstone.plans import catalogue, mechanisms, records, service  # noqa: F401  the others add their queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert counted(ours) == counted(theirs)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "call_id"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
