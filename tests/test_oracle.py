"""Every query with SQL gives the rows DuckDB gives."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from scripts.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, name):
    got = queries()[name](spark, SF).toPandas()
    want = connect(SF).sql(oracle_sql()[name]).df()
    assert compare(got, want) == ""
    assert len(got) > 0


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "shopping_mission" in df.columns


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
