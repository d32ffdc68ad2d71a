"""Every query that has SQL gives the rows that DuckDB gives; all others run."""

import pytest

from tessella.plans.catalogue import ORACLE, QUERIES

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, duck, name):
    compare(spark, SF, QUERIES[name], ORACLE[name], duck)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.collect()) >= 0 and len(set(df.columns)) == len(df.columns)
