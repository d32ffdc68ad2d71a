"""Corpus queries that have SQL give the rows that DuckDB gives."""

import pytest

from tessella.llm.queries import ORACLE, QUERIES

from ..oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    compare(spark, SF, QUERIES[name], ORACLE[name], connect(SF))


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
