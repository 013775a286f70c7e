"""Queries of the ten operators that SQL can express, against DuckDB."""

import pytest

from docweft.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, small, duck, compare, name):
    compare(queries.QUERIES[name](spark, small).toPandas(), duck.execute(queries.ORACLE[name]).fetchdf())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
