"""Every query that SQL can express, against DuckDB over the same whole tables."""

import pytest

from docweft.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, duck, compare, name):
    got = catalogue.QUERIES[name](spark, small).toPandas()
    if name in catalogue.ORACLE:
        compare(got, duck.execute(catalogue.ORACLE[name]).fetchdf())
    assert len(got.columns)
