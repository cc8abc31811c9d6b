"""Every query with SQL gives the rows of that SQL; every other one runs."""

import pytest

import oracle
from clarion.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connection(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    columns, got = oracle.of_spark(catalog.queries()[name](spark, sf_dir))
    names, want = oracle.of_sql(duck, SQL[name])
    assert columns == names
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want) if a != b][:3] == []


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, sf_dir, name):
    n = catalog.queries()[name](spark, sf_dir).count()
    assert n > 0
