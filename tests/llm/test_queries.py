import pytest

import oracle
from clarion.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    columns, got = oracle.of_spark(queries.queries()[name](spark, sf_dir))
    names, want = oracle.of_sql(oracle.connection(sf_dir), queries.oracle_sql()[name])
    assert columns == names and got == want


def test_all_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]
