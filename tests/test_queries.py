"""Every registered query against its SQL, on the smallest tables."""

import pytest

from compare import connect, spark_rows, sql_rows
from quire import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    assert spark_rows(registry.queries()[name](spark, SF)) == sql_rows(con, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.count() >= 0
    assert len(set(df.columns)) == len(df.columns)
