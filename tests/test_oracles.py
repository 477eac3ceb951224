"""Every registered query against its SQL oracle on the smallest driver tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_module

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_oracle_belongs_to_a_query():
    assert SQL.keys() <= QUERIES.keys()


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "invocation_id"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert differences(df, con, SQL[name]) == []
    else:
        assert df.count() > 0
