import pytest

from __spark_entry__ import entry
from table_queries import QUERIES, SQL
from tests.compare import differences, sql_connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return sql_connection(SF_DIR)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], SQL[name], SF_DIR) == []


def test_entry(spark):
    assert entry(spark).count() > 0
