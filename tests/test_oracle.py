"""Every query against its SQL counterpart on the smallest tables."""

import __spark_entry__ as entry_point
import pytest
from compare import connect, difference, type_gaps

from oracle.sql import all_sql
from profitloom.catalog import all_queries

SF_DIR = "/root/testdata/sf0.001"
QUERIES = all_queries()
SQL = all_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_point.queries()) and set(SQL) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    assert difference(df, duck, SQL[name]) is None
    assert not type_gaps(df, duck, SQL[name])


def test_entry_is_weekly_profit(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["week", "revenue_excl_mva", "total_cost", "profit"]
    assert df.count() == 328
