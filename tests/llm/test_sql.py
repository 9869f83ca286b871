"""Operators' queries against SQL, on the smallest tables."""

import pytest
from compare import connect, difference, type_gaps

from profitloom.llm.catalog import llm_queries
from profitloom.llm.sql import llm_sql

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_query_equals_sql(spark, duck, name):
    df = llm_queries()[name](spark, SF_DIR)
    assert difference(df, duck, llm_sql()[name]) is None
    assert not type_gaps(df, duck, llm_sql()[name])


def test_all_are_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert {n.split("_")[0] for n in llm_queries()} == {f"op{i}" for i in range(1, 14)}
    assert set(llm_queries()) <= set(names) and "pipeline" in __spark_entry__.queries()
