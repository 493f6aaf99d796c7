import pytest
from oracle import DATA, from_spark, from_sql

from yakinma.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert from_spark(QUERIES[name](spark, DATA)) == from_sql(SQL[name])
