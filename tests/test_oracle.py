import importlib

import pytest
from oracle import DATA, from_spark, from_sql

import __spark_entry__ as entry

CORE = [importlib.import_module(m) for m in entry.MODULES]
SQL = {k: v for m in CORE for k, v in m.SQL.items()}
QUERIES = {k: v for m in CORE for k, v in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert from_spark(QUERIES[name](spark, DATA)) == from_sql(SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
