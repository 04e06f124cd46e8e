"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n in entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, DIR, entry.queries()[name], entry.oracle_sql()[name], duck(DIR)) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_of_sql_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
