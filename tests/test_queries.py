"""Every registered query equals its SQL on a second engine."""

import pytest
from compare import compare, oracle

import __spark_entry__ as entry
from tidemark.plans import queries as registered

SF = "/root/testdata/sf0.001"
# Three streams of this size write thousands of small hourly folders; one of them is enough here.
SLOW = {"src_archive", "stream_reject_split"}


@pytest.fixture(scope="module")
def duck():
    return oracle(SF)


def test_every_query_has_its_sql():
    assert set(registered.all_queries()) <= set(entry.queries()) & set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(registered.all_queries()) - SLOW))
def test_query_equals_sql(spark, duck, name):
    assert compare(duck, entry.queries()[name](spark, SF), entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["level", "event", "count"]
