"""Every registered query against its SQL counterpart, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import DATA, compare, connect

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    assert compare(spark, duck, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 4


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
