"""Every registered query against its DuckDB statement on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tallyglass import registry
from tests.parity import connect, difference, type_difference

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_a_statement():
    assert set(registry.queries()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    result = entry.queries()[name](spark, SF_DIR)
    relation = duck.sql(entry.oracle_sql()[name])
    assert type_difference(result.dtypes, relation) is None
    assert difference(result.toPandas(), relation.df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
