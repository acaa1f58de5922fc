"""The queries that SQL can express, against their statements on the small tables."""

import os

import pytest

from tallyglass.llm import queries as llm
from tests.parity import connect, difference, type_difference

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query(spark, duck, name):
    result = llm.queries()[name](spark, SF_DIR)
    relation = duck.sql(llm.oracle_sql()[name])
    assert type_difference(result.dtypes, relation) is None
    assert difference(result.toPandas(), relation.df()) is None
