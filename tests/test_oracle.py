"""Every registered query against its checking SQL, on the smallest tables."""

import pytest

from tests.compare import connect, difference
from siftline.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert sorted(set(QUERIES) - set(ORACLES)) == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None
