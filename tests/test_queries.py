"""Every registered query against its checking SQL, on the whole tables of the smallest scale."""
import os

import pytest

from tests.compare import compare, connect
from vacantia.plans import catalog, checks

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CHECKS = checks.all_checks()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_check():
    assert set(catalog.QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    assert compare(catalog.QUERIES[name](spark, SF), con, CHECKS[name]) == []


def test_flagship_count(spark):
    rows = catalog.flagship(spark, "/root/testdata/sf0.001").collect()
    assert [sum(r.location_tier == t for r in rows) for t in (1, 2, 3)] == [0, 2, 7]
