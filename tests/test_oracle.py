"""Every named query against its SQL in DuckDB, over all columns and values."""

import os

import pytest

from check_oracle import compare, connect
from plylake.plans.catalog import QUERIES
from plylake.plans.oracle import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_names_match():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    problem = compare(spark, duck, SF_DIR, QUERIES[name], ORACLES[name])
    if problem == "both empty":
        pytest.skip("no rows at this scale")
    assert problem is None
