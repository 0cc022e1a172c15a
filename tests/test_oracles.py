"""Every registered query that has SQL agrees with it on whole tables."""

import pytest

import checks
from tests.conftest import SMALL
from tests.oracle import compare, connect

checks.load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(checks.ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(checks.QUERIES[name](spark, SMALL), con, checks.ORACLES[name]) == []


def test_names_are_shared():
    assert set(checks.ORACLES) <= set(checks.QUERIES)
