import pytest

from oddrows.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SMALL
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name]) == []
