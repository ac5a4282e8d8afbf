"""Every corpus query against its SQL on the smallest tables."""

from collections import Counter

import pytest
from motionlake.plans.queries import QUERIES, SQL

from tests.oracle import connect, same

@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, sf_dir, duck):
    same(QUERIES[name](spark, sf_dir), SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_is_the_same_again(name, spark, sf_dir):
    once, again = (Counter(map(str, QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert once and once == again
