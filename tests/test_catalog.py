import pytest

from siltstone.plans.catalog import ORACLE, QUERIES
from tests.oracle import expect_same

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    expect_same(QUERIES[name](spark, DIR), ORACLE[name], DIR)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
