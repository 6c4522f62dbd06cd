import pytest

from donorframe.queries import QUERIES, SQL

from .oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], FOLDER)


@pytest.mark.parametrize("name", ["cluster_general", "match_search_0_0_0", "match_search_1_1_2"])
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
