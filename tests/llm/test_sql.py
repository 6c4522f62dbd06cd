import pytest

from donorframe.llm import queries as q

from .oracle import compare


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_equals_sql(spark, name):
    assert compare(spark, q.queries()[name], q.oracle_sql()[name], "/root/testdata/sf0.001") > 0
