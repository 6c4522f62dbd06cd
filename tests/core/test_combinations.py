import itertools

import pytest
from pyspark.sql import functions as F

from donorframe.functions.combinations import binomial, k_subsets, k_subsets_with_sum


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_subsets_equal_itertools(spark, k):
    groups = [(n, [(i, i % 3 - 1) for i in range(n)]) for n in (0, 1, 2, 5, 9)]
    df = spark.createDataFrame(groups, "g int, listed array<struct<i: int, change: int>>")
    want = sorted((n, r, list(c)) for n, rows in groups for r, c in enumerate(itertools.combinations(range(n), k)))
    told = k_subsets(df, "listed", k, block=4)
    assert sorted((r.g, r.rank, [x.i for x in r.listed]) for r in told.collect()) == want
    assert sorted((r.g, r.rank, list(r.places)) for r in told.collect()) == want
    some = sorted((r.g, r.rank) for r in k_subsets_with_sum(df, "listed", k, "change", 0).collect())
    assert some == [(n, r) for n, r, c in want if sum(i % 3 - 1 for i in c) == 0]
    assert k_subsets(df.where(F.lit(False)), "listed", k).count() == 0


def test_a_group_of_many_subsets_is_dealt_to_many_tasks(spark):
    df = spark.createDataFrame([(1, list(range(24)))], "g int, listed array<int>")
    told = k_subsets(df, "listed", 4, block=500).withColumn("task", F.spark_partition_id())
    assert told.count() == 10_626 and told.select("task").distinct().count() > 1
    assert spark.range(1).select(binomial(F.lit(60), F.lit(30)).alias("n")).first().n == 118264581564861424
