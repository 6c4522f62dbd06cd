"""Subsets of k rows, each found from its number alone.

The subsets of k of n rows are numbered in the order of their rows (combinatorial number system). A subset is unranked from its
number, so the subsets of one group need no list of them and can be dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Subsets that one row stands for before they are dealt out.
BLOCK = 10_000


def binomial(n: Column, k: Column) -> Column:
    """Subsets of k of n rows; 0 where there are none. What exceeds a long is an error, not a wrong number."""
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), F.lit(1).cast("long"), lambda acc, j: F.call_function("div", acc * (n - k + j), j.cast("long")))
    return F.when((k < 0) | (k > n), 0).when(k == 0, 1).otherwise(product).cast("long")


def unrank(n: Column, k: int, rank: Column) -> Column:
    """The places (from 0, ascending) of the subset of that number."""
    kind = "struct<left: int, rank: bigint, places: array<int>>"

    def step(acc: Column, i: Column) -> Column:
        here = binomial(n - i - 1, acc["left"] - 1)
        taken = F.struct((acc["left"] - 1).alias("left"), acc["rank"].alias("rank"), F.concat(acc["places"], F.array(i)).alias("places"))
        passed = F.struct(acc["left"].alias("left"), (acc["rank"] - here).alias("rank"), acc["places"].alias("places"))
        return F.when(acc["left"] == 0, acc).when(acc["rank"] < here, taken.cast(kind)).otherwise(passed.cast(kind))

    zero = F.struct(F.lit(k).alias("left"), rank.cast("long").alias("rank"), F.array().cast("array<int>").alias("places")).cast(kind)
    return F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda acc: acc["places"])


def k_subsets(groups: DataFrame, listed: str, k: int, block: int = BLOCK) -> DataFrame:
    """One row per subset of k of a group's rows (an array column, in order): the group's other columns, rank, places and the
    subset itself in place of the array. Groups with fewer rows have none; k is at least 1."""
    size = F.size(listed)
    total = binomial(size, F.lit(k))
    some = groups.where(size >= k)
    blocks = some.select("*", total.alias("_total"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / block))).alias("_block"))
    # a group of many subsets is dealt out by its blocks; a fixed number, as blocks are few bytes and much work
    dealt = blocks.repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(listed), "_block")
    ranks = dealt.select(*groups.columns, F.explode(F.sequence(F.col("_block") * block, F.least((F.col("_block") + 1) * block, F.col("_total")) - 1)).alias("rank"))
    return ranks.withColumn("places", unrank(size, k, F.col("rank"))).withColumn(listed, F.transform("places", lambda i: F.get(listed, i)))


def k_subsets_with_sum(groups: DataFrame, listed: str, k: int, change: str, target: int) -> DataFrame:
    """The subsets of k rows whose field `change` adds up to the target."""
    total = F.aggregate(listed, F.lit(0).cast("long"), lambda acc, r: acc + r[change])
    return k_subsets(groups, listed, k).where(total == target)
