"""Subsets of a cluster's rows and the donors they spell (one strand).

A cluster of n rows of a side has 2 ** n - 1 subsets; those whose rows overlap are left out, the others are applied to the
cluster's window. Two subsets that spell the same donor are equivalent: of two sides, that is a match; of one side, the set
says the same thing twice. Clusters of more than `most` rows of a side are not enumerated; divisive clustering
(clustering.split_clusters) makes them smaller first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import apply_variants
from ..sources.readers import genome_windows

MOST = 12


def picks(rows: Column, mask: Column) -> Column:
    """The rows whose bit is set."""
    return F.filter(rows, lambda r, i: F.getbit(mask, i) == 1)


def disjoint(rows: Column) -> Column:
    """Whether no row of an array sorted by position begins before the one before it ends."""
    return F.forall(F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1))), lambda i: F.coalesce(F.get(rows, i)["pos"] >= F.get(rows, i - 1)["pos"] + F.length(F.get(rows, i - 1)["ref"]), F.lit(True)))


def subset_donors(clustered: DataFrame, genome: DataFrame, most: int = MOST) -> DataFrame:
    """cluster_id, side, mask, rows (the subset: pos, ref, alt, row_id), donor; rows count with their first alt."""
    one = F.struct("pos", "ref", F.get("alts", F.lit(0)).alias("alt"), "row_id")
    by_side = clustered.groupBy("cluster_id", "chrom", "side").agg(F.array_sort(F.collect_list(one)).alias("listed"))
    # both sides of a cluster are spelled over one window
    span = clustered.groupBy("cluster_id").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.length("ref")).alias("end"))
    held = genome_windows(genome, by_side.where(F.size("listed") <= most).join(span, "cluster_id"))
    masks = held.select("*", F.expr("explode(sequence(1L, shiftleft(1L, size(listed)) - 1))").alias("mask"))
    subsets = masks.withColumn("rows", picks(F.col("listed"), F.col("mask"))).where(disjoint(F.col("rows")))
    edits = F.transform("rows", lambda r: F.struct((r["pos"] - F.col("start")).alias("pos"), r["ref"].alias("ref"), r["alt"].alias("alt")))
    return subsets.select("cluster_id", "side", "mask", "rows", apply_variants(F.col("seq"), edits).alias("donor"))


def equal_donors(donors: DataFrame) -> DataFrame:
    """Pairs of a baseline and a query subset of one cluster that spell the same donor: cluster_id, b_rows, q_rows, n."""
    b = donors.where("side = 'baseline'").select("cluster_id", "donor", F.col("rows").alias("b_rows"))
    q = donors.where("side = 'query'").select("cluster_id", "donor", F.col("rows").alias("q_rows"))
    return b.join(q, ["cluster_id", "donor"]).select("cluster_id", "b_rows", "q_rows", (F.size("b_rows") + F.size("q_rows")).alias("n"))


def best_equal(donors: DataFrame) -> DataFrame:
    """The pair of each cluster with the most rows (the first by rows on ties)."""
    order = F.struct(F.col("n"), F.struct("b_rows", "q_rows"))
    return equal_donors(donors).groupBy("cluster_id").agg(F.max(order).alias("x")).select("cluster_id", F.col("x.col2.b_rows").alias("b_rows"), F.col("x.col2.q_rows").alias("q_rows"), F.col("x.n").alias("n"))


def in_any_equal(donors: DataFrame) -> DataFrame:
    """Rows that take part in any equal pair of subsets, whatever conflicts: cluster_id, side, row_id."""
    pairs = equal_donors(donors)
    named = lambda c, side: pairs.select("cluster_id", F.lit(side).alias("side"), F.explode(f"{c}.row_id").alias("row_id"))
    return named("b_rows", "baseline").unionByName(named("q_rows", "query")).distinct()


def duplicates_within(clustered: DataFrame, genome: DataFrame, most: int = MOST) -> DataFrame:
    """Subsets of one side of a cluster that say the same: cluster_id, side, round, first and second (row ids).

    Rounds: of all pairs of subsets without a common row that spell one donor, the one of fewest rows is reported and its
    rows go; and so on until no pair is left."""
    donors = subset_donors(clustered, genome, most)
    # only donors that are spelled twice can make a pair
    twice = donors.groupBy("cluster_id", "side", "donor").agg(F.collect_list(F.struct(F.size("rows").alias("n"), "mask", F.col("rows.row_id").alias("ids"))).alias("same")).where(F.size("same") > 1)

    def rounds(frame: pd.DataFrame) -> pd.DataFrame:
        pairs = []
        for same in frame["same"]:
            same = sorted(((int(x["n"]), int(x["mask"]), [int(i) for i in x["ids"]]) for x in same), key=lambda x: x[:2])
            pairs += [(a[0] + b[0], a[1], b[1], a[2], b[2]) for k, a in enumerate(same) for b in same[k + 1 :] if not a[1] & b[1]]
        gone, out = 0, []
        for _, a, b, first, second in sorted(pairs, key=lambda x: x[:3]):
            if not (a | b) & gone:
                gone |= a | b
                out.append((frame["cluster_id"].iloc[0], frame["side"].iloc[0], len(out), first, second))
        return pd.DataFrame(out, columns=["cluster_id", "side", "round", "first", "second"])

    return twice.groupBy("cluster_id", "side").applyInPandas(rounds, "cluster_id string, side string, round int, first array<long>, second array<long>")
