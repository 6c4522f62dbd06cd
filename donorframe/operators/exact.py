"""Exact matching: equality predicates and the joins built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["chrom", "pos", "ref"]


def shared_alleles(a: Column, b: Column) -> Column:
    """Number of pairs of equal alleles."""
    return F.aggregate(a, F.lit(0), lambda n, x: n + F.size(F.filter(b, lambda y: x == y)))


def same_genotype(b: str = "b", q: str = "q") -> Column:
    """Equality with genotype of two rows of one chromosome, position and ref: like zygosity and number of alts, then
    both alts in any order for heterozygous rows of two, else the first alt; two rows with a reference allele and two
    alts each are equal by their alts alone."""
    c = lambda side, name: F.col(f"{side}.{name}")
    first = F.get(c(b, "alts"), F.lit(0)) == F.get(c(q, "alts"), F.lit(0))
    both = shared_alleles(c(b, "alts"), c(q, "alts")) >= 2
    alike = (c(b, "het") == c(q, "het")) & (c(b, "multi") == c(q, "multi"))
    with_ref = c(b, "multi") & c(b, "zero_one") & c(q, "multi") & c(q, "zero_one")
    return (alike & F.when(c(b, "multi") & c(b, "het"), both).otherwise(first)) | (with_ref & both)


def same_allele(b: str = "b", q: str = "q") -> Column:
    """Any allele in common."""
    return F.arrays_overlap(F.col(f"{b}.alts"), F.col(f"{q}.alts"))


def lenient(b: str = "b", q: str = "q") -> Column:
    """Any allele in common if both are heterozygous with two alts, else the same first alt."""
    two = F.col(f"{b}.multi") & F.col(f"{b}.het") & F.col(f"{q}.multi") & F.col(f"{q}.het")
    return F.when(two, same_allele(b, q)).otherwise(F.get(F.col(f"{b}.alts"), F.lit(0)) == F.get(F.col(f"{q}.alts"), F.lit(0)))


def on_key(b: str = "b", q: str = "q") -> Column:
    out = F.lit(True)
    for k in KEY:
        out = out & (F.col(f"{b}.{k}") == F.col(f"{q}.{k}"))
    return out


PREDICATES = {"genotype": same_genotype, "allele": same_allele, "lenient": lenient}


def matched(rows: DataFrame, others: DataFrame, by: str = "genotype", negate: bool = False) -> DataFrame:
    """Rows that have an equal row among the others (or none, with negate); the others may serve any number of times."""
    return rows.alias("q").join(others.alias("b"), on_key() & PREDICATES[by](), "left_anti" if negate else "left_semi")


def first_match(baseline: DataFrame, query: DataFrame, by: str = "genotype") -> DataFrame:
    """For each baseline row the first equal query row of its cluster: b_row, q_row. Query rows may serve again."""
    same = on_key() & (F.col("b.cluster_id") == F.col("q.cluster_id")) & PREDICATES[by]() if "cluster_id" in baseline.columns else on_key() & PREDICATES[by]()
    pairs = baseline.alias("b").join(query.alias("q"), same)
    return pairs.groupBy(F.col("b.row_id").alias("b_row"), *[F.col(f"b.{k}") for k in KEY], F.col("b.alts").alias("b_alts")).agg(F.min("q.row_id").alias("q_row"))


def one_to_one(baseline: DataFrame, query: DataFrame, key: list[str]) -> DataFrame:
    """Greedy matching that uses every row once, for equality of whole keys: the n-th row of a key on one side takes the
    n-th on the other."""
    numbered = lambda df, name: df.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("row_id")).alias("nth"), F.col("row_id").alias(name))
    return numbered(baseline, "b_row").join(numbered(query, "q_row"), [*key, "nth"]).drop("nth")


def one_per_position(baseline: DataFrame, query: DataFrame, by: str = "genotype") -> DataFrame:
    """One row of each side per position (the last read), matched where equal."""
    last = lambda df: df.groupBy("chrom", "pos").agg(F.max_by(F.struct(*[c for c in df.columns if c not in ("chrom", "pos")]), "row_id").alias("r")).select("chrom", "pos", "r.*")
    pairs = last(baseline).alias("b").join(last(query).alias("q"), on_key() & PREDICATES[by]())
    return pairs.select(F.col("b.chrom").alias("chrom"), F.col("b.pos").alias("pos"), F.col("b.row_id").alias("b_row"), F.col("q.row_id").alias("q_row"))


def merged_order(both: DataFrame) -> DataFrame:
    """Both sides in comparison order with a running number per chromosome."""
    from ..functions.scalar import comparison_order

    return both.withColumn("order_in_chrom", F.row_number().over(Window.partitionBy("chrom").orderBy(*comparison_order())))
