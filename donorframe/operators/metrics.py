"""Quality cut-offs, totals, recall and precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import mode_label
from ..model import LOW_QUALITY, PERCENTAGES, Scoring


def quality_thresholds(qualities: DataFrame, percentages: list[float] = PERCENTAGES) -> DataFrame:
    """Cut-offs of a query's qualities (column qual): t, qual_min, pct.

    Cut-off 0 is 0; the others stand at index low + trunc(rest * p) of the ascending qualities, low being the number of
    those under 0.1. pct is (number of lower qualities + 1) / number of all, at most 1.
    """
    spark = qualities.sparkSession
    # ranks by distinct quality: the window sorts one row per quality, not one per variant
    q = qualities.where(F.col("qual").isNotNull()).groupBy("qual").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("qual"))
    q = q.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("n"))
    total = q.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("qual") < LOW_QUALITY, F.col("n"))), F.lit(0)).alias("low"))
    p = spark.createDataFrame([(i, x) for i, x in enumerate(percentages)], "t int, p double")
    index = p.join(F.broadcast(total)).withColumn("at", F.least(F.col("low") + ((F.col("total") - F.col("low")) * F.col("p")).cast("long"), F.col("total") - 1))
    found = q.join(F.broadcast(index), (F.col("below") <= F.col("at")) & (F.col("at") < F.col("upto")))
    first = F.col("t") == 0
    return found.select("t", F.when(first, 0.0).otherwise(F.col("qual")).alias("qual_min"), F.when(first, 0.0).otherwise(F.least(F.lit(1.0), (F.col("below") + 1) / F.col("total"))).alias("pct"))


def totals_by_threshold(query_rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """query_total: trunc(rows * (1 - pct)); query_exact: rows at or above the cut-off."""
    q = F.broadcast(thresholds)  # five rows
    n = query_rows.agg(F.count("*").alias("n"))
    exact = query_rows.join(q, F.col("qual") >= F.col("qual_min")).groupBy("t").agg(F.count("*").alias("query_exact"))
    return q.join(F.broadcast(n)).join(exact, "t", "left").select("t", "qual_min", "pct", (F.col("n") * (1 - F.col("pct"))).cast("long").alias("query_total"), F.coalesce("query_exact", F.lit(0).cast("long")).alias("query_exact"))


def rate(a: str, b: str):
    """a in per cent of b, 0 where b is 0."""
    return F.coalesce(F.try_divide(F.col(a) * F.lit(100.0), F.col(b)), F.lit(0.0))


def recall_precision(counts: DataFrame) -> DataFrame:
    """Add recall (baseline_match of baseline_total) and precision (query_match of query_total)."""
    return counts.withColumn("recall", rate("baseline_match", "baseline_total")).withColumn("precision", rate("query_match", "query_total"))


def mismatches(counts: DataFrame) -> DataFrame:
    """Add the rows of both sides that are not matched."""
    return counts.withColumn("baseline_mismatch", F.col("baseline_total") - F.col("baseline_match")).withColumn("query_mismatch", F.col("query_total") - F.col("query_match"))


def pr_curve(counts: DataFrame) -> DataFrame:
    """True (recall, precision) pairs per mode, by recall."""
    w = Window.partitionBy("unit", "mode", "scheme").orderBy("recall", "precision", "t")
    return recall_precision(counts).withColumn("point", F.row_number().over(w))


def match_counts(results: DataFrame) -> DataFrame:
    """Matched rows and edit distances per mode and threshold, from matcher results."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("baseline_match", "query_match", "baseline_edits", "query_edits")]
    return results.groupBy("unit", "mode", "scheme", "t").agg(*sums)


def modes(spark: SparkSession, chosen: list[Scoring]) -> DataFrame:
    """The chosen modes as a table (at most 12 rows)."""
    df = spark.createDataFrame([(s.unit, s.mode, s.scheme, s.index) for s in chosen], "unit int, mode int, scheme int, mode_index int")
    return df.withColumn("label", mode_label(F.col("unit"), F.col("mode"), F.col("scheme")))


def by_query(counts: DataFrame, value: str = "recall", names: list[str] | None = None) -> DataFrame:
    """One row per mode, one column per query."""
    return counts.groupBy("unit", "mode", "scheme").pivot("query_id", names).agg(F.first(value))


def indel_counts(variants: DataFrame) -> DataFrame:
    indel = F.exists("alts", lambda a: F.length(a) != F.length("ref"))
    return variants.groupBy("side").agg(F.count("*").alias("n_rows"), F.count_if(indel).alias("n_indels"))


def matches_by_quality(rows: DataFrame) -> DataFrame:
    """Counts by whole quality."""
    return rows.groupBy(F.col("qual").cast("int").alias("qual")).agg(F.count("*").alias("n"))


def match_diff(files: DataFrame, n_files: int) -> DataFrame:
    """Positions that some of the match files lack or that carry different donors: chrom, pos, n_files, alts by file."""
    by = files.groupBy("chrom", "pos").agg(F.collect_set(F.struct("file_id", "ref", "alt")).alias("told"))
    named = F.filter("told.file_id", lambda x: x.isNotNull())
    donors = F.filter(F.transform("told", lambda x: F.struct(x.ref, x.alt)), lambda x: x.ref.isNotNull() & x.alt.isNotNull())
    size = lambda c: F.size(F.array_distinct(c)).cast("long")
    shown = F.array_sort(F.array_distinct(F.transform("told", lambda x: F.struct(x.file_id, x.alt))))
    counted = by.withColumns({"n_files": size(named), "n_donors": size(donors)}).where((F.col("n_files") < n_files) | (F.col("n_donors") > 1))
    return counted.select("chrom", "pos", "n_files", F.array_join(F.transform(shown, lambda x: F.concat_ws("=", x.file_id.cast("string"), x.alt)), ";").alias("donors"))
