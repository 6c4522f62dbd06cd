"""Interval operators: merging, range joins, and the two region filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import unused
from .running import running

#: Width of the buckets that turn range joins into equi-joins.
BUCKET = 1 << 14


def merge_intervals(intervals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Union of closed intervals (start, end) per key; intervals that share a point become one, adjacent ones do not."""
    by = by or ["chrom"]
    order = [F.col("start"), F.col("end")]
    # equal intervals would tie, and the two passes could see them in different orders
    ends = running(intervals.select(*by, "start", "end").distinct(), by, order, "start", before=("max", F.col("end"), False))
    fresh = F.when(F.col("before") >= F.col("start"), 0).otherwise(1)
    runs = running(ends, by, order, "start", run=("sum", fresh, True))
    return runs.groupBy(*by, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def in_intervals(rows: DataFrame, intervals: DataFrame, inside: bool = True, bucket: int = BUCKET) -> DataFrame:
    """Rows whose pos lies (or does not lie) in a half-open interval of their chromosome, by an equi-join on buckets."""
    name = unused(rows, "bucket")
    cut = intervals.where("end > start").select("chrom", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))).alias(name))
    left = rows.withColumn(name, F.floor(F.col("pos") / bucket)).alias("v")
    on = (F.col("v.chrom") == F.col("i.chrom")) & (F.col(f"v.{name}") == F.col(f"i.{name}")) & (F.col("i.start") <= F.col("v.pos")) & (F.col("v.pos") < F.col("i.end"))
    return left.join(cut.alias("i"), on, "left_semi" if inside else "left_anti").drop(name)


def bed_filter(rows: DataFrame, bed: DataFrame, inside: bool = True) -> DataFrame:
    """Rows inside (or outside) the intervals; rows on chromosomes that the intervals do not name are always kept."""
    if not inside:
        return in_intervals(rows, bed, inside=False)  # an unnamed chromosome has no interval to be in
    # what is kept is what is not outside on a named chromosome; the names are few, the rows are read twice at most
    names = bed.select("chrom").distinct()
    return in_intervals(rows, bed).unionByName(rows.join(names, "chrom", "left_anti"))


def complex_filter(rows: DataFrame, reach: int = 10) -> DataFrame:
    """Rows in merged windows of `reach` bases around indels that have another such row at most `reach` bases away."""
    indel = F.exists("alts", lambda a: F.length(a) != F.length("ref"))
    windows = rows.where(indel).select("chrom", (F.col("pos") - reach).alias("start"), (F.col("pos") + reach).alias("end"))
    near = in_intervals(rows, merge_intervals(windows))
    w = Window.partitionBy("chrom").orderBy("pos", "row_id")
    close = (F.col("pos") - F.lag("pos").over(w) <= reach) | (F.lead("pos").over(w) - F.col("pos") <= reach)
    name = unused(near, "close")
    return near.withColumn(name, F.coalesce(close, F.lit(False))).where(name).drop(name)


def overlapping(rows: DataFrame) -> DataFrame:
    """Mark rows that begin before an earlier row of their chromosome and side ends."""
    name = unused(rows, "run_end")
    ends = running(rows, ["side", "chrom"], [F.col("pos"), F.col("row_id"), *[F.col(c) for c in ("alts", "qual") if c in rows.columns]], **{name: ("max", F.col("pos") + F.length("ref"), False)})
    return ends.withColumn("overlaps", F.coalesce(F.col(name) > F.col("pos"), F.lit(False))).drop(name)
