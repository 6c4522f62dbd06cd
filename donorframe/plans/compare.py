"""Whole comparisons, direct matches, filters and diffs, from files to files; and their command line."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BASELINE, PERCENTAGES, QUERY, Scoring, scorings
from ..operators.clustering import cluster
from ..operators.exact import matched
from ..operators.intervals import bed_filter, complex_filter
from ..operators.matcher import match_clusters
from ..operators.metrics import match_counts, match_diff, quality_thresholds, recall_precision, totals_by_threshold
from ..sources import writers
from ..sources.readers import query_qualities, read_bed, read_fasta, read_match, read_vcf, sides
from ..session import session


#: Positions that the page of a diff shows.
PAGE = 1_000


def match(baseline: DataFrame, query: DataFrame, genome: DataFrame, thresholds: DataFrame, chosen: list[Scoring]) -> DataFrame:
    """Matcher results of one query against the baseline."""
    return match_clusters(cluster(sides(baseline, query), genome), genome, thresholds, chosen)


def counts_of(results: DataFrame, thresholds: DataFrame, baseline: DataFrame, query: DataFrame, chosen: list[Scoring]) -> DataFrame:
    """Counts, recall and precision per mode and threshold; modes without a match have zeros."""
    spark = baseline.sparkSession
    grid = spark.createDataFrame([(s.unit, s.mode, s.scheme) for s in chosen], "unit int, mode int, scheme int").join(F.broadcast(totals_by_threshold(query, thresholds)))
    found = grid.join(match_counts(results), ["unit", "mode", "scheme", "t"], "left").na.fill(0, ["baseline_match", "query_match", "baseline_edits", "query_edits"])
    return recall_precision(found.join(F.broadcast(baseline.agg(F.count("*").alias("baseline_total")))))


def compare(spark: SparkSession, baseline: str, genome: str, queries: list[str], output: str, unit: int = -1, mode: int = -1, scheme: int = -1, curves: bool = True, use_genotype: bool = True, fast: bool = False, graphs: bool = True) -> DataFrame:
    """Compare VCF files with a baseline; writes statistics, match records and a report, returns the counts."""
    if fast:
        unit = mode = scheme = 0
    chosen = scorings(unit, mode, scheme)
    folder = str(output).rstrip("/")
    bases = read_fasta(spark, genome).persist()
    base = read_vcf(spark, baseline, BASELINE, 0, bases, use_genotype).persist()
    all_counts, held = None, [bases, base]
    for n, path in enumerate(queries, 1):
        rows = read_vcf(spark, path, QUERY, n, bases, use_genotype).persist()
        cuts = quality_thresholds(query_qualities(spark, path), PERCENTAGES if curves else PERCENTAGES[:1]).persist()
        results = match(base.withColumn("query_id", F.lit(n)), rows, bases, cuts, chosen).persist()
        counted = counts_of(results, cuts, base, rows, chosen).withColumn("query_id", F.lit(n))
        counts = spark.createDataFrame(counted.collect(), counted.schema)  # a row per mode and cut-off
        writers.write_stat(counts, base.count(), rows.count(), f"{folder}/query{n}.stat")
        writers.write_match(results, f"{folder}/query{n}.match")
        for table in (rows, cuts, results):
            table.unpersist()
        all_counts = counts if all_counts is None else all_counts.unionByName(counts)
    for table in held:
        table.unpersist()
    writers.write_report(all_counts, f"{folder}/stat.html", graphs)
    return all_counts


def direct_match(spark: SparkSession, baseline: str, query: str, mode: int = 0, output: str | None = None) -> DataFrame:
    """Query rows with an equal baseline row, without clustering and without a genome."""
    by = "allele" if mode == 1 else "genotype"
    found = matched(read_vcf(spark, query, QUERY, 1, use_genotype=mode != 1), read_vcf(spark, baseline, use_genotype=mode != 1), by)
    if output and mode != 1:
        writers.write_direct(found, output)
    return found


def filter_regions(spark: SparkSession, vcf: str, bed: str, output: str, inside: bool = True) -> DataFrame:
    """Lines of a VCF file inside (outside) the intervals of a BED file; header lines are kept."""
    rows = read_vcf(spark, vcf, keep_line=True, filters=False, use_genotype=False)
    kept = bed_filter(rows, read_bed(spark, bed), inside)
    head = spark.read.text(vcf).where(F.col("value").startswith("#")).select(F.lit(-1).cast("long").alias("row_id"), F.col("value").alias("line"))
    writers.write_lines(head.unionByName(kept.select("row_id", "line")).orderBy("row_id"), output)
    return kept


def filter_complex(spark: SparkSession, vcf: str, output: str) -> DataFrame:
    """Lines of a VCF file around indels with a close neighbour; no header."""
    kept = complex_filter(read_vcf(spark, vcf, keep_line=True, filters=False, use_genotype=False))
    writers.write_lines(kept.orderBy("row_id"), output)
    return kept


def diff(spark: SparkSession, files: list[str], output: str | None = None) -> DataFrame:
    """Positions at which match files differ."""
    rows = None
    for i, path in enumerate(files):
        one = read_match(spark, path, i)
        rows = one if rows is None else rows.unionByName(one)
    found = match_diff(rows, len(files))
    if output:
        folder = str(output).rstrip("/")
        writers.write_lines(found.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "donors").alias("line")), f"{folder}/diff")
        total = found.count()
        some = found.orderBy("chrom", "pos").limit(PAGE).collect()  # a page to look at; the file has all rows
        told = rows.join(F.broadcast(spark.createDataFrame(some, found.schema).select("chrom", "pos")), ["chrom", "pos"]).orderBy("chrom", "pos", "file_id").collect() if some else []
        note = f"<p>{len(some)} of {total} positions</p>"
        blocks = [writers.match_block(f"{files[r.file_id]}, {r.chrom}:{r.pos}", r) for r in told]
        writers.write_text(spark, f"{folder}/compare.html", "\n".join([note, writers.table_html(["chrom", "pos", "donors"], [[r.chrom, r.pos, r.donors] for r in some]), *blocks]))
    return found


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="donorframe")
    sub = parser.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compare", help="compare query VCF files with a baseline")
    c.add_argument("-b", "--baseline", required=True)
    c.add_argument("-g", "--genome", required=True)
    c.add_argument("-q", "--query", nargs="+", required=True)
    c.add_argument("-o", "--output", default="./output")
    c.add_argument("-u", "--score-unit", type=int, default=-1, choices=[-1, 0, 1])
    c.add_argument("-m", "--match-mode", type=int, default=-1, choices=[-1, 0, 1])
    c.add_argument("-s", "--score-scheme", type=int, default=-1, choices=[-1, 0, 1, 2, 3])
    c.add_argument("-t", "--threads", type=int, help="accepted; Spark's own settings decide")
    c.add_argument("-G", "--no-graph", action="store_true", help="reports without plots")
    c.add_argument("-C", "--disable-curves", action="store_true")
    c.add_argument("-f", "--fast", action="store_true")
    b = sub.add_parser("regions", help="filter a VCF file by a BED file")
    b.add_argument("-b", "--bed", required=True)
    b.add_argument("-v", "--vcf", required=True)
    b.add_argument("-o", "--outside", action="store_true")
    x = sub.add_parser("complex", help="variants close to each other around indels")
    x.add_argument("vcf")
    d = sub.add_parser("diff", help="differences of match files")
    d.add_argument("files", nargs="+")
    d.add_argument("-o", "--output", default="./match_diff_output")
    a = parser.parse_args(args)
    spark = session()
    if a.command == "compare" and a.score_scheme == 3:
        for q in a.query:
            print(direct_match(spark, a.baseline, q, a.match_mode, f"{a.output}/{q.rstrip('/').rsplit('/', 1)[-1]}.direct").count())
    elif a.command == "compare":
        compare(spark, a.baseline, a.genome, a.query, a.output, a.score_unit, a.match_mode, a.score_scheme, not a.disable_curves, fast=a.fast, graphs=not a.no_graph)
    elif a.command == "regions":
        filter_regions(spark, a.vcf, a.bed, f"{a.vcf}.lcr.vcf", not a.outside)
    elif a.command == "complex":
        filter_complex(spark, a.vcf, f"{a.vcf}.cv.vcf")
    else:
        diff(spark, a.files, a.output)


if __name__ == "__main__":
    main()
