"""Smaller operators: called alleles, plots, allele rendering, mismatches, text comparison."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from donorframe.functions.scalar import apply_variants, phase, prefix_match, same_letters, trim_alleles
from donorframe.operators.clustering import size_histogram, two_sided
from donorframe.operators.metrics import by_query, mismatches
from donorframe.operators.running import running
from donorframe.sources.readers import read_haploid, read_vcf
from donorframe.sources.writers import match_block, plot_svg, write_report


def write(path, rows):
    path.write_text("##x\n#CHROM\n" + "".join("\t".join(map(str, r)) + "\n" for r in rows))
    return str(path)


def test_called_alleles(spark, tmp_path):
    row = lambda pos, ref, alt, gt, fmt="GT": ["1", pos, ".", ref, alt, 50, ".", "i", fmt, gt]
    path = write(tmp_path / "a.vcf", [row(10, "a", "c,gt", "2/0"), row(11, "AC", "A,G", "1|2"), row(12, "A", "C", "0/0"), row(13, "A", "C", "7:0/1", "DP:GT"), row(14, "A", "C", "1"), row(15, "A", "C", "./."), ["1", 16, ".", "A", "C", 5]])
    got = {(r.pos, r.alt): (r.ref, r.allele, r.snp_type, r.gt) for r in read_haploid(spark, path).collect()}
    assert got == {(9, "GT"): ("A", 1, "I", "0|2"), (10, "A"): ("AC", 0, "D", "1|2"), (10, "G"): ("AC", 1, "D", "1|2"), (12, "C"): ("A", 0, "S", "0|1")}
    long = write(tmp_path / "b.vcf", [row(10, "A", "C" * 99, "0/1"), row(11, "A", "C" * 100, "0/1"), row(12, "A" * 100, "C", "0/1")])
    assert [r.pos for r in read_vcf(spark, long, longest=100).collect()] == [9]
    import gzip

    with gzip.open(tmp_path / "c.vcf.gz", "wt") as f:
        f.write(open(long).read())
    assert read_vcf(spark, str(tmp_path / "c.vcf.gz")).count() == read_vcf(spark, long).count() == 3


def test_report_has_plots_and_tables(spark, tmp_path):
    rows = [(q, u, 0, 0, t, float(t), 100, 50, 10 * t + q, 5 * t + u, 10.0 * t + q, 90.0 - t) for q in (1, 2) for u in (0, 1) for t in range(3)]
    counts = spark.createDataFrame(rows, "query_id int, unit int, mode int, scheme int, t int, qual_min double, baseline_total long, query_total long, baseline_match long, query_match long, recall double, precision double")
    write_report(counts, str(tmp_path / "a.html"))
    write_report(counts, str(tmp_path / "b.html"), graphs=False)
    page = (tmp_path / "a.html").read_text()
    assert page.count("<svg") == 2 + 2 and page.count("<polyline") == 4 * 2 and page.endswith("</body></html>")
    assert "<svg" not in (tmp_path / "b.html").read_text()
    assert {(r.unit, r["1"], r["2"]) for r in by_query(counts.where("t = 1"), names=[1, 2]).collect()} == {(0, 11.0, 12.0), (1, 11.0, 12.0)}
    assert {(r.baseline_mismatch, r.query_mismatch) for r in mismatches(counts.where("query_id = 1 and unit = 0 and t = 2")).collect()} == {(79, 40)}
    svg = plot_svg("a < b", {"x": [(0, 0), (100, 100)]})
    assert "a &lt; b" in svg and 'points="45.0,255.0 515.0,45.0"' in svg


def test_alleles_stand_under_their_bases():
    r = SimpleNamespace(pos=5, ref="ACGT", alt="ATGT/ACGT", vcf1="6,C,T", vcf2="6,C,T/G", phase1="1|0", phase2="2|1")
    block = match_block("file", r).splitlines()
    text = [x.split(":", 1)[1].removesuffix("</pre>") for x in block[1:]]
    assert text == ["A C G T", "A T G T", "A C G T", "  C", "  T", "  C", "  T", "  G"]
    assert [x.split('"')[1] for x in block[4:]] == ["selected", "selected", "", "selected", "selected"]
    assert len(match_block("direct", SimpleNamespace(pos=1, ref="A", alt="C", vcf1=".", vcf2=".", phase1=".", phase2=".")).splitlines()) == 4


def test_scalar_functions(spark):
    one = spark.range(1)
    a, b = F.lit("acGT"), F.lit("ACgt")
    assert one.select(same_letters(a, b), prefix_match(F.lit("ac"), b), prefix_match(b, F.lit("g"))).first()[:] == (True, True, False)
    edits = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(r).alias("ref"), F.lit(x).alias("alt")) for p, r, x in ((6, "G", "GA"), (1, "CG", "C"))])
    assert one.select(apply_variants(F.lit("ACGTACGT"), edits)).first()[0] == "ACTACGAT"
    assert tuple(one.select(trim_alleles(F.lit("GACCT"), F.lit("GATCT")).alias("x")).first().x) == (2, "C", "T")
    assert tuple(one.select(trim_alleles(F.lit("A"), F.lit("AT")).alias("x")).first().x) == (0, "A", "AT")
    cases = {(0, False, False, False): "1|1", (0, True, True, False): "1|2", (0, True, False, True): "1|0", (1, True, True, False): "2|1", (1, True, True, True): "2|0", (1, True, False, True): "0|1", (-1, True, False, True): "0|1", (-2, True, True, True): "0|2"}
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "c int, h boolean, m boolean, z boolean, want string")
    assert df.where(phase(F.col("c"), F.col("h"), F.col("m"), F.col("z")) != F.col("want")).count() == 0


def test_running_over_stretches(spark):
    rows = [("a" if i % 3 else "b", (i * 37) % 200, i) for i in range(300)]
    df = spark.createDataFrame(rows, "chrom string, pos int, i int").withColumn("stretch", F.lit("kept")).repartition(5)
    got = running(df, ["chrom"], [F.col("pos"), F.col("i")], width=16, most=("max", F.col("i"), False), total=("sum", F.col("i"), True))
    assert set(r.stretch for r in got.collect()) == {"kept"} and got.columns == [*df.columns, "most", "total"]
    for c in "ab":
        seen, total = None, 0
        for r in sorted((r for r in got.collect() if r.chrom == c), key=lambda r: (r.pos, r.i)):
            total += r.i
            assert (r.most, r.total) == (seen, total)
            seen = r.i if seen is None else max(seen, r.i)


def test_cluster_tables(spark):
    df = spark.createDataFrame([("x", "baseline"), ("x", "query"), ("y", "query"), ("z", "query"), ("z", "query")], "cluster_id string, side string")
    assert {r.cluster_id for r in two_sided(df).collect()} == {"x"}
    assert {r.cluster_size: r.n_clusters for r in size_histogram(df).collect()} == {2: 2, 1: 1}
