"""Text files that are read by byte range."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from donorframe.sources.readers import genome_windows, lines, read_fasta, read_vcf, short_windows

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n"


@pytest.fixture()
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    yield spark
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def bases(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGTacgtN") for _ in range(n))


def wrapped(seq, width):
    return "".join(seq[i : i + width] + "\n" for i in range(0, len(seq), width))


def test_lines_are_numbered_whatever_the_ranges(small_ranges, tmp_path):
    spark = small_ranges
    texts = {"b.txt": [f"b{i} " + "x" * (i % 90) for i in range(20_000)], "a.txt": [f"a{i}" for i in range(30_000)], "c.txt": ["", "last"]}
    for name, rows in texts.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    read = lines(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    got = sorted((r.row_id, r.file.rsplit("/", 1)[1], r.line) for r in read.collect())
    assert got == [(i, n, line) for i, (n, line) in enumerate((n, line) for n in sorted(texts) for line in texts[n])]
    assert read.where("file LIKE '%b.txt'").select("task").distinct().count() > 3
    with gzip.open(tmp_path / "z.gz", "wt") as f:
        f.write("\n".join(texts["b.txt"]))
    packed = lines(spark, str(tmp_path / "z.gz")).withColumn("task", F.spark_partition_id())
    assert [r.line for r in packed.orderBy("row_id").collect()] == texts["b.txt"] and packed.select("task").distinct().count() == 1


def test_a_record_is_cut_by_many_tasks(small_ranges, tmp_path):
    spark = small_ranges
    one, two, three = bases(3_000_000, 1), bases(300_001, 2), bases(4_096, 3)
    void = wrapped(bases(90_000, 4), 60)
    p = tmp_path / "g.fa"
    p.write_text(f"stray\n>1 first\n{wrapped(one, 61)}>chrUn\n{wrapped(two, 70)}>2\n{void[:600]}AC GT\n{void[600:]}>X x\n{two}\n>chr3\n{wrapped(three, 64)}\n{void}A C\n>Y\n>22\n{wrapped(two, 4096)}")
    want = {"1": one, "X": two, "chr3": three, "22": two}
    got = {}
    for r in read_fasta(spark, str(p), chunk=1 << 12).collect():
        assert r.start == r.chunk_id << 12
        got.setdefault(r.chrom, {})[r.chunk_id] = r.seq
    assert got.keys() == want.keys()
    for name, seq in want.items():
        assert "".join(got[name][i] for i in range(len(got[name]))) == seq.upper()
        assert all(len(got[name][i]) == 1 << 12 for i in range(len(got[name]) - 1))
    tasks = lines(spark, str(p)).where("length(line) = 61").select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks > 5
    whole = read_fasta(spark, str(p), single="all").agg(F.sum(F.length("seq")).alias("n")).first().n
    text = "".join(x for x in p.read_text().splitlines() if not x.startswith(">"))
    assert whole == len("".join(text.split()))


def test_files_follow_each_other(small_ranges, tmp_path):
    spark = small_ranges
    # the first file ends within a record, the second has its own FORMAT and its own end of genotypes
    (tmp_path / "1.fa").write_text(">1\nACGT\nAC")
    (tmp_path / "2.fa").write_text("GGGG\n>2\nTT\n")
    assert sorted((r.chrom, r.seq) for r in read_fasta(spark, str(tmp_path / "*.fa")).collect()) == [("1", "ACGTAC"), ("2", "TT")]
    row = lambda pos, fmt, call: f"1\t{pos}\t.\tA\tC\t5\t.\ti\t{fmt}\t{call}\n"
    (tmp_path / "a.vcf").write_text(HEAD + row(1, "GT:DP", "0/1:3") + row(2, "GT:DP", "nothing") + row(3, "GT:DP", "0/1:3"))
    (tmp_path / "b.vcf").write_text(HEAD + row(4, "DP:GT", "3:0/1") + row(5, "DP:GT", "3:1/1"))
    got = read_vcf(spark, [str(tmp_path / "b.vcf"), str(tmp_path / "a.vcf")]).orderBy("row_id").collect()
    assert [(r.pos, r.het) for r in got] == [(0, True), (1, False), (2, False), (3, True), (4, False)]
    assert [r.row_id for r in got] == [2, 3, 4, 7, 8]
    assert read_fasta(spark, str(tmp_path / "a.vcf")).count() == 0
    (tmp_path / "empty.fa").write_text("")
    assert read_fasta(spark, str(tmp_path / "empty.fa")).count() == 0 and lines(spark, str(tmp_path / "empty.fa")).count() == 0


def test_short_windows_equal_windows_of_any_length(spark):
    seq = bases(1_000, 5).upper()
    g = spark.createDataFrame([("1", i, i * 128, seq[i * 128 : (i + 1) * 128]) for i in range(8)], "chrom string, chunk_id int, start int, seq string")
    rng = random.Random(2)
    asked = [(i, "1" if i % 9 else "2", at := rng.randrange(990), at + rng.choice([0, 1, 2, 60, 127, 128])) for i in range(300)]
    w = spark.createDataFrame(asked, "n int, chrom string, start int, end int")
    told = lambda df: {r.n: r.seq for r in df.collect()}
    got = told(short_windows(g, w, 128, chunk=128))
    assert got == told(genome_windows(g, w, chunk=128)) == {n: seq[a:b] if c == "1" else "" for n, c, a, b in asked}
