import random

from pyspark.sql import functions as F

from donorframe.operators.clustering import cluster, cluster_unchanging, split_clusters
from donorframe.operators.exact import first_match, matched, one_per_position, one_to_one
from donorframe.operators.intervals import bed_filter, complex_filter, merge_intervals
from donorframe.plans.compare import compare, diff, direct_match, filter_complex, filter_regions
from donorframe.sources.readers import genome_windows, haploid_alleles, read_bed, read_fasta, read_match, read_stat, read_vcf, sides

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n"


def vcf(path, rows, head=HEAD):
    path.write_text(head + "".join("\t".join(map(str, r)) + "\n" for r in rows))
    return str(path)


def line(chrom, pos, ref, alt, gt="0/1", qual="50", fmt="GT"):
    return [chrom, pos, ".", ref, alt, qual, ".", "i", fmt, gt]


def test_fasta(spark, tmp_path):
    p = tmp_path / "g.fa"
    p.write_text(">1 first\nacgtACGT\nTT\n>zz\nAAAA\n>chr2\nAC GT\n>X\nGGG\n\nCCC\n>2\nTTTTT")
    g = read_fasta(spark, str(p), chunk=4)
    assert sorted((r.chrom, r.start, r.seq) for r in g.collect()) == [("1", 0, "ACGT"), ("1", 4, "ACGT"), ("1", 8, "TT"), ("2", 0, "TTTT"), ("2", 4, "T"), ("X", 0, "GGG")]
    w = spark.createDataFrame([("1", 2, 9, 0), ("1", 8, 30, 1), ("X", 1, 1, 2), ("2", 3, 5, 3)], "chrom string, start int, end int, n int")
    assert {r.n: r.seq for r in genome_windows(g, w, chunk=4).collect()} == {0: "GTACGTT", 1: "TT", 2: "", 3: "TT"}
    assert [r.seq for r in read_fasta(spark, str(p), single="all").collect()][0].startswith("ACGTACGTTTAAAA")


def test_vcf_rules(spark, tmp_path):
    rows = [
        line("1", 10, "a", "c", "0/1:9", fmt="GT:DP"), line("1", 11, "A", "C,G", "1|2"), line("1", 12, "A", "C", "0/0"), line("1", "x", "A", "C", "1/1", "."), line("1", 14, "A", "C,G,T", "1/3"),
        line("1", 15, "A", "A" * 101), line("1", 16, "A", "A" * 102), line("9", 17, "A", "C"), line("1", 18, "A", "C,G", "0/2"), line("1", 19, "A", "C,G,T", "0/2"), line("1", 20, "A", "C", "./."), ["1", 21, "", ".", "AC", "A", 5, ".", "i", "GT", "0/1"],
        ["1", 30, ".", "A", "C"], line("1", 31, "A", "C", "0/1"), ["1", 32, ".", "A", "C", "7", ".", "i"],
    ]
    genome = spark.createDataFrame([("1", 0, 0, "A" * 50)], "chrom string, chunk_id int, start int, seq string")
    got = {r.pos: r for r in read_vcf(spark, vcf(tmp_path / "a.vcf", rows), genome=genome).collect()}
    told = {p: (r.ref, r.alts, r.het, r.multi, r.zero_one, r.mil, r.mdl, r.qual) for p, r in got.items()}
    assert told[9] == ("A", ["C"], True, False, True, 0, 0, 50.0) and told[10] == ("A", ["C", "G"], True, True, False, 0, 0, 50.0)
    assert 11 not in told and told[-1] == ("A", ["C"], False, False, False, 0, 0, 1.0) and told[13][1] == ["C", "T"] and told[13][3]
    assert told[14][5] == 100 and 15 not in told and 16 not in told and told[17][3:5] == (True, True) and told[18][1:5] == (["G"], True, False, True)
    assert told[19][2] is False and told[20] == ("AC", ["A"], True, False, True, 0, 1, 5.0)
    assert 29 not in told and told[30][2] is False and told[31][7] == 7.0
    assert haploid_alleles(read_vcf(spark, vcf(tmp_path / "a.vcf", rows))).groupBy("snp_type").count().count() == 3


def plain_clusters(rows, genome):
    """The rule, row by row."""
    repeat = lambda s: len(s) == 1 or any(s[: u * (len(s) // u)] == s[:u] * (len(s) // u) for u in range(1, len(s) // 2 + 1))
    out, now, end = [], [], 0
    ins, dele = [0, 0], [0, 0]
    for r in sorted(rows, key=lambda r: (r[0], -r[3], r[4])):
        pos, ref, alt, side, _ = r
        if now and pos - end >= 2:
            change = max(ins[0] + dele[1], ins[1] + dele[0])
            if change == 0 or (pos - end > 2 * change and (pos - end > 1000 or not repeat(genome[end:pos]))):
                out.append(now)
                now, end, ins, dele = [], 0, [0, 0], [0, 0]
        end = max(end, pos + len(ref))
        ins[side] += max(0, len(alt) - len(ref))
        dele[side] += max(0, len(ref) - len(alt))
        now.append(r)
    return sorted(sorted(c) for c in [*out, now] if c)


def test_clusters_equal_the_plain_fold(spark):
    rng = random.Random(8)
    for trial in range(4):
        genome = "".join(rng.choice("ACGT" if trial % 2 else "AC") for _ in range(20_000))
        rows, at = [], 3
        while at < 19_000:
            n = rng.choice([1, 1, 2, 40, 99])
            ref = genome[at : at + n]
            alt = ref[0] + "T" * rng.choice([0, 0, 1, 60])
            rows.append((at, ref, alt, rng.randint(0, 1), len(rows)))
            at += rng.choice([0, 1, 2, 3, 5, 30, 200, 400, 900, 1001, 1500])
        df = spark.createDataFrame([(i, "query" if s else "baseline", 1, "1", p, r, [a]) for p, r, a, s, i in rows], "row_id long, side string, query_id int, chrom string, pos int, ref string, alts array<string>")
        df = df.withColumns({"mil": F.greatest(F.lit(0), F.length(F.get("alts", F.lit(0))) - F.length("ref")), "mdl": F.greatest(F.lit(0), F.length("ref") - F.length(F.get("alts", F.lit(0))))})
        g = spark.createDataFrame([("1", i, i * 4096, genome[i * 4096 : (i + 1) * 4096]) for i in range(5)], "chrom string, chunk_id int, start int, seq string")
        import donorframe.operators.clustering as c
        import donorframe.sources.readers as rd

        old = c.genome_windows
        c.genome_windows = lambda a, b: rd.genome_windows(a, b, 4096)
        got = {}
        for r in cluster(df.repartition(3), g).collect():
            got.setdefault(r.cluster_id, []).append((r.pos, r.ref, r.alts[0], int(r.side == "query"), r.row_id))
        c.genome_windows = old
        assert sorted(sorted(x) for x in got.values()) == plain_clusters(rows, genome)
        snv = df.where("mil = 0 and mdl = 0")
        assert cluster_unchanging(snv).groupBy("cluster_no").count().count() == len(plain_clusters([r for r in rows if len(r[1]) == len(r[2])], genome))
        for bases, told in ((None, None), (g, genome)):
            back = {}
            c.genome_windows = lambda a, b: rd.genome_windows(a, b, 4096)
            for r in cluster(df.repartition(3), bases, backwards=True).collect():
                back.setdefault(r.cluster_id, []).append((r.pos, r.ref, r.alts[0], int(r.side == "query"), r.row_id))
            c.genome_windows = old
            assert sorted(sorted(x) for x in back.values()) == plain_backwards(rows, told)


def plain_backwards(rows, genome):
    """One fold over all rows from the right."""
    out, least, inserted, deleted = [], None, [0, 0], [0, 0]
    for r in sorted(rows, key=lambda r: (-(r[0] + len(r[1])), r[3] == 0, r[4])):
        end = r[0] + len(r[1])
        gap = None if least is None else least - end
        change = max(inserted[0] + deleted[1], inserted[1] + deleted[0])
        if gap is None or (gap >= 2 and (change == 0 or (gap > 2 * change and (gap > 1000 or genome is None or not plain_repeat(genome[end : end + gap]))))):
            out.append([])
            least, inserted, deleted = None, [0, 0], [0, 0]
        out[-1].append(r)
        least = r[0] if least is None else min(least, r[0])
        inserted[r[3]] += max(0, len(r[2]) - len(r[1]))
        deleted[r[3]] += max(0, len(r[1]) - len(r[2]))
    return sorted(sorted(x) for x in out)


def plain_repeat(s):
    return len(s) == 1 or any(s[: u * (len(s) // u)] == s[:u] * (len(s) // u) for u in range(1, len(s) // 2 + 1))


def test_split_clusters(spark):
    genome = "ACGTTGCAAC" * 3 + "GATTACAGGC" * 30 + "CCTGATCGAT" * 30
    rows = [("c", "1", 5, "A", "AT", "baseline"), ("c", "1", 9, "C", "G", "query"), ("c", "1", 90, "GATTACAG", "G", "query"), ("c", "1", 100, "A", "AC", "baseline"), ("d", "1", 300, "G", "C", "query")]
    df = spark.createDataFrame([(i, *r[:3], r[3], [r[4]], r[5], max(0, len(r[4]) - len(r[3])), max(0, len(r[3]) - len(r[4]))) for i, r in enumerate(rows)], "row_id long, cluster_id string, chrom string, pos int, ref string, alts array<string>, side string, mil int, mdl int")
    g = spark.createDataFrame([("1", i, i * 4096, genome[i * 4096 : (i + 1) * 4096]) for i in range(1)], "chrom string, chunk_id int, start int, seq string")
    got = {r.row_id: (r.cluster_id, r.cluster_part) for r in split_clusters(df, g).collect()}
    # the gap from the first row's end to the last row's start exceeds twice the lesser change and is no repeat, and so on;
    # the last two rows are 2 bases apart, which is twice the change of one of them
    assert [got[i] for i in range(5)] == [("c", 0), ("c", 1), ("c", 2), ("c", 2), ("d", 0)]


def test_whole_comparison(spark, tmp_path):
    rng = random.Random(4)
    genome = "".join(rng.choice("ACGT") for _ in range(5_000))
    (tmp_path / "g.fa").write_text(">1\n" + "\n".join(genome[i : i + 60] for i in range(0, 5_000, 60)) + "\n")
    other = lambda b: rng.choice([x for x in "ACGT" if x != b])
    base, query = [], []
    for at in range(20, 4_900, 25):
        kind = rng.choice(["same", "same", "split", "baseline", "query", "gt"])
        b = genome[at - 1]
        alt = other(b)
        q = rng.choice([1, 20, 60, 90])
        if kind == "split":  # a two-base change against two single ones
            two = genome[at - 1 : at + 1]
            alts = other(two[0]), other(two[1])
            base.append(line("1", at, two, "".join(alts), "1/1"))
            query += [line("1", at, two[0], alts[0], "1/1", q), line("1", at + 1, two[1], alts[1], "1/1", q)]
        elif kind == "gt":
            base.append(line("1", at, b, alt, "0/1"))
            query.append(line("1", at, b, alt, "1/1", q))
        else:
            if kind != "query":
                base.append(line("1", at, b, alt))
            if kind != "baseline":
                query.append(line("1", at, b, alt, qual=q))
    b, q = vcf(tmp_path / "b.vcf", base), vcf(tmp_path / "q.vcf", query)
    out = tmp_path / "out"
    counts = {(r.unit, r.mode, r.scheme, r.t): r for r in compare(spark, b, str(tmp_path / "g.fa"), [q], str(out)).collect()}
    assert len(counts) == 60
    kinds = {"same": 0, "split": 0, "gt": 0}
    for r in base:
        same = [x for x in query if x[1] == r[1]]
        kinds["split" if len(r[3]) == 2 else "gt" if same and same[0][9] != r[9] else "same"] += bool(same)
    g, a = counts[0, 0, 0, 0], counts[0, 1, 0, 0]
    assert g.baseline_match == kinds["same"] + kinds["split"] and g.query_match == kinds["same"] + 2 * kinds["split"]
    assert a.baseline_match == g.baseline_match + kinds["gt"] and a.query_match == g.query_match + kinds["gt"]
    assert g.baseline_total == len(base) and g.recall == g.baseline_match * 100.0 / len(base)
    assert counts[0, 0, 0, 4].query_match <= counts[0, 0, 0, 1].query_match <= g.query_match
    stat = {(r.unit, r.mode, r.scheme, r.t): r for r in read_stat(spark, str(out / "query1.stat")).collect()}
    assert all(stat[k].baseline_match == r.baseline_match and stat[k].query_total == r.query_total for k, r in counts.items())
    part = out / "query1.match" / "query_id=1" / "match=0_0_0"
    found = read_match(spark, str(part)).collect()
    assert len(found) == kinds["same"] + kinds["split"] and {x.score for x in found if x.vcf2 != "." and ";" in x.vcf2} == {"3"}
    assert "Comparison" in (out / "stat.html").read_text() and "<polyline" in (out / "stat.html").read_text()
    assert direct_match(spark, b, q, output=str(tmp_path / "d")).count() == kinds["same"] and direct_match(spark, b, q, 1).count() == kinds["same"] + kinds["gt"]
    assert diff(spark, [str(part), str(part)]).count() == 0
    one_less = [str(p) for p in part.glob("part-*")]
    assert one_less and diff(spark, [str(part), str(out / "query1.match" / "query_id=1" / "match=0_1_0")], str(tmp_path / "x")).count() >= kinds["gt"]


def test_regions_and_joins(spark, tmp_path):
    rows = [line("1", p, "A", "C") for p in (5, 10, 11, 20, 21, 30)] + [line("2", 7, "A", "C"), line("1", 100, "AC", "A"), line("1", 105, "A", "C"), line("1", 300, "A", "AC"), line("1", 311, "A", "G")]
    (tmp_path / "b.bed").write_text("1\t9\t10\n1\t10\t20\n1\t25\t20\n")
    v = vcf(tmp_path / "v.vcf", rows)
    bed = read_bed(spark, str(tmp_path / "b.bed"))
    df = read_vcf(spark, v)
    assert sorted((r.chrom, r.pos + 1) for r in bed_filter(df, bed).collect()) == [("1", 10), ("1", 11), ("1", 20), ("2", 7)]
    assert sorted(r.pos + 1 for r in bed_filter(df, bed, inside=False).collect()) == [5, 7, 21, 30, 100, 105, 300, 311]
    assert filter_regions(spark, v, str(tmp_path / "b.bed"), str(tmp_path / "o")).count() == 4
    assert sum(r.value.startswith("#") for r in spark.read.text(str(tmp_path / "o")).collect()) == 2
    assert sorted(r.pos + 1 for r in complex_filter(df).collect()) == [100, 105] and filter_complex(spark, v, str(tmp_path / "c")).count() == 2
    iv = spark.createDataFrame([("1", 1, 3), ("1", 3, 5), ("1", 6, 7), ("2", 1, 9), ("2", 2, 3)], "chrom string, start int, end int")
    assert sorted(map(tuple, merge_intervals(iv).select("chrom", "start", "end").collect())) == [("1", 1, 5), ("1", 6, 7), ("2", 1, 9)]
    a = df.limit(100)
    assert matched(df, a).count() == 11 and matched(df, a.where("pos < 15"), negate=True).count() == 7
    assert one_to_one(df, df, ["chrom", "pos", "ref", "alts"]).count() == 11 and one_per_position(df, df).count() == 11 and first_match(df, df).count() == 11
    assert sides(df, df).groupBy("side").count().count() == 2
