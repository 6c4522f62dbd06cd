"""What keeps queries within their limits on large tables, and results that do not depend on how ties are dealt."""

import itertools

import pytest
from pyspark.sql import functions as F

from donorframe.functions import scalar
from donorframe.functions.alignment import left_normalize
from donorframe.operators import clustering, duplicates, intervals, metrics, normalize
from donorframe.queries import QUERIES, VARIED, genome, variants
from donorframe.sources.readers import genome_windows, short_windows

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_genome_is_made_by_many_tasks(spark):
    assert genome(spark, FOLDER).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("windows", [genome_windows, lambda g, w: short_windows(g, w, 20)])
def test_genome_is_not_broadcast(spark, windows):
    asked = spark.range(10).selectExpr("'1' AS chrom", "cast(id * 7 AS int) AS start", "cast(id * 7 + 9 AS int) AS end")
    assert "BroadcastHashJoin" not in plan(windows(genome(spark, FOLDER), asked))
    assert "BroadcastHashJoin" not in plan(QUERIES["apply_variant"](spark, FOLDER))


def test_equal_intervals_in_any_order(spark, monkeypatch):
    shuffled = lambda rows, by, order, *rest, **wanted: plain(rows.withColumn("dealt", F.rand()), by, [*order, F.col("dealt")], *rest, **wanted).drop("dealt")
    plain = intervals.running
    monkeypatch.setattr(intervals, "running", shuffled)
    rows = spark.range(400).selectExpr("'1' AS chrom", "cast(id div 8 * 100 AS int) AS start", "cast(id div 8 * 100 + 60 AS int) AS end")
    assert sorted(map(tuple, intervals.merge_intervals(rows).collect())) == [("1", i * 100, i * 100 + 60) for i in range(50)]


def test_trim_alleles_computes_the_suffix_once(spark):
    trimmed = spark.createDataFrame([("xabcz", "xacz"), ("a", "a"), ("", "a"), ("abab", "ab"), ("gt", "ct")], "r string, a string").select("r", "a", scalar.trim_alleles(F.col("r"), F.col("a")).alias("t"))
    assert trimmed._jdf.queryExecution().optimizedPlan().toString().count("filter(") == 2
    assert [tuple(x) for x in trimmed.select("t.*").collect()] == [(1, "ab", "a"), (0, "a", "a"), (0, "", "a"), (0, "aba", "a"), (0, "g", "c")]


def test_repeats_by_plain_python(spark):
    texts = ["", "a", "aa", "ab", "abab", "ababa", "aba", "abcabcab", "aab", "aaab", "abaab", "a\na\n", "\n\n\n", "abcdabce", "aaaaaaab"]
    want = [(s, len(s) == 1 or any(s[: u * (len(s) // u)] == s[:u] * (len(s) // u) for u in range(1, len(s) // 2 + 1))) for s in texts]
    got = spark.createDataFrame([(s,) for s in texts], "s string").select("s", scalar.is_tandem_repeat(F.col("s")).alias("r"))
    assert list(map(tuple, got.collect())) == want


def test_diff_needs_no_expanded_rows(spark):
    files = spark.createDataFrame([(0, "1", 5, "A", "C"), (1, "1", 5, "A", "C"), (0, "1", 6, "A", "C"), (0, "2", 7, "A", "C"), (1, "2", 7, "A", "G"), (1, "3", 1, None, "G"), (0, "3", 1, "A", None)], "file_id int, chrom string, pos int, ref string, alt string")
    told = metrics.match_diff(files, 2)
    assert "Expand" not in plan(told)
    assert sorted(map(tuple, told.collect())) == [("1", 6, 1, "0=C"), ("2", 7, 2, "0=C;1=G")]


def test_tandem_by_plain_python():
    texts = ["".join(x) for n in range(11) for x in itertools.product("AC", repeat=n)] + ["ACGACGAC", "ACGACGAG", "ACACG", "CCCCCCCCA"]
    for s in texts:
        assert clustering.tandem(s) == (len(s) == 1 or any(s[: u * (len(s) // u)] == s[:u] * (len(s) // u) for u in range(1, len(s) // 2 + 1))), s


def test_clustering_shuffles_rows_once(spark, monkeypatch):
    plans = {}
    kept = clustering.keep
    monkeypatch.setattr(clustering, "keep", lambda df, name: plans.setdefault(name, plan(df)) and kept(df, name))
    clustering.cluster(variants(spark, FOLDER, VARIED), genome(spark, FOLDER))
    assert set(plans) == {"changes", "carries", "clusters"}
    assert "Exchange hashpartitioning" not in plans["clusters"] and "Python" not in plans["clusters"] and "Arrow" not in plans["clusters"]


def test_windows_of_one_chunk_are_not_put_together(spark):
    asked = spark.createDataFrame([("1", 5, 9, "a"), ("1", 4090, 4100, "b"), ("1", 4095, 4096, "c"), ("1", 7, 7, "d"), (None, 5, 9, "e"), ("23", 5, 9, "f"), ("1", -3, 2, "g")], "chrom string, start int, end int, n string")
    bases = "".join(r.seq for r in genome(spark, FOLDER).where("chrom = '1' AND chunk_id < 2").orderBy("chunk_id").collect())
    told = genome_windows(genome(spark, FOLDER), asked)
    assert {r.n: r.seq for r in told.collect()} == {"a": bases[5:9], "b": bases[4090:4100], "c": bases[4095], "d": "", "e": "", "f": "", "g": bases[:2]}
    first = told._jdf.queryExecution().optimizedPlan().children().head().toString()
    assert "Union" in told._jdf.queryExecution().optimizedPlan().toString() and "Aggregate" not in first


def test_what_cannot_move_asks_for_no_bases(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(normalize, "genome_windows", lambda g, w, *rest: asked.append(w.count()) or genome_windows(g, w, *rest))
    rows = [("1", 300, "A", ["C"]), ("1", 300, "A", ["AC", "T"]), ("1", 300, "AC", ["GT"]), ("1", 300, "A", ["CA"]), ("1", 300, "AC", ["AT"]), ("1", 300, "A", [""]), ("1", 300, "A", [None])]
    told = normalize.normalize_variants(spark.createDataFrame(rows, "chrom string, pos int, ref string, alts array<string>"), genome(spark, FOLDER))
    assert told.count() == len(rows) and asked == [2]


def test_left_normalize_takes_bases_off_one_by_one_or_at_once():
    def plain(genome, pos, ref, alts):
        changed = True
        while changed:
            changed = False
            if all([ref, *alts]) and len({x[-1] for x in [ref, *alts]}) == 1:
                ref, alts, changed = ref[:-1], [x[:-1] for x in alts], True
            if not all([ref, *alts]):
                if pos == 0:
                    base = genome[len(ref)]
                    return pos, ref + base, [x + base for x in alts]
                pos -= 1
                ref, alts, changed = genome[pos] + ref, [genome[pos] + x for x in alts], True
        while min(map(len, [ref, *alts])) > 1 and len({x[0] for x in [ref, *alts]}) == 1:
            pos, ref, alts = pos + 1, ref[1:], [x[1:] for x in alts]
        return pos, ref, alts

    words = ["".join(x) for n in range(1, 5) for x in itertools.product("AC", repeat=n)]
    for seq in ("AACACACCAC", "CCCCCCCCCC", "ACACACACAC"):
        for pos, size, alt in itertools.product(range(5), range(1, 5), words):
            ref = seq[pos : pos + size]
            for alts in ([alt], [alt, alt[::-1] + "A"]):
                if ref not in alts:
                    assert left_normalize(seq, pos, ref, alts) == plain(seq, pos, ref, alts)


def test_duplicates_are_looked_for_in_written_rows(spark, monkeypatch):
    read = []
    monkeypatch.setattr(duplicates, "cluster", lambda rows, *rest, **more: read.append(plan(rows)) or clustering.cluster(rows, *rest, **more))
    told = QUERIES["set_duplicates"](spark, FOLDER)
    assert told.count() > 0 and len(read) == 2 and not any("Window" in p or "Join" in p for p in read)


def test_clustering_shuffles_no_column_twice(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(clustering, "keep", lambda df, name: seen.append(plan(df)) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        clustering.cluster(variants(spark, FOLDER, VARIED), genome(spark, FOLDER))
    assert "FlatMapCoGroupsInArrow" in seen[0] and "order0" not in seen[0] and "row_end" not in seen[0]


def test_clusters_read_once_are_not_written(spark, monkeypatch):
    kept, names = clustering.keep, []
    monkeypatch.setattr(clustering, "keep", lambda df, name: names.append(name) or kept(df, name))
    for q in ("cluster_haploid", "cluster_backwards"):
        assert QUERIES[q](spark, FOLDER).count() > 0
    assert names == ["changes", "carries"] * 2


def test_what_asks_is_told_once(spark, monkeypatch):
    plans, kept = {}, normalize.keep
    monkeypatch.setattr(normalize, "keep", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and kept(df, name))
    told = QUERIES["left_normalized"](spark, FOLDER)
    assert told.count() == variants(spark, FOLDER).count()
    assert plans["asking"].count("md5") <= 2 and "md5" not in told._jdf.queryExecution().optimizedPlan().toString()
