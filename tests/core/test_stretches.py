"""Duplicates are searched where rows and bases of a stretch meet, with the results of the plain way."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from donorframe.operators import clustering, duplicates
from donorframe.operators.clustering import ONE_SET, cluster, split_clusters
from donorframe.operators.duplicates import first_duplicate, first_of_few, set_duplicates
from donorframe.queries import QUERIES, VARIED, variants
from donorframe.sources.readers import first_of_each

from .test_consuming import FOLDER, made

ROWS = "row_id long, side string, query_id int, chrom string, pos int, ref string, alts array<string>, mil int, mdl int"


def table(spark, rows):
    return spark.createDataFrame([(i, "query", 1, "1", p, r, [a], max(0, len(a) - len(r)), max(0, len(r) - len(a))) for i, (p, r, a) in rows], ROWS)


def chunks(spark, seq):
    return spark.createDataFrame([("1", i, i * 4096, seq[i * 4096 : (i + 1) * 4096]) for i in range((len(seq) + 4095) // 4096)], "chrom string, chunk_id int, start int, seq string")


@pytest.fixture(scope="module")
def dense():
    """Rows with duplicates, some over the borders of chunks, one cluster of over 20 rows, and some rows twice."""
    rng = random.Random(7)
    seq, other, rows = "".join(rng.choice("ACGT") for _ in range(9_000)), {"A": "C", "C": "G", "G": "T", "T": "A"}, []
    for at in [*range(10, 8_900, 60), 4_095, 8_190]:
        two = seq[at : at + 2]
        alt = other[two[0]] + other[two[1]]
        rows += [(at, two, alt), (at, two[0], alt[0]), (at + 1, two[1], alt[1])] if at % 120 == 10 or at in (4_095, 8_190) else [(at, two[0], alt[0])] * 2
    rows += [(3_000 + i, seq[3_000 + i], other[seq[3_000 + i]]) for i in range(1, 40) if (3_000 + i - 10) % 60 > 1]
    return seq, list(enumerate(rows))


def plainly(df):
    return sorted((r.cluster_id.count(":"), r.round, r.status, str(r.set1), str(r.set2), r.pos, r.ref, r.alt) for r in df.collect())


def test_stretches_do_not_matter(spark, dense):
    seq, rows = dense
    want = plainly(set_duplicates(table(spark, rows), chunks(spark, seq)))
    assert len(want) > 70 and any("pos=4095" in r[3] for r in want)
    assert plainly(set_duplicates(table(spark, rows[::-1]), chunks(spark, seq), width=256)) == want
    # a window that the genome does not cover is put together apart
    few = [r for r in rows if r[1][0] + len(r[1][1]) <= 8_192]
    less = [plainly(set_duplicates(table(spark, few), chunks(spark, seq[:8_192]), width=w)) for w in (256, 1 << 18)]
    assert less[0] == less[1] and any("pos=8190" in r[3] for r in less[0]) and len(less[0]) < len(want)


def test_first_of_equal_rows_in_the_stretch(spark, dense):
    seq, rows = dense
    g, df = chunks(spark, seq), table(spark, rows).unionByName(table(spark, [(i + 1_000, r) for i, r in rows[::3]]).withColumn("query_id", F.lit(2)))
    want = sorted(map(tuple, cluster(first_of_each(df), g, rule=ONE_SET).select("row_id", "cluster_id").collect()))
    assert sorted(map(tuple, cluster(df, g, rule=ONE_SET, first=True).select("row_id", "cluster_id").collect())) == want and len(want) < df.count()
    found = cluster(df, g, rule=ONE_SET, width=256, home=True, once=True)
    begin = found.groupBy("cluster_id").agg(F.floor(F.min("pos") / 256).alias("at"), F.min("home").alias("least"), F.max("home").alias("most"))
    assert begin.where("at <> least OR at <> most").count() == 0 and begin.where("at > 0").count() > 20


@pytest.mark.parametrize("seed", range(3))
def test_few_rows_as_many(seed):
    rng, hits = random.Random(seed), 0
    for _ in range(150):
        a, b, window = made(rng, 3)
        rows = [(*r[:3], i) for i, r in enumerate(dict.fromkeys(r[:3] for r in a + b))]
        got = first_of_few(rows, window)
        assert got == first_duplicate(rows, window), (rows, window)
        hits += got is not None
    assert hits > 3


def test_split_by_the_first_row_in_order(spark):
    """Of rows that begin together the first by number counts, whatever the order in which they come."""
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(50)) + "AC" * 60 + "GGTT" * 5
    rows = [(2, (10, seq[10], "T" if seq[10] != "T" else "G")), (1, (10, seq[10:50], "")), (3, (160, seq[160], "G"))]
    for order in (rows, rows[::-1]):
        df = table(spark, order).coalesce(1).withColumn("cluster_id", F.lit("1:0"))
        parts = {r.row_id: r.cluster_part for r in split_clusters(df, chunks(spark, seq), one_set=True).collect()}
        # what lies between is a tandem repeat from the end of row 1 on, not from that of row 2
        assert parts == {1: 0, 2: 0, 3: 0}


def test_rows_are_not_gathered_and_written_again(spark, monkeypatch):
    names = []
    for module in (clustering, duplicates):
        monkeypatch.setattr(module, "keep", lambda df, name, kept=module.keep: names.append(name) or kept(df, name))
    assert QUERIES["set_duplicates"](spark, FOLDER).count() > 0
    assert [n for n in names if n != "apart"] == ["changes", "carries", "found"] * 2


def test_rows_of_several_alts_are_left_out_without_hashing_anew(spark):
    told = first_of_each(variants(spark, FOLDER, VARIED))
    assert told._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 2
    rows = spark.createDataFrame([(1, ["C", "G"]), (2, ["C"]), (3, ["C"]), (4, ["G", "C"]), (5, None), (6, [])], "row_id long, alts array<string>").selectExpr("*", "'query' AS side", "1 AS query_id", "'1' AS chrom", "5 AS pos", "'A' AS ref")
    assert [r.row_id for r in first_of_each(rows).collect()] == [2]


def test_columns_as_lists():
    for column in (["a", None], ["a", "b"], [1, 2], [1, None], []):
        assert clustering.as_list(pa.chunked_array([pa.array(column)])) == column
