import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from donorframe.llm.quality import LABELLERS, HashFilter, classify, expectation_maximisation, keep_good, measures, vote
from donorframe.llm.textcore import buffers

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    seen = labels.where("doc_id % 4 != 0")
    held = classify(docs, seen).join(labels.where("doc_id % 4 = 0"), "doc_id")
    rows = held.groupBy(((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"), "rejected").count().collect()
    n = {(r.bad, r.rejected): r["count"] for r in rows}
    assert n.get((False, True), 0) <= 0.01 * n[(False, False)]
    assert n[(True, True)] >= 0.85 * (n[(True, True)] + n.get((True, False), 0))


def test_cases(spark):
    junk, good = "The*** thonea&&& was$$$ ### of%%% " * 10, "The thonea was of the ernt and this is a plain text that says many different things " * 1
    rows = [(1, None), (2, ""), (3, good), (3, good), (None, junk), (5, junk), (6, "LA SE QUE MENTE OTRA COSA!! " * 9), (7, "Der " * 300), (8, "x"), (9, good * 2)]
    df = spark.createDataFrame([(a, b, "q") for a, b in rows], "doc_id long, text string, votes string")
    got = sorted((r.doc_id or 0, r.rejected) for r in classify(df).collect())
    assert got == [(0, True), (1, False), (2, False), (3, False), (3, False), (5, True), (6, True), (7, True), (8, False), (9, False)]
    assert sorted(r.doc_id or 0 for r in keep_good(df).collect()) == [0, 1, 2, 3, 3, 8, 9] and keep_good(df).columns == df.columns
    assert classify(df.limit(0)).count() == 0


def test_measures_and_votes():
    texts = ["a b | - c", "", "WOW!! NO!! " * 10, "so so so it is " * 10]
    m = measures(*buffers(pa.array(texts)))
    assert m["n_words"].tolist() == [5, 0, 20, 50] and m["bare_marks"].tolist()[0] == 0.4 and m["exclaiming"].tolist()[2] == 1 and m["stuttering"].tolist()[3] == 0.4
    v = vote(*buffers(pa.array(texts)), HashFilter(np.zeros(0, np.uint64)))
    assert v.shape == (len(LABELLERS), 4) and (v[:, 1] == 0).all()


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    bad = rng.random(20_000) < 0.2
    votes = np.zeros((len(LABELLERS), len(bad)), int)
    for i in range(7):
        votes[i] = np.where(rng.random(len(bad)) < np.where(bad, 0.5, 0.0005 * (i + 1)), 2, 0)
    for i in (7, 8):
        votes[i] = rng.random(len(bad)) < np.where(bad, 0.1, 0.8)
    p, n = np.unique((3 ** np.arange(len(LABELLERS))) @ votes, return_counts=True)
    post, table = expectation_maximisation(dict(zip(p.tolist(), n.tolist())))
    said = np.array([post[int(x)] > 0.5 for x in (3 ** np.arange(len(LABELLERS))) @ votes])
    assert (said == bad).mean() > 0.97 and abs(table[0, 1, 2] - 0.5) < 0.05 and table[7, 0, 1] > 0.7
