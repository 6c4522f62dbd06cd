"""Stages of the pipeline on rows with null, repeated and shared ids."""

import corpus_pipeline as cp
import pytest

SF = "/root/testdata/sf0.001"
JUNK = "The*** thonea&&& was$$$ ### of%%% " * 10
GOOD = "The thonea was of the ernt and this is a plain text that says many different things"
OTHER = "Nobody knew how the river came to bend so far away from its former bed that year"


def through(spark, stage, rows):
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    return sorted(((r.doc_id, r.text) for r in cp.STAGES[stage][1](spark, docs, SF).collect()), key=str)


def test_quality(spark):
    rows = [(None, JUNK), (None, GOOD), (5, JUNK), (5, GOOD), (6, GOOD)]
    assert through(spark, 0, rows) == sorted([(None, GOOD), (5, GOOD), (6, GOOD)], key=str)


def test_near_dedup(spark):
    long = " ".join(f"word{i}" for i in range(60))
    near = long + " more"
    rows = [(None, GOOD), (3, GOOD), (3, GOOD), (2, OTHER), (3, OTHER), (None, long), (None, near), (None, long), (9, ""), (None, "")]
    got = through(spark, 1, rows)
    rest = [x for x in got if x[1] not in (long, near)]
    assert rest == sorted([(3, GOOD), (2, OTHER), (9, ""), (None, "")], key=str)
    assert len(got) == len(rest) + 1


@pytest.mark.parametrize("doc_id", [None, 7])
def test_decontamination(spark, doc_id):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(doc_id, f"{OTHER} {item} {OTHER}"), (doc_id, GOOD), (8, OTHER)]
    assert through(spark, 2, rows) == sorted([(doc_id, GOOD), (8, OTHER)], key=str)
