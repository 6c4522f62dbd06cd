"""Queries over whole tables against plain Python."""

from collections import defaultdict

import pytest

from donorframe.queries import QUERIES, variants

FOLDER = "/root/testdata/sf0.001"


def test_match_diff_takes_all_rows(spark):
    files = defaultdict(list)
    for r in variants(spark, FOLDER).collect():
        files[r.chrom, r.pos, r.row_id % 2].append((r.ref, "/".join(r.alts)))
    places = defaultdict(list)
    for (chrom, pos, file_id), rows in files.items():
        places[chrom, pos].append((file_id, min(x for x, _ in rows), max(y for _, y in rows)))
    want = {(*k, len(v), ";".join(f"{f}={alt}" for f, _, alt in sorted(v))) for k, v in places.items() if len(v) < 2 or len({x[1:] for x in v}) > 1}
    got = [(r.chrom, r.pos, r.n_files, r.donors) for r in QUERIES["match_diff_whole"](spark, FOLDER).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {pos % 7 for _, pos, *_ in want} == set(range(7))


@pytest.mark.parametrize("name,inside", [("bed_inside_whole", True), ("bed_outside_whole", False)])
def test_bed_takes_all_parts(spark, name, inside):
    regions = defaultdict(list)
    for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect():
        regions[str(1 + r.p_partkey % 20)].append((r.p_partkey * 50, r.p_partkey * 50 + r.p_size * 8))
    want = [(r.row_id, r.chrom, r.pos, r.qual) for r in variants(spark, FOLDER).collect() if r.chrom not in regions or any(s <= r.pos < e for s, e in regions[r.chrom]) == inside]
    got = [(r.row_id, r.chrom, r.pos, r.qual) for r in QUERIES[name](spark, FOLDER).collect()]
    assert sorted(got) == sorted(want) and got
