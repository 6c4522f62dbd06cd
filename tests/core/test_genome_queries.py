"""Clusters and matches over the varied genome against plain Python."""

import hashlib
from collections import defaultdict

import pytest

from donorframe.model import MAX_REPEAT, Scoring, scorings
from donorframe.operators.clustering import cluster
from donorframe.operators.matcher import match_clusters, rows_left
from donorframe.operators.search import Row, direct, hopeless
from donorframe.queries import QUERIES, VARIED, cuts, genome, variants

from .test_search import plain_best

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return variants(spark, FOLDER, VARIED).collect()


def bases(start, end):
    digest = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    digits = "".join("0123" * 8 if ord(digest(i // 4)[0]) % 4 == 0 else digest(i) for i in range(start // 32, end // 32 + 1))
    return "".join("ACGT"[int(x, 16) % 4] for x in digits[start % 32 :][: end - start])


def repeats(seq):
    return len(seq) == 1 or any(seq[: u * (len(seq) // u)] == seq[:u] * (len(seq) // u) for u in range(1, len(seq) // 2 + 1))


def plain_clusters(rows, genome=True):
    """One fold over each chromosome, without islands."""
    by_chrom = defaultdict(list)
    for r in rows:
        by_chrom[r.chrom].append(r)
    out = []
    for chrom in by_chrom.values():
        end, change = None, {}
        for r in sorted(chrom, key=lambda r: (r.pos, r.side != "query", r.row_id)):
            gap = None if end is None else r.pos - end
            most = max(change.get(("baseline", "i"), 0) + change.get(("query", "d"), 0), change.get(("query", "i"), 0) + change.get(("baseline", "d"), 0))
            tied = genome and gap is not None and 2 <= gap <= MAX_REPEAT and repeats(bases(end, r.pos))
            if gap is None or (gap >= 2 and (most == 0 or (gap > 2 * most and not tied))):
                out.append([])
                change = defaultdict(int)
            out[-1].append(r)
            end = max(end or 0, r.pos + len(r.ref))
            change[r.side, "i"] += r.mil
            change[r.side, "d"] += r.mdl
    return out


def named(clusters):
    return {frozenset((r.row_id, r.pos, r.qual) for r in c) for c in clusters}


def test_refs_are_those_of_the_genome(rows):
    assert all(r.ref == bases(r.pos, r.pos + 1) and r.ref not in r.alts for r in rows)


def test_clusters(spark, rows):
    got = defaultdict(list)
    for r in QUERIES["cluster_general"](spark, FOLDER).collect():
        got[r.cluster_id].append(r)
    assert named(got.values()) == named(plain_clusters(rows)) != named(plain_clusters(rows, genome=False))


@pytest.fixture(scope="module")
def searched(spark):
    g = genome(spark, FOLDER)
    found = match_clusters(cluster(variants(spark, FOLDER, VARIED), g), g, cuts(spark, FOLDER), scorings())
    return found.select("unit", "mode", "scheme", "t", "chrom", "pos", "status", "score", "cluster_id").collect()


def test_the_queries_are_the_modes_of_one_run(spark, searched):
    got = QUERIES["match_search_1_0_2"](spark, FOLDER).collect()
    want = [r for r in searched if (r.unit, r.mode, r.scheme) == (1, 0, 2)]
    key = lambda r: (r.t, r.cluster_id, r.pos, r.status, str(r.score))
    assert sorted(map(key, got)) == sorted(map(key, want)) and {r.status for r in got} >= {"equal", "search"}


def test_equal_pairs_are_settled_in_every_mode(spark, rows, searched):
    low = {r.t: r.qual_min for r in cuts(spark, FOLDER).collect()}
    want = set()
    for c in plain_clusters(rows):
        for t, q in low.items():
            some = [r for r in c if r.qual >= q]
            if len(some) == 2 and {r.side for r in some} == {"baseline", "query"} and direct([Row.of(r.asDict()) for r in some]):
                want |= {(s.unit, s.mode, s.scheme, t, c[0].chrom, some[0].pos) for s in scorings()}
    got = [(r.unit, r.mode, r.scheme, r.t, r.chrom, r.pos) for r in searched if r.status == "equal"]
    assert set(got) == want and len(got) == len(want) > 0


@pytest.mark.parametrize("scoring", [(s.unit, s.mode, s.scheme) for s in scorings()])
def test_matches_at_all_cut_offs(spark, rows, searched, scoring):
    found = [r for r in searched if (r.unit, r.mode, r.scheme) == scoring and r.status == "search"]
    got, want = defaultdict(list), defaultdict(list)
    for t, low in [(r.t, r.qual_min) for r in cuts(spark, FOLDER).collect()]:
        for c in plain_clusters(rows):
            some = [Row.of({**r.asDict(), "side": r.side}) for r in c if r.qual >= low]
            if {r.side for r in some} != {0, 1} or len(some) > 5 or hopeless(some) or (len(some) == 2 and direct(some)):
                continue
            # the plain version takes two changes of one side at one position for an overlap, the search may take both
            if len({(r.side, r.pos) for r in some}) < len(some):
                continue
            start, end = max(0, min(r.pos for r in some) - 1), max(r.pos + len(r.ref) for r in some) + 1
            want[t, c[0].chrom, start].append(plain_best(some, bases(start, end), start, Scoring(*scoring)))
    for r in found:
        got[r.t, r.chrom, r.pos].append(r.score)
    assert {r.t for r in found} >= {0, 1, 2, 3}  # few rows reach the last cut-off
    assert want and {k: v for k, v in want.items() if got.get(k, [0]) != v} == {}


def test_thresholds_that_leave_the_same_rows_go_on_as_one(spark):
    schema = "cluster_id string, gathered array<struct<pos: int, qual: double>>"
    clusters = spark.createDataFrame([("a", [(1, 0.5), (2, 9.0), (3, None)]), ("b", [(5, 7.0)])], schema)
    cuts = spark.createDataFrame([(0, 0.0), (1, 0.2), (2, 0.2), (3, 8.0), (4, 10.0)], "t int, qual_min double")
    got = {(r.cluster_id, tuple(x.pos for x in r.rows)): r.ts for r in rows_left(clusters, cuts).collect()}
    assert got == {("a", (1, 2)): [0, 1, 2], ("a", (2,)): [3], ("a", ()): [4], ("b", (5,)): [0, 1, 2], ("b", ()): [3, 4]}
