import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from donorframe.operators.subsets import best_equal, duplicates_within, equal_donors, in_any_equal, subset_donors

GENOME = "GATTACAGATTACCA" * 4


def corpus(seed, clusters=12):
    rng, rows = random.Random(seed), []
    for c in range(clusters):
        start = rng.randrange(5, 30)
        for side in ("baseline", "query"):
            for _ in range(rng.randint(1, 5)):
                pos = start + rng.randrange(12)
                ref = GENOME[pos : pos + rng.choice([1, 1, 1, 2])]
                alt = rng.choice([x for x in ("A", "C", "G", "T", "GA", "TA", ref[0]) if x != ref])
                rows.append((f"c{c}", side, len(rows), pos, ref, alt))
    return rows


def plain(rows):
    """(cluster, side) -> donor -> subsets (row ids), and each cluster's pairs of equal subsets."""
    by, spans = defaultdict(list), {}
    for r in rows:
        by[r[0], r[1]].append(r)
        a, b = spans.get(r[0], (10**9, 0))
        spans[r[0]] = min(a, r[3]), max(b, r[3] + len(r[4]))
    out = defaultdict(lambda: defaultdict(list))
    for key, rs in by.items():
        rs.sort(key=lambda r: (r[3], r[4], r[5], r[2]))
        start, end = spans[key[0]]
        for n in range(1, len(rs) + 1):
            for pick in itertools.combinations(rs, n):
                if all(b[3] >= a[3] + len(a[4]) for a, b in zip(pick, pick[1:])):
                    s = GENOME[start:end]
                    for r in reversed(pick):
                        s = s[: r[3] - start] + r[5] + s[r[3] - start + len(r[4]) :]
                    out[key][s].append(frozenset(r[2] for r in pick))
    return out


@pytest.fixture(scope="module")
def made(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(c, "1", s, i, p, r, [a]) for c, s, i, p, r, a in rows], "cluster_id string, chrom string, side string, row_id long, pos int, ref string, alts array<string>")
    genome = spark.createDataFrame([("1", 0, 0, GENOME)], "chrom string, chunk_id int, start int, seq string")
    return rows, df, genome


def test_equal_donors(made):
    rows, df, genome = made
    want = set()
    found = plain(rows)
    for (c, side), donors in found.items():
        if side == "baseline":
            want |= {(c, b, q) for d, bs in donors.items() for b in bs for q in found.get((c, "query"), {}).get(d, [])}
    donors = subset_donors(df, genome)
    ids = lambda x: frozenset(r.row_id for r in x)
    got = [(r.cluster_id, ids(r.b_rows), ids(r.q_rows)) for r in equal_donors(donors).collect()]
    assert set(got) == want and len(got) == len(want) > 0
    most = {c: max(len(b) + len(q) for x, b, q in want if x == c) for c, _, _ in want}
    assert {r.cluster_id: r.n for r in best_equal(donors).collect()} == most
    assert {(r.cluster_id, r.row_id) for r in in_any_equal(donors).collect()} == {(c, i) for c, b, q in want for i in b | q}


def test_duplicates_within_one_set(made):
    rows, df, genome = made
    extra = [("x", "1", "query", 900, 20, "C", ["G"]), ("x", "1", "query", 901, 21, "A", ["T"]), ("x", "1", "query", 902, 20, "CA", ["GT"]), ("x", "1", "query", 903, 30, "A", ["C"]), ("x", "1", "query", 904, 30, "A", ["C"])]
    extra = [(c, h, s, i, p, GENOME[p : p + len(r)], a) for c, h, s, i, p, r, a in extra]
    extra = [e for e in extra if e[5] != e[6][0]]
    both = df.unionByName(df.sparkSession.createDataFrame(extra, df.schema))
    got = duplicates_within(both, genome).collect()
    found = plain(rows + [(c, s, i, p, r, a[0]) for c, _, s, i, p, r, a in extra])
    for r in got:
        a, b = frozenset(r.first), frozenset(r.second)
        assert not a & b and any({a, b} <= set(x) for x in found[r.cluster_id, r.side].values())
    for (c, side), donors in found.items():
        gone = {i for r in got if (r.cluster_id, r.side) == (c, side) for i in [*r.first, *r.second]}
        left = [[x for x in same if not x & gone] for same in donors.values()]
        assert not any(not a & b for same in left for a, b in itertools.combinations(same, 2))
    told = {(r.round, tuple(sorted([tuple(r.first), tuple(r.second)]))) for r in got if r.cluster_id == "x"}
    assert {x[1] for x in told} == {((900, 901), (902,)), ((903,), (904,))}
    assert duplicates_within(both.where(F.lit(False)), genome).count() == 0
