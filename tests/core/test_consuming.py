import itertools
import random

import pytest
from pyspark.sql import functions as F

from donorframe.functions.alignment import left_normalize
from donorframe.operators.clustering import HAPLOID, cluster
from donorframe.operators.consuming import best_match, consuming_matches, rounds
from donorframe.operators.normalize import normalize_variants
from donorframe.queries import QUERIES, VARIED, genome, variants

FOLDER = "/root/testdata/sf0.001"


def donor_of(pick, window):
    """The donor of rows in order, or None if they overlap."""
    if any(b[0] < a[0] + len(a[1]) for a, b in zip(pick, pick[1:])):
        return None
    out, at = "", 0
    for pos, ref, alt, _ in pick:
        out, at = out + window[at:pos] + alt, pos + len(ref)
    return out + window[at:]


def plain_match(baseline, query, window):
    """All subsets of both sides: large query subsets first, in the order of combinations; of the baseline's, small ones and
    the last of these."""
    order = lambda r: (r[0], *r[1:])
    baseline, query = sorted(baseline, key=order), sorted(query, key=order)
    held = {}
    for n in range(len(baseline), 0, -1):
        for pick in itertools.combinations(baseline, n):
            if (d := donor_of(pick, window)) is not None:
                held[d] = pick
    for n in range(len(query), 0, -1):
        for pick in itertools.combinations(query, n):
            if (d := donor_of(pick, window)) in held and d is not None:
                return list(held[d]), list(pick), d
    return None


def plain_rounds(baseline, query, window):
    while baseline and query and (found := plain_match(baseline, query, window)):
        yield found
        baseline, query = ([r for r in side if r not in used] for side, used in zip((baseline, query), found))


def made(rng, most):
    window = "".join(rng.choice(rng.choice(["ACGT", "AC", "A"])) for _ in range(rng.randint(6, 24)))
    pool = {}
    for _ in range(2 * most):
        pos = rng.randrange(len(window))
        ref = window[pos : pos + rng.choice([1, 1, 1, 2, 3])]
        pool[pos, ref, rng.choice([x for x in ["A", "C", "G", "T", "AC", "CA", "AA", ref[0], ref + ref[0], "ACA"] if x != ref])] = len(pool)
    sides = [[(*k, i) for k, i in rng.sample(sorted(pool.items()), min(len(pool), rng.randint(1, most)))] for _ in range(2)]
    return *sides, window


@pytest.mark.parametrize("seed", range(5))
def test_rounds_equal_all_subsets(seed):
    rng = random.Random(seed)
    several = 0
    for _ in range(120):
        b, q, window = made(rng, 8)
        got = [(set(x), set(y), d) for _, x, y, d in rounds(b, q, window)]
        want = [(set(x), set(y), d) for x, y, d in plain_rounds(b, q, window)]
        assert got == want, (b, q, window)
        several += len(got) > 1
    assert several > 5


def test_many_rows_and_the_budget():
    rng = random.Random(1)
    window = "".join(rng.choice("ACGT") for _ in range(200))
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    single = [(p, window[p], other[window[p]], p) for p in range(2, 190, 4)]
    pairs = [(p, window[p : p + 2], other[window[p]] + window[p + 1], 1000 + p) for p in range(2, 190, 4)]
    got = list(rounds(pairs, single, window))
    assert len(got) == 1 and len(got[0][1]) == len(got[0][2]) == 47  # 2 ** 47 subsets a side
    repeat = "A" * 60
    rows = [(p, "A", "A" * n, p * 10 + n) for p in range(2, 50, 2) for n in (2, 3)]
    assert best_match(rows, rows, repeat) not in (None, "budget") and best_match(rows, rows, repeat, 3) == "budget"


@pytest.fixture(scope="module")
def clustered(spark):
    return cluster(variants(spark, FOLDER, VARIED), genome(spark, FOLDER), rule=HAPLOID)


def test_view_equals_all_subsets(spark, clustered):
    found = {}
    for r in QUERIES["match_consuming"](spark, FOLDER).collect():
        assert r.status == "match"
        found.setdefault(r.cluster_id, []).append((r.round, r.b_rows, r.q_rows, r.pos, r.ref, r.alt))
    bases = {(r.chrom, r.chunk_id): r.seq for r in genome(spark, FOLDER).collect()}
    by = {}
    for r in clustered.collect():
        by.setdefault(r.cluster_id, []).append(r)
    checked = 0
    for c, rows in by.items():
        b, q = ([r for r in rows if r.side == s] for s in ("baseline", "query"))
        if not b or not q or len(b) == len(q) == 1 or max(len(b), len(q)) > 8:
            continue
        start, end = max(min(r.pos for r in rows) - 1, 0), max(r.pos + len(r.ref) for r in rows) + 1
        seq = "".join(bases[rows[0].chrom, i] for i in range(start >> 12, (end >> 12) + 1))[start & 4095 :][: end - start]
        sides = [[(r.pos - start, r.ref, r.alts[0], r.row_id) for r in side] for side in (b, q)]
        want = [(n, *("/".join(str(v[3]) for v in used) for used in x[:2])) for n, x in enumerate(plain_rounds(*sides, seq))]
        assert [x[:3] for x in sorted(found.get(c, []))] == want
        checked += 1
    assert checked > 20 and len(found) > 3


def test_consuming_cases(spark, clustered):
    g = genome(spark, FOLDER)
    assert consuming_matches(clustered.where(F.lit(False)), g).count() == 0
    given_up = consuming_matches(clustered, g, budget=1).groupBy("status").count().collect()
    assert {r.status for r in given_up} >= {"budget"}
    assert consuming_matches(clustered, g, singles=True).count() >= consuming_matches(clustered, g).count()


def test_normalize_over_chunks(spark):
    rng = random.Random(7)
    seq = "GATTACA" + "".join(rng.choice("ACGT") for _ in range(50)) + "AC" * 700 + "GT" + "".join(rng.choice("AC") for _ in range(300)) + "T" * 90 + "G"
    g = spark.createDataFrame([("1", i, i * 128, seq[i * 128 : (i + 1) * 128]) for i in range(len(seq) // 128 + 1)], "chrom string, chunk_id int, start int, seq string")
    rows = [(1, "1", 1400, seq[1400:1403], [seq[1400]]), (2, "1", 0, "G", ["GG"]), (3, "1", 5, "C", ["C"]), (4, "1", 9, None, ["A"]), (5, "1", 9, seq[9], None), (6, None, 9, "A", ["C"]), (7, "2", 9, "A", ["C"]), (8, "1", 60, "Q", ["C"]), (9, "1", len(seq) - 3, "T", ["TT", "TTT"]), (10, "1", 1450, seq[1450:1452], [seq[1450:1452] * 2, seq[1450]])]
    for i in range(300):
        pos = rng.randrange(1, len(seq) - 5)
        ref = seq[pos : pos + rng.choice([1, 1, 2, 3])]
        alts = [a for a in dict.fromkeys(rng.choice([ref + ref, ref[0], ref + "A", ref + "AC", "C", "GT"]) for _ in range(rng.choice([1, 1, 2]))) if a != ref]
        rows.append((100 + i, "1", pos, ref, alts))
    df = spark.createDataFrame([(*r, "w") for r in rows], "row_id long, chrom string, pos int, ref string, alts array<string>, window string").repartition(3)
    got = {r.row_id: (r.pos, r.ref, r.alts) for r in normalize_variants(df, g, chunk=128).collect()}
    moved = 0
    for i, chrom, pos, ref, alts in rows:
        fine = chrom == "1" and ref and alts and ref not in alts and seq[pos : pos + len(ref)] == ref
        want = left_normalize(seq, pos, ref, alts) if fine else (pos, ref, alts)
        assert got[i] == want, (i, pos, ref, alts)
        moved += pos - want[0] > 200
        if fine:  # the same donors
            assert all(seq[:pos] + a + seq[pos + len(ref) :] == seq[: want[0]] + b + seq[want[0] + len(want[1]) :] for a, b in zip(alts, want[2]))
    assert len(got) == len(rows) and moved > 3 and got[1][0] < 60
    assert normalize_variants(df.where(F.lit(False)), g).count() == 0


def test_normalized_view(spark):
    bases = {}
    for r in genome(spark, FOLDER).collect():
        bases.setdefault(r.chrom, {})[r.chunk_id] = r.seq
    bases = {c: "".join(s[i] for i in range(len(s))) for c, s in bases.items()}
    want = sorted((r.row_id, r.qual, r.chrom, *left_normalize(bases[r.chrom], r.pos, r.ref, r.alts)) for r in variants(spark, FOLDER, VARIED).collect())
    got = sorted((r.row_id, r.qual, r.chrom, r.pos, r.ref, r.alt.split("/")) for r in QUERIES["left_normalized"](spark, FOLDER).collect())
    assert got == want
