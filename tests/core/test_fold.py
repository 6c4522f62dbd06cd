"""The clustering fold, taken apart into stretches."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from donorframe.operators.clustering import HAPLOID, LIVE, ONE_SET, carries, cluster, summary


def fold(most, du, dv, u=0, v=0, n=0):
    out = []
    for m, x, y in zip(most, du, dv):
        if max(u, v) <= m:
            u, v, n = 0, 0, n + 1
        u, v = u + x, v + y
        out.append(n)
    return out, u, v


@pytest.mark.parametrize("seed", range(6))
def test_summaries_compose_to_the_fold(seed):
    rng = random.Random(seed)
    for _ in range(150):
        n = rng.randint(1, 60)
        most = [rng.choice([-1, -1, 0, 1, 2, 5, 40, 600]) for _ in range(n)]
        du, dv = ([rng.choice([0, 0, 0, 1, 3, 30]) for _ in range(n)] for _ in range(2))
        cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 8)))) if n > 1 else []
        parts = list(zip([0, *cuts], [*cuts, n]))
        told = []
        for i, (a, b) in enumerate(parts):
            bounds, u, v = summary(most[a:b], du[a:b], dv[a:b])
            # no bound is within one before it
            assert all(not any(x[0] <= y[0] and x[1] <= y[1] for y in bounds[:k]) for k, x in enumerate(bounds))
            told.append(("1", i, [dict(zip("abuvn", x)) for x in bounds], u, v))
        carry = carries(pd.DataFrame(told[::-1], columns=["chrom", "stretch", "bounds", "u", "v"]))
        got = []
        for (a, b), r in zip(parts, carry.itertuples()):
            got += fold(most[a:b], du[a:b], dv[a:b], r.u_in, r.v_in, r.n_in)[0]
        assert got == fold(most, du, dv)[0]


def plain(rows, genome, two_sides, free):
    """Sets of row numbers, one row after the other; rows: (pos, ref, alt, side, number)."""
    repeat = lambda s: len(s) == 1 or any(s[: u * (len(s) // u)] == s[:u] * (len(s) // u) for u in range(1, len(s) // 2 + 1))
    out, end, ins, dele = [], None, {"baseline": 0, "query": 0}, {"baseline": 0, "query": 0}
    for pos, ref, alt, side, i in sorted(rows, key=lambda r: (r[0], r[3] != "query", r[4])):
        change = max(ins["baseline"] + dele["query"], ins["query"] + dele["baseline"]) if two_sides else max(sum(ins.values()), sum(dele.values()))
        gap = None if end is None else pos - end
        if gap is None or (gap >= 2 and ((free and change == 0) or (gap > 2 * change and (gap > 1000 or not repeat(genome[end:pos]))))):
            out.append(set())
            ins, dele = {"baseline": 0, "query": 0}, {"baseline": 0, "query": 0}
        out[-1].add(i)
        end = max(end or 0, pos + len(ref))
        ins[side] += max(0, len(alt) - len(ref))
        dele[side] += max(0, len(ref) - len(alt))
    return sorted(map(sorted, out))


@pytest.mark.parametrize("rule", [LIVE, HAPLOID, ONE_SET])
def test_one_dense_chromosome_in_many_stretches(spark, rule):
    rng = random.Random(3)
    genome = "".join(rng.choice("AC") for _ in range(16_384))
    rows, at = [], 3
    while at < 16_000:  # no gap of over 1000 bases, so there is nothing that ends every cluster
        ref = genome[at : at + rng.choice([1] * 30 + [2, 40])]
        rows.append((at, ref, ref[0] + "T" * rng.choice([0] * 30 + [1, 30]), rng.choice(["baseline", "query"]), len(rows)))
        at += rng.choice([0, 1, 2, 3, 5, 30, 90, 400])
    df = spark.createDataFrame([(i, s, 1, "1", p, r, [a], max(0, len(a) - len(r)), max(0, len(r) - len(a))) for p, r, a, s, i in rows], "row_id long, side string, query_id int, chrom string, pos int, ref string, alts array<string>, mil int, mdl int")
    bases = spark.createDataFrame([("1", i, i * 4096, genome[i * 4096 : (i + 1) * 4096]) for i in range(4)], "chrom string, chunk_id int, start int, seq string")
    got = {}
    found = cluster(df.repartition(3), bases, rule=rule, width=256)
    for r in found.collect():
        got.setdefault(r.cluster_id, []).append(r.row_id)
    assert sorted(map(sorted, got.values())) == plain(rows, genome, rule.two_sides, rule.free)
    assert found.columns == [*df.columns, "cluster_id"] and len(got) > 20
    assert cluster(df.where(F.lit(False)), bases).count() == 0
