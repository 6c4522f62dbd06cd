import itertools
import random

import pytest
from pyspark.sql import functions as F

from donorframe.model import scorings
from donorframe.operators.clustering import cluster
from donorframe.operators.matcher import match_clusters
from donorframe.operators.strands import best_phases, match_strands, phases_of, resolve, spelled
from donorframe.queries import QUERIES, VARIED, cuts, genome, variants, with_joint_rows

FOLDER = "/root/testdata/sf0.001"


def donors(rows, used, window):
    """Both strands of one side, or None where rows of one strand overlap."""
    for strand in (0, 1):
        end = 0
        for (pos, _, ref, _), alleles in zip(rows, used):
            if alleles and alleles[strand] is not None:
                if pos < end:
                    return None
                end = pos + len(ref)
    return spelled(rows, used, window)


def plain(rows, window, bases):
    """The best score over all choices."""
    sides = [[r for r in rows if r[1] == s] for s in (-1, 1)]
    weigh = lambda part, used: sum((len(r[2]) if bases else 1) for r, u in zip(part, used) if u)
    held = {}
    for used in itertools.product(*((None, *r[3]) for r in sides[0])):
        if (d := donors(sides[0], used, window)) is not None:
            held[tuple(d)] = max(held.get(tuple(d), 0), weigh(sides[0], used))
    best = 0
    for used in itertools.product(*((None, *r[3]) for r in sides[1])):
        d = donors(sides[1], used, window)
        if d is not None and tuple(d) in held:
            best = max(best, held[tuple(d)] + weigh(sides[1], used))
    return best


def made(rng):
    window = "".join(rng.choice(rng.choice(["ACGT", "AC"])) for _ in range(rng.randint(5, 12)))
    rows = []
    for side in (-1, 1):
        for _ in range(rng.randint(1, 4)):
            if side == 1 and rng.random() < 0.5:
                pos, _, ref, phases = rng.choice(rows)
                rows.append((pos, 1, ref, phases))
                continue
            pos = rng.randrange(len(window))
            ref = window[pos : pos + rng.choice([1, 1, 1, 2])]
            alts = rng.sample([x for x in ["A", "C", "G", "T", "AC", ref + ref[0], ref[0]] if x != ref], 2)
            het, multi, zero_one = rng.choice([(True, False, True), (False, False, False), (True, True, False), (True, True, True)])
            rows.append((pos, side, ref, phases_of(alts, het, multi, zero_one)))
    return sorted(rows, key=lambda r: (r[0], -r[1])), window


@pytest.mark.parametrize("seed", range(6))
def test_best_score_over_all_choices(seed):
    rng, some = random.Random(seed), 0
    for _ in range(60):
        rows, window = made(rng)
        for bases in (False, True):
            found, want = best_phases(rows, window, bases), plain(rows, window, bases)
            assert (found[0] if found else 0) == want, (rows, window)
            if found:
                used, told = resolve(rows, found[1], window)
                for side in (-1, 1):
                    assert donors([r for r in rows if r[1] == side], [u for r, u in zip(rows, used) if r[1] == side], window) == told
                assert sum((len(r[2]) if bases else 1) for r, u in zip(rows, used) if u) == want
                some += 1
    assert some > 20


def test_both_pairings_and_the_budget():
    # 1|0 and 0|1 of the baseline in one row, as two alts of the query
    rows = [(1, 1, "C", (("A", "G"), ("G", "A"))), (1, -1, "C", (("A", None), (None, "A"))), (1, -1, "C", (("G", None), (None, "G")))]
    assert best_phases(rows, "ACGT")[0] == 3 and best_phases(rows, "ACGT", budget=1) == "budget"


def test_view_scores_equal_the_search(spark):
    g = genome(spark, FOLDER)
    plainly = cluster(variants(spark, FOLDER, VARIED), g)
    # the query says what pairs of baseline rows say
    said = with_joint_rows(variants(spark, FOLDER, VARIED).where("side = 'baseline'"), g)
    clustered = cluster(said.withColumn("side", F.when(F.col("row_id") < 0, "query").otherwise(F.col("side"))), g)
    by = {}
    for r in clustered.collect():
        by.setdefault(r.cluster_id, []).append(r)
    # the other search lets an insertion stand behind a changed base, here rows of one strand may not overlap
    apart = lambda rows: all(a.pos + len(a.ref) <= b.pos for s in ("baseline", "query") for a, b in itertools.pairwise(sorted((r for r in rows if r.side == s), key=lambda r: r.pos)))
    searched = {r.cluster_id: r for r in match_clusters(clustered, g, cuts(spark, FOLDER).where("t = 0"), scorings(0, 0, 0)).collect()}
    mine = {r.cluster_id: r for r in match_strands(clustered, g).collect()}
    checked = 0
    for c, r in searched.items():
        if r.status == "search" and len(by[c]) <= 8:
            score = mine[c].score if c in mine else 0
            assert score <= r.score and (score == r.score or not apart(by[c]))
            checked += apart(by[c])
        if r.status == "equal":
            assert mine[c].score == 2
    assert checked > 20
    assert all(c in searched for c, r in mine.items() if r.status == "match" and len(by[c]) <= 4)
    both = {r.cluster_id: (r.score, r.bases) for r in QUERIES["match_two_strands"](spark, FOLDER).collect()}
    assert {c: s for c, (s, _) in both.items()} == {r.cluster_id: r.score for r in match_strands(plainly, g).collect()} and all(b >= s for s, b in both.values() if s is not None)
    assert match_strands(clustered.where(F.lit(False)), g).count() == 0
