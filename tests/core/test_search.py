import random
from itertools import product

import pytest

from donorframe.functions.alignment import align, base_edits, left_normalize
from donorframe.model import Scoring, scorings
from donorframe.operators.search import Row, Search, agree, decidable, direct, distance, equal_rows, hopeless, phasings, window_of, worth


def row(side, pos, ref, *alts, het=True, zero_one=None):
    multi = len(alts) > 1
    change = [len(a) - len(ref) for a in alts]
    return Row(side, pos, ref, tuple(alts), het, multi, (het and not multi) if zero_one is None else zero_one, max(0, *change), max(0, *(-c for c in change)))


GENOME = "GTCAGCCGG"
GOLDEN = [row(1, 1, "T", "A", "C", zero_one=False), row(0, 1, "T", "A", "C", zero_one=False), row(1, 3, "AG", "A"), row(0, 4, "G", "C"), row(0, 5, "C", "T"), row(0, 6, "C", "G"), row(1, 7, "G", "GA"), row(0, 7, "G", "A")]


@pytest.mark.parametrize("scoring,score,used", [((0, 0, 0), 7, (4, 3)), ((0, 0, 1), 4, (4, None)), ((0, 0, 2), 3, (None, 3)), ((1, 0, 0), 9, (4, 3))])
def test_golden(scoring, score, used):
    offset, end = window_of(GOLDEN, len(GENOME))
    assert (offset, end) == (0, 9)
    best = Search(GOLDEN, GENOME, offset, Scoring(*scoring)).best()
    assert best.score == score and agree(best.donors, 0)
    for side, n in enumerate(used):
        if n is not None:
            assert sum(r.side == side and c != "" for r, c in zip(GOLDEN, best.choices)) == n


def plain_best(rows, window, offset, scoring):
    """All choices of all rows; alleles on one strand must not overlap."""
    best = 0
    options = [[None, *phasings(r, scoring.mode)] for r in rows]
    for pick in product(*options):
        strands = [[] for _ in range(4)]
        score = 0
        for r, p in zip(rows, pick):
            if p is None:
                continue
            score += worth(r, p[0], scoring)
            for y, a in enumerate(p[1]):
                if a != r.ref:
                    strands[2 * r.side + y].append((r.pos - offset, r.ref, a))
        donors, ok = [], True
        for s in strands:
            out, at = "", 0
            for pos, ref, alt in sorted(s):
                if pos < at:
                    ok = False
                    break
                out += window[at:pos] + alt
                at = pos + len(ref)
            donors.append(out + window[at:])
        if ok and donors[0] == donors[2] and (scoring.mode == 1 or donors[1] == donors[3]):
            best = max(best, score)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_equals_all_subsets(seed):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT" if seed % 2 else "AC") for _ in range(24))
    rows = []
    for side in (0, 1):
        at = 1
        for _ in range(rng.randint(1, 3)):
            at += rng.randint(0, 4)
            n = rng.choice([1, 1, 2])
            if at + n >= 23:
                break
            ref = genome[at : at + n]
            alts = []
            while len(alts) < rng.choice([1, 1, 2]):
                a = "".join(rng.choice("ACGT") for _ in range(rng.choice([1, 1, 2, 3])))
                if a != ref and a not in alts and (n == 1 or len(a) == 1) and (len(a) == 1 or a[0] == ref[0]) and (n == 1 or a[0] == ref[0]):
                    alts.append(a)
            het = rng.random() < 0.6
            rows.append(row(side, at, ref, *alts, het=het or len(alts) > 1, zero_one=len(alts) == 1 and het))
            at += n
    rows.sort(key=lambda r: (r.pos, -r.side))
    if {r.side for r in rows} != {0, 1}:
        return
    low, high = window_of(rows, len(genome))
    for scoring in scorings():
        best = Search(rows, genome[low:high], low, scoring).best()
        assert (best.score if best else 0) == plain_best(rows, genome[low:high], low, scoring), (rows, scoring)


def test_identical_sides_match_whole_and_swap_keeps_the_score():
    rng = random.Random(5)
    for _ in range(20):
        genome = "".join(rng.choice("ACGT") for _ in range(60))
        rows, at = [], 1
        while at < 50:
            ref = genome[at]
            alt = rng.choice([x for x in "ACGT" if x != ref]) if rng.random() < 0.7 else ref + rng.choice("ACGT")
            rows += [row(1, at, ref, alt), row(0, at, ref, alt)]
            at += rng.randint(2, 9)
        low, high = window_of(rows, 60)
        assert Search(rows, genome[low:high], low, Scoring()).best().score == len(rows)
    swapped = sorted([Row(1 - r.side, *[getattr(r, f) for f in ("pos", "ref", "alts", "het", "multi", "zero_one", "mil", "mdl")]) for r in GOLDEN], key=lambda r: (r.pos, -r.side))
    assert Search(swapped, GENOME, 0, Scoring()).best().score == 7


def test_budget_equality_and_filters():
    assert Search(GOLDEN, GENOME, 0, Scoring(), budget=5).best() == "budget"
    assert direct(GOLDEN) == [(1, 0)]
    assert equal_rows(row(0, 1, "T", "A", "C"), row(1, 1, "T", "C", "A")) and not equal_rows(row(0, 1, "T", "A", het=False), row(1, 1, "T", "A"))
    assert equal_rows(row(0, 1, "T", "A", "C", zero_one=True), row(1, 1, "T", "C", "A", het=False, zero_one=True))
    many = [row(1, 5, "A" * 31, "A"), *[row(0, i, "C", "CA") for i in range(10, 15)]]
    assert hopeless(many) and hopeless(many[1:]) and not hopeless(GOLDEN)
    assert decidable(many) == [False] + [True] * 5 and decidable(many[:3]) == [True] * 3


def test_alignment():
    assert base_edits("A", "AG") == ("AG",) and base_edits("AG", "A") == ("A", "") and base_edits("ACG", "ATG") == ("A", "T", "G")
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randint(1, 6))) for _ in range(2))
        pairs = align(a, b)
        assert "".join(x for x, _ in pairs) == a and "".join(y for _, y in pairs) == b and sum(x != y for x, y in pairs) == distance(a, b)
        assert "".join(base_edits(a, b)) == b and len(base_edits(a, b)) == len(a)
    assert left_normalize("GCAAAT", 3, "AA", ["A"]) == (1, "CA", ["C"]) and left_normalize("ACGT", 1, "CGT", ["CTT"]) == (2, "G", ["T"])


def test_what_a_row_writes_is_worked_out_once(monkeypatch):
    """Ways share the edits of a row, and what a strand spells is worked out once for all that share its edits."""
    rows = [row(side, pos, GENOME[pos], "A" if GENOME[pos] != "A" else "C", het=False) for pos in (1, 3, 5) for side in (0, 1)]
    spelled = []
    told = Search.text
    monkeypatch.setattr(Search, "text", lambda self, edits, at, to: spelled.append((id(edits), to)) or told(self, edits, at, to))
    best = Search(rows, GENOME[:7], 0, Scoring()).best()
    assert best.score == 6 and best.choices == (0,) * 6
    assert 0 < len(spelled) == len(set(spelled))
