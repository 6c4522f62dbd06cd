import itertools
import random

import pytest
from pyspark.sql import functions as F

from donorframe.operators.duplicates import duplicate_rounds, first_duplicate, set_duplicates
from donorframe.operators.clustering import ONE_SET, cluster
from donorframe.queries import QUERIES, VARIED, genome, variants, with_joint_rows
from donorframe.sources.writers import write_duplicates

from .test_consuming import FOLDER, donor_of, made


def plain_first(rows, window):
    """All subsets from small to large ones, in the order of combinations."""
    rows, seen = sorted(rows, key=lambda r: (r[0], *r[1:])), {}
    for n in range(1, len(rows)):
        for pick in itertools.combinations(rows, n):
            d = donor_of(pick, window)
            if d is None:
                continue
            if d in seen:
                return list(pick), list(seen[d]), d
            seen[d] = pick
    return None


def plain_rounds(rows, window):
    while len(rows) > 1 and (found := plain_first(rows, window)):
        yield found
        rows = [r for r in rows if r not in found[0] and r not in found[1]]


@pytest.mark.parametrize("seed", range(5))
def test_rounds_equal_all_subsets(seed):
    rng, several = random.Random(seed), 0
    for _ in range(100):
        rows, window = {}, ""
        for _ in range(2):  # two places with rows of their own
            a, b, more = made(rng, 3)
            some = sorted(r[:3] for r in a + b)
            x, y = some[0], some[-1]
            if y[0] >= x[0] + len(x[1]):  # and a row that says what two others say
                some.append((x[0], more[x[0] : y[0] + len(y[1])], x[2] + more[x[0] + len(x[1]) : y[0]] + y[2]))
            rows |= {(r[0] + len(window), *r[1:]): None for r in some}
            window += more + "GGTT"
        rows = [(*r, i) for i, r in enumerate(rows)]
        got = [(x, y, d) for _, x, y, d in duplicate_rounds(rows, window)]
        want = list(plain_rounds(rows, window))
        assert got == want, (rows, window)
        several += len(got) > 1
    assert several > 3


def test_thirty_rows_and_the_budget():
    rng = random.Random(1)
    window = "".join(rng.choice("ACGT") for _ in range(200))
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    rows = [(p, window[p], other[window[p]], p) for p in range(2, 120, 4)]
    joint = (50, window[50:55], other[window[50]] + window[51:54] + other[window[54]], 999)
    found = first_duplicate([*rows, joint], window)
    assert [r[3] for r in found[0]] == [50, 54] and found[1] == [joint] and len(rows) == 30
    assert first_duplicate(rows, window) is None and first_duplicate([*rows, joint], window, 5) == "budget"


def test_from_end_to_end(spark, tmp_path):
    rng = random.Random(5)
    seq = "".join(rng.choice("ACGT") for _ in range(6_000))
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    rows, pairs = [], []
    for at in range(10, 5_900, 60):
        two = seq[at : at + 2]
        alt = other[two[0]] + other[two[1]]
        if at % 120 == 10:  # a two-base change and its two single ones
            rows += [(at, two, alt), (at, two[0], alt[0]), (at + 1, two[1], alt[1])]
            pairs.append(at)
        else:
            rows += [(at, two[0], alt[0])] * 2
    # a cluster of over 20 rows that only divisive clustering takes apart: a long insertion, then many single changes
    rows += [(3_000 + i, seq[3_000 + i], other[seq[3_000 + i]]) for i in range(1, 8) if (3_000 + i - 10) % 60 > 1]
    df = spark.createDataFrame([(i, "query", 1, "1", p, r, [a], max(0, len(a) - len(r)), max(0, len(r) - len(a))) for i, (p, r, a) in enumerate(rows)], "row_id long, side string, query_id int, chrom string, pos int, ref string, alts array<string>, mil int, mdl int")
    g = spark.createDataFrame([("1", i, i * 4096, seq[i * 4096 : (i + 1) * 4096]) for i in range(2)], "chrom string, chunk_id int, start int, seq string")
    found = set_duplicates(df, g)
    got = {r.set2[0].pos: r for r in found.collect()}
    assert sorted(got) == pairs and all(len(r.set1) == 2 and len(r.set2) == 1 and r.status == "match" for r in got.values())
    write_duplicates(found, str(tmp_path / "out"))
    lines = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == len(pairs) and all(len(x) == 6 and x[4].count(";") == 1 for x in lines)
    # the same whatever is split first
    assert {r.set2[0].pos for r in set_duplicates(df, g, most=2).collect()} <= set(pairs) and set_duplicates(df.where(F.lit(False)), g).count() == 0


def test_view_equals_all_subsets(spark):
    """Every cluster of up to 9 rows of the view's baseline, as one set."""
    found = {}
    for r in QUERIES["set_duplicates"](spark, FOLDER).collect():
        assert r.status == "match"
        found.setdefault((r.side, r.cluster_id.rsplit(":", 1)[0]), []).append((r.round, r.set1, r.set2))
    g = genome(spark, FOLDER)
    bases = {(r.chrom, r.chunk_id): r.seq for r in g.collect()}
    rows = with_joint_rows(variants(spark, FOLDER, VARIED), g).where("side = 'baseline'")
    by, checked, several = {}, 0, 0
    for r in cluster(rows, g, rule=ONE_SET).collect():
        by.setdefault(r.cluster_id, []).append(r)
    for c, part in by.items():
        if not 1 < len(part) <= 9:
            continue
        start, end = max(min(r.pos for r in part) - 1, 0), max(r.pos + len(r.ref) for r in part) + 1
        seq = "".join(bases[part[0].chrom, i] for i in range(start >> 12, (end >> 12) + 1))[start & 4095 :][: end - start]
        want = [(n, *("/".join(str(v[3]) for v in used) for used in x[:2])) for n, x in enumerate(plain_rounds([(r.pos - start, r.ref, r.alts[0], r.row_id) for r in part], seq))]
        assert sorted(found.get(("baseline", c), [])) == want
        checked, several = checked + 1, several + bool(want)
    assert checked > 100 and several > 20
