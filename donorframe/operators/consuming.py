"""Equal donors on one strand, taken out of a cluster round by round.

A subset of the baseline's rows and one of the query's match if they spell the same donor over the cluster's window. In each
round the match with the most query rows is taken (of several, the one whose rows come first; of its baseline subsets the one
with the fewest rows, of several the one whose rows come last), its rows leave the cluster, and so on until nothing matches.

Subsets are not enumerated. The rows of both sides are decided in the order of their positions, and a state is all that the
rest depends on: how far each side's donor has come along the window, and what the longer donor has more than the other (one
has to begin with the other). Of the ways to one state the best is kept: what is decided later adds the same to all of them.
So the work grows with the donors that stay apart, and not with the subsets. A cluster with more than BUDGET such states at
one place is given up, and its row says so.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alignment import left_normalize
from ..kept import keep
from ..model import SEARCH_BUDGET
from ..sources.readers import genome_windows

#: (position in the window, ref, alt, row id)
Row = tuple[int, str, str, int]
State = tuple[int, int, int, str, bool]
RESULT = "cluster_id string, chrom string, round int, status string, b_rows array<long>, q_rows array<long>, pos int, ref string, alt string"


def append(ahead: int, tail: str, side: int, bases: str) -> tuple[int, str] | None:
    """Go on with one side's donor (side -1 or 1; ahead: the longer one, or 0); None if the donors part."""
    if not bases:
        return ahead, tail
    if ahead in (0, side):
        return side, tail + bases
    if tail.startswith(bases):
        return (ahead, rest) if (rest := tail[len(bases) :]) else (0, "")
    return (side, bases[len(tail) :]) if bases.startswith(tail) else None


def best_match(baseline: list[Row], query: list[Row], window: str, budget: int = SEARCH_BUDGET) -> tuple[list[Row], list[Row], str] | str | None:
    """The best pair of subsets that spell one donor, and that donor; "budget" if the search is given up."""
    rows = sorted([(r[0], 1, r) for r in query] + [(r[0], -1, r) for r in baseline], key=lambda x: (x[0], x[1], x[2][1:]))
    # the order among ways: query rows, the earlier ones, few baseline rows, the later ones
    states: dict[State, tuple] = {(0, 0, 0, "", False): (0, 0, 0, 0)}
    for at, side, (_, ref, alt, _) in rows:
        later: dict[State, tuple] = {}

        def reach(state: State, key: tuple) -> None:
            if state not in later or later[state] < key:
                later[state] = key

        for (x_b, x_q, ahead, tail, some), (n_q, q, n_b, b) in states.items():
            told = append(ahead, tail, -1, window[x_b:at])
            told = told and append(*told, 1, window[x_q:at])
            if told is None:
                continue
            x_b, x_q = max(x_b, at), max(x_q, at)
            reach((x_b, x_q, *told, some), (n_q, q * 2, n_b, b) if side == 1 else (n_q, q, n_b, b * 2))
            if at >= (x_q if side == 1 else x_b) and (used := append(*told, side, alt)):
                if side == 1:
                    reach((x_b, at + len(ref), *used, some), (n_q + 1, q * 2 + 1, n_b, b))
                else:
                    reach((at + len(ref), x_q, *used, True), (n_q, q, n_b - 1, b * 2 - 1))
        states = later
        if len(states) > budget:
            return "budget"
    ends = []
    for (x_b, x_q, ahead, tail, some), key in states.items():
        told = append(ahead, tail, -1, window[x_b:])
        told = told and append(*told, 1, window[x_q:])
        if told == (0, "") and some and key[0]:
            ends.append(key)
    if not ends:
        return None
    _, q, _, b = max(ends)
    listed = lambda side, bits: [r for i, r in enumerate(reversed([r for _, s, r in rows if s == side])) if bits >> i & 1][::-1]
    used_b, used_q = listed(-1, -b), listed(1, q)
    donor, at = "", 0
    for pos, ref, alt, _ in used_q:
        donor, at = donor + window[at:pos] + alt, pos + len(ref)
    return used_b, used_q, donor + window[at:]


def rounds(baseline: list[Row], query: list[Row], window: str, budget: int = SEARCH_BUDGET):
    """(status, baseline rows, query rows, donor) of each round."""
    while baseline and query:
        found = best_match(baseline, query, window, budget)
        if found is None:
            return
        if found == "budget":
            yield "budget", baseline, query, None
            return
        used_b, used_q, donor = found
        yield "match", used_b, used_q, donor
        baseline, query = [r for r in baseline if r not in used_b], [r for r in query if r not in used_q]


def consuming_matches(clustered: DataFrame, genome: DataFrame, singles: bool = False, budget: int = SEARCH_BUDGET) -> DataFrame:
    """One row per match (RESULT), rounds from 0; pos, ref and alt are the match as one variant, shifted to the left within its
    window. A cluster that is given up has a last row with status "budget" and the rows that were left. Rows count with their
    first alt. Clusters of one row a side are left out (exact matching has them) unless `singles`; one-sided clusters too."""
    one = F.struct("pos", "ref", F.get("alts", F.lit(0)).alias("alt"), "row_id")
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, one)))
    by = clustered.groupBy("cluster_id", "chrom").agg(of("baseline").alias("b"), of("query").alias("q"), (F.greatest(F.min("pos") - 1, F.lit(0))).alias("start"), (F.max(F.col("pos") + F.length("ref")) + 1).alias("end"))
    two = by.where((F.size("b") > 0) & (F.size("q") > 0) & (F.lit(singles) | (F.size("b") > 1) | (F.size("q") > 1)))

    def run(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples():
                b, q = ([(v["pos"] - r.start, v["ref"], v["alt"], v["row_id"]) for v in rows] for rows in (r.b, r.q))
                for n, (status, used_b, used_q, donor) in enumerate(rounds(b, q, r.seq, budget)):
                    one = left_normalize(r.seq, r.start, r.seq, [donor], r.start) if donor is not None and donor != r.seq else (r.start, r.seq, [donor])
                    out.append((r.cluster_id, r.chrom, n, status, [v[3] for v in used_b], [v[3] for v in used_q], one[0], one[1], one[2][0]))
            yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in RESULT.split(", ")])

    # clusters differ much in their work
    return genome_windows(genome, keep(two, "sides")).repartition("cluster_id").mapInPandas(run, RESULT)
