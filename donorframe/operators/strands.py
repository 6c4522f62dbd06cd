"""The best two-strand match of a cluster, by states ordered along the genome.

Every row is left out or put on the strands in one of its phases: a row on both strands alike has one, a heterozygous row of
one alt two, of two alts two (or four where one of its alleles is the reference). The two sides match if both strands spell
the same; as all phases of both sides are tried, so are both pairings of their haplotypes.

Rows are decided in the order of their positions, so states meet where they have come equally far: of each strand, how far both
sides' donors have come and what the longer one has more. Strands may be exchanged on both sides at once, so a state is the
pair in either order. Of the ways to one state the one with the greatest score is kept, of equal ones the one that uses earlier
rows. Scores count rows, or the bases of their refs. Rows of one strand may not overlap (search.py goes base by base and lets
an insertion stand behind a changed base).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import comparison_order
from ..model import SEARCH_BUDGET
from ..sources.readers import genome_windows
from .consuming import append

#: (position in the window, side, ref, phases: alt or None for each strand); side -1 is the baseline and 1 the query
Row = tuple[int, int, str, tuple[tuple[str | None, str | None], ...]]
RESULT = "cluster_id string, chrom string, status string, score int, baseline_match int, query_match int, states int, b_phases string, q_phases string, pos int, donor0 string, donor1 string"


def phases_of(alts: list[str], het: bool, multi: bool, zero_one: bool) -> tuple[tuple[str | None, str | None], ...]:
    """What a used row can put on both strands."""
    if multi and not zero_one:
        return (alts[0], alts[1]), (alts[1], alts[0])
    if not het:
        return ((alts[0], alts[0]),)
    return tuple(x for a in (alts if multi else alts[:1]) for x in ((a, None), (None, a)))


def best_phases(rows: list[Row], window: str, bases: bool = False, budget: int = SEARCH_BUDGET) -> tuple[int, list[int], int] | str | None:
    """(score, the phase of each row from 1 on or 0 if it is left out, states visited) of the best match that uses rows;
    "budget" if the search is given up. Rows come in order of position."""
    start = (0, 0, 0, "")
    states: dict[tuple, tuple[int, tuple[int, ...]]] = {(start, start): (0, ())}
    visited = 0
    for at, side, ref, phases in rows:
        later: dict[tuple, tuple[int, tuple[int, ...]]] = {}
        gain = len(ref) if bases else 1
        for strands, (score, chosen) in states.items():
            moved = []
            for x_b, x_q, ahead, tail in strands:
                told = append(ahead, tail, -1, window[x_b:at])
                told = told and append(*told, 1, window[x_q:at])
                if told is None:
                    break
                moved.append((max(x_b, at), max(x_q, at), *told))
            if len(moved) < 2:
                continue
            for n, alleles in enumerate((None, *phases)):
                both = []
                for (x_b, x_q, ahead, tail), alt in zip(moved, alleles or (None, None)):
                    if alt is not None:
                        if at < (x_q if side == 1 else x_b) or (used := append(ahead, tail, side, alt)) is None:
                            break
                        x_b, x_q = (x_b, at + len(ref)) if side == 1 else (at + len(ref), x_q)
                        ahead, tail = used
                    both.append((x_b, x_q, ahead, tail))
                if len(both) == 2:
                    # the strands change places together, and the phases that led here with them: only their score matters
                    key, way = tuple(sorted(both)), (score + (gain if n else 0), (*chosen, n))
                    if key not in later or later[key] < way:
                        later[key] = way
        states = later
        visited += len(states)
        if len(states) > budget:
            return "budget"
    best = None
    for strands, way in states.items():
        ends = []
        for x_b, x_q, ahead, tail in strands:
            told = append(ahead, tail, -1, window[x_b:])
            ends.append(told and append(*told, 1, window[x_q:]))
        if ends == [(0, ""), (0, "")] and way[0] and (best is None or best < way):
            best = way
    return best and (best[0], list(best[1]), visited)


def spelled(rows: list[Row], used: list[tuple[str | None, str | None] | None], window: str) -> list[str]:
    """Both strands of the rows' alleles (None: left out)."""
    out = []
    for strand in (0, 1):
        donor, at = "", 0
        for (pos, _, ref, _), alleles in zip(rows, used):
            if alleles and alleles[strand] is not None:
                donor, at = donor + window[at:pos] + alleles[strand], pos + len(ref)
        out.append(donor + window[at:])
    return out


def resolve(rows: list[Row], chosen: list[int], window: str) -> tuple[list[tuple | None], list[str]]:
    """Alleles of all rows on fixed strands, and the donors. States held strands in either order, so a phase number tells which
    alleles a row has but not on which strand; one run that keeps strands apart along the chosen rows finds that."""
    ways: dict[tuple, list] = {((0, 0, 0, ""), (0, 0, 0, "")): []}
    for (at, side, ref, phases), n in zip(rows, chosen):
        later: dict[tuple, list] = {}
        options = [None] if not n else [p for p in phases if sorted(map(str, p)) == sorted(map(str, phases[n - 1]))]
        for strands, told in ways.items():
            for alleles in options:
                both = []
                for (x_b, x_q, ahead, tail), alt in zip(strands, alleles or (None, None)):
                    moved = append(ahead, tail, -1, window[x_b:at])
                    moved = moved and append(*moved, 1, window[x_q:at])
                    x_b, x_q = max(x_b, at), max(x_q, at)
                    if moved is not None and alt is not None:
                        moved = append(*moved, side, alt) if at >= (x_q if side == 1 else x_b) else None
                        x_b, x_q = (x_b, at + len(ref)) if side == 1 else (at + len(ref), x_q)
                    if moved is None:
                        break
                    both.append((x_b, x_q, *moved))
                if len(both) == 2:
                    later.setdefault(tuple(both), [*told, alleles])
        ways = later
    for used in ways.values():
        mine = [spelled([r for r in rows if r[1] == s], [u for r, u in zip(rows, used) if r[1] == s], window) for s in (-1, 1)]
        if mine[0] == mine[1]:
            return used, mine[0]
    raise AssertionError("a match without strands")


def match_strands(clustered: DataFrame, genome: DataFrame, bases: bool = False, budget: int = SEARCH_BUDGET) -> DataFrame:
    """One row per two-sided cluster that has a match (RESULT); phases are those of the used rows, "pos:a|b". Clusters that are
    given up have status "budget" and no score."""
    order = [c.alias(f"o{i}") for i, c in enumerate(comparison_order())]
    one = F.struct(*order, "pos", "side", "ref", "alts", "het", "multi", "zero_one")
    by = clustered.groupBy("cluster_id", "chrom").agg(F.array_sort(F.collect_list(one)).alias("rows"), F.count_distinct("side").alias("sides"), F.greatest(F.min("pos") - 1, F.lit(0)).alias("start"), (F.max(F.col("pos") + F.length("ref")) + 1).alias("end"))

    def run(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples():
                rows = [(v["pos"] - r.start, 1 if v["side"] == "query" else -1, v["ref"], phases_of(list(v["alts"]), v["het"], v["multi"], v["zero_one"])) for v in r.rows]
                found = best_phases(rows, r.seq, bases, budget)
                if found == "budget":
                    out.append((r.cluster_id, r.chrom, "budget", None, 0, 0, None, "", "", r.start, None, None))
                elif found is not None:
                    used, donors = resolve(rows, found[1], r.seq)
                    told = {s: [f"{row[0] + r.start}:{'|'.join(a or row[2] for a in u)}" for row, u in zip(rows, used) if u and row[1] == s] for s in (-1, 1)}
                    out.append((r.cluster_id, r.chrom, "match", found[0], len(told[-1]), len(told[1]), found[2], ";".join(told[-1]), ";".join(told[1]), r.start, *donors))
            yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in RESULT.split(", ")]).astype({"score": "object", "states": "object"})

    return genome_windows(genome, by.where("sides = 2").drop("sides")).repartition("cluster_id").mapInPandas(run, RESULT)
