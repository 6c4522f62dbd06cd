"""Duplicates within one set of variants: two different subsets of a cluster's rows that spell the same donor.

In each round subsets are compared from small to large ones (of one size, those whose rows come first): the first subset whose
donor an earlier one has spelled is reported with that one, the rows of both leave the cluster, and so on until nothing is
found. The two may share rows.

As in consuming.py subsets are not enumerated, but for the few of small clusters: rows are decided in the order of their
positions, each for both subsets at once, and states are what the rest depends on. Clusters of many rows are split by divisive
clustering first, and what is still given up by its number of states is reported with the rows that were left.

Clusters are searched where their rows and bases meet: rows are shuffled to the stretch that their cluster begins in, and so are
the chunks of that stretch. Only clusters of many rows, and those with bases beyond these chunks, are put together apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.alignment import left_normalize
from ..kept import keep
from ..model import SEARCH_BUDGET
from ..sources.readers import CHUNK, derived, genome_windows
from .clustering import ONE_SET, as_list, cluster, split_clusters
from .consuming import Row, append

#: Clusters of more rows are split first.
MANY = 20
#: Of so many rows all subsets are tried.
FEW = 10
#: Positions of a stretch.
WIDTH = 1 << 18
ROWS = "array<struct<pos: int, ref: string, alt: string, row_id: long>>"
NAMES = ["cluster_id", "chrom", "round", "status", "set1", "set2", "pos", "ref", "alt"]
RESULT = f"cluster_id string, chrom string, round int, status string, set1 {ROWS}, set2 {ROWS}, pos int, ref string, alt string"

ONE = pa.list_(pa.struct([("pos", pa.int32()), ("ref", pa.string()), ("alt", pa.string()), ("row_id", pa.int64())]))
ARROW = pa.schema(list(zip(NAMES, (pa.string(), pa.string(), pa.int32(), pa.string(), ONE, ONE, pa.int32(), pa.string(), pa.string()))))


def first_of_few(rows: list[Row], window: str) -> tuple[list[Row], list[Row], str] | None:
    """first_duplicate by all subsets, from small to large ones, in the order of their rows."""
    rows = sorted(rows, key=lambda r: (r[0], *r[1:]))
    seen: dict[str, tuple[int, ...]] = {}
    # rows taken, the donor up to the last one's end, and that end
    level: list[tuple[tuple[int, ...], str, int]] = [((), "", 0)]
    for _ in range(len(rows) - 1):
        larger = []
        for used, begun, end in level:
            for i in range(used[-1] + 1 if used else 0, len(rows)):
                at, ref, alt, _ = rows[i]
                if at < end:
                    continue
                one = (*used, i), begun + window[end:at] + alt, at + len(ref)
                donor = one[1] + window[one[2] :]
                if (earlier := seen.setdefault(donor, one[0])) is not one[0]:
                    return [rows[k] for k in one[0]], [rows[k] for k in earlier], donor
                larger.append(one)
        level = larger
    return None


def first_duplicate(rows: list[Row], window: str, budget: int = SEARCH_BUDGET) -> tuple[list[Row], list[Row], str] | str | None:
    """The subset whose donor an earlier one spells, that one, and the donor; "budget" if the search is given up."""
    rows = sorted(rows, key=lambda r: (r[0], *r[1:]))
    # a state: how far both donors have come, the longer one and what it has more, rows of the later subset less those of the
    # earlier one, which of them has the first row that only one has (0: none so far), and whether the earlier one has any
    states = {(0, 0, 0, "", 0, 0, False): (0, 0, 0)}
    for at, ref, alt, _ in rows:
        later: dict[tuple, tuple] = {}
        for (x_a, x_b, ahead, tail, more, first, some), (n, a, b) in states.items():
            told = append(ahead, tail, -1, window[x_a:at])
            told = told and append(*told, 1, window[x_b:at])
            if told is None:
                continue
            x_a, x_b = max(x_a, at), max(x_b, at)
            for in_a, in_b in ((0, 0), (0, 1), (1, 0), (1, 1)):
                if in_a and at < x_a or in_b and at < x_b:
                    continue
                used = append(*told, -1, alt) if in_a else told
                used = append(*used, 1, alt) if used and in_b else used
                if used is None:
                    continue
                state = (at + len(ref) if in_a else x_a, at + len(ref) if in_b else x_b, *used, more + in_a - in_b, first or in_b - in_a, some or bool(in_b))
                key = (n - in_a, a * 2 + in_a, b * 2 + in_b)
                if state not in later or later[state] < key:
                    later[state] = key
        states = later
        if len(states) > budget:
            return "budget"
    ends = []
    for (x_a, x_b, ahead, tail, more, first, some), key in states.items():
        told = append(ahead, tail, -1, window[x_a:])
        told = told and append(*told, 1, window[x_b:])
        # the second subset is the earlier one, and the first is not the whole set
        if told == (0, "") and some and (more > 0 or more == 0 and first == 1) and -key[0] < len(rows):
            ends.append(key)
    if not ends:
        return None
    _, a, b = max(ends)
    used_a, used_b = ([r for i, r in enumerate(rows) if bits >> (len(rows) - 1 - i) & 1] for bits in (a, b))
    donor, at = "", 0
    for pos, ref, alt, _ in used_a:
        donor, at = donor + window[at:pos] + alt, pos + len(ref)
    return used_a, used_b, donor + window[at:]


def duplicate_rounds(rows: list[Row], window: str, budget: int = SEARCH_BUDGET):
    """(status, later subset, earlier subset, donor) of each round."""
    while len(rows) > 1:
        found = first_of_few(rows, window) if len(rows) <= FEW and 1 << len(rows) <= budget else first_duplicate(rows, window, budget)
        if found is None:
            return
        if found == "budget":
            yield "budget", rows, [], None
            return
        yield "match", *found
        rows = [r for r in rows if r not in found[0] and r not in found[1]]


def told_of(clusters, budget: int) -> pa.Table:
    """Rounds of clusters (id, chrom, window's start and bases, rows with positions in the window) as a table of RESULT."""
    ids, numbers, states, sets, ends, donors = [], [], [], ([], []), ([0], [0]), []
    for name, chrom, start, seq, rows in clusters:
        for n, (status, *used, donor) in enumerate(duplicate_rounds(rows, seq, budget)):
            ids.append((name, chrom)), numbers.append(n), states.append(status)
            for all_rows, end, some in zip(sets, ends, used):
                all_rows += [(r[0] + start, *r[1:]) for r in some]
                end.append(len(all_rows))
            donors.append(left_normalize(seq, start, seq, [donor], start) if donor is not None and donor != seq else (start, seq, [donor]))
    return table_of(ids, numbers, states, sets, ends, donors)


def table_of(ids: list[tuple], numbers: list[int], states: list[str], sets: tuple[list, list], ends: tuple[list, list], donors: list[tuple]) -> pa.Table:
    """A table of RESULT; sets: the rows of all first and all second subsets, ends: where each of those ends."""
    across = lambda rows, n: zip(*rows) if rows else [()] * n
    column = lambda name, values: pa.array(values, ARROW.field(name).type)
    fields = ONE.value_type
    listed = [pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(across(rows, 4), fields)], fields=list(fields)), type=ONE) for rows, end in zip(sets, ends)]
    names, chroms = across(ids, 2)
    pos, ref, alts = across(donors, 3)
    return pa.Table.from_arrays([column("cluster_id", names), column("chrom", chroms), column("round", numbers), column("status", states), *listed, column("pos", pos), column("ref", ref), column("alt", [a[0] for a in alts])], schema=ARROW)


def searched(rows: pa.Table, chunks: pa.Table, most: int, budget: int, chunk: int = CHUNK) -> pa.Table:
    """The rounds of all clusters of two rows or more that begin in one stretch (rows: cluster_id, chrom, pos, ref, alt, row_id),
    with the genome's chunks there. A cluster of more than `most` rows, or with bases in other chunks, is given back with its
    rows in set1 and status "apart"."""
    if rows.num_rows == 0:
        return ARROW.empty_table()
    order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("cluster_id", "pos", "ref", "alt", "row_id")])
    chrom = rows.column("chrom")[0].as_py()
    names = rows.column("cluster_id").take(order).combine_chunks().dictionary_encode()
    begin = np.flatnonzero(np.diff(names.indices.to_numpy(), prepend=-1)).tolist()
    listed = list(zip(*[as_list(rows.column(c).take(order)) for c in ("pos", "ref", "alt", "row_id")]))
    seqs = dict(zip(as_list(chunks.column("at")), as_list(chunks.column("seq"))))
    near, apart = [], []
    for name, i, k in zip(names.dictionary.to_pylist(), begin, [*begin[1:], len(listed)]):
        if k - i < 2:
            continue
        held = listed[i:k]
        start, end = max(held[0][0] - 1, 0), max(r[0] + len(r[1]) for r in held) + 1
        asked = range(start // chunk * chunk, end, chunk)
        if k - i > most or not all(at in seqs for at in asked):
            apart.append((name, held))
            continue
        seq = seqs[asked[0]] if len(asked) == 1 else "".join(seqs[at] for at in asked)
        near.append((f"{name}:0", chrom, start, seq[start - asked[0] : end - asked[0]], [(r[0] - start, *r[1:]) for r in held]))
    more = table_of([(name, chrom) for name, _ in apart], [0] * len(apart), ["apart"] * len(apart), ([r for _, held in apart for r in held], []), (np.cumsum([0, *[len(held) for _, held in apart]]).tolist(), [0] * (len(apart) + 1)), [(0, "", [None])] * len(apart))
    return pa.concat_tables([told_of(near, budget), more])


def set_duplicates(variants: DataFrame, genome: DataFrame, most: int = MANY, budget: int = SEARCH_BUDGET, width: int = WIDTH) -> DataFrame:
    """Duplicates within each side of variants (RESULT), from end to end: rows of one alt, the first of equal ones, clustered
    as one set, clusters of over `most` rows split, and rounds in each. A cluster that is given up has a last row with status
    "budget" and the rows that were left. Variants are read twice, so they had better be kept."""
    rows = variants.where(F.size("alts") == 1)
    clustered = cluster(rows, genome, rule=ONE_SET, width=width, once=True, first=True, home=True)
    slim = clustered.select("chrom", "home", "cluster_id", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), F.col("row_id").cast("long").alias("row_id"))
    # a cluster's window begins a base before its stretch at most, and few go on behind it for more than a chunk
    low = F.col("start").cast("long")
    asked = F.explode(F.sequence(F.floor((low - CHUNK) / width), F.floor((low + F.length("seq")) / width)))
    chunks = genome.select(F.col("chrom").alias("near_chrom"), asked.alias("near_home"), low.alias("at"), "seq")
    find = lambda rows, chunks: searched(rows, chunks, most, budget)
    found = keep(slim.groupBy("chrom", "home").cogroup(chunks.groupBy("near_chrom", "near_home")).applyInArrow(find, RESULT), "found")
    told, apart = found.where("status <> 'apart'"), found.where("status = 'apart'")
    if apart.isEmpty():
        return told
    bounds = [F.greatest(F.min("pos") - 1, F.lit(0)).alias("start"), (F.max(F.col("pos") + F.length("ref")) + 1).alias("end")]
    one = F.struct("pos", "ref", F.get("alts", F.lit(0)).alias("alt"), "row_id")
    held = apart.select("cluster_id", "chrom", F.size("set1").alias("n"), F.inline("set1")).withColumns({"alts": F.array("alt"), "side": F.lit("baseline")})
    large = derived(held.where(F.col("n") > most).drop("alt", "n"))
    parts = split_clusters(large, genome, one_set=True).withColumn("cluster_id", F.concat_ws(":", "cluster_id", F.col("cluster_part").cast("string")))
    wide = held.where(F.col("n") <= most).withColumn("cluster_id", F.concat("cluster_id", F.lit(":0")))
    gathered = wide.select(*(needed := ["cluster_id", "chrom", "pos", "ref", "alts", "row_id"])).unionByName(parts.select(*needed))
    by = keep(gathered.groupBy("cluster_id", "chrom").agg(F.array_sort(F.collect_list(one)).alias("rows"), *bounds).where(F.size("rows") > 1), "apart")

    def run(batches):
        for batch in batches:
            rows = [(r["cluster_id"], r["chrom"], r["start"], r["seq"], [(v["pos"] - r["start"], v["ref"], v["alt"], v["row_id"]) for v in r["rows"]]) for r in batch.to_pylist()]
            yield from told_of(rows, budget).to_batches()

    return told.unionByName(genome_windows(genome, by).repartition("cluster_id").mapInArrow(run, RESULT))


def duplicates_by_side(variants: DataFrame, genome: DataFrame, sides: tuple[str, ...] = ("baseline", "query"), **options) -> DataFrame:
    """set_duplicates of each side, with the side."""
    told = [set_duplicates(variants.where(F.col("side") == s), genome, **options).withColumn("side", F.lit(s)) for s in sides]
    out = told[0]
    for more in told[1:]:
        out = out.unionByName(more)
    return out
