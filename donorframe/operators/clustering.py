"""Clustering of nearby variants into independent groups.

A row opens a new cluster where the gap to the greatest end so far is at least 2 and either nothing in the cluster so far
changes lengths, or the gap is longer than twice the change that could have built up and is not a tandem repeat (repeats
are not looked for in gaps of over 1000 bases).

The rule depends on what the cluster has gathered, so it is a fold; but the fold composes. A stretch of a chromosome is
summed up as a function of what comes into it: where it first ends the incoming cluster for which incoming changes, and what
it leads to from there. All stretches are summed up at once, the summaries of a chromosome (a row per stretch) are composed
in order, and a join numbers the rows of all stretches, each from what comes into it. So a chromosome without any wide gap is
no task, and what a task holds is a stretch with its bases. Rows are shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import comparison_order
from ..kept import drop, keep
from ..model import MAX_REPEAT
from ..sources.readers import CHUNK, genome_windows
from .running import WIDTH, running


def total_order(rows: DataFrame) -> list[Column]:
    """Comparison order, and then what tells rows of one id apart: several passes see the same order."""
    return [*comparison_order(), *[F.col(c) for c in ("ref", "alts", "qual") if c in rows.columns]]


def running_gaps(both: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Gap of each row to the greatest end before it on its chromosome (null for the first), and that end (run_end)."""
    out = running(both, ["chrom"], order or total_order(both), run_end=("max", F.col("pos") + F.length("ref"), False))
    return out.withColumn("gap", F.col("pos") - F.col("run_end"))


@dataclass(frozen=True)
class Rule:
    """What the changes of a cluster are and when a gap of at least 2 ends it. two_sides: insertions of one side add to
    deletions of the other, else the rows are one set and the larger of its insertions and deletions counts. free: where
    nothing changes lengths every gap ends the cluster, else a tandem repeat never does."""

    two_sides: bool = True
    free: bool = True


LIVE, HAPLOID, ONE_SET = Rule(), Rule(free=False), Rule(two_sides=False, free=False)


def tandem(s: str) -> bool:
    """scalar.is_tandem_repeat in Python: whether s is a unit of at most half its length repeated, an incomplete last unit
    aside. Longer units are only tried where the first four bases stand again."""
    n = len(s)
    if n < 2 or s == s[0] * n:
        return n > 0
    whole = lambda u: s.startswith(s[:u], u) and s[: u * (n // u)] == s[:u] * (n // u)
    if n >= 4 and whole(2) or n >= 6 and whole(3):
        return True
    u = s.find(s[:4], 4)
    while 0 < u <= n // 2:
        if whole(u):
            return True
        u = s.find(s[:4], u + 1)
    return False


def in_order(rows: pa.Table) -> pa.Array:
    """total_order in Arrow. Arrays are told by their texts: the separator comes before every base."""
    keys = [rows.column("pos"), pc.coalesce(pc.not_equal(rows.column("side"), "query"), True), rows.column("row_id")]
    keys += [pc.binary_join(rows.column(c), "\0") if c == "alts" else rows.column(c) for c in ("ref", "alts", "qual") if c in rows.column_names]
    table = pa.Table.from_arrays(keys, names=[str(i) for i in range(len(keys))])
    return pc.sort_indices(table, sort_keys=[(k, "ascending") for k in table.column_names], null_placement="at_start")


def as_list(column: pa.ChunkedArray) -> list:
    """to_pylist, faster for texts and for numbers without nulls."""
    return column.to_pylist() if column.null_count else column.to_numpy().tolist()


def first_of_equal(rows: pa.Table) -> pa.Table:
    """readers.first_of_each of rows of one alt in order: equal rows have one position, so a stretch holds them all."""
    pos = rows.column("pos").to_numpy()
    same = pos[1:] == pos[:-1]
    near = np.flatnonzero(np.append(same, False) | np.append(False, same))
    some = rows.take(near)
    columns = [as_list(some.column(c)) for c in ("side", "query_id", "pos", "ref") if c in some.column_names]
    keys = zip(*columns, as_list(pc.binary_join(some.column("alts"), "\0")))
    seen: dict[tuple, int] = {}
    again = [i for i, key in zip(near.tolist(), keys) if seen.setdefault(key, i) != i]
    return rows.take(np.delete(np.arange(rows.num_rows), again)) if again else rows


def reduced(rows: pa.Table, beside: pa.Table, rule: Rule, backwards: bool, columns: list[str], chunk: int = CHUNK, first: bool = False) -> pa.Table:
    """The rows of one stretch in order, with what the fold needs, and on the first row what the stretch does (told). first:
    only the first of equal rows.

    beside: the greatest end before the stretch (run_end), and the genome's chunks that its gaps may lie in. ways has for
    each bound of the stretch how many clusters have begun up to the row where the incoming one ends there. most is the
    largest change that the cluster may have gathered where it ends before a row (-1: it goes on in any case)."""
    rows = rows.take(in_order(rows))
    rows = first_of_equal(rows) if first else rows
    whole = lambda c: rows.column(c).to_numpy().astype("int64")
    pos = whole("pos")
    end = pos + pc.utf8_length(rows.column("ref")).to_numpy().astype("int64")
    begun = pc.max(beside.column("run_end")).as_py()
    # the first row of a chromosome has no gap, so it goes on
    run_end = np.maximum.accumulate(np.append(pos[0] if begun is None else begun, end[:-1]))
    gap = pos - run_end
    seqs = {k: s for k, s in zip(beside.column("at").to_pylist(), beside.column("seq").to_pylist()) if s is not None}
    most = np.where(gap < 2, -1, (gap - 1) // 2).tolist()
    for i in np.flatnonzero((gap >= 2) & (gap <= MAX_REPEAT)).tolist() if seqs else []:
        start = int(-pos[i] if backwards else run_end[i])
        at = start // chunk * chunk
        if at in seqs:
            low, high = start - at, start - at + int(gap[i])
            s = seqs[at][low:high]
            if high > chunk:
                s += seqs.get(at + chunk, "")[: high - chunk]
            if tandem(s):
                most[i] = 0 if rule.free else -1
    mil, mdl = (whole(c).tolist() for c in ("mil", "mdl"))
    if rule.two_sides:
        query = [s == "query" for s in as_list(rows.column("side"))]
        mil, mdl = [y if q else x for x, y, q in zip(mil, mdl, query)], [x if q else y for x, y, q in zip(mil, mdl, query)]
    bounds, u, v, begin, leads = summed(most, mil, mdl)
    told = [{"bounds": [dict(zip("abuvn", x)) for x in bounds], "u": u, "v": v}] + [None] * (len(most) - 1)
    # what meets a bound first ends there, and from there the rows that end clusters lead to each other
    ways = np.zeros((len(most), len(bounds)), "int32")
    for way, i in enumerate(begin):
        while i < len(most):
            ways[i, way] = 1
            i = leads[i]
    ways = ways.cumsum(axis=0, dtype="int32")
    ways = pa.ListArray.from_arrays(pa.array(np.arange(len(most) + 1) * len(bounds), pa.int32()), pa.array(ways.ravel()))
    long = pa.int64()
    added = {"ways": ways, "told": pa.array(told, pa.struct([("bounds", pa.list_(pa.struct([(c, long) for c in "abuvn"]))), ("u", long), ("v", long)]))}
    out = rows.select([*columns, "stretch"])
    for name, values in added.items():
        out = out.append_column(name, values)
    return out


def summary(most: list[int], du: list[int], dv: list[int]) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """summed without the rows."""
    return summed(most, du, dv)[:3]


def summed(most: list[int], du: list[int], dv: list[int]) -> tuple[list[tuple[int, int, int, int, int]], int, int, list[int], dict[int, int]]:
    """What a stretch of rows does to a cluster that comes in with changes (u, v), whatever they are.

    The cluster ends at the first row whose `most` is not below u and v plus what the rows before it add. So the rows that can
    be first are those that bound u or v less than all before them; each comes with where the stretch leads once it has cut
    there: (bound of u, bound of v, u and v at the end, clusters begun). A cluster that meets no bound goes on with the sums.
    Then the row of each bound, and for rows that end a cluster the next one that does (or the number of rows)."""
    ends: dict[int, tuple[int, int, int]] = {}
    leads: dict[int, int] = {}

    def after(i: int) -> tuple[int, int, int]:
        """Changes at the end of the stretch, and clusters begun, after a cut before row i."""
        chain = []
        while i not in ends:
            u, v, k = du[i], dv[i], i + 1
            while k < len(most) and max(u, v) > most[k]:
                u, v, k = u + du[k], v + dv[k], k + 1
            chain.append(i)
            leads[i] = k
            if k == len(most):
                ends[i] = u, v, 1
                break
            i = k
        for j in reversed(chain):
            if j not in ends:
                u, v, n = ends[i]
                ends[j] = u, v, n + 1
            i = j
        return ends[i]

    bounds, u, v, begin = [], 0, 0, []
    for i, m in enumerate(most):
        a, b = m - u, m - v
        if a >= 0 and b >= 0 and not any(a <= x[0] and b <= x[1] for x in bounds):
            bounds.append((a, b, *after(i)))
            begin.append(i)
        u, v = u + du[i], v + dv[i]
    return bounds, u, v, begin, leads


ADDED = "stretch long, ways array<int>, told struct<bounds: array<struct<a: long, b: long, u: long, v: long, n: long>>, u: long, v: long>"
CARRY = "chrom string, stretch long, u_in long, v_in long, n_in long, way int, home_in long"


def carries(frame: pd.DataFrame) -> pd.DataFrame:
    """Compose the summaries of a chromosome (a row per stretch): what comes into each stretch, which
    of its bounds that meets first (way; -1: none), and the stretch that it begins in (home_in)."""
    u = v = n = 0
    out, home = [], None
    for r in frame.sort_values("stretch").itertuples():
        home = r.stretch if home is None else home
        way = next((i for i, x in enumerate(r.bounds) if u <= x["a"] and v <= x["b"]), -1)
        out.append((r.chrom, r.stretch, u, v, n, way, home))
        hit = r.bounds[way] if way >= 0 else None
        home = r.stretch if hit is not None else home
        u, v, n = (r.u + u, r.v + v, n) if hit is None else (hit["u"], hit["v"], n + hit["n"])
    return pd.DataFrame(out, columns=["chrom", "stretch", "u_in", "v_in", "n_in", "way", "home_in"])


def cluster(both: DataFrame, genome: DataFrame | None = None, backwards: bool = False, rule: Rule = LIVE, width: int = WIDTH, once: bool = False, first: bool = False, home: bool = False) -> DataFrame:
    """Rows of both sides with cluster_id (chrom:number), as a kept table, or not if they are read only once. Without a genome
    no gap counts as a repeat. first: of equal rows (readers.first_of_each; all of one alt) only the first. home: with the
    stretch that the cluster begins in, too.

    Backwards, a row joins the rows after it: gaps are measured from its end to the least start of those, and what a
    cluster has gathered is their change. That is the same fold over mirrored positions, numbered from the right."""
    length = F.length("ref")
    if backwards:
        both = both.withColumn("pos", -(F.col("pos") + length))
    rows = both.withColumn("stretch", F.floor(F.col("pos") / width)).where("stretch IS NOT NULL")
    ends = rows.groupBy("chrom", "stretch").agg(F.max(F.col("pos") + length).alias("most"))
    before = Window.partitionBy("chrom").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    beside = ends.select("chrom", "stretch", F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("seq"), F.max("most").over(before).cast("long").alias("run_end"))
    if genome is not None:
        # a gap lies at most MAX_REPEAT bases before its row, so a chunk goes to one or two stretches
        low, high = F.col("start").cast("long"), F.col("start").cast("long") + F.length("seq")
        least, last = (-high, MAX_REPEAT - low) if backwards else (low, high + MAX_REPEAT)
        asked = F.explode(F.sequence(F.floor(least / width), F.floor(last / width)))
        beside = beside.unionByName(genome.select("chrom", asked.alias("stretch"), low.alias("at"), "seq", F.lit(None).cast("long").alias("run_end")))

    def told(rows: pa.Table, beside: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            return pa.table({})
        return reduced(rows, beside, rule, backwards, columns, first=first)

    columns, by = both.columns, ["chrom", "stretch"]
    schema = T.StructType([*both.schema, *T.StructType.fromDDL(ADDED)])
    near = beside.withColumnsRenamed({c: f"near_{c}" for c in by})  # it comes from the same rows
    ready = keep(rows.groupBy(*by).cogroup(near.groupBy(*[f"near_{c}" for c in by])).applyInArrow(told, schema), "changes")
    carry = keep(ready.where("told IS NOT NULL").select(*by, "told.*").groupBy("chrom").applyInPandas(carries, CARRY), "carries")
    numbered = ready.drop("told").join(carry, by).withColumn("cluster_no", F.col("n_in") + F.coalesce(F.get("ways", F.col("way")), F.lit(0)))
    numbered = numbered.withColumn("home", F.when(F.col("cluster_no") == F.col("n_in"), F.col("home_in")).otherwise(F.col("stretch"))) if home else numbered
    out = numbered.withColumn("cluster_id", F.concat_ws(":", "chrom", F.col("cluster_no").cast("string")))
    if backwards:
        out = out.withColumn("pos", -(F.col("pos") + length))
    out = out.select(*both.columns, "cluster_id", *(["home"] if home else []))
    if once:
        return out
    found = keep(out, "clusters")
    drop(ready, carry)
    return found


def cluster_unchanging(both: DataFrame) -> DataFrame:
    """Clusters where no row changes lengths: split at every gap of at least 2."""
    fresh = F.coalesce(F.col("gap") >= 2, F.lit(False)).cast("int")
    return running(running_gaps(both), ["chrom"], total_order(both), cluster_no=("sum", fresh, True)).drop("run_end", "gap")


def changes(frame: pd.DataFrame) -> int:
    """Most change of length that the rows of both sides can build up together."""
    total = lambda side, c: int(frame.loc[frame["side"] == side, c].sum())
    return max(total("baseline", "mil") + total("query", "mdl"), total("query", "mil") + total("baseline", "mdl"))


def repeated(seq: str, gap: int) -> bool:
    """Whether the first `gap` bases are a unit of at most half their length repeated (an incomplete last unit aside)."""
    s = seq[:gap]
    return len(s) == 1 or any(s[: u * (len(s) // u)] == s[:u] * (len(s) // u) for u in range(1, len(s) // 2 + 1))


def largest_change(frame: pd.DataFrame) -> int:
    """The larger of a set's insertions and deletions."""
    return max(int(frame["mil"].sum()), int(frame["mdl"].sum()))


def split_apart(frame: pd.DataFrame, one_set: bool = False) -> pd.Series:
    """Divisive clustering of one cluster (rows with seq_no in order, and seq: the bases from the first row's end on).

    A part is cut at the gap between its first row's end and its last row's start, where that exceeds twice the lesser
    change of the rows that start before the gap and of the others (of one set: the greater) and is no repeat; both parts are
    cut in their turn."""
    frame = frame.sort_values("seq_no")
    number, n = {}, 0
    todo = [frame]
    while todo:
        part = todo.pop()
        first, last = part.iloc[0], part.iloc[-1]
        end = first["pos"] + len(first["ref"])
        gap = last["pos"] - end
        left, right = part[part["pos"] <= end], part[part["pos"] > end]
        at = end - (frame.iloc[0]["pos"] + len(frame.iloc[0]["ref"]))
        change = max(map(largest_change, (left, right))) if one_set else min(map(changes, (left, right)))
        if len(right) and gap > 2 * change and not repeated(first["seq"][max(at, 0) :], min(gap, MAX_REPEAT)):
            todo += [right, left]
            continue
        number |= dict.fromkeys(part.index, n)
        n += 1
    return pd.Series(number)


def split_clusters(clustered: DataFrame, genome: DataFrame, one_set: bool = False) -> DataFrame:
    """Rows of clusters (cluster_id) with cluster_part: the parts that divisive clustering cuts each cluster into."""
    order = Window.partitionBy("cluster_id").orderBy(*total_order(clustered))
    rows = clustered.withColumn("seq_no", F.row_number().over(order))
    # several rows may begin where the first one does
    spans = rows.groupBy("cluster_id", "chrom").agg(F.min_by(F.col("pos") + F.length("ref"), "seq_no").alias("start"), (F.max("pos") + 1).alias("end"))
    told = genome_windows(genome, spans).select("cluster_id", "seq")
    slim = rows.select("cluster_id", "seq_no", "pos", "ref", "side", "mil", "mdl").join(told, "cluster_id")
    fold = lambda frame: frame.assign(cluster_part=split_apart(frame, one_set))[["cluster_id", "seq_no", "cluster_part"]]
    parts = slim.groupBy("cluster_id").applyInPandas(fold, "cluster_id string, seq_no int, cluster_part int")
    return rows.join(parts, ["cluster_id", "seq_no"]).drop("seq_no")


def two_sided(clustered: DataFrame) -> DataFrame:
    """Rows of clusters in which both sides take part."""
    n = clustered.groupBy("cluster_id").agg(F.countDistinct("side").alias("n_sides")).where("n_sides = 2").select("cluster_id")
    return clustered.join(n, "cluster_id", "left_semi")


def size_histogram(clustered: DataFrame, by: str = "cluster_id") -> DataFrame:
    return clustered.groupBy(by).agg(F.count("*").alias("cluster_size")).groupBy("cluster_size").agg(F.count("*").alias("n_clusters"))
