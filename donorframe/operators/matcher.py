"""The matcher over all clusters, thresholds and modes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import comparison_order, edit_distance_by_choice
from ..kept import keep
from ..model import SINGLE_LIMIT, Scoring
from ..sources.readers import genome_windows
from .exact import same_genotype
from .search import Row, Search, direct, edits_total, window_of

RECORD = "array<struct<pos: int, ref: string, alts: array<string>, choice: int, het: boolean, multi: boolean, zero_one: boolean>>"
RESULT = f"query_id int, t int, unit int, mode int, scheme int, cluster_id string, chrom string, status string, score int, baseline_match int, query_match int, baseline_edits int, query_edits int, pos int, ref string, donor0 string, donor1 string, vcf1 {RECORD}, vcf2 {RECORD}"


def _record(row: Row, choice: int) -> dict:
    return {"pos": row.pos, "ref": row.ref, "alts": list(row.alts), "choice": choice, "het": row.het, "multi": row.multi, "zero_one": row.zero_one}


def solve(rows: list[Row], window: str, offset: int, scoring: Scoring) -> list[dict]:
    """Match records of one cluster: one of the search, or one per pair where the search was given up."""
    found = Search(rows, window, offset, scoring).best()
    if found is None:
        return []
    if found == "budget":
        out = []
        for i, k in direct(rows):
            e = edits_total(rows[i], 0, 0)
            out.append({"status": "direct", "score": None, "baseline_match": 1, "query_match": 1, "baseline_edits": e, "query_edits": e, "pos": rows[i].pos, "ref": rows[i].ref, "donor0": rows[i].alts[0], "donor1": rows[i].alts[1] if rows[i].multi else rows[i].alts[0], "vcf1": [_record(rows[i], 0)], "vcf2": [_record(rows[k], 0)]})
        return out
    used = [[(r, c) for r, c in zip(rows, found.choices) if r.side == s and c not in (None, "")] for s in (0, 1)]
    edits = [sum(edits_total(r, c, scoring.mode) for r, c in u) for u in used]
    donor1 = found.donors[1] if scoring.mode == 0 else found.donors[0]
    return [{"status": "search", "score": found.score, "baseline_match": len(used[0]), "query_match": len(used[1]), "baseline_edits": edits[0], "query_edits": edits[1], "pos": offset, "ref": window, "donor0": found.donors[0], "donor1": donor1, "vcf1": [_record(*u) for u in used[0]], "vcf2": [_record(*u) for u in used[1]]}]


def settled(groups: DataFrame, modes: DataFrame) -> DataFrame:
    """RESULT for clusters of one equal pair (struct columns b and q; ts: the thresholds that leave it), by column expressions."""
    used = lambda side: F.array(F.struct(*[F.col(f"{side}.{c}") for c in ("pos", "ref", "alts")], F.lit(0).alias("choice"), *[F.col(f"{side}.{c}") for c in ("het", "multi", "zero_one")]))
    first, second = (F.get("b.alts", F.lit(i)) for i in (0, 1))
    edits = edit_distance_by_choice(F.col("b.ref"), F.col("b.alts"), F.lit(0), F.col("b.multi"), F.col("b.zero_one")).cast("int")
    one = F.lit(1)
    return groups.withColumn("t", F.explode("ts")).join(modes).select(
        "query_id", "t", "unit", "mode", "scheme", "cluster_id", "chrom", F.lit("equal").alias("status"), F.lit(None).cast("int").alias("score"),
        one.alias("baseline_match"), one.alias("query_match"), edits.alias("baseline_edits"), edits.alias("query_edits"), F.col("b.pos").alias("pos"), F.col("b.ref").alias("ref"),
        first.alias("donor0"), F.when(F.col("b.multi"), second).otherwise(first).alias("donor1"), used("b").alias("vcf1"), used("q").alias("vcf2"),
    )


def outmatched() -> Column:
    """One row against more than SINGLE_LIMIT of the other side, whose changes together it exceeds (columns rows, n_b, n_q)."""
    total = lambda side, c: F.aggregate(F.filter("rows", lambda r: r["side"] == side), F.lit(0), lambda n, r: n + r[c])
    change = {side: F.greatest(total(side, "mil"), total(side, "mdl")) for side in ("baseline", "query")}
    lone = lambda few, many, a, b: (F.col(few) == 1) & (F.col(many) > SINGLE_LIMIT) & (change[a] > change[b])
    return lone("n_b", "n_q", "baseline", "query") | lone("n_q", "n_b", "query", "baseline")


def rows_left(clusters: DataFrame, thresholds: DataFrame) -> DataFrame:
    """What thresholds (t, qual_min) leave of the rows of clusters (array gathered, with qual): a row per cluster and distinct
    array `rows`, with all thresholds that leave it (ts)."""
    levels = F.broadcast(thresholds.agg(F.array_sort(F.collect_list(F.struct("qual_min", "t"))).alias("levels")))  # five at most
    left = F.transform("levels", lambda x: F.struct(x["t"].alias("t"), F.filter("gathered", lambda r: r["qual"] >= x["qual_min"]).alias("rows")))
    names = [c for c in clusters.columns if c != "gathered"]
    cut = clusters.join(levels).select(*names, left.alias("left")).select(*names, "left", F.explode(F.array_distinct("left.rows")).alias("rows"))
    ts = F.transform(F.filter("left", lambda x: x["rows"] == F.col("rows")), lambda x: x["t"])
    return cut.select(*names, ts.alias("ts"), "rows")


def match_clusters(clustered: DataFrame, genome: DataFrame, thresholds: DataFrame, chosen: list[Scoring]) -> DataFrame:
    """Results per cluster, threshold and mode (RESULT). clustered: rows of both sides with query_id and cluster_id.

    Rows are gathered once per cluster; what a threshold leaves of them is cut out of the gathered row, and thresholds that
    leave the same rows (ts) go on as one. Clusters left with one side, those that can match nothing, and equal pairs are
    settled by column expressions. The rest is dealt out by cluster and rows left with the bases of its window, once for all
    modes, and each result is told for all of ts.
    """
    order = [c.alias(f"o{i}") for i, c in enumerate(comparison_order())]
    fields = ["side", "pos", "ref", "alts", "het", "multi", "zero_one", "mil", "mdl"]
    both = clustered.groupBy("query_id", "chrom", "cluster_id").agg(F.array_sort(F.collect_list(F.struct(*order, *fields, "qual"))).alias("gathered"), F.count_distinct("side").alias("sides")).where("sides = 2")
    both = keep(both, "gathered")  # the cut-offs and the two ways below read it
    one = ["query_id", "chrom", "cluster_id"]
    key = [*one, "ts"]
    count = lambda side: F.size(F.filter("rows", lambda r: r["side"] == side))
    groups = rows_left(both, thresholds).select(*key, "rows").withColumns({"n_b": count("baseline"), "n_q": count("query")}).where("n_b > 0 and n_q > 0")
    at = lambda side: F.get(F.filter("rows", lambda r: r["side"] == side), F.lit(0))
    pair = groups.withColumns({"b": at("baseline"), "q": at("query")})
    equal = (F.col("n_b") == 1) & (F.col("n_q") == 1) & (F.col("b.pos") == F.col("q.pos")) & (F.col("b.ref") == F.col("q.ref")) & same_genotype()
    spark = clustered.sparkSession
    modes = F.broadcast(spark.createDataFrame([(s.unit, s.mode, s.scheme) for s in chosen], "unit int, mode int, scheme int"))  # 12 rows at most
    told = pair.withColumn("equal", F.coalesce(equal, F.lit(False)))
    ends = F.transform("rows", lambda r: r["pos"] + F.length(r["ref"]))
    open_ = told.where(~F.col("equal") & ~outmatched()).select(*key, "rows", F.greatest(F.array_min(F.transform("rows", lambda r: r["pos"])) - 1, F.lit(0)).alias("start"), (F.array_max(ends) + 1).alias("end"))

    def run(batches):
        names = [x.split(" ")[0] for x in RESULT.replace(RECORD, "x").split(", ")]
        for frame in batches:
            out = []
            for r in frame.to_dict("records"):
                variants = [Row.of(v) for v in r["rows"]]
                offset, _ = window_of(variants)
                for s in chosen:
                    told = {k: r[k] for k in one} | {"unit": s.unit, "mode": s.mode, "scheme": s.scheme}
                    out += [told | {"t": t} | f for f in solve(variants, r["seq"], offset, s) for t in r["ts"]]
            yield pd.DataFrame(out, columns=names).astype({"score": "object"})

    dealt = genome_windows(genome, open_).repartition("cluster_id", "ts", "query_id")
    found = dealt.select(*key, "rows", "seq").mapInPandas(run, RESULT)
    return settled(told.where("equal"), modes).unionByName(found)
