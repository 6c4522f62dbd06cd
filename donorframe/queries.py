"""Driver queries over the variant view of lineitem, with their SQL.

The view makes a baseline of odd and a query of even lines. Every query and its SQL use the same projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar
from .functions.combinations import k_subsets, k_subsets_with_sum
from .kept import keep
from .model import scorings
from .operators import clustering, exact, intervals, metrics
from .operators.consuming import consuming_matches
from .operators.duplicates import duplicates_by_side
from .operators.matcher import match_clusters
from .operators.normalize import normalize_variants
from .operators.running import running
from .operators.strands import match_strands
from .sources.readers import CHUNK, derived, first_of_each, haploid_alleles, keep_usable, short_windows

REACH = 30


def variants(spark: SparkSession, sf_dir: str, at: str = "pos") -> DataFrame:
    """The variant view, with gt and sort keys that make order total. at: what refs and alts follow, the position or
    VARIED."""
    base = lambda x: f"substring('ACGT', 1 + cast(({x}) % 4 as int), 1)"
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey * 10 + l_linenumber AS row_id", "IF(l_linenumber % 2 = 1, 'baseline', 'query') AS side", "1 AS query_id",
        "cast(1 + l_suppkey % 22 AS string) AS chrom", "cast(l_partkey * 50 + (l_suppkey div 22) * 12 AS int) AS pos",
        "CASE l_returnflag WHEN 'A' THEN '0/1' WHEN 'N' THEN '1/1' ELSE '1/2' END AS gt", "cast(round(l_tax * 100) AS int) AS tax", "cast(l_quantity AS int) AS quantity", "l_extendedprice AS qual",
    ).selectExpr("*", f"{at} AS at").selectExpr("*", f"{base('at')} AS ref")
    alts = f"CASE WHEN tax % 4 = 3 THEN array(concat(ref, {base('at + 1')})) WHEN gt = '1/2' THEN array({base('at + 1')}, {base('at + 2')}) ELSE array({base('at + 1 + quantity % 3')}) END"
    out = raw.selectExpr("row_id", "side", "query_id", "chrom", "pos", "ref", f"{alts} AS alts", "gt", "gt <> '1/1' AS het", "gt = '0/1' AS zero_one", "qual")
    return derived(out)


def both_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = variants(spark, sf_dir)
    return v.where("side = 'baseline'"), v.where("side = 'query'")


BASE = lambda x: f"substr('ACGT', CAST(1 + ({x}) % 4 AS INT), 1)"


def view_sql(at: str = "pos") -> str:
    """The variant view in SQL; at: what refs and alts follow."""
    return f"""
raw AS (
  SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_linenumber % 2 = 1 THEN 'baseline' ELSE 'query' END AS side,
    CAST(1 + l_suppkey % 22 AS VARCHAR) AS chrom, CAST(l_partkey * 50 + (l_suppkey // 22) * 12 AS INT) AS pos,
    CASE l_returnflag WHEN 'A' THEN '0/1' WHEN 'N' THEN '1/1' ELSE '1/2' END AS gt, CAST(round(l_tax * 100) AS INT) AS tax,
    CAST(trunc(l_quantity) AS INT) AS quantity, l_extendedprice AS qual FROM lineitem
), withref AS (SELECT *, {BASE("site")} AS ref FROM (SELECT *, {at} AS site FROM raw)),
v0 AS (
  SELECT row_id, side, chrom, pos, ref, gt, qual, gt <> '1/1' AS het, gt = '0/1' AS zero_one,
    CASE WHEN tax % 4 = 3 THEN [ref || {BASE("site + 1")}] WHEN gt = '1/2' THEN [{BASE("site + 1")}, {BASE("site + 2")}]
      ELSE [{BASE("site + 1 + quantity % 3")}] END AS alts FROM withref
), v AS (
  SELECT *, len(alts) > 1 AS multi, CAST(greatest(0, length(alts[1]) - length(ref)) AS INT) AS mil, CAST(greatest(0, length(ref) - length(alts[1])) AS INT) AS mdl FROM v0
), b AS (SELECT * FROM v WHERE side = 'baseline'), q AS (SELECT * FROM v WHERE side = 'query')
"""
VIEW = view_sql()
SHARED = "len(list_filter(b.alts, lambda x: list_contains(q.alts, x)))"
SAME = f"""b.chrom = q.chrom AND b.pos = q.pos AND b.ref = q.ref AND (
  (b.het = q.het AND b.multi = q.multi AND CASE WHEN b.multi AND b.het THEN {SHARED} >= 2 ELSE b.alts[1] = q.alts[1] END)
  OR (b.multi AND b.zero_one AND q.multi AND q.zero_one AND {SHARED} >= 2))"""
ALLELE = "b.chrom = q.chrom AND b.pos = q.pos AND b.ref = q.ref AND list_has_any(b.alts, q.alts)"
ROW = "row_id, chrom, pos, ref, array_to_string(alts, '/') AS alt, gt, qual"


def shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("row_id", "chrom", "pos", "ref", F.array_join("alts", "/").alias("alt"), "gt", "qual", *more)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = f"WITH {VIEW} {sql}"
        return f

    return add


@query(f"SELECT {ROW}, side, het, multi, zero_one, mil, mdl FROM v")
def variant_view(spark, sf_dir):
    return shown(variants(spark, sf_dir), "side", "het", "multi", "zero_one", "mil", "mdl")


@query(f"SELECT {ROW} FROM v WHERE gt <> '1/1' AND mil <= 0 AND mdl <= 100 AND chrom IN (SELECT DISTINCT chrom FROM v WHERE CAST(chrom AS INT) <= 11)")
def filter_homref_longindel_chrom(spark, sf_dir):
    v = variants(spark, sf_dir)
    names = F.broadcast(v.where(F.col("chrom").cast("int") <= 11).select("chrom").distinct())  # at most 22 names
    return shown(v.where("gt <> '1/1' AND mil <= 0 AND mdl <= 100").join(names, "chrom", "left_semi"))


@query(f"SELECT {ROW} FROM q WHERE EXISTS (SELECT 1 FROM b WHERE {SAME})")
def exact_match_genotype(spark, sf_dir):
    b, q = both_sides(spark, sf_dir)
    return shown(exact.matched(q, b))


@query(f"SELECT {ROW} FROM q WHERE EXISTS (SELECT 1 FROM b WHERE {ALLELE})")
def exact_match_allele(spark, sf_dir):
    b, q = both_sides(spark, sf_dir)
    return shown(exact.matched(q, b, "allele"))


@query(f"""SELECT {ROW} FROM q WHERE EXISTS (SELECT 1 FROM b WHERE b.chrom = q.chrom AND b.pos = q.pos AND b.ref = q.ref
  AND CASE WHEN b.multi AND b.het AND q.multi AND q.het THEN list_has_any(b.alts, q.alts) ELSE b.alts[1] = q.alts[1] END)""")
def exact_match_lenient(spark, sf_dir):
    b, q = both_sides(spark, sf_dir)
    return shown(exact.matched(q, b, "lenient"))


@query("""SELECT bb.chrom, bb.pos, bb.ref, bb.alt, bb.gt, bb.n, bb.row_id AS b_row, qq.row_id AS q_row FROM
  (SELECT chrom, pos, ref, array_to_string(alts, '/') AS alt, gt, row_id, row_number() OVER (PARTITION BY chrom, pos, ref, alts, gt ORDER BY row_id, qual) AS n FROM b) bb JOIN
  (SELECT chrom, pos, ref, array_to_string(alts, '/') AS alt, gt, row_id, row_number() OVER (PARTITION BY chrom, pos, ref, alts, gt ORDER BY row_id, qual) AS n FROM q) qq USING (chrom, pos, ref, alt, gt, n)""")
def exact_match_one_to_one(spark, sf_dir):
    key = ["chrom", "pos", "ref", "alt", "gt"]
    b, q = (x.withColumn("alt", F.array_join("alts", "/")) for x in both_sides(spark, sf_dir))
    number = lambda df, name: df.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("row_id", "qual")).alias("n"), F.col("row_id").alias(name))
    return number(b, "b_row").join(number(q, "q_row"), [*key, "n"])


@query(f"SELECT b.row_id AS b_row, b.chrom, b.pos, b.ref, array_to_string(b.alts, '/') AS b_alt, min(q.row_id) AS q_row FROM b JOIN q ON {SAME} GROUP BY 1, 2, 3, 4, 5")
def cluster_inner_first_match(spark, sf_dir):
    b, q = both_sides(spark, sf_dir)
    return exact.first_match(b, q).withColumn("b_alt", F.array_join("b_alts", "/")).drop("b_alts")


@query(f"SELECT {ROW} FROM q WHERE NOT EXISTS (SELECT 1 FROM b WHERE {SAME})")
def unmatched_query(spark, sf_dir):
    b, q = both_sides(spark, sf_dir)
    return shown(exact.matched(q, b, negate=True))


@query(f"SELECT {ROW} FROM b WHERE NOT EXISTS (SELECT 1 FROM q WHERE {SAME})")
def unmatched_baseline(spark, sf_dir):
    b, q = both_sides(spark, sf_dir)
    return shown(exact.matched(b, q, negate=True))


ORDER = "pos, CASE side WHEN 'query' THEN 0 ELSE 1 END, row_id, qual"


@query(f"SELECT {ROW}, side, row_number() OVER (PARTITION BY chrom ORDER BY {ORDER}) AS order_in_chrom FROM v")
def merged_order(spark, sf_dir):
    return shown(running(variants(spark, sf_dir), ["chrom"], [*scalar.comparison_order(), F.col("qual")], order_in_chrom=("sum", F.lit(1), True)), "side", "order_in_chrom")


def indel_windows(v: DataFrame) -> DataFrame:
    return v.where("mil > 0 OR mdl > 0").select("chrom", (F.col("pos") - REACH).alias("start"), (F.col("pos") + REACH).alias("end"))


MERGED = f"""m0 AS (SELECT chrom, pos - {REACH} AS s, pos + {REACH} AS e FROM v WHERE mil > 0 OR mdl > 0),
m1 AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS fresh FROM m0),
m2 AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m1),
merged AS (SELECT chrom, min(s) AS s, max(e) AS e FROM m2 GROUP BY chrom, run)"""
query(f", {MERGED} SELECT chrom, s AS start, e AS \"end\" FROM merged", "interval_merge")(lambda spark, sf_dir: intervals.merge_intervals(indel_windows(variants(spark, sf_dir))))


def bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("cast(1 + p_partkey % 20 AS string) AS chrom", "cast(p_partkey * 50 AS int) AS start", "cast(p_partkey * 50 + p_size * 8 AS int) AS end")


BED = "bed AS (SELECT CAST(1 + p_partkey % 20 AS VARCHAR) AS chrom, CAST(p_partkey * 50 AS INT) AS s, CAST(p_partkey * 50 + p_size * 8 AS INT) AS e FROM part)"
HIT = "EXISTS (SELECT 1 FROM bed WHERE bed.chrom = v.chrom AND bed.s <= v.pos AND v.pos < bed.e)"
ABSENT = "v.chrom NOT IN (SELECT chrom FROM bed)"
query(f", {BED} SELECT {ROW} FROM v WHERE {HIT} OR {ABSENT}", "bed_inside")(lambda spark, sf_dir: shown(intervals.bed_filter(variants(spark, sf_dir), bed(spark, sf_dir))))
query(f", {BED} SELECT {ROW} FROM v WHERE NOT {HIT} OR {ABSENT}", "bed_outside")(lambda spark, sf_dir: shown(intervals.bed_filter(variants(spark, sf_dir), bed(spark, sf_dir), inside=False)))
for side in ("inside", "outside"):
    QUERIES[f"bed_{side}_whole"] = QUERIES[f"bed_{side}"]
    SQL[f"bed_{side}_whole"] = SQL[f"bed_{side}"]


@query(f""", {MERGED}, near AS (SELECT * FROM v WHERE EXISTS (SELECT 1 FROM merged WHERE merged.chrom = v.chrom AND merged.s <= v.pos AND v.pos < merged.e)),
c AS (SELECT *, pos - lag(pos) OVER w AS before, lead(pos) OVER w - pos AS after FROM near WINDOW w AS (PARTITION BY chrom ORDER BY pos, row_id))
SELECT {ROW} FROM c WHERE coalesce(before <= {REACH}, false) OR coalesce(after <= {REACH}, false)""")
def complex_filter(spark, sf_dir):
    return shown(intervals.complex_filter(variants(spark, sf_dir), REACH))


GAPS = f"gaps AS (SELECT *, pos - max(pos + length(ref)) OVER (PARTITION BY chrom ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM v)"
query(f", {GAPS} SELECT {ROW}, side, gap FROM gaps", "running_gap")(lambda spark, sf_dir: shown(gaps(variants(spark, sf_dir)), "side", "gap"))


def gaps(v: DataFrame) -> DataFrame:
    """running_gaps with the view's total order."""
    return clustering.running_gaps(v, [*scalar.comparison_order(), F.col("qual")]).drop("run_end")


def snv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).where("mil = 0 AND mdl = 0")


SNV = f"""s AS (SELECT * FROM v WHERE mil = 0 AND mdl = 0),
g AS (SELECT *, pos - max(pos + length(ref)) OVER (PARTITION BY chrom ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM s),
k AS (SELECT *, CAST(sum(CASE WHEN gap >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster_no FROM g)"""
query(f", {SNV} SELECT {ROW}, side, cluster_no FROM k", "snv_clusters")(lambda spark, sf_dir: shown(clustering.cluster_unchanging(snv(spark, sf_dir)), "side", "cluster_no"))
query(f", {SNV} SELECT cluster_size, count(*) AS n_clusters FROM (SELECT count(*) AS cluster_size FROM k GROUP BY chrom, cluster_no) GROUP BY 1", "cluster_size_histogram")(lambda spark, sf_dir: clustering.size_histogram(snv_named(spark, sf_dir)))
query(f", {SNV} SELECT chrom, cluster_no, count(*) AS n, count(*) FILTER (side = 'query') AS n_query FROM k GROUP BY 1, 2 HAVING count(DISTINCT side) = 2", "two_sided_clusters")(
    lambda spark, sf_dir: clustering.two_sided(snv_named(spark, sf_dir)).groupBy("chrom", "cluster_no").agg(F.count("*").alias("n"), F.count_if(F.col("side") == "query").alias("n_query"))
)


#: Hexadecimal digits for 32 positions, a hash; of every four stretches of 128 positions about one is periodic instead, so
#: gaps that are tandem repeats and gaps that are not both occur.
DIGITS = "IF(ascii(md5(cast({0} div 4 AS string))) % 4 = 0, repeat('0123', 8), md5(cast({0} AS string)))"
#: What refs and genome follow instead of the position.
VARIED = f"instr('0123456789abcdef', substring({DIGITS.format('(pos div 32)')}, 1 + pos % 32, 1)) - 1"


def genome(spark: SparkSession, sf_dir: str, chunk: int = CHUNK) -> DataFrame:
    """The genome of the view that follows VARIED, in chunks. (That of the plain view is periodic: every long gap would
    be a tandem repeat, and whole chromosomes one cluster.)"""
    top = variants(spark, sf_dir).agg(F.max("pos")).first()[0]
    n = (top + 200) // chunk + 1 if top is not None else 0
    # a task makes some MB of bases, however long the genome is
    ids = spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, n // 64)).select(F.col("id").cast("int").alias("chunk_id"))
    names = spark.range(1, 23).select(F.col("id").cast("string").alias("chrom"))
    digits = f"array_join(transform(sequence(0, {chunk // 32 - 1}), i -> {DIGITS.format(f'(chunk_id * {chunk // 32} + i)')}), '')"
    bases = ids.select("chunk_id", F.expr(f"translate({digits}, '0123456789abcdef', 'ACGTACGTACGTACGT')").alias("seq"))
    return F.broadcast(names).join(bases).select("chrom", "chunk_id", (F.col("chunk_id") * chunk).cast("int").alias("start"), "seq")


# The same digits, refs and genome in SQL.
DIGITS_SQL = "CASE WHEN ascii(md5(CAST(({0}) // 4 AS VARCHAR))) % 4 = 0 THEN repeat('0123', 8) ELSE md5(CAST({0} AS VARCHAR)) END"
VARIED_SQL = f"instr('0123456789abcdef', substr({DIGITS_SQL.format('(pos // 32)')}, 1 + pos % 32, 1)) - 1"
REPEATED = "length(s) = 1 OR len(list_filter(range(1, length(s) // 2 + 1), lambda u: substr(s, 1, u * (length(s) // u)) = repeat(substr(s, 1, u), length(s) // u))) > 0"
BETWEEN = f"substr(translate(array_to_string(list_transform(range(s0 // 32, (s0 + gap - 1) // 32 + 1), lambda i: {DIGITS_SQL.format('i')}), ''), '0123456789abcdef', 'ACGTACGTACGTACGT'), CAST(1 + s0 % 32 AS INT), gap)"


def clusters_sql(rows: str = "v", backwards: bool = False, two_sides: bool = True, free: bool = True) -> str:
    """The clustering rule as a fold over all rows of each chromosome, one after the other."""
    at = "-(pos + length(ref))" if backwards else "pos"
    query = "b" if two_sides else "true"  # whether a row's insertions go to the first sum
    no_change = "greatest(u, v) = 0 OR " if free else ""
    return f"""WITH RECURSIVE {view_sql(VARIED_SQL)},
p AS (SELECT *, {at} AS place FROM {rows}),
o AS (SELECT *, row_number() OVER w AS rn, max(place + length(ref)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run_end FROM p
  WINDOW w AS (PARTITION BY chrom ORDER BY place, CASE side WHEN 'query' THEN 0 ELSE 1 END, row_id, ref, alts, qual)),
g AS (SELECT *, place - run_end AS gap, {"-place" if backwards else "run_end"} AS s0 FROM o),
apart AS (SELECT chrom, rn, {BETWEEN} AS s FROM g WHERE gap BETWEEN 2 AND 1000),
r AS MATERIALIZED (SELECT g.chrom, g.rn, gap, CASE WHEN {query} THEN mil ELSE mdl END AS du, CASE WHEN {query} THEN mdl ELSE mil END AS dv, coalesce({REPEATED}, false) AS same
  FROM (SELECT *, side = 'baseline' AS b FROM g) g LEFT JOIN apart USING (chrom, rn)),
f AS (SELECT chrom, rn, du AS u, dv AS v, 0 AS n FROM r WHERE rn = 1
  UNION ALL SELECT chrom, rn, CASE WHEN cut THEN 0 ELSE u END + du, CASE WHEN cut THEN 0 ELSE v END + dv, n + CASE WHEN cut THEN 1 ELSE 0 END
  FROM (SELECT r.*, u, v, n, gap >= 2 AND ({no_change}(gap > 2 * greatest(u, v) AND (gap > 1000 OR NOT same))) AS cut FROM f JOIN r ON r.chrom = f.chrom AND r.rn = f.rn + 1))
SELECT {ROW}, side, chrom || ':' || min(pos) OVER (PARTITION BY chrom, n) AS cluster_id FROM g JOIN f USING (chrom, rn)"""


def clustering_query(name: str, side: str | None = None, backwards: bool = False, rule: clustering.Rule = clustering.LIVE) -> None:
    """Clusters over the varied genome, named by their chromosome and least position."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = variants(spark, sf_dir, VARIED)
        found = clustering.cluster(rows if side is None else rows.where(F.col("side") == side), genome(spark, sf_dir), backwards, rule, once=True)
        least = F.min("pos").over(Window.partitionBy("cluster_id"))
        return shown(found.withColumn("cluster_id", F.concat_ws(":", "chrom", least.cast("string"))), "side", "cluster_id")

    QUERIES[name], SQL[name] = run, clusters_sql("v" if side is None else side[0], backwards, rule.two_sides, rule.free)


clustering_query("cluster_general")
clustering_query("cluster_backwards", backwards=True)
clustering_query("cluster_haploid", rule=clustering.HAPLOID)
clustering_query("cluster_one_set", side="baseline", rule=clustering.ONE_SET)


def matching(unit: int, mode: int, scheme: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = genome(spark, sf_dir)
        found = match_clusters(clustering.cluster(variants(spark, sf_dir, VARIED), g), g, cuts(spark, sf_dir), scorings(unit, mode, scheme))
        return found.select("t", "cluster_id", "chrom", "pos", "status", "score", "baseline_match", "query_match", "baseline_edits", "query_edits")

    return run


def match_consuming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal donors of both sides on one strand, round by round."""
    g = genome(spark, sf_dir)
    found = consuming_matches(clustering.cluster(variants(spark, sf_dir, VARIED), g, rule=clustering.HAPLOID), g)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "/").alias(c)
    return found.select("cluster_id", "chrom", "round", "status", ids("b_rows"), ids("q_rows"), "pos", "ref", "alt")


def left_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows over the varied genome, shifted to the left."""
    return shown(normalize_variants(variants(spark, sf_dir, VARIED), genome(spark, sf_dir)), "side")


def match_two_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best two-strand matches, scored by rows and by reference bases."""
    g = genome(spark, sf_dir)
    clustered = clustering.cluster(variants(spark, sf_dir, VARIED), g)
    by_bases = match_strands(clustered, g, bases=True).select("cluster_id", F.col("score").alias("bases"))
    told = match_strands(clustered, g).join(by_bases, "cluster_id")
    return told.select("cluster_id", "chrom", "status", "score", "bases", "baseline_match", "query_match", "pos", "donor0", "donor1")


def with_joint_rows(v: DataFrame, g: DataFrame) -> DataFrame:
    """The rows of one alt, and for every second of them and the one after it (of a side, within 60 bases) a row that says
    what both say; its row_id is below 0."""
    # equal rows and neighbours are told from one shuffle by stretches
    near = ("chrom", "near")
    cut = v.withColumn("near", F.floor(F.col("pos") / (1 << 16))).repartition(*near)
    order = Window.partitionBy(*near, "side").orderBy("pos", "row_id", "ref", "alts")
    told = first_of_each(cut, near).withColumns({"nth": F.row_number().over(order), "after": F.lead(F.struct("pos", "ref", "alts")).over(order)})
    kept = keep(told.select(*v.columns, F.when(F.col("nth") % 2 == 1, F.col("after")).alias("after")), "rows")
    rows = kept.drop("after")  # the pairs and the result read them
    pairs = kept.withColumn("start", F.col("pos")).where("after.pos BETWEEN pos + length(ref) AND pos + length(ref) + 60")
    wide = short_windows(g, pairs.withColumn("end", F.expr("after.pos + length(after.ref)")), 200)
    between = F.expr("substring(seq, length(ref) + 1, after.pos - pos - length(ref))")
    joint = wide.withColumns({"alts": F.array(F.concat(F.get("alts", F.lit(0)), between, F.get("after.alts", F.lit(0)))), "row_id": -F.col("row_id") - 1}).withColumn("ref", F.col("seq"))
    return rows.unionByName(keep(derived(joint.select(rows.columns)), "joint"))


def set_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsets of one side that say the same, of both sides, with joint rows."""
    g = genome(spark, sf_dir)
    v = variants(spark, sf_dir, VARIED).drop("gt", "het", "zero_one", "qual")
    found = duplicates_by_side(with_joint_rows(v, g), g)
    listed = lambda c: F.array_join(F.transform(f"{c}.row_id", lambda x: x.cast("string")), "/").alias(c)
    return found.select("side", "cluster_id", "chrom", "round", "status", listed("set1"), listed("set2"), "pos", "ref", "alt")


QUERIES |= {"match_consuming": match_consuming, "match_two_strands": match_two_strands, "set_duplicates": set_duplicates, "left_normalized": left_normalized}
for s in scorings():
    QUERIES[f"match_search_{s.unit}_{s.mode}_{s.scheme}"] = matching(s.unit, s.mode, s.scheme)


@query("SELECT p_partkey, p_name, length(p_name) = 1 OR len(list_filter(range(1, length(p_name) // 2 + 1), lambda u: substr(p_name, 1, u * (length(p_name) // u)) = repeat(substr(p_name, 1, u), length(p_name) // u))) > 0 AS is_repeat FROM (SELECT p_partkey, repeat(substr(p_name, 1, CAST(1 + p_partkey % 5 AS INT)), CAST(1 + p_size % 3 AS INT)) AS p_name FROM part)")
def tandem_repeat(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", "repeat(substring(p_name, 1, cast(1 + p_partkey % 5 AS int)), cast(1 + p_size % 3 AS int)) AS p_name")
    return p.withColumn("is_repeat", scalar.is_tandem_repeat(F.col("p_name")))


@query("SELECT row_id, ref, alts[1] AS alt, CAST(levenshtein(ref, alts[1]) AS INT) AS distance FROM v")
def edit_distance(spark, sf_dir):
    return variants(spark, sf_dir).select("row_id", "ref", F.get("alts", F.lit(0)).alias("alt"), scalar.edit_distance(F.col("ref"), F.get("alts", F.lit(0))).alias("distance"))


@query("""SELECT row_id, qual, c.choice, CAST(CASE c.choice WHEN -1 THEN d1 WHEN -2 THEN d2 WHEN 0 THEN d1 + CASE WHEN multi AND NOT zero_one THEN d2 ELSE 0 END ELSE d1 + d2 END AS INT) AS distance
FROM (SELECT *, levenshtein(ref, alts[1]) AS d1, coalesce(levenshtein(ref, alts[2]), 0) AS d2 FROM v), (VALUES (-2), (-1), (0), (1)) c(choice)""")
def edit_distance_by_choice(spark, sf_dir):
    v = variants(spark, sf_dir).withColumn("choice", F.explode(F.array(*[F.lit(x) for x in (-2, -1, 0, 1)])))
    return v.select("row_id", "qual", "choice", scalar.edit_distance_by_choice(F.col("ref"), F.col("alts"), F.col("choice"), F.col("multi"), F.col("zero_one")).alias("distance"))


MODES = "modes AS (SELECT CAST(u AS INT) AS unit, CAST(m AS INT) AS mode, CAST(s AS INT) AS scheme FROM range(2) a(u), range(2) b(m), range(3) c(s))"
#: A mode for every line.
LINE_MODES = ["l_orderkey", "l_linenumber", "cast(l_linenumber % 2 as int) AS unit", "cast(l_partkey % 2 as int) AS mode", "cast(l_suppkey % 3 as int) AS scheme"]
LINES = "m AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber % 2 AS INT) AS unit, CAST(l_partkey % 2 AS INT) AS mode, CAST(l_suppkey % 3 AS INT) AS scheme FROM lineitem)"


@query(f", {LINES} SELECT *, unit * 8 + mode * 4 + scheme AS mode_index, unit AS unit_back, mode AS mode_back, scheme AS scheme_back FROM m")
def mode_codec(spark, sf_dir):
    m = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*LINE_MODES).withColumn("mode_index", scalar.mode_index(F.col("unit"), F.col("mode"), F.col("scheme")))
    unit, mode, scheme = scalar.mode_parts(F.col("mode_index"))
    return m.select("*", unit.alias("unit_back"), mode.alias("mode_back"), scheme.alias("scheme_back"))


@query(f", {LINES} SELECT *, CASE unit WHEN 0 THEN 'U' ELSE 'E' END || CASE mode WHEN 0 THEN 'G' ELSE 'V' END || CASE scheme WHEN 0 THEN 'T' WHEN 1 THEN 'B' ELSE 'Q' END AS label FROM m")
def mode_label(spark, sf_dir):
    m = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*LINE_MODES)
    return m.withColumn("label", scalar.mode_label(F.col("unit"), F.col("mode"), F.col("scheme")))


@query(f", {MODES} SELECT m.unit, m.mode, m.scheme, side, count(*) AS n FROM modes m, v GROUP BY ALL")
def mode_grid(spark, sf_dir):
    m = F.broadcast(metrics.modes(spark, scorings()).select("unit", "mode", "scheme"))  # 12 rows
    n = variants(spark, sf_dir).groupBy("side").agg(F.count("*").alias("n"))
    return n.join(m).select("unit", "mode", "scheme", "side", "n")


@query("SELECT side, CASE WHEN length(a) > length(ref) THEN 'I' WHEN length(a) < length(ref) THEN 'D' ELSE 'S' END AS snp_type, count(*) AS n FROM (SELECT side, ref, unnest(alts) AS a FROM v) GROUP BY 1, 2")
def snp_type_counts(spark, sf_dir):
    v = variants(spark, sf_dir).select("side", "ref", F.explode("alts").alias("a"))
    return v.groupBy("side", scalar.snp_type(F.col("ref"), F.col("a")).alias("snp_type")).agg(F.count("*").alias("n"))


query("SELECT side, count(*) AS n_rows, count(*) FILTER (length(alts[1]) <> length(ref)) AS n_indels FROM v GROUP BY 1", "indel_counts")(lambda spark, sf_dir: metrics.indel_counts(variants(spark, sf_dir)))
query(f"SELECT CAST(trunc(q.qual) AS INT) AS qual, count(*) AS n FROM q WHERE EXISTS (SELECT 1 FROM b WHERE {SAME}) GROUP BY 1", "matches_by_quality")(
    lambda spark, sf_dir: metrics.matches_by_quality(exact.matched(*reversed(both_sides(spark, sf_dir))))
)


@query("SELECT row_id, qual, g AS gt, array_to_string(list_sort(string_split(replace(g, '/', '|'), '|')), '|') AS normal FROM (SELECT row_id, qual, CASE WHEN row_id % 3 = 0 THEN reverse(gt) ELSE gt END AS g FROM v)")
def gt_normalized(spark, sf_dir):
    v = variants(spark, sf_dir).select("row_id", "qual", F.expr("IF(row_id % 3 = 0, reverse(gt), gt)").alias("gt"))
    return v.withColumn("normal", scalar.genotype_normalized(F.col("gt")))


AROUND = 8


def apply_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first alt of every row applied to the genome around it."""
    asked = variants(spark, sf_dir, VARIED).withColumns({"start": F.greatest(F.col("pos") - AROUND, F.lit(0)), "end": F.col("pos") + F.length("ref") + AROUND})
    at = F.col("pos") - F.col("start")
    # refs of the view have one base
    return short_windows(genome(spark, sf_dir), asked, 2 * AROUND + 1).select("row_id", "qual", "seq", scalar.apply_variant(F.col("seq"), at, F.length("ref"), F.get("alts", F.lit(0))).alias("donor"))


QUERIES["apply_variant"], SQL["apply_variant"] = apply_variant, f"""WITH {view_sql(VARIED_SQL)}, w AS (SELECT *, greatest(pos - {AROUND}, 0) AS s0, pos + length(ref) + {AROUND} - greatest(pos - {AROUND}, 0) AS gap FROM v),
x AS (SELECT *, {BETWEEN} AS seq FROM w) SELECT row_id, qual, seq, substr(seq, 1, pos - s0) || alts[1] || substr(seq, pos - s0 + length(ref) + 1) AS donor FROM x"""


@query("SELECT row_id, qual, side FROM (SELECT *, CASE WHEN quantity % 10 = 0 THEN '0/0' ELSE gt END AS g FROM (SELECT v.*, raw.quantity FROM v JOIN raw USING (row_id, side, chrom, pos, qual))) WHERE g <> '0/0' AND quantity * 3 <= 100 AND CAST(chrom AS INT) <= 11")
def usable_rows(spark, sf_dir):
    """Rows without 0/0 calls, long insertions (three bases for each of the quantity) and unknown chromosomes."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey * 10 + l_linenumber AS row_id", "IF(l_linenumber % 2 = 1, 'baseline', 'query') AS side", "cast(1 + l_suppkey % 22 AS string) AS chrom", "cast(l_quantity AS int) AS quantity", "l_extendedprice AS qual", "'A' AS ref")
    rows = derived(line.withColumns({"alts": F.array(F.concat("ref", F.repeat(F.lit("C"), F.col("quantity") * 3))), "hom_ref": F.col("quantity") % 10 == 0}))
    known = genome(spark, sf_dir).where(F.col("chrom").cast("int") <= 11)
    return keep_usable(rows, known).select("row_id", "qual", "side")


@query("""SELECT row_id, qual, side, allele, alt, CASE WHEN length(alt) > length(ref) THEN 'I' WHEN length(alt) < length(ref) THEN 'D' ELSE 'S' END AS snp_type
  FROM (SELECT *, CAST(unnest(range(len(alts))) AS INT) AS allele, unnest(alts) AS alt FROM v) WHERE list_contains(string_split(gt, '/'), CAST(allele + 1 AS VARCHAR))""")
def called_alleles(spark, sf_dir):
    return haploid_alleles(variants(spark, sf_dir), F.col("gt")).select("row_id", "qual", "side", "allele", "alt", "snp_type")


@query("""SELECT row_id, qual, c.choice, CASE c.choice WHEN 0 THEN CASE WHEN NOT het THEN '1|1' WHEN multi AND NOT zero_one THEN '1|2' ELSE '1|0' END
  WHEN 1 THEN CASE WHEN multi AND NOT zero_one THEN '2|1' WHEN multi THEN '2|0' ELSE '0|1' END WHEN -1 THEN '0|1' WHEN -2 THEN '0|2' END AS phase FROM v, (VALUES (-2), (-1), (0), (1)) c(choice)""")
def phases(spark, sf_dir):
    v = variants(spark, sf_dir).withColumn("choice", F.explode(F.array(*[F.lit(x) for x in (-2, -1, 0, 1)])))
    return v.select("row_id", "qual", "choice", scalar.phase(F.col("choice"), F.col("het"), F.col("multi"), F.col("zero_one")).alias("phase"))


TRIM = """t AS (SELECT p_partkey, p_brand || '-' || p_type AS ref, p_brand || p_name || p_type AS alt FROM part),
t1 AS (SELECT *, list_max(list_filter(range(0, least(length(ref), length(alt))), lambda k: right(ref, k) = right(alt, k))) AS tail FROM t),
t2 AS (SELECT p_partkey, left(ref, length(ref) - tail) AS ref, left(alt, length(alt) - tail) AS alt FROM t1),
t3 AS (SELECT *, CAST(list_max(list_filter(range(0, least(length(ref), length(alt))), lambda k: left(ref, k) = left(alt, k))) AS INT) AS chopped FROM t2)"""


@query(f", {TRIM} SELECT p_partkey, chopped, substr(ref, chopped + 1) AS ref, substr(alt, chopped + 1) AS alt FROM t3")
def trimmed_alleles(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    told = scalar.trim_alleles(F.concat("p_brand", F.lit("-"), "p_type"), F.concat("p_brand", "p_name", "p_type"))
    return p.select("p_partkey", told.alias("t")).select("p_partkey", "t.*")


@query("""SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS words, CAST(p_partkey % 1000 AS INT) AS n, upper(p_name) = upper(lower(p_name)) AS same,
  starts_with(upper(p_type), upper(left(p_type, CAST(1 + p_size % 9 AS INT)))) OR starts_with(upper(left(p_type, CAST(1 + p_size % 9 AS INT))), upper(p_type)) AS prefix FROM part""")
def text_functions(spark, sf_dir):
    p, cut = spark.read.parquet(f"{sf_dir}/part.parquet"), F.expr("lower(left(p_type, 1 + p_size % 9))")
    number = scalar.leading_int(F.concat((F.col("p_partkey") % 1000).cast("string"), F.lit("x"), "p_name"))
    return p.select("p_partkey", scalar.split_nonempty(F.col("p_name"), " ").alias("words"), number.alias("n"), scalar.same_letters(F.col("p_name"), F.lower("p_name")).alias("same"), scalar.prefix_match(F.col("p_type"), cut).alias("prefix"))


PER_POSITION = """lb AS (SELECT DISTINCT ON (chrom, pos) * FROM b ORDER BY chrom, pos, row_id DESC, qual DESC), lq AS (SELECT DISTINCT ON (chrom, pos) * FROM q ORDER BY chrom, pos, row_id DESC, qual DESC)"""


@query(f", {PER_POSITION} SELECT b.chrom, b.pos, b.row_id AS b_row, q.row_id AS q_row FROM lb b JOIN lq q ON {SAME}")
def match_per_position(spark, sf_dir):
    # row ids are not unique in this view: quality decides between rows of one id
    first = lambda df: df.orderBy("qual").groupBy("chrom", "pos", "row_id").agg(F.max_by(F.struct("ref", "alts", "het", "multi", "zero_one"), "qual").alias("r")).select("chrom", "pos", "row_id", "r.*")
    return exact.one_per_position(*map(first, both_sides(spark, sf_dir)))


def snv_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_unchanging(snv(spark, sf_dir)).withColumn("cluster_id", F.concat_ws(":", "chrom", F.col("cluster_no").cast("string")))


@query(f""", {SNV}, kb AS (SELECT * FROM k WHERE side = 'baseline'), kq AS (SELECT * FROM k WHERE side = 'query')
SELECT b.row_id AS b_row, b.chrom, b.pos, b.ref, array_to_string(b.alts, '/') AS b_alt, min(q.row_id) AS q_row FROM kb b JOIN kq q ON b.cluster_no = q.cluster_no AND {SAME} GROUP BY 1, 2, 3, 4, 5""")
def match_inside_clusters(spark, sf_dir):
    rows = snv_named(spark, sf_dir)
    return exact.first_match(rows.where("side = 'baseline'"), rows.where("side = 'query'")).withColumn("b_alt", F.array_join("b_alts", "/")).drop("b_alts")


def gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows between gaps of at least 2, gathered in order."""
    rows = clustering.cluster_unchanging(variants(spark, sf_dir))
    one = F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*scalar.comparison_order(), F.col("qual")])], "row_id", (F.length(F.get("alts", F.lit(0))) - F.length("ref")).alias("change"))
    return rows.groupBy("chrom", "cluster_no").agg(F.array_sort(F.collect_list(one)).alias("listed"))


GROUPED = f"""{GAPS}, k AS (SELECT *, CAST(sum(CASE WHEN gap >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster_no FROM gaps),
n AS (SELECT *, row_number() OVER (PARTITION BY chrom, cluster_no ORDER BY {ORDER}) - 1 AS i, count(*) OVER (PARTITION BY chrom, cluster_no) AS n, length(alts[1]) - length(ref) AS change FROM k),
two AS (SELECT a.chrom, a.cluster_no, a.i * (2 * a.n - a.i - 1) // 2 + b.i - a.i - 1 AS rank, a.row_id || '/' || b.row_id AS rows, a.change + b.change AS change FROM n a JOIN n b ON a.chrom = b.chrom AND a.cluster_no = b.cluster_no AND a.i < b.i)"""


def two_rows(found: DataFrame) -> DataFrame:
    return found.select("chrom", "cluster_no", "rank", F.array_join(F.transform("listed.row_id", lambda x: x.cast("string")), "/").alias("rows"))


query(f", {GROUPED} SELECT chrom, cluster_no, rank, rows FROM two", "subsets_of_two")(lambda spark, sf_dir: two_rows(k_subsets(gap_groups(spark, sf_dir), "listed", 2)))
query(f", {GROUPED} SELECT chrom, cluster_no, rank, rows FROM two WHERE change = 1", "subsets_of_two_with_sum")(lambda spark, sf_dir: two_rows(k_subsets_with_sum(gap_groups(spark, sf_dir), "listed", 2, "change", 1)))


CUTS = """sorted AS (SELECT qual, row_number() OVER (ORDER BY qual) AS rn FROM q WHERE qual IS NOT NULL),
n AS (SELECT count(*) AS total, count(*) FILTER (qual < 0.1) AS low FROM sorted),
p(t, p) AS (VALUES (0, 0.0::DOUBLE), (1, 0.1::DOUBLE), (2, 0.2::DOUBLE), (3, 0.3::DOUBLE), (4, 0.9::DOUBLE)),
picked AS (SELECT t, qual, total FROM p, n, sorted WHERE rn = least(low + CAST(trunc((total - low) * p) AS BIGINT), total - 1) + 1),
cuts AS (SELECT CAST(t AS INT) AS t, CASE WHEN t = 0 THEN 0.0 ELSE qual END AS qual_min,
  CASE WHEN t = 0 THEN 0.0 ELSE least(1.0, ((SELECT count(*) FROM sorted x WHERE x.qual < picked.qual) + 1)::DOUBLE / total) END AS pct FROM picked)"""


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quality_thresholds(both_sides(spark, sf_dir)[1].select("qual"))


query(f", {CUTS} SELECT t, qual_min, pct FROM cuts", "quality_thresholds")(cuts)
TOTALS = "totals AS (SELECT cuts.*, CAST(trunc((SELECT count(*) FROM q) * (1 - pct)) AS BIGINT) AS query_total, (SELECT count(*) FROM q WHERE q.qual >= qual_min) AS query_exact FROM cuts)"
query(f", {CUTS}, {TOTALS} SELECT * FROM totals", "query_totals_by_threshold")(lambda spark, sf_dir: metrics.totals_by_threshold(both_sides(spark, sf_dir)[1], cuts(spark, sf_dir)))
BOTH = f"""bq AS (SELECT b.row_id AS b_row, b.qual AS b_qual, b.ref AS r1, q.row_id AS q_row, q.qual AS q_qual FROM b JOIN q ON {SAME}),
counts AS (SELECT totals.t, qual_min, query_total, (SELECT count(*) FROM b) AS baseline_total,
  (SELECT count(DISTINCT (q_row, q_qual)) FROM bq WHERE q_qual >= qual_min AND b_qual >= qual_min) AS query_match,
  (SELECT count(DISTINCT (b_row, b_qual)) FROM bq WHERE q_qual >= qual_min AND b_qual >= qual_min) AS baseline_match FROM totals)"""


def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directly matched rows of both sides per cut-off: equal pairs are found once, then counted for every cut-off that
    both rows reach."""
    b, q = both_sides(spark, sf_dir)
    totals = metrics.totals_by_threshold(q, cuts(spark, sf_dir))
    pairs = b.alias("b").join(q.alias("q"), exact.on_key() & exact.same_genotype()).select(F.struct("b.row_id", "b.qual").alias("b"), F.struct("q.row_id", "q.qual").alias("q"), F.least("b.qual", "q.qual").alias("both"))
    hit = pairs.join(F.broadcast(totals.select("t", "qual_min")), F.col("both") >= F.col("qual_min"))  # five cut-offs
    n = hit.groupBy("t").agg(F.count_distinct("q").alias("query_match"), F.count_distinct("b").alias("baseline_match"))
    out = totals.join(n, "t", "left").join(F.broadcast(b.agg(F.count("*").alias("baseline_total")))).na.fill(0, ["query_match", "baseline_match"])
    return out.select("t", "qual_min", "query_total", "baseline_total", "query_match", "baseline_match")


query(f", {CUTS}, {TOTALS}, {BOTH} SELECT * FROM counts", "match_counts_by_threshold")(match_counts)
RATES = "CASE WHEN baseline_total = 0 THEN 0.0 ELSE baseline_match * 100.0::DOUBLE / baseline_total END AS recall, CASE WHEN query_total = 0 THEN 0.0 ELSE query_match * 100.0::DOUBLE / query_total END AS precision"
query(f", {CUTS}, {TOTALS}, {BOTH} SELECT *, {RATES} FROM counts", "recall_precision")(lambda spark, sf_dir: metrics.recall_precision(match_counts(spark, sf_dir)))
query(f", {CUTS}, {TOTALS}, {BOTH} SELECT *, baseline_total - baseline_match AS baseline_mismatch, query_total - query_match AS query_mismatch FROM counts", "mismatches")(lambda spark, sf_dir: metrics.mismatches(match_counts(spark, sf_dir)))
query(f", {CUTS}, {TOTALS}, {BOTH}, r AS (SELECT *, {RATES} FROM counts) SELECT t, recall, precision, CAST(row_number() OVER (ORDER BY recall, precision, t) AS INT) AS point FROM r", "pr_curve")(
    lambda spark, sf_dir: metrics.pr_curve(match_counts(spark, sf_dir).withColumns({"unit": F.lit(0), "mode": F.lit(0), "scheme": F.lit(0)})).select("t", "recall", "precision", "point")
)


@query(f", {CUTS}, {TOTALS}, {BOTH} SELECT concat_ws(chr(9), '0', '0', '0', string_agg(format('{{:.6f}}', qual_min), ',' ORDER BY t), string_agg(baseline_match::VARCHAR, ',' ORDER BY t), string_agg(query_match::VARCHAR, ',' ORDER BY t), string_agg(query_total::VARCHAR, ',' ORDER BY t)) AS line FROM counts")
def stat_lines(spark, sf_dir):
    from .sources.writers import stat_lines as lines

    return lines(match_counts(spark, sf_dir).withColumns({"unit": F.lit(0), "mode": F.lit(0), "scheme": F.lit(0)})).select("line")


FILES = "f AS (SELECT CAST(row_id % 2 AS INT) AS file_id, chrom, pos, min(ref) AS ref, max(array_to_string(alts, '/')) AS alt FROM v GROUP BY 1, 2, 3)"


@query(f", {FILES} SELECT chrom, pos, count(DISTINCT file_id) AS n_files, string_agg(file_id || '=' || alt, ';' ORDER BY file_id, alt) AS donors FROM f GROUP BY 1, 2 HAVING count(DISTINCT file_id) < 2 OR count(DISTINCT ref || ' ' || alt) > 1")
def match_diff(spark, sf_dir):
    return diff_of_halves(variants(spark, sf_dir))


QUERIES["match_diff_whole"], SQL["match_diff_whole"] = QUERIES["match_diff"], SQL["match_diff"]


def diff_of_halves(v: DataFrame) -> DataFrame:
    v = v.withColumn("alt", F.array_join("alts", "/")).repartition("chrom", "pos")  # serves both groupings
    files = v.groupBy((F.col("row_id") % 2).cast("int").alias("file_id"), "chrom", "pos").agg(F.min("ref").alias("ref"), F.max("alt").alias("alt"))
    return metrics.match_diff(files, 2)


@query("SELECT side, chrom, pos, ref, alts[1] AS alt, min(row_id) AS row_id FROM v WHERE len(alts) = 1 GROUP BY 1, 2, 3, 4, 5")
def dedup_exact(spark, sf_dir):
    return first_of_each(variants(spark, sf_dir)).select("side", "chrom", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), "row_id")


@query("SELECT side, count(*) AS n FROM v GROUP BY 1")
def side_totals(spark, sf_dir):
    return variants(spark, sf_dir).groupBy("side").agg(F.count("*").alias("n"))


@query(f"SELECT {ROW}, side, coalesce(max(pos + length(ref)) OVER (PARTITION BY side, chrom ORDER BY pos, row_id, qual ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > pos, false) AS overlaps FROM v")
def overlapping(spark, sf_dir):
    return shown(intervals.overlapping(variants(spark, sf_dir)), "side", "overlaps")
