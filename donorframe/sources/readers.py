"""Readers of the text formats, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import genotype_normalized, leading_int, split_nonempty
from ..model import BASELINE, CHROMOSOMES, COLUMNS, MAX_INDEL, QUERY, unused
from ..operators.running import running

#: Bases of one genome row.
CHUNK = 1 << 12
#: Most input files and byte ranges of which a row each (about 200 bytes) is broadcast.
MOST_FILES, MOST_RANGES = 1_000, 100_000


def few_files(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a table with some rows per input file is small enough to broadcast."""
    return len(spark.read.text(path).inputFiles()) <= MOST_FILES


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files (gz too): row_id (from 0 over all lines, files by name), file, line.

    Spark cuts plain files at byte ranges, which different tasks read; a gz file is one range. A first pass counts the lines
    of each range, and sums over the ranges (one row each) number the lines, however the files are cut."""
    read = spark.read.text(path)
    raw = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range_at"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    ranges = raw.groupBy("file", "range_at").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "range_at").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranges.select("file", "range_at", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    # a task reads one range or whole small files, so there are no more ranges than tasks and files
    if read.rdd.getNumPartitions() + len(read.inputFiles()) <= MOST_RANGES:
        shift = F.broadcast(shift)
    return raw.join(shift, ["file", "range_at"]).select((F.col("at") + F.col("shift")).alias("row_id"), "file", "line")


def read_fasta(spark: SparkSession, path: str | list[str], single: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """A genome as rows of fixed size: chrom, chunk_id, start, seq (upper case).

    A record's name is the header up to the first space; unknown names and records with a blank inside a sequence line
    are left out, a blank line ends a record, and so does the end of a file. With `single` all sequence lines of the file
    make one record of that name. Names are taken to stand once.

    Files are read by byte range, so a record is cut by many tasks: running sums over the lines (by stretches of them, with
    carried totals) tell each line its record and its place in it, and lines are then gathered chunk by chunk. A line may be
    as long as the whole record.
    """
    line = F.col("line")
    header, blank = line.startswith(">"), F.trim(F.translate(line, "\t", " ")) == ""
    told = running(
        lines(spark, path).withColumn("bases", F.upper(F.translate(line, " \t", ""))), ["file"], [F.col("row_id")], "row_id",
        record=("sum", header.cast("int"), True), blanks=("sum", blank.cast("int"), True), total=("sum", F.when(header, 0).otherwise(F.length("bases")), False),
    ).withColumn("total", F.coalesce("total", F.lit(0)))
    body = told.where(~header & ~blank)
    if single is not None:
        rows = body.select(F.lit(single).alias("chrom"), F.col("total").alias("at"), "bases")
    else:
        first = lambda c: F.min(F.when(c, F.col("row_id")))
        of_header = lambda c: F.max(F.when(header, c))
        heads = told.groupBy("file", "record").agg(of_header(F.split(F.substr("line", F.lit(2)), " ", 2)[0]).alias("chrom"), of_header(F.col("total")).alias("began"), F.min("blanks").alias("blanks_before"), first(blank).alias("blank_at"), first(~header & ~blank & line.contains(" ")).alias("space_at"))
        # a blank inside a line counts only before the record's first blank line
        sound = heads.where(F.col("chrom").isin(CHROMOSOMES) & (F.col("space_at").isNull() | (F.col("space_at") > F.col("blank_at"))))
        known = sound.select("file", "record", "chrom", "began", "blanks_before")
        known = F.broadcast(known) if few_files(spark, path) else known  # at most 48 names a file
        rows = body.join(known, ["file", "record"]).where("blanks = blanks_before").select("chrom", (F.col("total") - F.col("began")).alias("at"), "bases")
    # a line is cut into pieces of a chunk's size first, so that a long one is gone through once
    short = rows.select("chrom", "at", F.posexplode(F.regexp_extract_all("bases", F.lit(f".{{1,{chunk}}}"), F.lit(0))).alias("i", "bases")).withColumn("at", F.col("at") + F.col("i") * chunk)
    end = F.col("at") + F.length("bases")
    ids = F.explode(F.sequence(F.floor(F.col("at") / chunk).cast("int"), F.floor((end - 1) / chunk).cast("int"))).alias("chunk_id")
    cut = short.select("chrom", "at", "bases", ids).withColumn("from", F.greatest("at", F.col("chunk_id").cast("long") * chunk))
    length = (F.least(end, (F.col("chunk_id").cast("long") + 1) * chunk) - F.col("from")).cast("int")
    pieces = cut.select("chrom", "chunk_id", F.struct("from", F.substr("bases", (F.col("from") - F.col("at") + 1).cast("int"), length).alias("part")).alias("piece"))
    gathered = pieces.groupBy("chrom", "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["part"]), "").alias("seq"))
    return gathered.select("chrom", "chunk_id", (F.col("chunk_id") * chunk).cast("int").alias("start"), "seq")


def genome_windows(genome: DataFrame, windows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Windows (chrom, start, end and any others) with their bases as `seq`: equi-joins on chunks, never the whole genome in
    one place. A window of no bases has an empty seq.

    A window that lies in one chunk is cut out of it where they meet; only the others are put together from parts. So windows
    are read twice."""
    # Spark knows a chunk's size only after it is made, so it has to be told not to broadcast the genome
    g = genome.select("chrom", "chunk_id", F.col("start").alias("g_start"), "seq").hint("merge")
    chunk_of = lambda at: F.floor(at / chunk).cast("int")
    within = F.coalesce((F.col("end") > F.col("start")) & (chunk_of(F.col("start")) == chunk_of(F.col("end") - 1)), F.lit(False))
    here = windows.where(within).withColumn("chunk_id", chunk_of(F.col("start"))).join(g, ["chrom", "chunk_id"], "left")
    cut = F.substr("seq", F.col("start") - F.col("g_start") + 1, F.col("end") - F.col("start"))
    near = here.withColumn("seq", F.coalesce(cut, F.lit(""))).select(*windows.columns, "seq")

    key = ["chrom", "start", "end"]
    over = windows.where(~within)
    asked = over.where("end > start").select(*key).distinct()
    pieces = asked.select(*key, F.explode(F.sequence(chunk_of(F.col("start")), chunk_of(F.col("end") - 1))).alias("chunk_id"))
    low = F.greatest(F.col("start") - F.col("g_start"), F.lit(0))
    high = F.least(F.col("end") - F.col("g_start"), F.length("seq"))
    found = pieces.join(g, ["chrom", "chunk_id"]).select(*key, "chunk_id", F.substr("seq", low + 1, F.greatest(high - low, F.lit(0))).alias("part"))
    joined = found.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "part"))), lambda p: p.part), "").alias("seq"))
    far = over.join(joined.hint("merge"), key, "left").withColumn("seq", F.coalesce("seq", F.lit(""))).select(*windows.columns, "seq")
    return near.unionByName(far)


def short_windows(genome: DataFrame, windows: DataFrame, longest: int, chunk: int = CHUNK) -> DataFrame:
    """genome_windows for windows of at most `longest` bases (no more than a chunk): each chunk gets the first bases of the
    next, so that a window lies in one row and one join finds it."""
    g = genome.select("chrom", "chunk_id", F.col("start").alias("g_start"), "seq")
    following = genome.select("chrom", (F.col("chunk_id") - 1).alias("chunk_id"), F.left("seq", F.lit(longest)).alias("more"))
    # neither side of the joins is broadcast (see genome_windows)
    wide = g.join(following.hint("merge"), ["chrom", "chunk_id"], "left").select("chrom", "chunk_id", "g_start", F.concat("seq", F.coalesce("more", F.lit(""))).alias("seq"))
    asked = windows.withColumn("chunk_id", F.floor(F.col("start") / chunk).cast("int"))
    seq = F.substr("seq", F.col("start") - F.col("g_start") + 1, F.greatest(F.col("end") - F.col("start"), F.lit(0)))
    return asked.join(wide.hint("merge"), ["chrom", "chunk_id"], "left").withColumn("seq", F.coalesce(seq, F.lit(""))).drop("chunk_id", "g_start")


def derived(df: DataFrame) -> DataFrame:
    """Add multi, mil and mdl from ref and alts."""
    over = lambda a, b: F.greatest(F.lit(0), F.array_max(F.transform("alts", lambda x: a(x) - b(x)))).cast("int")
    ref, alt = (lambda x: F.length("ref")), F.length
    return df.withColumns({"multi": F.size("alts") > 1, "mil": over(alt, ref), "mdl": over(ref, alt)})


def read_vcf(spark: SparkSession, path: str | list[str], side: str = BASELINE, query_id: int = 0, genome: DataFrame | None = None, use_genotype: bool = True, keep_line: bool = False, filters: bool = True, longest: int | None = None) -> DataFrame:
    """Variants of VCF text files.

    Fields are split at tabs without empty ones; rows of under six fields are left out. Genotypes are read through the
    FORMAT of the first full row, up to the first row that has under ten fields or whose genotype has not two parts;
    from there on rows have no genotype. 0/0 rows, indels of over 100 bases and (given a genome) rows on other
    chromosomes are left out, and with `longest` those with an allele of so many bases or more. Rows are in the order of
    the files by name, and each file has its own FORMAT and its own end of genotypes; query_qualities() has the cut-offs'
    population.
    """
    one_each = F.broadcast if few_files(spark, path) else lambda df: df  # a row per file
    raw = lines(spark, path).where((F.length("line") > 1) & ~F.col("line").startswith("#"))
    raw = raw.withColumn("cols", split_nonempty(F.col("line"), "\t"))
    col = lambda i: F.get("cols", F.lit(i))
    wide = F.size("cols") >= 10
    index = raw.where(wide).groupBy("file").agg(F.min_by(col(8), "row_id").alias("format")).select("file", (F.array_position(F.split("format", ":"), "GT") - 1).cast("int").alias("gt_at"))
    rows = raw.join(one_each(index), "file", "left")
    token = F.when(wide & (F.col("gt_at") >= 0), F.get(F.split(col(9), ":"), F.col("gt_at")))
    rows = rows.withColumn("gt", token)
    slash, bar = F.split("gt", "/", -1), F.split("gt", r"\|", -1)
    parts = F.when(F.size(slash) == 2, slash).when(F.size(bar) == 2, bar)
    rows = rows.withColumn("gts", parts)
    first_bad = rows.where(F.col("gts").isNull()).groupBy("file").agg(F.min("row_id").alias("off_at"))
    rows = rows.join(one_each(first_bad), "file", "left")
    on = F.lit(use_genotype) & (F.col("off_at").isNull() | (F.col("row_id") < F.col("off_at")))
    rows = rows.where(F.size("cols") >= 6).withColumn("gts", F.when(on, F.col("gts")))
    out = _variants(rows, col, side, query_id, genome, keep_line, filters)
    return out if longest is None else out.where((F.length("ref") < longest) & F.forall("alts", lambda x: F.length(x) < longest))


def _variants(rows: DataFrame, col, side: str, query_id: int, genome: DataFrame | None, keep_line: bool, filters: bool) -> DataFrame:
    known = F.col("gts").isNotNull()
    g = lambda i: F.get("gts", F.lit(i))
    listed = split_nonempty(F.upper(col(4)), ",")
    chosen = F.array_distinct(F.transform(F.filter("gts", lambda x: x != "0"), lambda x: F.get(listed, x.try_cast("int") - 1)))
    picked = F.when((F.size(listed) > 2) & known, F.filter(chosen, lambda x: x.isNotNull())).otherwise(F.slice(listed, 1, 2))
    kept = F.when(F.size(picked) > 0, picked).otherwise(F.slice(listed, 1, 2))
    out = rows.select(
        "row_id", F.lit(side).alias("side"), F.lit(query_id).alias("query_id"), col(0).alias("chrom"), (leading_int(col(1)) - 1).alias("pos"),
        F.upper(col(3)).alias("ref"), kept.alias("alts"), F.coalesce(g(0) != g(1), F.lit(False)).alias("het"),
        F.coalesce((g(0) == "0") | (g(1) == "0"), F.lit(False)).alias("zero_one"), F.when(col(5) == ".", 1.0).otherwise(col(5).try_cast("double")).alias("qual"),
        F.coalesce((g(0) == "0") & (g(1) == "0"), F.lit(False)).alias("hom_ref"), "line",
    )
    out = derived(out)
    if filters:
        out = keep_usable(out, genome)
    return out.select(*COLUMNS, *(["line"] if keep_line else []))


def keep_usable(variants: DataFrame, genome: DataFrame | None = None) -> DataFrame:
    """Without 0/0 rows (column hom_ref, if there), indels of over 100 bases and rows on chromosomes not in the genome."""
    out = variants.where((F.col("mil") <= MAX_INDEL) & (F.col("mdl") <= MAX_INDEL))
    if "hom_ref" in out.columns:
        out = out.where(~F.col("hom_ref"))
    if genome is not None:
        out = out.join(F.broadcast(genome.select("chrom").distinct()), "chrom", "left_semi")  # at most 48 names
    return out


def query_qualities(spark: SparkSession, path: str) -> DataFrame:
    """Qualities of all rows of at least six fields, before any filter: the population of the quality cut-offs."""
    raw = lines(spark, path).where((F.length("line") > 1) & ~F.col("line").startswith("#")).withColumn("cols", split_nonempty(F.col("line"), "\t"))
    q = F.get("cols", F.lit(5))
    return raw.where(F.size("cols") >= 6).select(F.when(q == ".", 1.0).otherwise(q.try_cast("double")).cast("float").cast("double").alias("qual"))


def haploid_alleles(variants: DataFrame, gt: Column | None = None) -> DataFrame:
    """One row per allele with its type S, I or D; given a genotype (text such as 0/1), only of the alleles that it calls."""
    from ..functions.scalar import snp_type

    calls = unused(variants, "calls")
    told = variants.withColumn(calls, F.lit(None).cast("array<string>") if gt is None else F.split(gt, r"[/|]", -1))
    listed = told.select("*", F.posexplode("alts").alias("allele", "alt"))
    called = listed if gt is None else listed.where(F.array_contains(calls, (F.col("allele") + 1).cast("string")))
    return called.drop(calls).withColumn("snp_type", snp_type(F.col("ref"), F.col("alt")))


def read_haploid(spark: SparkSession, path: str, side: str = BASELINE) -> DataFrame:
    """Called alleles of a VCF file, one row each: row_id, side, chrom, pos, ref, alt, allele, snp_type, gt (sorted, joined
    by a bar). Each row's own FORMAT tells where its genotype is; rows without a genotype of two parts are left out."""
    raw = lines(spark, path).where((F.length("line") > 1) & ~F.col("line").startswith("#")).withColumn("cols", split_nonempty(F.col("line"), "\t"))
    col = lambda i: F.get("cols", F.lit(i))
    at = F.array_position(F.split(col(8), ":"), "GT") - 1
    rows = raw.where(F.size("cols") >= 10).withColumn("gt", F.when(at >= 0, F.get(F.split(col(9), ":"), at.cast("int")))).where(F.size(F.split("gt", r"[/|]", -1)) == 2)
    told = rows.select("row_id", F.lit(side).alias("side"), col(0).alias("chrom"), (leading_int(col(1)) - 1).alias("pos"), F.upper(col(3)).alias("ref"), split_nonempty(F.upper(col(4)), ",").alias("alts"), "gt")
    return haploid_alleles(told, F.col("gt")).withColumn("gt", genotype_normalized(F.col("gt"))).drop("alts")


def first_of_each(variants: DataFrame, near: tuple[str, ...] = ()) -> DataFrame:
    """The first row (by row_id) of each chromosome, position, ref and alt; rows of several alts are left out. near: columns
    that equal rows share and by which they are partitioned already."""
    several = F.size("alts") != 1
    # rows of several alts go last and are dropped with the rest, as a filter on them would be pushed down to where alts are
    # made, and make them once more for each time that it names them
    w = Window.partitionBy(*near, "side", "query_id", "chrom", "pos", "ref", F.get("alts", F.lit(0))).orderBy(F.coalesce(several, F.lit(True)), "row_id")
    name = unused(variants, "nth")
    return variants.withColumn(name, F.row_number().over(w)).where((F.col(name) == 1) & ~several).drop(name)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Intervals: chrom, start (from 0), end (exclusive)."""
    return spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start int, end int", mode="DROPMALFORMED").where(F.col("start").isNotNull() & F.col("end").isNotNull())


MATCH = "chrom string, pos int, ref string, alt string, vcf1 string, vcf2 string, phase1 string, phase2 string, score string"


def read_match(spark: SparkSession, path: str, file_id: int = 0) -> DataFrame:
    """Match records; the last row of each chromosome and position wins."""
    rows = lines(spark, path).where(~F.col("line").startswith("#") & (F.length("line") > 0)).withColumn("c", F.split("line", "\t", -1))
    names = [x.split(" ")[0] for x in MATCH.split(", ")]
    fields = [(F.get("c", F.lit(i)).cast("int") if n == "pos" else F.get("c", F.lit(i))).alias(n) for i, n in enumerate(names)]
    last = rows.select("row_id", *fields).groupBy("chrom", "pos").agg(F.max_by(F.struct(*[n for n in names if n not in ("chrom", "pos")]), "row_id").alias("r"))
    return last.select(F.lit(file_id).alias("file_id"), "chrom", "pos", "r.*")


def read_stat(spark: SparkSession, path: str) -> DataFrame:
    """Counts per mode and threshold: unit, mode, scheme, t, qual_min, baseline_match, query_match, query_total,
    baseline_total, query_rows."""
    rows = lines(spark, path)
    total = lambda name: rows.where(F.col("line").startswith(f"##{name}:")).agg(F.max(F.split("line", ":")[1].cast("long")))
    c = rows.where(~F.col("line").startswith("#") & (F.length("line") > 1)).select(F.split("line", "\t").alias("c"))
    many = lambda i, t: F.split(F.get("c", F.lit(i)), ",").cast(f"array<{t}>")
    zipped = F.arrays_zip(many(3, "double").alias("qual_min"), many(4, "long").alias("baseline_match"), many(5, "long").alias("query_match"), many(6, "long").alias("query_total"))
    out = c.select(*[F.get("c", F.lit(i)).cast("int").alias(n) for i, n in enumerate(("unit", "mode", "scheme"))], F.posexplode(zipped).alias("t", "z")).select("unit", "mode", "scheme", "t", "z.*")
    return out.join(F.broadcast(total("Baseline").toDF("baseline_total"))).join(F.broadcast(total("Query").toDF("query_rows")))


def sides(baseline: DataFrame, query: DataFrame) -> DataFrame:
    """Both sides in one table."""
    return baseline.withColumn("side", F.lit(BASELINE)).unionByName(query.withColumn("side", F.lit(QUERY)))
