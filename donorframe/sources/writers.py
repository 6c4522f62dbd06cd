"""Sinks: statistics, match records, direct matches, filtered variants and reports."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import mode_label, phase


def stat_lines(counts: DataFrame) -> DataFrame:
    """One tab-separated line per mode with comma lists over the thresholds: unit, mode, scheme, line."""
    names = ["qual_min", "baseline_match", "query_match", "query_total"]
    one = [F.format_string("%.6f", "qual_min").alias("qual_min"), *[F.col(n).cast("string").alias(n) for n in names[1:]]]
    by = counts.select("unit", "mode", "scheme", F.struct("t", *one).alias("x")).groupBy("unit", "mode", "scheme").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    lists = [F.array_join(F.col(f"xs.{n}"), ",") for n in names]
    return by.select("unit", "mode", "scheme", F.concat_ws("\t", F.col("unit").cast("string"), F.col("mode").cast("string"), F.col("scheme").cast("string"), *lists).alias("line"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in whatever file system the path names (by Spark's own configuration)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_stat(counts: DataFrame, baseline_total: int, query_total: int, path: str) -> None:
    """A .stat file (at most 12 lines)."""
    head = "#score_unit\tmatch_mode\tscore_scheme\tqual_threshold\tbaseline_match_num\tquery_match_num\tquery_total_num"
    rows = [r.line for r in stat_lines(counts).orderBy("unit", "mode", "scheme").collect()]
    write_text(counts.sparkSession, path, "\n".join([f"##Baseline:{baseline_total}", f"##Query:{query_total}", head, *rows]) + "\n")


def match_rows(results: DataFrame) -> DataFrame:
    """Match records (threshold 0) as the nine text columns."""
    r = results.where("t = 0")
    alt = F.when(F.col("donor0") == F.col("donor1"), F.col("donor0")).otherwise(F.concat_ws("/", "donor0", "donor1"))
    search = F.col("status") == "search"
    listed = lambda c: F.array_join(F.transform(c, lambda v: F.concat_ws(",", (v.pos + 1).cast("string"), v.ref, F.array_join(v.alts, "/"))), ";")

    def phases(c: str):
        strand = F.transform(c, lambda v: F.when(F.col("mode") == 1, F.when(v.choice == 1, "2").otherwise("1")).otherwise(phase(v.choice, v.het, v.multi, v.zero_one)))
        return F.array_join(strand, ";")

    told = lambda c: F.when(search, c).otherwise(".")
    return r.select("query_id", "unit", "mode", "scheme", "chrom", (F.col("pos") + 1).alias("pos"), "ref", alt.alias("alt"), told(listed("vcf1")).alias("vcf1"), told(listed("vcf2")).alias("vcf2"), told(phases("vcf1")).alias("phase1"), told(phases("vcf2")).alias("phase2"), told(F.col("score").cast("string")).alias("score"))


def write_match(results: DataFrame, folder: str) -> None:
    """Match records as text, one folder per query and mode."""
    rows = match_rows(results)
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "ref", "alt", "vcf1", "vcf2", "phase1", "phase2", "score")
    rows.select("query_id", F.concat_ws("_", F.col("unit").cast("string"), F.col("mode").cast("string"), F.col("scheme").cast("string")).alias("match"), line.alias("value")).write.mode("overwrite").partitionBy("query_id", "match").text(folder)


def write_direct(matched: DataFrame, path: str) -> None:
    """Directly matched rows (positions from 0, with a trailing tab)."""
    matched.select(F.concat(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "ref", F.array_join("alts", "/")), F.lit("\t")).alias("value")).write.mode("overwrite").text(path)


def write_duplicates(found: DataFrame, path: str) -> None:
    """Duplicates within a set: chromosome, position from 1, ref, alt and both sets of rows."""
    listed = lambda c: F.array_join(F.transform(c, lambda v: F.concat_ws(",", (v["pos"] + 1).cast("string"), v["ref"], v["alt"])), ";")
    rows = found.where("status = 'match'").orderBy("chrom", "pos", "round")
    write_lines(rows.select(F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), "ref", "alt", listed("set1"), listed("set2")).alias("line")), path)


def write_lines(rows: DataFrame, path: str, column: str = "line") -> None:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def table_html(header: list[str], rows: list[list]) -> str:
    cell = lambda tag, v: f"<{tag}>{html.escape(str(v))}</{tag}>"
    body = ["<tr>" + "".join(cell("th", h) for h in header) + "</tr>"]
    body += ["<tr>" + "".join(cell("td", f"{v:.4f}" if isinstance(v, float) else v) for v in r) + "</tr>" for r in rows]
    return "<table>\n" + "\n".join(body) + "\n</table>"


PLOT = (560, 300, 45)  # width, height and margin
COLORS = ["#4269d0", "#d95f02", "#3ca951", "#a463f2", "#9c6b4e", "#ff8ab7"]


def plot_svg(title: str, lines: dict[str, list[tuple[float, float]]], ticks: list[str] | None = None) -> str:
    """Lines of (x, y) with y in per cent; ticks name the values 0, 1, ... of x, else x is in per cent too."""
    width, height, margin = PLOT
    most = max(1, len(ticks) - 1) if ticks else 100
    at = lambda x, y: (margin + x / most * (width - 2 * margin), height - margin - y / 100 * (height - 2 * margin))
    out = [f'<svg width="{width}" height="{height}" role="img"><title>{html.escape(title)}</title>']
    for y in range(0, 101, 20):
        (x0, h), (x1, _) = at(0, y), at(most, y)
        out.append(f'<line x1="{x0:.1f}" y1="{h:.1f}" x2="{x1:.1f}" y2="{h:.1f}" stroke="#ddd"/><text x="{x0 - 6:.1f}" y="{h + 4:.1f}" font-size="11" text-anchor="end">{y}</text>')
    for x, name in enumerate(ticks) if ticks else [(v, str(v)) for v in range(0, 101, 20)]:
        out.append(f'<text x="{at(x, 0)[0]:.1f}" y="{height - margin + 16}" font-size="11" text-anchor="middle">{html.escape(name)}</text>')
    for i, (name, points) in enumerate(lines.items()):
        color = COLORS[i % len(COLORS)]
        places = [at(*p) for p in points]
        out.append(f'<polyline fill="none" stroke="{color}" stroke-width="2" points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in places)}"/>')
        out += [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3" fill="{color}"/>' for x, y in places]
        out.append(f'<text x="{margin + 8}" y="{16 + 14 * i}" font-size="12" fill="{color}">{html.escape(name)}</text>')
    return "\n".join([*out, "</svg>"])


def write_report(counts: DataFrame, path: str, graphs: bool = True) -> None:
    """A page with recall and precision by mode and by query, and precision-recall pairs (a small table by nature); with
    graphs, recall and precision of all rows over the modes, and a precision-recall curve per mode."""
    rows = counts.withColumn("label", mode_label(F.col("unit"), F.col("mode"), F.col("scheme"))).orderBy("query_id", "unit", "mode", "scheme", "t").collect()
    head = ["query", "mode", "quality", "baseline matched", "query matched", "recall", "precision"]
    line = lambda r: [r.query_id, r.label, r.qual_min, r.baseline_match, r.query_match, r.recall, r.precision]
    whole, labels = [r for r in rows if r.t == 0], list(dict.fromkeys(r.label for r in rows))
    of = lambda some: {f"Query {q}": [r for r in some if r.query_id == q] for q in dict.fromkeys(r.query_id for r in some)}
    parts = ["<!DOCTYPE html><html><head><meta charset='utf-8'><title>Comparison</title></head><body>", "<h1>All rows</h1>", table_html(head, [line(r) for r in whole])]
    if graphs:
        for name in ("recall", "precision"):
            parts += [f"<h2>{name.capitalize()} (%)</h2>", plot_svg(f"{name} by mode", {q: [(labels.index(r.label), r[name]) for r in some] for q, some in of(whole).items()}, labels)]
    for label in labels:
        some = sorted((r for r in rows if r.label == label), key=lambda r: (r.query_id, r.recall, r.precision))
        parts.append(f"<h2>{label}: precision and recall by quality</h2>")
        if graphs:
            parts.append(plot_svg(f"{label}: precision over recall", {q: [(r.recall, r.precision) for r in x] for q, x in of(some).items()}))
        parts.append(table_html(head, [line(r) for r in some]))
    write_text(counts.sparkSession, path, "\n".join([*parts, "</body></html>"]))


def spaced(text: str) -> str:
    return " ".join(text)


def match_block(name: str, r) -> str:
    """A match record with its alleles in columns under the bases that they stand for; used ones are marked."""
    shown = lambda mark, label, text: f'<pre class="{mark}">{html.escape(f"{label:>13}:{spaced(text)}")}</pre>'
    donors = (r.alt or "").split("/")
    out = [f"<h3>{html.escape(name)}</h3>", shown("genome", "Genome REF", r.ref), shown("donor", "Donor 0", donors[0]), shown("donor", "Donor 1", donors[-1])]
    for side, listed, phases in (("Baseline", r.vcf1, r.phase1), ("Query", r.vcf2, r.phase2)):
        if not listed or listed == ".":
            continue
        for one, phase in zip(listed.split(";"), phases.split(";")):
            pos, ref, alts = one.split(",", 2)
            shift, used = " " * (int(pos) - r.pos), phase.split("|")
            out.append(shown("selected" if "0" in used else "", f"{side} REF", shift + ref))
            out += [shown("selected" if str(i) in used else "discard", "ALT", shift + alt) for i, alt in enumerate(alts.split("/"), 1)]
    return "\n".join(out)
