"""Removal of long repeats with a logarithmic family of sparse suffix arrays.

A suffix enters an array where it starts at an anchor: in every run of LENGTH bytes the position (of those whose GRAM
bytes lie inside) with the least gram hash, the leftmost on ties. Equal runs choose the same anchor, so two places of a
repeated run always meet in the arrays, and the arrays hold about one suffix in 120 bytes. Suffixes are ordered by the
fingerprint of their first GRAM bytes, not by the bytes: of the merge-scan only equality of beginnings is asked.

The family: documents come in batches. A new batch gets its array, is merge-scanned against every level held (sorted
joins on the fingerprint) for common beginnings, and becomes a level of its own; levels of equal size are merged before
the next batch, so a suffix is rewritten once per doubling. Marks work backwards too: a suffix of an old level that a new
batch repeats is found by its fingerprint in the end.

Verification: of the suffixes with a repeated beginning, contexts (LENGTH - GRAM bytes before, LENGTH after the anchor)
are compared. Equal whole contexts are repeats throughout. The other contexts of a group are compared run by run over all
LENGTH - GRAM + 1 offsets by the window's hash, each group's contexts once per class of equal contexts; groups of
more than LARGE classes do this by a shuffle on the window hash instead of in one task. A run that occurs elsewhere marks
its bytes. Equality is that of 128 bits, the 64 of the fingerprint and 64 of the context or window; no bytes are compared.
Documents are scanned once for suffixes, once for the contexts of repeated ones, and once for the result.

Defined cases: a null text is empty; matches never cross documents; repeated rows are repeats of each other; null ids are
handled like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import BASE, INVERSE, _byte_values, blocks, buffers, mix, powers
from .workspace import Workspace, prepare

LENGTH = 400
GRAM = 160
BATCHES = 4
LARGE = 20_000
#: Bytes of one text that are scanned at a time.
PIECE = 2 << 20
SECOND = 0xC2B2AE3D27D4EB4F
SECOND_INVERSE = pow(SECOND, -1, 1 << 64)
ODD = np.uint64(0x9FB21C651E98DF25)


class Prefix:
    """Prefix sums of a byte buffer from which the hash of any stretch follows."""

    def __init__(self, data: np.ndarray, double: bool = True):
        values = _byte_values()[data]
        n = len(data)
        self.sums, self.inverse = [], []
        for base, inverse in ((BASE, INVERSE), (SECOND, SECOND_INVERSE))[: 1 + double]:
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(values * powers(n, base), out=s[1:])
            self.sums.append(s)
            self.inverse.append(powers(n + 1, inverse))

    def short(self, start: np.ndarray, size: int) -> np.ndarray:
        return mix((self.sums[0][start + size] - self.sums[0][start]) * self.inverse[0][start])

    def both(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = ((s[end] - s[start]) * inv[start] for s, inv in zip(self.sums, self.inverse))
        return mix(a) + mix(b) * ODD + (end - start).astype(np.uint64)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours, in two passes."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, windows: tuple[int, int] | None = None) -> tuple[np.ndarray, ...]:
    """Anchors of the texts in a buffer: text number, position in the buffer, fingerprint, context hash."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    if len(data) < length:
        return none
    prefix = Prefix(data)
    low, high = windows or (0, len(data) - length + 1)
    high = min(high, len(data) - length + 1)
    if high <= low:
        return none
    width = length - gram + 1
    at = np.arange(low, high + width - 1)
    h = prefix.short(at, gram)
    bits = np.uint64((1 << 24) - 1)
    least = (sliding_least((h & ~bits) | np.arange(len(h), dtype=np.uint64), width) & bits).astype(np.int64)
    doc = np.searchsorted(offsets, np.arange(low, high), "right") - 1
    least = least[np.arange(low, high) + length <= offsets[doc + 1]]
    if not len(least):
        return none
    least = least[np.r_[True, least[1:] != least[:-1]]]
    pos = least + low
    doc = np.searchsorted(offsets, pos, "right") - 1
    start = np.maximum(offsets[doc], pos - (length - gram))
    end = np.minimum(offsets[doc + 1], pos + length)
    context = prefix.both(start, end) ^ mix((pos - start).astype(np.uint64))
    return doc, pos, h[least], context


def text_anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """find_anchors for any size: a long text is scanned in pieces with margins. Positions count from the text's start."""
    if len(offsets) > 2 or len(data) <= PIECE + 4 * length:
        doc, pos, g, c = find_anchors(data, offsets, length, gram)
        return doc, pos - offsets[doc], g, c
    found: dict[int, tuple[int, int]] = {}
    for low in range(0, len(data) - length + 1, PIECE):
        a, b = max(0, low - 2 * length), min(len(data), low + PIECE + 3 * length)
        _, pos, g, c = find_anchors(data[a:b], np.array([0, b - a]), length, gram, (low - a, low - a + PIECE))
        found |= {p + a: (x, y) for p, x, y in zip(pos.tolist(), g.tolist(), c.tolist())}
    pos = np.array(sorted(found), dtype=np.int64)
    return np.zeros(len(pos), np.int64), pos, np.array([found[p][0] for p in pos.tolist()], np.uint64), np.array([found[p][1] for p in pos.tolist()], np.uint64)


def suffixes(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchored suffixes of documents (doc_id, text, mark): doc_id, mark, at, g (fingerprint), c (context hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column("text")):
                doc, pos, g, c = text_anchors(*buffers(batch.column("text").slice(a, b - a)), length, gram)
                if len(doc):
                    row = pa.array(doc + a)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("mark").take(row), pa.array(pos, pa.int32()), pa.array(g.view(np.int64)), pa.array(c.view(np.int64))], ["doc_id", "mark", "at", "g", "c"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, at int, g long, c long")


class Family:
    """Levels of sorted fingerprints; sizes are counted in batches and double upwards."""

    def __init__(self, work: Workspace):
        self.work = work
        self.levels: list[tuple[int, DataFrame]] = []
        self.repeated: DataFrame | None = None

    def append(self, batch: DataFrame) -> None:
        """Take a batch of suffixes (column g) in and note the fingerprints that it repeats."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            merged = self.work.keep(a.unionAll(b).distinct().sortWithinPartitions("g"), "level")
            self.work.drop(a, b)
            self.levels.append((n + m, merged))
        array = self.work.keep(batch.groupBy("g").agg(F.count("*").alias("n")).sortWithinPartitions("g"), "array")
        hits = array.where("n > 1").select("g")
        for _, level in self.levels:
            hits = hits.unionAll(array.select("g").join(level, "g", "left_semi"))
        hits = self.work.keep(hits.distinct(), "hits")
        self.repeated = hits if self.repeated is None else self.repeated.unionAll(hits)
        self.levels.append((1, array.select("g")))
        self.levels[-1][1]._workspace_path = array._workspace_path


def whole_groups(batches: Iterator[pa.RecordBatch], name: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows that end where a group of the sorted column ends."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= rows:
            last = held[-1].column(name)[-1].as_py()
            cut = int(np.argmax(np.r_[batch.column(name).to_numpy(zero_copy_only=False) != last, True]))
            if cut:
                held.append(batch.slice(0, cut))
            if cut < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, n = [batch.slice(cut)], batch.num_rows - cut
            continue
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def windows_of(table: pa.Table | pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every offset: the rows (g, off, context) that have a run of `length` starting that far before the anchor, and
    its hash with the group's fingerprint mixed in."""
    context = table.column("context")
    context = context.combine_chunks() if isinstance(context, pa.ChunkedArray) else context
    data, offsets = buffers(context)
    prefix = Prefix(data)
    off = table.column("off").to_numpy().astype(np.int64)
    salt = mix(table.column("g").to_numpy().astype(np.int64).view(np.uint64))
    for d in range(length - gram + 1):
        start = offsets[:-1] + off - d
        ok = np.flatnonzero((off >= d) & (start + length <= offsets[1:]))
        if len(ok):
            yield d, ok, mix(prefix.both(start[ok], start[ok] + length) ^ salt[ok])


def compare_groups(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Least and greatest offset of a repeated run for each context of whole groups."""
    for table in whole_groups(batches, "g", 4_000):
        least, most = np.full(table.num_rows, length), np.full(table.num_rows, -1)
        for d, rows, h in windows_of(table, length, gram):
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            twice = rows[order[np.r_[same, False] | np.r_[False, same]]]
            least[twice] = np.minimum(least[twice], d)
            most[twice] = np.maximum(most[twice], d)
        got = np.flatnonzero((most >= 0) & table["alone"].to_numpy())
        t = table.select(["doc_id", "mark", "at"]).take(pa.array(got)).combine_chunks()
        at = t["at"].to_numpy().astype(np.int64)
        for x in pa.Table.from_arrays([t["doc_id"], t["mark"], pa.array(at - most[got]), pa.array(at - least[got] + length)], names=["doc_id", "mark", "low", "high"]).to_batches():
            yield x


def repeated_runs(docs: DataFrame, work: Workspace, length: int, gram: int, batches: int) -> DataFrame:
    """Marked stretches of documents (doc_id, text, mark): doc_id, mark, low, high (bytes)."""
    same_doc = ["doc_id", "mark"]
    family = Family(work)
    everything = work.keep(suffixes(docs, length, gram).withColumn("batch", F.expr(f"pmod(mark, {batches})")), "suffixes")
    for i in range(batches):
        family.append(everything.where(F.col("batch") == i))
    repeated = work.keep(family.repeated.distinct(), "repeated")
    met = work.keep(everything.drop("batch").join(repeated, "g", "left_semi"), "met")
    work.drop(everything)
    classes = work.keep(met.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "at")).alias("first")), "classes")
    everywhere = met.join(classes.where("n > 1").select("g", "c"), ["g", "c"]).select(*same_doc, F.greatest(F.col("at") - (length - gram), F.lit(0)).cast("long").alias("low"), (F.col("at") + length).cast("long").alias("high"))
    everywhere = work.keep(everywhere, "everywhere")
    groups = work.keep(classes.groupBy("g").agg(F.count("*").alias("classes"), F.min("n").alias("least")).where("classes > 1 and least = 1").select("g", "classes"), "groups")
    wanted = work.keep(classes.join(groups, "g").select("g", "classes", (F.col("n") == 1).alias("alone"), "first.*"), "wanted")
    places = wanted.groupBy(*same_doc).agg(F.collect_list(F.struct("at", "g", "alone", "classes")).alias("places"))
    # rows that repeat another row are never alone: their contexts count once
    asked = docs.join(places.withColumnsRenamed({"doc_id": "id2", "mark": "mark2"}), F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2"))).select(*same_doc, "text", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            raw = data.tobytes()
            row, at, g, alone, classes, off, context = [], [], [], [], [], [], []
            for i, places in enumerate(batch.column("places").to_pylist()):
                for p in places:
                    a = int(offsets[i]) + p["at"]
                    low, high = max(int(offsets[i]), a - (length - gram)), min(int(offsets[i + 1]), a + length)
                    row.append(i), at.append(p["at"]), g.append(p["g"]), alone.append(p["alone"]), classes.append(p["classes"]), off.append(a - low), context.append(raw[low:high])
            rows = pa.array(row, pa.int32())
            out = pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("mark").take(rows), pa.array(at, pa.int32()), pa.array(g, pa.int64()), pa.array(alone, pa.bool_()), pa.array(classes, pa.int64()), pa.array(off, pa.int32()), pa.array(context, pa.binary())], ["doc_id", "mark", "at", "g", "alone", "classes", "off", "context"])
            yield from (out.slice(i, 5_000) for i in range(0, max(1, out.num_rows), 5_000))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    contexts = asked.mapInArrow(cut, f"doc_id {id_type}, mark long, at int, g long, alone boolean, classes long, off int, context binary")
    runs = f"doc_id {id_type}, mark long, low long, high long"
    large = groups.where(F.col("classes") > LARGE).limit(1).count() > 0
    if large:
        contexts = work.keep(contexts, "contexts")
    small = contexts.where(F.col("classes") <= LARGE) if large else contexts
    found = small.repartition("g").sortWithinPartitions("g").mapInArrow(lambda it: compare_groups(it, length, gram), runs)
    if large:
        found = found.unionAll(compare_by_shuffle(contexts.where(F.col("classes") > LARGE), work, length, gram))
    return everywhere.unionAll(work.keep(found, "found"))


def compare_by_shuffle(contexts: DataFrame, work: Workspace, length: int, gram: int) -> DataFrame:
    """compare_groups for groups of any size: window hashes are counted by a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1_000):
                part = batch.slice(a, 1_000)
                for d, rows, h in windows_of(part, length, gram):
                    t = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([part.column(n).take(t) for n in ("doc_id", "mark", "at", "alone", "g")] + [pa.array(np.full(len(rows), d), pa.int32()), pa.array(h.view(np.int64))], ["doc_id", "mark", "at", "alone", "g", "d", "h"])

    id_type = contexts.schema["doc_id"].dataType.simpleString()
    windows = work.keep(contexts.mapInArrow(run, f"doc_id {id_type}, mark long, at int, alone boolean, g long, d int, h long"), "windows")
    twice = work.keep(windows.groupBy("g", "h").agg(F.count("*").alias("n")).where("n > 1").select("g", "h"), "twice")
    hit = windows.where("alone").join(twice, ["g", "h"], "left_semi").groupBy("doc_id", "mark", "at").agg(F.min("d").alias("least"), F.max("d").alias("most"))
    return hit.select("doc_id", "mark", (F.col("at") - F.col("most")).cast("long").alias("low"), (F.col("at") - F.col("least") + length).cast("long").alias("high"))


def merge_stretches(stretches: list, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(stretches):
        high = min(high, size)
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256[, removed (spans), kept
    (binary: the bytes that stay)]."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    work = Workspace(spark, "repeats")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select("doc_id", text.alias("text")).withColumn("mark", F.xxhash64("text"))
    marked = repeated_runs(slim, work, length, gram, batches)
    spans = work.keep(marked.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("low", "high")).alias("stretches")), "spans")
    spans = spans.withColumnsRenamed({"doc_id": "id2", "mark": "mark2"})
    both = slim.join(spans, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")), "left").select("doc_id", "text", "stretches")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            rows = []
            for t, stretches in zip(batch.column("text").to_pylist(), batch.column("stretches").to_pylist()):
                raw, at, kept = t.encode(), 0, []
                gone = merge_stretches([(s["low"], s["high"]) for s in stretches or []], len(raw))
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), gone, kept))
            columns = list(zip(*rows)) if rows else [[]] * 6
            out = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())]
            if with_text:
                out += [pa.array([[{"start": a, "end": b} for a, b in g] for g in columns[4]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(columns[5], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"][: 5 + 2 * with_text])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", removed array<struct<start: long, end: long>>, kept binary" if with_text else ""))
