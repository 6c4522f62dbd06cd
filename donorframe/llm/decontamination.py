"""Benchmark decontamination: test items inside documents.

Method: size-partitioned MinHash containment search. Items are partitioned by the size of their shingle set in powers of
two; a partition has its own sketch size, about a third of its largest sets, and an item keeps that many of its smallest
hashes.
A document that holds an item may lack only so many of its shingles, so it holds at least `need` values of the sketch;
for large sets, whose sketch is SKETCH values, `need` is the most that such a document misses with a probability below
1e-9. Document shingles are joined to the sketches and counted; pairs that reach `need` are verified by exact containment
of the item's whole shingle set in the document's.

Scale: items are a table and never gathered. What travels to the tasks are two bit tables of at most 2 ** TABLE_BITS bits
(which hashes the sketches have, and which the whole sets), made by an aggregation; they drop document shingles that no
item has before the join, and hits that they let through wrongly fall out in the join. Documents are scanned once.
Hashes that more than COMMON items share come last in a sketch, so that a phrase common to many items makes no
candidates; verification goes along candidate pairs, not along shared hashes.

Words are runs of lower-cased ASCII letters and digits and non-ASCII characters; shingles have five words. A text of one
to four words is one shingle of its own.

Defined cases: null or empty texts and items match nothing; null ids, repeated rows and items with equal texts are kept
apart; very long texts are hashed in segments of bounded memory; empty tables give no rows; other columns are ignored by
find_items() and kept by the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import ALNUM, Words, blocks, buffers, list_array, text_key
from .workspace import Workspace, prepare

SHINGLE = 5
CONTAINMENT = 0.8
#: Most values of a sketch.
SKETCH = 64
#: Items that may share a hash before it goes to the end of their sketches.
COMMON = 64
TABLE_BITS = 27


def sets_of(items: DataFrame, shingle: int) -> DataFrame:
    """A row per item with words: item_key (unique), item_id, n, values (sorted hashes of its shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in blocks(batch.column(1)):
                sets = Words(*buffers(batch.column(1).slice(a, b - a)), ALNUM).shingle_sets(shingle)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + b - a)), batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), list_array(sets)], ["item_key", "item_id", "n", "values"])
                key += b - a

    id_type = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"item_key long, item_id {id_type}, n long, values array<bigint>").where("n > 0")


def sure_hits(sketch: int, containment: float, risk: float = 1e-9) -> int:
    """Most hits that a document with the share `containment` of a large item has but for the risk."""
    below = 0.0
    for h in range(sketch):
        below += math.comb(sketch, h) * containment**h * (1 - containment) ** (sketch - h)
        if below >= risk:
            return max(1, h)
    return sketch


def sketches(sets: DataFrame, containment: float) -> DataFrame:
    """v, item_key, need: the sketch of each item, one row per value."""
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1  # of the size partition
    size = F.least(F.col("n"), F.lit(SKETCH), F.floor(1.5 * (1 - containment) * upper + 1e-9) + 2).cast("int")
    lacking = F.col("n") - F.ceil(containment * F.col("n") - 1e-9)
    rows = sets.select("item_key", size.alias("size"), lacking.alias("lacking"), F.explode("values").alias("v"))
    common = rows.groupBy("v").agg(F.count("*").alias("items")).where(F.col("items") > COMMON).select("v", F.lit(1).alias("common"))
    ranked = rows.join(common, "v", "left").groupBy("item_key", "size", "lacking").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("common", F.lit(0)).alias("common"), "v"))).alias("values"))
    need = F.when(F.col("size") > F.col("lacking"), F.col("size") - F.col("lacking")).otherwise(sure_hits(SKETCH, containment))
    return ranked.select("item_key", need.cast("long").alias("need"), F.explode(F.slice("values", F.lit(1), F.col("size"))).alias("x")).select("x.v", "item_key", "need")


class BitTable:
    """Which of many hashes may belong to a set of any size; at most 2 ** TABLE_BITS bits."""

    def __init__(self, values: DataFrame):
        bits = min(TABLE_BITS, max(16, math.ceil(math.log2(4096 * max(1, values.count())))))
        self.mask = (1 << bits) - 1
        at = F.col("v").bitwiseAND(F.lit(self.mask))
        words = values.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(v & 63 as int))")).alias("bits")).toPandas()
        self.words = np.zeros((self.mask + 1) // 64, dtype=np.int64)
        self.words[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.mask)
        word = self.words.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)]
        return (word >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def hits_of(docs: DataFrame, in_sketches: BitTable, in_sets: BitTable, shingle: int) -> DataFrame:
    """Documents that may hold an item: doc_key (unique), doc_id, t1, t2 (128 bits of the text), values (distinct shingles
    that items may have)."""
    tables = docs.sparkSession.sparkContext.broadcast((in_sketches, in_sets))  # bounded by TABLE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        in_sketches, in_sets = tables.value
        for batch in batches:
            for a, b in blocks(batch.column("text")):
                g, doc = Words(*buffers(batch.column("text").slice(a, b - a)), ALNUM).shingles(shingle)
                some = np.unique(doc[in_sketches.find(g)])
                if not len(some):
                    continue
                wanted = np.zeros(b - a, dtype=bool)
                wanted[some] = True
                at = np.flatnonzero(wanted[doc])
                at = at[in_sets.find(g[at])]
                order = np.argsort(doc[at], kind="stable")
                g, doc = g[at][order], doc[at][order]
                cut = np.searchsorted(doc, np.append(some, b - a))
                rows = batch.slice(a, b - a).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([pa.array(key + np.arange(len(some))), *(rows.column(c) for c in ("doc_id", "t1", "t2")), list_array([np.unique(g[x:y]) for x, y in zip(cut[:-1], cut[1:])])], ["doc_key", "doc_id", "t1", "t2", "values"])
                key += len(some)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *text_key()).mapInArrow(run, f"doc_key long, doc_id {id_type}, t1 long, t2 long, values array<bigint>")


def search(docs: DataFrame, items: DataFrame, shingle: int, containment: float) -> DataFrame:
    """doc_id, t1, t2, item_id, n_item_shingles, n_shared of all pairs whose containment is reached."""
    prepare(docs.sparkSession)
    work = Workspace(docs.sparkSession, "decontamination")
    sets = work.keep(sets_of(items, shingle), "sets")
    sketch = work.keep(sketches(sets, containment), "sketches")
    hits = work.keep(hits_of(docs, BitTable(sketch.select("v")), BitTable(sets.select(F.explode("values").alias("v"))), shingle), "hits")
    held = hits.select("doc_key", F.explode("values").alias("v"))
    pairs = held.join(sketch, "v").groupBy("doc_key", "item_key", "need").agg(F.count("*").alias("found")).where("found >= need").select("doc_key", "item_key")
    pairs = work.keep(pairs, "pairs")
    # along the candidate pairs: every shingle of the item is looked up in the document
    asked = pairs.join(sets.select("item_key", F.explode("values").alias("v")), "item_key")
    shared = asked.join(held, ["doc_key", "v"]).groupBy("doc_key", "item_key").agg(F.count("*").alias("n_shared"))
    told = shared.join(sets.select("item_key", "item_id", F.col("n").alias("n_item_shingles")), "item_key").where(F.col("n_shared") >= containment * F.col("n_item_shingles") - 1e-9)
    return told.join(hits.drop("values"), "doc_key").select("doc_id", "t1", "t2", "item_id", "n_item_shingles", "n_shared")


def find_items(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs of documents (doc_id, text) and items (item_id, text) with the item in the document:
    doc_id, item_id, n_item_shingles, n_shared, containment."""
    found = search(docs, items, shingle, containment)
    return found.select("doc_id", "item_id", "n_item_shingles", "n_shared", (F.col("n_shared") / F.col("n_item_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no item, with all their columns. A finding names an id: rows that share it go with it, and
    rows with a null id are kept; see decontaminate_rows()."""
    return docs.join(find_items(docs, items, **options).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def decontaminate_rows(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """The rows that hold no item, with all their columns: each row by its own text, whatever its id."""
    gone = search(docs, items, shingle, containment).select("t1", "t2").distinct().alias("gone")
    t1, t2 = text_key()
    # a null text has a key of its own that no finding has
    return docs.alias("docs").join(gone, (t1 == F.col("gone.t1")) & (t2 == F.col("gone.t2")), "left_anti").select("docs.*")
