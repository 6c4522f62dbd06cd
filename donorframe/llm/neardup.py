"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Every text becomes the set of 64-bit hashes of its word shingles; texts with equal sets are one class, and one class
   member stands for it from here on, so exact copies cost one row each.
2. A class keeps its SKETCH smallest hashes. Its PREFIX first values go to inverted lists, values that more than LONG
   classes have after all others. Two sets with a similarity of 0.8 share one of these ten values except with a
   probability of about 0.2 ** 10.
3. Inverted lists generate overlaps: in a list of up to LONG classes all pairs of different local groups are tried, and
   the union sketch (the SKETCH smallest of both) estimates their similarity; pairs within five standard deviations of
   the threshold are joined into candidate groups. Longer lists are listed anew by pairs of values: a class enters the
   list of each pair that its long value makes with another of its values, so classes that share one frequent shingle
   and nothing else never meet. A list of a pair that is still longer is one candidate group as a whole. Only forests
   leave a task, so rows stay linear in the number of list entries.
4. Exact verification: the full sets of a candidate group are compared by exact intersection, all pairs that are not yet
   joined. A group of up to BLOCK classes is one tile. The classes of a larger one are dealt twice to random tiles of
   about BLOCK: where most of a group belongs together (thousands of near copies) that joins them. Then every class
   outside the group's largest component is compared with all classes of other components, in tiles again; so work is
   linear in a group that holds together, and no link is lost in one that does not.
5. Links are joined to components, whose id is the least document id of all members of all classes.

Defined cases: null and empty texts and texts without words have the empty set and link with nothing; null ids take part
and get their component's least id, and are never kept beside a known id; repeated rows and ids that stand for several
texts are told apart by the text; very long texts are hashed in segments of bounded memory; an empty table gives no rows; other columns are ignored by near_duplicates() and kept by deduplicate().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import unused
from .components import Forest, components
from .textcore import NOT_SPACE, Words, blocks, buffers, list_array, set_key, text_key
from .workspace import Workspace, prepare

SHINGLE = 5
PERCENT = 80
SKETCH = 64
PREFIX = 10
#: First sketch values of which the list lengths are counted.
COUNTED = 20
LONG = 128
BLOCK = 96
BLOCK_SHINGLES = 1 << 20


def sets_of(docs: DataFrame, shingle: int, row_key: str | None = None) -> DataFrame:
    """A row per document: key (unique; row_key of docs where one is named), doc_id, n, set_a, set_b (128 bits that
    identify the set), t1, t2 (128 bits of the text), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in blocks(batch.column(1)):
                sets = Words(*buffers(batch.column(1).slice(a, b - a)), NOT_SPACE).shingle_sets(shingle)
                ids = np.array([set_key(s) for s in sets], dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(row_key).slice(a, b - a) if row_key else pa.array(np.arange(key, key + b - a)), batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), batch.column("t1").slice(a, b - a), batch.column("t2").slice(a, b - a), list_array([s[:SKETCH] for s in sets])],
                    ["key", "doc_id", "n", "set_a", "set_b", "t1", "t2", "sketch"],
                )
                key += b - a

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *text_key(), *([row_key] if row_key else [])).mapInArrow(run, f"key long, doc_id {id_type}, n long, set_a long, set_b long, t1 long, t2 long, sketch array<bigint>")


def estimate(a: frozenset, b: frozenset) -> float:
    """Similarity estimated from the union sketch of two bottom-k sketches (exact where both sets fit in it)."""
    union = sorted(a | b)[:SKETCH]
    both = a & b
    return sum(v in both for v in union) / len(union)


def close(a: frozenset, n_a: int, b: frozenset, n_b: int, percent: int) -> bool:
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    if n_a <= SKETCH and n_b <= SKETCH:
        shared = len(a & b)
        return 100 * shared >= percent * (n_a + n_b - shared)
    p = percent / 100
    least = p - 5 * np.sqrt(p * (1 - p) / SKETCH)
    return len(a & b) >= least * min(SKETCH, n_a, n_b) * 0.99 and estimate(a, b) >= least


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the named columns; only one such run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        head = tuple(c[0] for c in columns)
        new[0] = last is not None and head != last
        cut = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:]):
            if new[a] and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def edge_batch(forest: Forest) -> pa.RecordBatch:
    a, b = forest.edges()
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def join_lists(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Candidate edges from inverted lists (v, key, n, sketch) that come list by list."""
    forest = Forest()
    for group in runs(batches, ["v"]):
        keys, sizes = group["key"].to_pylist(), group["n"].to_pylist()
        roots = {forest.find(k) for k in keys}
        if len(roots) < 2:
            continue
        sketches = [frozenset(s) for s in group["sketch"].to_pylist()]
        for i in range(len(keys)):
            for j in range(i):
                if forest.find(keys[i]) != forest.find(keys[j]) and close(sketches[i], sizes[i], sketches[j], sizes[j], percent):
                    forest.union(keys[i], keys[j])
    yield edge_batch(forest)


def verify_tiles(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Exact links from tiles (comp, low, high, first, key, root, values) that come tile by tile: of pairs of rows of which
    one at least is a first, and whose roots are not joined. Links name roots."""
    forest = Forest()
    for tile in runs(batches, ["comp", "low", "high"]):
        first = tile["first"].to_numpy()
        roots = tile["root"].to_pylist()
        values = tile["values"].combine_chunks()
        flat = values.flatten().to_numpy()
        size = np.diff(values.offsets.to_numpy()).astype(np.int64)
        start = np.cumsum(size) - size
        _, number = np.unique(flat, return_inverse=True)
        mark = np.zeros(number.max(initial=-1) + 1, dtype=np.int64)
        for i in np.flatnonzero(first):
            others = np.flatnonzero(~first | (np.arange(len(first)) > i))
            others = others[100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])]
            mine = forest.find(roots[i])
            others = [j for j in others.tolist() if forest.find(roots[j]) != mine]
            if not others:
                continue
            own = number[start[i] : start[i] + size[i]]
            mark[own] = 1
            for j in others:
                if forest.find(roots[j]) == forest.find(roots[i]):
                    continue
                shared = int(mark[number[start[j] : start[j] + size[j]]].sum())
                if 100 * shared >= percent * (size[i] + size[j] - shared):
                    forest.union(roots[i], roots[j])
            mark[own] = 0
    yield edge_batch(forest)


def compare_tiles(placed: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of tiles (comp, low, high, first, key, root)."""
    place = ["comp", "low", "high"]
    arranged = placed.hint("merge").join(full, "key").repartition(*place).sortWithinPartitions(*place)
    return arranged.select(*place, "first", "key", "root", "values").mapInArrow(partial(verify_tiles, percent=percent), "a long, b long")


def verify(work: Workspace, members: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """node, comp: components of exact links in candidate groups (members: comp, node, n; full: key, values)."""
    blocks_of = lambda: F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    stats = work.keep(members.groupBy("comp").agg(blocks_of().alias("n_blocks")), "stats")
    dealt = members.join(stats, "comp").select("comp", F.col("node").alias("key"), F.col("node").alias("root"), "n_blocks", F.expr("explode(IF(n_blocks = 1, array(0), array(0, 1)))").alias("low"))
    mixed = dealt.select("comp", "low", F.expr("pmod(xxhash64(key, low), n_blocks)").cast("int").alias("high"), F.lit(True).alias("first"), "key", "root")
    links = work.keep(compare_tiles(mixed, full, percent), "links")
    joined = components(work, links)
    # groups of several tiles that have not become one component: those outside the largest meet all the others
    large = members.join(stats.where("n_blocks > 1").select("comp"), "comp").select("comp", "node", "n")
    rooted = large.join(joined.select("node", F.col("comp").alias("root")), "node", "left").select("comp", "node", "n", F.coalesce("root", "node").alias("root"))
    rooted = work.keep(rooted, "rooted")
    sizes = rooted.groupBy("comp", "root").agg(F.count("*").alias("held"))
    most = sizes.groupBy("comp").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("held", "root")).alias("largest")).where("roots > 1")
    apart = work.keep(rooted.join(most.select("comp", "largest"), "comp").withColumn("rest", F.col("root") != F.col("largest")), "apart")
    if not apart.limit(1).count():
        return joined
    count = apart.groupBy("comp").agg(blocks_of().alias("n_all"), F.greatest(F.ceil(F.count_if("rest") / BLOCK), F.ceil(F.sum(F.when(F.col("rest"), F.col("n"))) / BLOCK_SHINGLES)).cast("int").alias("n_rest"))
    apart = apart.join(count, "comp").select("comp", F.col("node").alias("key"), "root", "rest", "n_all", "n_rest")
    block = lambda n: F.expr(f"pmod(xxhash64(key), {n})").cast("int")
    ours = apart.where("rest").select("comp", block("n_rest").alias("low"), F.expr("explode(sequence(0, n_all - 1))").alias("high"), F.lit(True).alias("first"), "key", "root")
    theirs = apart.select("comp", F.expr("explode(sequence(0, n_rest - 1))").alias("low"), block("n_all").alias("high"), F.lit(False).alias("first"), "key", "root")
    more = work.keep(compare_tiles(ours.unionByName(theirs), full, percent), "more")
    return components(work, links.unionAll(more)) if more.limit(1).count() else joined


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, keep_keys: bool = False, row_key: str | None = None) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_shingles, component_id, kept. row_key: a unique long column of docs,
    written once, that becomes the key."""
    # tables that grow with the input are joined by merging at every size: what is small enough to broadcast today is
    # not at scale, and a plan that changes with the size cannot be projected
    spark = docs.sparkSession
    prepare(spark)
    work = Workspace(spark, "neardup")
    sets = work.keep(sets_of(docs, shingle, row_key), "sets")
    same = ["n", "set_a", "set_b"]
    classes = work.keep(sets.where("n > 0").groupBy(*same).agg(F.min("key").alias("rep"), F.min("doc_id").alias("least_id")), "classes")
    slim = sets.select("key", "n", "t1", "t2", "sketch")
    reps = work.keep(slim.join(classes.select(F.col("rep").alias("key")).hint("merge"), "key", "left_semi"), "reps")

    counted = reps.select(F.explode(F.slice("sketch", 1, COUNTED)).alias("v")).groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > LONG)
    counted = work.keep(counted, "counted")
    hot = counted.select(F.col("v"), F.lit(1).alias("hot"))
    first = reps.select("key", F.posexplode(F.slice("sketch", 1, COUNTED)).alias("pos", "v")).join(hot, "v", "left")
    ordered = first.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("hot", F.lit(0)).alias("hot"), "pos", "v"))), 1, PREFIX).alias("p"))
    postings = work.keep(ordered.select("key", F.col("p.v").alias("vs"), F.explode("p.v").alias("v")), "postings")
    lists = work.keep(postings.groupBy("v").agg(F.count("*").alias("entries")).where("entries > 1"), "lists")
    entries = work.keep(postings.join(lists.hint("merge"), "v"), "entries")
    work.drop(postings)
    long_ones = entries.where(F.col("entries") > LONG)
    twos = long_ones.select("key", "v", F.explode("vs").alias("u")).where("u <> v").select("key", F.xxhash64(F.least("u", "v"), F.greatest("u", "v")).alias("v")).distinct()
    twos = work.keep(twos, "twos")
    pairs = twos.groupBy("v").agg(F.count("*").alias("entries"), F.min("key").alias("hub")).where("entries > 1")
    in_twos = work.keep(twos.join(pairs.hint("merge"), "v"), "in_twos")
    whole = in_twos.where(F.col("entries") > LONG).select(F.col("key").alias("a"), F.col("hub").alias("b"))
    listed = entries.where(F.col("entries") <= LONG).select("v", "key").unionAll(in_twos.where(F.col("entries") <= LONG).select("v", "key"))
    arranged = listed.hint("merge").join(reps, "key").repartition("v").sortWithinPartitions("v")
    close_by = arranged.select("v", "key", "n", "sketch").mapInArrow(partial(join_lists, percent=percent), "a long, b long")
    candidates = work.keep(components(work, whole.unionAll(close_by)), "candidates")
    work.drop(entries, lists, twos, in_twos)

    members = work.keep(candidates.join(classes.select(F.col("rep").alias("node"), *same), "node"), "members")
    full = work.keep(full_sets(docs, members.join(reps.select(F.col("key").alias("node"), "t1", "t2"), "node"), shingle), "full")
    joined = verify(work, members, full, percent)
    work.drop(full)

    named = work.keep(joined.join(classes.select(F.col("rep").alias("node"), "least_id"), "node"), "named")
    least = work.keep(named.groupBy("comp").agg(F.min("least_id").alias("component_id")), "least")
    linked = work.keep(named.join(least, "comp").select(F.col("node").alias("rep"), F.col("comp"), "component_id"), "linked")
    of_class = work.keep(classes.join(linked, "rep", "left").select(*same, F.coalesce("component_id", "least_id").alias("component_id"), F.coalesce("comp", "rep").alias("group_key")), "of_class")
    rows = sets.select("key", "doc_id", *same)
    some = rows.where("n > 0").join(of_class.hint("merge"), same)
    none = rows.where("n = 0").select(*same, "key", "doc_id", F.col("doc_id").alias("component_id"), F.col("key").alias("group_key"))
    out = some.unionByName(none).withColumn("kept", F.expr("coalesce(doc_id = component_id, component_id is null)"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept", *(["key", "group_key"] if keep_keys else []))


def full_sets(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """The whole shingle sets of candidate classes (node, t1, t2): key, values. Texts are found by their 128 bits, so
    neither null nor repeated ids make pairs; copies of a text come one after another and give one set."""
    t1, t2 = text_key()
    texts = docs.select(t1, t2, F.col("text").cast("string").alias("text"))
    both = texts.join(members.select("t1", "t2", F.col("node").alias("key")).hint("merge"), ["t1", "t2"]).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            fresh = np.r_[key[0] != last, key[1:] != key[:-1]]
            last = key[-1]
            batch = batch.filter(pa.array(fresh))
            for a, b in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), list_array(Words(*buffers(batch.column(1).slice(a, b - a)), NOT_SPACE).shingle_sets(shingle))], ["key", "values"])

    return both.mapInArrow(run, "key long, values array<bigint>")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component (that with the least id), with all columns; see deduplicate_rows() for tables whose
    ids are not unique. Documents without words stay, and so
    do rows with a null id, which no finding can name; rows that share the kept id are one document."""
    found = near_duplicates(docs, shingle, percent)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def deduplicate_rows(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all columns: of the rows with the least id the first; null ids come last. Rows
    without words stay. Rows are told apart by a key that is written once, so ids may be null, repeated or shared."""
    name = unused(docs, "row_key")
    keyed = Workspace(docs.sparkSession, "deduplicate").keep(docs.withColumn(name, F.monotonically_increasing_id()), "keyed")
    found = near_duplicates(keyed, shingle, percent, keep_keys=True, row_key=name)
    first = found.groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first"))
    return keyed.join(first.select(F.col("first.key").alias(name)).hint("merge"), name, "left_semi").select(docs.columns)
