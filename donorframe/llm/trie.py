"""Trie of conversation prefixes, built by union-find over the edges between sorted neighbours.

A conversation is the sequence of its turns' digests (16 bytes a turn), copies are one row with their number. Rows are range
partitioned and sorted, so a node (a common prefix of d turns) is a stretch of neighbours whose common prefixes (LCP) have d
turns or more. In each partition the edges between neighbours are taken in descending LCP: joining the components of an edge
makes a branching node at that depth, and a component gives one node for every depth between two such events. All sums of a
node are sums over its stretch: of the numbers of conversations and words, minus the words of what neighbours share.

Partition forests are contracted and merged: a stretch that reaches neither end of its partition is a finished node. The
others are prefixes of the partition's first or last row (its two spines). They are merged by the digest of their prefix,
and what two partitions share at their boundary (found by joining the last spine of one with the first of the next) is
counted once. So a prefix of all conversations costs one row per partition, and no partition sees another's rows.

Defined cases: turns are ordered by turn (nulls first), ties by the digest of role and text; a null role or text is an empty
one; rows with a null conv_id belong to no conversation and are left out; repeated rows are turns of their own; an empty
table has no node, not even the root; other columns are ignored. A conversation's digests meet in one row (28 bytes a turn,
texts of any length are only read), and the ids of copies of one whole conversation too, as one SHA-256 runs over them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, prepare

WORD = r"[^\x20\x09-\x0D]+"
#: Heads come from every GROUP-th conversation and have under HEADS turns.
GROUP, HEADS = 20, 4
SIZE = 16
NODE = "pid long, depth long, key binary, parent_key binary, at_left boolean, at_right boolean, last_ends boolean, low long, parent_low long, n long, children long, leaves long, net long, before long, at long, ends string"
NAMES = [x.split(" ")[0] for x in NODE.split(", ")]


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, key, words) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    one = F.struct("turn", key.alias("key"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    return turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of c - c % GROUP in place of its own first h, h = crc32(c) % HEADS."""
    head = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    based = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(head, "base", "left")
    first = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return based.select("conv_id", F.concat(first, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """seq (digests in order), words (of each turn), n, low (least id), ends (digest of all ids)."""
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    rows = convs.select("conv_id", seq.alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    return rows.groupBy("seq").agg(F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("low"), F.sha2(ids, 256).alias("ends"))


def shared(a: bytes, b: bytes) -> int:
    """Digests that two sequences have in common at their beginning."""
    low, high = 0, min(len(a), len(b)) // SIZE
    if a[: high * SIZE] == b[: high * SIZE]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: mid * SIZE] == b[: mid * SIZE] else (low, mid)
    return low


def spine(seq: bytes) -> list[bytes]:
    """Digests of all prefixes."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for i in range(0, len(seq), SIZE):
        h.update(seq[i : i + SIZE])
        out.append(h.digest())
    return out


class Forest:
    """The nodes over one partition's sorted sequences."""

    def __init__(self, pid: int, seqs: list[bytes], words: list[np.ndarray], n: list[int], low: list[int], ends: list[str]):
        self.pid, self.words, self.last, self.rows = pid, words, len(seqs) - 1, []
        self.first_spine, self.last_spine = spine(seqs[0]), spine(seqs[-1])
        self.last_depth = len(seqs[-1]) // SIZE
        lcp = [0, *map(shared, seqs, seqs[1:])]
        self.up = list(range(len(seqs)))
        # a component: its stretch, sums, and what its deepest node has
        self.comps = {}
        for i, seq in enumerate(seqs):
            depth, total = len(seq) // SIZE, int(words[i][-1])
            leaf = i == self.last or lcp[i + 1] < depth
            self.comps[i] = {"l": i, "r": i, "n": n[i], "low": low[i], "net": (n[i] - 1) * total, "leaves": int(leaf), "depth": depth, "children": 0, "ends": ends[i]}
        edges: dict[int, list[int]] = {}
        for i in range(1, len(seqs)):
            edges.setdefault(lcp[i], []).append(i)
        for depth in sorted(edges, reverse=True):
            self.join(depth, edges[depth])
        for comp in self.comps.values():
            self.emit(comp, -1, None)

    def find(self, i: int) -> int:
        root = i
        while self.up[root] != root:
            root = self.up[root]
        while self.up[i] != root:
            self.up[i], i = root, self.up[i]
        return root

    def join(self, depth: int, edges: list[int]) -> None:
        """Join the components at all edges of one LCP; each group of them becomes a branching node."""
        groups: dict[int, list[dict]] = {}
        for i in edges:
            a, b = self.find(i - 1), self.find(i)
            self.up[b] = a
            if a not in groups:
                groups[a] = [self.comps.pop(a)]
            groups[a] += groups.pop(b, None) or [self.comps.pop(b)]
        for root, parts in groups.items():
            whole = {k: sum(p[k] for p in parts) for k in ("n", "net", "leaves")}
            # a prefix that neighbours share is one run of words and not two
            whole["net"] += (len(parts) - 1) * int(self.words[parts[0]["l"]][depth])
            ended = parts[0]["depth"] == depth
            whole |= {"l": parts[0]["l"], "r": parts[-1]["r"], "low": min(p["low"] for p in parts), "depth": depth, "children": len(parts) - ended, "ends": parts[0]["ends"] if ended else None}
            for p in parts:
                self.emit(p, depth, whole)
            self.comps[root] = whole

    def key(self, comp: dict, depth: int) -> bytes | None:
        """The digest of an open node's prefix."""
        return self.first_spine[depth] if comp["l"] == 0 else self.last_spine[depth] if comp["r"] == self.last else None

    def emit(self, comp: dict, above: int, parent: dict | None) -> None:
        """Nodes of a component at all depths below its parent's."""
        words, right = self.words[comp["l"]], comp["r"] == self.last
        for depth in range(comp["depth"], above, -1):
            top, deepest = depth - 1 == above, depth == comp["depth"]
            over = parent if top else comp
            key, parent_key = self.key(comp, depth), self.key(over, depth - 1) if over and depth else None
            parent_low = over["low"] if over and depth and not parent_key else None
            self.rows.append((self.pid, depth, key, parent_key, comp["l"] == 0, right, right and depth == self.last_depth, comp["low"], parent_low, comp["n"], comp["children"] if deepest else 1, comp["leaves"], comp["net"], int(words[depth - 1]) if depth else 0, int(words[depth]), comp["ends"] if deepest else None))


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = {c: [] for c in ("seq", "words", "n", "low", "ends")}
    for batch in batches:
        for c in ("seq", "n", "low", "ends"):
            table[c] += batch.column(c).to_pylist()
        table["words"] += [np.concatenate([[0], np.cumsum(w.values.to_numpy(zero_copy_only=False), dtype=np.int64)]) for w in batch.column("words")]
    if table["seq"]:
        rows = Forest(TaskContext.get().partitionId(), table["seq"], table["words"], table["n"], table["low"], table["ends"]).rows
        types = {"binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "long": pa.int64()}
        kinds = [types[x.split(" ")[1]] for x in NODE.split(", ")]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 10_000]), kinds)], NAMES)


def merge_open(nodes: DataFrame) -> DataFrame:
    """The nodes on spines (key not null), merged over partitions, with their parents' least id."""
    spark = nodes.sparkSession
    # one number per partition comes to the driver
    pids = sorted(r[0] for r in nodes.where("depth = 0").select("pid").collect())
    following = spark.createDataFrame(list(zip(pids, pids[1:])), "pid long, boundary long")
    right = nodes.where("at_right").join(F.broadcast(following), "pid").select("boundary", "depth", "key", "at", "last_ends")
    both = right.join(nodes.where("at_left").select(F.col("pid").alias("boundary"), "depth", "key"), ["boundary", "depth", "key"])
    end = both.groupBy("boundary").agg(F.max("depth").alias("deepest"), F.max_by("at", "depth").alias("words"), F.max_by("last_ends", "depth").alias("extended"))
    # of what two partitions share: one run of words, one child, and no leaf where the next row goes on
    twice = both.join(end, "boundary").select("key", F.col("words").alias("net"), F.when(F.col("depth") < F.col("deepest"), -1).otherwise(0).cast("long").alias("children"), F.when(F.col("extended"), -1).otherwise(0).cast("long").alias("leaves"))
    rows = nodes.select("key", "depth", "parent_key", "low", "n", "children", "leaves", "net", "before", "ends").unionByName(twice.withColumns({c: F.lit(None) for c in ("depth", "parent_key", "low", "n", "before", "ends")}))
    total = lambda *cs: [F.sum(c).alias(c) for c in cs]
    merged = rows.groupBy("key").agg(*[F.max(c).alias(c) for c in ("depth", "parent_key", "before", "ends")], F.min("low").alias("low"), *total("n", "children", "leaves", "net"))
    return merged.join(merged.select(F.col("key").alias("parent_key"), F.col("low").alias("parent_low")), "parent_key", "left")


def shown(nodes: DataFrame) -> DataFrame:
    saved: Column = F.col("net") - (F.col("n") - 1) * F.col("before")
    return nodes.select(
        F.col("low").alias("conv_id"), "depth", F.col("parent_low").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per node of the trie of conversations (conv_id, turn, role, text) with exchanged heads: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    prepare(spark)
    work = Workspace(spark, "trie")
    own = work.keep(sequences(turns), "own")
    rows = work.keep(distinct_sequences(rebuilt(own)), "sequences")
    ranged = rows.repartitionByRange("seq") if partitions is None else rows.repartitionByRange(partitions, "seq")
    nodes = work.keep(ranged.sortWithinPartitions("seq").mapInArrow(forest, NODE), "nodes")
    on_spine = nodes.where("key IS NOT NULL")
    merged = work.keep(merge_open(on_spine), "spines")
    closed = nodes.where("key IS NULL")
    # a finished node below a spine learns its parent's least id, partition by partition
    told = on_spine.select("pid", F.col("key").alias("parent_key")).join(merged.select(F.col("key").alias("parent_key"), F.col("low").alias("told")), "parent_key")
    below = closed.where("parent_key IS NOT NULL").drop("parent_low").join(told, ["pid", "parent_key"]).withColumnRenamed("told", "parent_low")
    work.drop(own, rows)
    return shown(merged).unionByName(shown(below)).unionByName(shown(closed.where("parent_key IS NULL")))
