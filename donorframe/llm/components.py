"""Connected components over distributed edges.

Hooking and contraction: every node hooks to its least neighbour, the resulting forest is flattened by pointer jumping,
edges are contracted to the roots, and so on until none are left; each round at least halves the roots that have edges.
Every step is a join or an aggregation of written tables; joins on a node with very many edges can be split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """Nodes of edges (a, b: long) with their component's least node: node, comp. Loops count as nodes."""
    e = work.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        both = e.select(F.col("a").alias("node"), F.col("a").alias("parent")).unionAll(e.select(F.col("b").alias("node"), F.col("a").alias("parent")))
        hook = work.keep(both.groupBy("node").agg(F.min("parent").alias("parent")), "hook")
        while True:
            up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = work.keep(hook.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "jumped")
            moved = jumped.where("moved").limit(1).count()
            work.drop(hook)
            hook = jumped
            if not moved:
                break
        if labels is None:
            labels = hook.select("node", F.col("parent").alias("comp"))
        else:
            root = hook.select(F.col("node").alias("comp"), F.col("parent").alias("root"))
            labels = work.keep(labels.join(root, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "labels")
        # both ends of an edge in one join each
        to = hook.select(F.col("node"), F.col("parent"))
        one = work.keep(e.join(to.withColumnRenamed("node", "a"), "a").select(F.col("parent").alias("x"), "b"), "half")
        contracted = one.join(to.withColumnRenamed("node", "b"), "b").where(F.col("x") != F.col("parent"))
        following = work.keep(contracted.select(F.least("x", "parent").alias("a"), F.greatest("x", "parent").alias("b")).distinct(), "edges")
        work.drop(one, e)
        e = following
        if not e.limit(1).count():
            return labels


class Forest:
    """Union-find over the keys of one task; its edges are at most as many as its keys."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in self.up if self.up[x] != x]
        return nodes, [self.find(x) for x in nodes]
