"""Embedding near-dedup with a hierarchical navigable small-world graph per shard.

Equal vectors of one label are one class. Classes of a label are dealt to shards of at most about SHARD vectors; a task
builds each shard's graph. Every class then queries every shard of its label that can hold a link of it: queries come in
blocks of about QUERIES, each with a copy of the shard's index, so neither a large label nor a large shard count gathers
in one task, and the copies stay a fraction of the queries. A query searches a shard's graph with a beam, then follows the
graph's links from all it met within FLOOD times the threshold's angle, so a query of many links needs no wide beam.

The beam is that of the label's audit: classes with an id divisible by AUDIT are also compared with whole shards, and their
links (not with themselves), summed over all shards of the label, say what share each beam of LADDER finds. A label uses
the first beam that finds RECALL of its own audited links and of those of all labels together; one that no beam satisfies
is scanned. Beam and audited recall are columns of the result. Found pairs are verified by cosine in double precision; only
counts and forests of links leave a task.

Shards are cut along cells: a vector belongs to the nearest of at most PIVOTS sampled vectors. With d the angle of the
threshold, a vector within d of a query whose nearest pivot is at an angle of a lies in a cell whose pivot is at most
a + 2 d from the query (twice the triangle inequality), so the cells beyond are skipped without losing a link. Pivots
decide only how many shards a query visits, never what it finds.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label,
link with nothing; vectors of different lengths are not compared; null ids get their component's least id and are not
audited by themselves; repeated rows are equal vectors; ties play no part, as every node at or above the cosine is a link;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, components
from .neardup import runs
from .workspace import Workspace, prepare

COSINE = 0.98
SHARD = 8192
QUERIES = 16_384
#: Vectors whose cells shards are cut along; a bounded sample, collected to the driver.
PIVOTS = 256
M = 12
BUILD_BEAM = 48
LADDER = (64, 256, 1024)
#: Ids divisible by this are audited; the share of their links that a beam has to find.
AUDIT = 20
RECALL = 0.999
#: Links are followed from nodes within this many times the threshold's angle of the query.
FLOOD = 1.5
#: What single precision may miss of the threshold.
SLACK = 1e-4


class Graph:
    """A navigable small-world hierarchy over unit vectors; all searches of a batch go in lockstep."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.v = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(self.v)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(M)).astype(int), 4)
        self.links = [np.full((n, 2 * M if lv == 0 else M), -1, dtype=np.int32) for lv in range(int(self.level.max(initial=0)) + 1)]
        # the tallest come first, so every layer exists before it is needed
        self.order = np.argsort(-self.level, kind="stable")
        self.entry = int(self.order[0]) if n else -1
        done = 0
        while done < n:
            batch = self.order[done : done + max(1, min(256, done or 64))]
            self._insert(batch, self.order[:done])
            done += len(batch)
        if n:
            self._bridge()

    def _bridge(self) -> None:
        """Lead to every node from the entry on the lowest layer: an island that no link enters gets one from a near node."""
        reached = np.zeros(len(self.v), dtype=bool)
        self._spread(reached, self.entry)
        while not reached.all():
            lost = np.flatnonzero(~reached)[:256]
            ids, _ = self.search(self.v[lost], BUILD_BEAM)
            for node, near in zip(lost.tolist(), ids.tolist()):
                if reached[node]:
                    continue
                mine = [w for w in near if w >= 0 and reached[w]] or [self.entry]
                free = next((w for w in mine if (self.links[0][w] < 0).any()), None)
                if free is None:
                    free, self.links[0] = mine[0], np.pad(self.links[0], ((0, 0), (0, 4)), constant_values=-1)
                self.links[0][free, np.argmax(self.links[0][free] < 0)] = node
                self._spread(reached, node)

    def _spread(self, reached: np.ndarray, start: int) -> None:
        """Mark what links lead to from a node."""
        reached[start] = True
        edge = np.array([start])
        while len(edge):
            to = np.unique(self.links[0][edge])
            edge = to[(to >= 0) & ~reached[to]]
            reached[edge] = True

    def _insert(self, batch: np.ndarray, before: np.ndarray) -> None:
        q = self.v[batch]
        start = np.full((len(batch), 1), self.entry if len(before) else -1)
        for lv in range(len(self.links) - 1, -1, -1):
            rows = np.flatnonzero(self.level[batch] >= lv)
            if len(before):
                found, sims = self._beam(q, start, lv, BUILD_BEAM if len(rows) else 4)
                start = found[:, :4]
            if not len(rows):
                continue
            mates = batch[rows]
            near = q[rows] @ self.v[mates].T
            np.fill_diagonal(near, -np.inf)
            ids = np.broadcast_to(mates, near.shape)
            if len(before):
                ids, near = np.concatenate([found[rows], ids], 1), np.concatenate([sims[rows], near], 1)
            ids, near = self._best(ids, near, BUILD_BEAM)
            picked = self._diverse(ids, near, M)
            self.links[lv][mates, :M] = picked
            self._link_back(lv, np.repeat(mates, M), picked.ravel())

    @staticmethod
    def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if ids.shape[1] > k:
            at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            ids, sims = np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)
        at = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)
        return np.where(np.isfinite(sims), ids, -1), sims

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Up to m of the candidates (best first), those closer to the node than to one already taken; then the nearest
        of the others up to half of m."""
        x = self.v[np.maximum(ids, 0)]
        between = np.matmul(x, x.transpose(0, 2, 1))
        keep = np.zeros(ids.shape, dtype=bool)
        worst = np.full(ids.shape, -np.inf, dtype=np.float32)
        n = np.zeros(len(ids), dtype=int)
        for j in range(ids.shape[1]):
            take = (ids[:, j] >= 0) & (n < m) & (worst[:, j] < sims[:, j])
            keep[take, j] = True
            n += take
            worst[take] = np.maximum(worst[take], between[take, j])
        rest = (ids >= 0) & ~keep
        keep |= rest & (np.cumsum(rest, axis=1) <= np.maximum(0, m // 2 - n)[:, None])
        at = np.argsort(~keep, axis=1, kind="stable")[:, :m]
        out = np.where(np.take_along_axis(keep, at, 1), np.take_along_axis(ids, at, 1), -1)
        return out if out.shape[1] == m else np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)

    def _link_back(self, lv: int, source: np.ndarray, target: np.ndarray) -> None:
        ok = target >= 0
        source, target = source[ok], target[ok]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        links = self.links[lv]
        width = links.shape[1]
        while len(target):
            # up to `width` new links of each node at a time
            first = np.r_[True, target[1:] != target[:-1]]
            rank = np.arange(len(target)) - np.maximum.accumulate(np.where(first, np.arange(len(target)), 0))
            now = rank < width
            nodes = target[first]
            fresh = np.full((len(nodes), width), -1, dtype=np.int32)
            fresh[np.cumsum(first)[now] - 1, rank[now]] = source[now]
            fresh[(fresh[:, :, None] == links[nodes][:, None, :]).any(2)] = -1
            ids = np.concatenate([links[nodes], fresh], 1)
            sims = np.einsum("nkd,nd->nk", self.v[np.maximum(ids, 0)], self.v[nodes])
            sims[ids < 0] = -np.inf
            ids, sims = self._best(ids, sims, ids.shape[1])
            full = (ids >= 0).sum(1) > width
            links[nodes[~full]] = ids[~full, :width]
            if full.any():
                links[nodes[full]] = self._diverse(ids[full], sims[full], width)
            source, target = source[~now], target[~now]

    def _beam(self, q: np.ndarray, start: np.ndarray, lv: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the best `beam` nodes met on one layer, best first."""
        links, b = self.links[lv], len(q)
        ids = np.sort(np.asarray(start), axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        sims = np.einsum("bkd,bd->bk", self.v[np.maximum(ids, 0)], q)
        sims[ids < 0] = -np.inf
        seen = np.zeros((b, len(self.v) + 1), dtype=bool)
        seen[np.arange(b)[:, None], ids] = True
        pad = max(0, beam - ids.shape[1])
        ids, sims = self._best(np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf), beam)
        open_ = np.isfinite(sims)
        step = 4
        while True:
            rows = np.flatnonzero(open_.any(1))
            if not len(rows):
                return ids, sims
            at = np.argsort(~open_[rows], axis=1, kind="stable")[:, :step]
            chosen = np.where(np.take_along_axis(open_[rows], at, 1), np.take_along_axis(ids[rows], at, 1), -1)
            sub = open_[rows]
            np.put_along_axis(sub, at, False, 1)
            nb = links[np.maximum(chosen, 0)]
            nb[chosen < 0] = -1
            nb = np.sort(nb.reshape(len(rows), -1), axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
            nb[seen[rows[:, None], nb]] = -1
            seen[rows[:, None], nb] = True
            near = np.einsum("bkd,bd->bk", self.v[np.maximum(nb, 0)], q[rows])
            near[nb < 0] = -np.inf
            all_ids, all_sims = np.concatenate([ids[rows], nb], 1), np.concatenate([sims[rows], near], 1)
            all_open = np.concatenate([sub, np.isfinite(near)], 1)
            at = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[rows], sims[rows], open_[rows] = (np.take_along_axis(x, at, 1) for x in (all_ids, all_sims, all_open))
            open_[rows] &= np.isfinite(sims[rows])

    def search(self, q: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The best `beam` nodes of each query; own: a node to start from besides (-1: none)."""
        entry = start = np.full((len(q), 1), self.entry)
        for lv in range(len(self.links) - 1, 0, -1):
            start = self._beam(q, start, lv, 4)[0]
        start = np.concatenate([start, entry, *([] if own is None else [own[:, None]])], 1)
        return self._beam(q, start, 0, beam)

    def within(self, q: np.ndarray, low: float, beam: int, own: np.ndarray) -> list[np.ndarray]:
        """The nodes at or above a similarity that each query meets: in its beam, and by links from all nodes met that are
        within FLOOD times the angle."""
        n, reach = len(self.v), float(np.cos(min(np.pi, FLOOD * np.arccos(low))))
        ids, sims = self.search(q, beam, own)
        met = sims >= reach
        rows, at, near = np.nonzero(met)[0], ids[met].astype(np.int64), sims[met]
        seen = np.zeros((len(q), n), dtype=bool)
        seen[rows, at] = True
        out = [(rows[near >= low], at[near >= low])]
        while len(rows):
            to = self.links[0][at].astype(np.int64)
            code = (rows[:, None] * n + to)[to >= 0]
            code = np.unique(code[~seen.reshape(-1)[code]])
            rows, at = code // n, code % n
            seen[rows, at] = True
            near = np.empty(len(rows), dtype=np.float32)
            for a in range(0, len(rows), 65_536):
                near[a : a + 65_536] = np.einsum("kd,kd->k", self.v[at[a : a + 65_536]], q[rows[a : a + 65_536]])
            out.append((rows[near >= low], at[near >= low]))
            rows, at = rows[near >= reach], at[near >= reach]
        rows, at = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(rows, kind="stable")
        return np.split(at[order], np.searchsorted(rows[order], np.arange(1, len(q))))

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, entry=self.entry, v=self.v, **{f"links{i}": x for i, x in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Graph":
        self = cls.__new__(cls)
        z = np.load(io.BytesIO(data))
        self.v, self.entry = z["v"], int(z["entry"])
        self.links = [z[f"links{i}"] for i in range(sum(k.startswith("links") for k in z.files))]
        return self


def links_of(graph: Graph, exact: np.ndarray, q: np.ndarray, own: np.ndarray, cosine: float, beam: int) -> list[np.ndarray]:
    """For each query the nodes at or above the cosine that its search meets; a beam of 0 scans the whole shard."""
    low, single = cosine - SLACK, q.astype(np.float32)
    found: list[np.ndarray] = []
    for a in range(0, len(q), 64):
        part = single[a : a + 64]
        met = graph.within(part, low, beam, own[a : a + 64]) if beam else [np.flatnonzero(x) for x in part @ graph.v.T >= low]
        found += [near[exact[near] @ q[i] >= cosine] for i, near in enumerate(met, a)]
    return found


def audit(graph: Graph, exact: np.ndarray, q: np.ndarray, own: np.ndarray, cosine: float) -> tuple[int, list[int]]:
    """Links of the queries with other nodes: all of them, and those that each beam of LADDER finds. Beams wider
    than one that finds all are not tried."""
    count = lambda beam: sum(int((near != o).sum()) for near, o in zip(links_of(graph, exact, q, own, cosine, beam), own.tolist()))
    truth, found = count(0), []
    for beam in LADDER:
        found.append(truth if found and found[-1] == truth else count(beam))
    return truth, found


def common_beam(audits: DataFrame, recall: float = RECALL) -> int:
    """The first beam that finds enough of all audited links (0: none does; nothing audited: the first)."""
    rungs = audits.groupBy("beam").agg(F.sum("truth").alias("truth"), F.sum("found").alias("found")).collect()  # one row per rung
    return min((r.beam for r in rungs if r.found >= recall * r.truth), default=0 if rungs else LADDER[0])


def beams(audits: DataFrame, least: int, recall: float = RECALL) -> DataFrame:
    """The beam of each label and length, `least` or more (0: scan), and the recall audited with it (null: no links)."""
    rungs = audits.groupBy("label", "dim", "beam").agg(F.sum("truth").alias("truth"), F.sum("found").alias("found"))
    fine = F.lit(least > 0) & (F.col("beam") >= least) & (F.col("found") >= recall * F.col("truth"))
    good = F.when(fine, F.struct("beam", (F.col("found") / F.when(F.col("truth") > 0, F.col("truth"))).alias("recall")))
    one = rungs.groupBy("label", "dim").agg(F.min(good).alias("x"))
    return one.select("label", "dim", F.coalesce("x.beam", F.lit(0)).alias("beam"), F.when(F.col("x").isNull(), 1.0).otherwise(F.col("x.recall")).alias("recall"))


def unit_vectors(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Dimension of each vector (0: links with nothing), and by dimension the rows and their unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets, dtype=np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component becomes nan
    size = np.diff(offsets)
    size[~np.asarray(column.is_valid())] = 0
    dims, out = np.zeros(len(column), dtype=np.int32), {}
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        x = values[offsets[rows][:, None] + np.arange(d)]
        # components are scaled by the largest first: no square overflows or vanishes
        top = np.abs(x).max(1)
        fine = np.isfinite(top) & (top > 0)
        rows, x = rows[fine], x[fine] / top[fine, None]
        dims[rows] = d
        out[d] = rows, x / np.sqrt((x * x).sum(1))[:, None] + 0.0
    return dims, out


def pick_pivots(table: DataFrame, most: int, shard: int) -> dict[int, np.ndarray]:
    """At most `most` unit vectors, by dimension; no more than shards are needed, as smaller cells would save nothing."""
    n = table.count()
    most = min(most, -(-n // shard))
    if not most:
        return {}
    some = table.where("label is not null and embedding is not null").where(F.expr(f"pmod(xxhash64(vec_id, label), {max(1, n // (4 * most))}) = 0"))
    rows = some.select(F.col("embedding").cast("array<double>")).limit(most).collect()
    _, found = unit_vectors(pa.array([r[0] for r in rows], pa.list_(pa.float64())))
    return {d: np.unique(x, axis=0) for d, (_, x) in found.items()}


def prepared(table: DataFrame, pivots: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """A row per vector: key, vec_id, label, dim (0: links with nothing), h1, h2 (128 bits of the unit vector), unit, cell,
    cells (those that can hold a link)."""
    reach = 2 * float(np.arccos(cosine)) + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            dims, by_dim = unit_vectors(batch.column("embedding"))
            h, cell = np.zeros((n, 2), dtype=np.int64), np.zeros(n, dtype=np.int32)
            units: list = [None] * n
            cells: list = [None] * n
            for d, (rows, x) in by_dim.items():
                for i, v in zip(rows.tolist(), x):
                    units[i] = v
                    h[i] = np.frombuffer(hashlib.blake2b(v.tobytes(), digest_size=16).digest(), np.int64)
                    cells[i] = [0]
                if len(pivots.get(d, ())):
                    angle = np.arccos(np.clip(x @ pivots[d].T, -1, 1))
                    cell[rows] = angle.argmin(1)
                    near = angle <= angle.min(1, keepdims=True) + reach
                    for i, c in zip(rows.tolist(), near):
                        cells[i] = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("vec_id"), batch.column("label"), pa.array(dims), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(units, pa.list_(pa.float64())), pa.array(cell), pa.array(cells, pa.list_(pa.int32()))],
                ["key", "vec_id", "label", "dim", "h1", "h2", "unit", "cell", "cells"],
            )

    types = {c: table.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    given = table.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", F.when(F.col("label").isNotNull(), F.col("embedding").cast("array<double>")).alias("embedding"))
    return given.mapInArrow(run, f"key long, vec_id {types['vec_id']}, label {types['label']}, dim int, h1 long, h2 long, unit array<double>, cell int, cells array<int>")


def near_vectors(table: DataFrame, cosine: float = COSINE, shard: int = SHARD, queries: int = QUERIES, pivots: int = PIVOTS) -> DataFrame:
    """One row per vector (vec_id, embedding, label): vec_id, n_links, component_id, kept; beam and recall: of its label's audit
    (beam 0: scanned; recall null: no audited class has a link; both null: links with nothing)."""
    spark = table.sparkSession
    prepare(spark)
    work = Workspace(spark, "vectors")
    rows = work.keep(prepared(table, pick_pivots(table, pivots, shard), cosine), "rows")
    same = ["label", "dim", "h1", "h2"]
    classes = work.keep(rows.where("dim > 0").groupBy(*same).agg(F.min("key").alias("rep"), F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.expr(f"coalesce(bool_or(pmod(try_cast(vec_id as bigint), {AUDIT}) = 0), false)").alias("audited")), "classes")
    vecs = work.keep(rows.select(F.col("key").alias("rep"), "unit", "cell", "cells").join(classes.select("rep", "label", "dim", "copies", "audited"), "rep"), "vecs")
    place = ["label", "dim", "cell"]
    # long vectors come in smaller shards and blocks, so that bytes and not rows are bounded
    some = lambda most: F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(128 * most) / F.col("dim")))).cast("int")
    held = vecs.groupBy(*place).agg(F.count("*").alias("n"))
    asking = vecs.select("label", "dim", F.explode("cells").alias("cell")).groupBy(*place).agg(F.count("*").alias("q"))
    sizes = held.join(asking, place).select(*place, F.ceil(F.col("n") / some(shard)).cast("int").alias("shards"), F.ceil(F.col("q") / some(queries)).cast("int").alias("blocks"))
    sizes = work.keep(sizes, "sizes")
    place = [*place, "shard"]
    label_type = rows.schema["label"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, place):
            exact = np.stack(group["unit"].to_numpy())
            index = io.BytesIO()
            np.savez(index, key=group["rep"].to_numpy(), copies=group["copies"].to_numpy(), exact=exact, graph=np.frombuffer(Graph(exact).save(), np.uint8))
            one = group.slice(0, 1)
            yield pa.RecordBatch.from_arrays([*(one[c].combine_chunks() for c in place), one["blocks"].combine_chunks(), pa.array([index.getvalue()], pa.binary())], [*place, "blocks", "index"])

    members = vecs.join(sizes, place[:3]).select(*place[:3], F.expr("pmod(xxhash64(rep), shards)").cast("int").alias("shard"), "rep", "copies", "unit", "blocks")
    members = members.repartition(*place).sortWithinPartitions(*place)
    index = work.keep(members.mapInArrow(build, f"label {label_type}, dim int, cell int, shard int, blocks int, index binary"), "index")

    routed = vecs.select("label", "dim", F.explode("cells").alias("cell"), "rep", "unit", "audited").join(sizes, place[:3])
    task = [*place, "block"]

    def put(questions: DataFrame, tables: DataFrame, blocks: str) -> DataFrame:
        """Each block of questions behind its shard's index."""
        to_all = questions.select(*place[:3], F.expr("explode(sequence(0, shards - 1))").alias("shard"), F.expr(f"pmod(xxhash64(rep, 1), {blocks})").cast("int").alias("block"), "rep", "unit", F.lit(None).cast("binary").alias("index"), F.lit(None).cast("int").alias("beam"), F.lit(1).alias("kind"))
        given = tables.select(*place, F.expr(f"explode(sequence(0, cast({blocks} - 1 as int)))").alias("block"), F.lit(None).cast("long").alias("rep"), F.lit(None).cast("array<double>").alias("unit"), "index", "beam", F.lit(0).alias("kind"))
        return given.unionByName(to_all).repartition(*task).sortWithinPartitions(*task, "kind")

    def blocks_of(batches: Iterator[pa.RecordBatch]):
        for group in runs(batches, task):
            if group.num_rows > 1:
                held = np.load(io.BytesIO(group["index"][0].as_py()))
                key, reps = held["key"], group["rep"][1:].to_numpy()
                order = np.argsort(key, kind="stable")
                at = np.minimum(np.searchsorted(key[order], reps), len(key) - 1)
                own = np.where(key[order][at] == reps, order[at], -1)
                yield group.slice(0, 1), held, Graph.load(held["graph"].tobytes()), reps, np.stack(group["unit"][1:].to_numpy()), own

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, held, graph, _, units, own in blocks_of(batches):
            truth, found = audit(graph, held["exact"], units, own, cosine)
            same_for = [pa.concat_arrays([one[c].combine_chunks()] * len(LADDER)) for c in place[:2]]
            yield pa.RecordBatch.from_arrays([*same_for, pa.array(LADDER, pa.int32()), pa.array([truth] * len(LADDER), pa.int64()), pa.array(found, pa.int64())], ["label", "dim", "beam", "truth", "found"])

    audits = work.keep(put(routed.where("audited"), index.withColumn("beam", F.lit(None).cast("int")), f"ceil(blocks / {AUDIT})").mapInArrow(measure, f"label {label_type}, dim int, beam int, truth long, found long"), "audits")
    # labels without an audited class take what all labels together need
    least = common_beam(audits)
    of_label = sizes.select("label", "dim").distinct().join(beams(audits, least), ["label", "dim"], "left").withColumn("beam", F.coalesce("beam", F.lit(least)).cast("int"))
    of_label = work.keep(of_label, "beams")

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for one, held, graph, reps, units, own in blocks_of(batches):
            key, copies = held["key"], held["copies"]
            found = links_of(graph, held["exact"], units, own, cosine, one["beam"][0].as_py())
            count = np.zeros(len(reps), dtype=np.int64)
            root = key.copy()  # of each node; what is out of date still leads to the right root
            for i, (rep, ids) in enumerate(zip(reps.tolist(), found)):
                ids = ids[key[ids] != rep]
                count[i] = copies[ids].sum()
                for other in np.unique(root[ids]).tolist():
                    forest.union(rep, other)
                root[ids] = forest.find(rep)
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(count), pa.nulls(len(reps), pa.int64())], ["rep", "n_links", "other"])
        a, b = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(b, pa.int64())], ["rep", "n_links", "other"])

    answers = work.keep(put(routed, index.join(of_label.drop("recall"), ["label", "dim"]), "blocks").mapInArrow(query, "rep long, n_links long, other long"), "answers")
    joined = components(work, answers.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    named = work.keep(joined.join(classes.select(F.col("rep").alias("node"), "least_id"), "node"), "named")
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    of_rep = work.keep(named.join(least, "comp").select(F.col("node").alias("rep"), "component_id"), "of_rep")
    counts = answers.where("n_links is not null").groupBy("rep").agg(F.sum("n_links").alias("links"))
    searched = classes.join(counts, "rep").join(of_rep, "rep", "left").join(of_label, ["label", "dim"])
    of_class = work.keep(searched.select(*same, "beam", "recall", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id")), "of_class")
    work.drop(vecs, index, audits, answers)
    slim = rows.select("vec_id", *same)
    some = slim.where("dim > 0").join(of_class, same).drop(*same)
    none = slim.where("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("int").alias("beam"), F.lit(None).cast("double").alias("recall"))
    return some.unionByName(none).withColumn("kept", F.expr("coalesce(vec_id = component_id, component_id is null)"))
