"""Best-fit packing of token pieces into sequences of a fixed capacity.

Method: the histogram of piece lengths (at most `capacity` numbers, whatever the corpus size) defines a configuration
linear program - least number of sequences such that the configurations cover every length's count. Multiplicative
weights solve it: each step prices a configuration with a knapsack dynamic program over the current weights and takes a
share of it, until every length is covered, so the solution is feasible (not optimal: the last steps cover what is left
with configurations that are not full). It is rounded down, which leaves a smaller
histogram; the program of that one is solved and rounded, and so on. Weights start near the dual prices of the volume
bound (a length's price is its length); where the plan misses that bound, they start at prices learned by steps that may
cover any length again and again, and the better plan counts. Full configurations are taken first, ever less full
ones only where no fuller ones are left. What no rounding takes in the end (a handful of pieces) is placed by best-fit
decreasing. The plan is a table of configurations with multiplicities; every piece finds its place by arithmetic on its
rank among the pieces of its length, so no task holds more than a batch of pieces.

Defined cases: a null or empty text is the end token alone (one piece of length 1); a null id stays null; repeated rows
are packed as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoders import byte_encoder
from .workspace import Workspace, prepare

CAPACITY = 1024
END = 2
#: Steps of the multiplicative-weights solver.
STEPS = 300
#: How fast weights fall with coverage, and how much more than in proportion the longest length weighs at first.
RATE = 0.5
LONG_FIRST = 0.5
#: How fast weights move while prices are learned.
LEARNING = 3.0

Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def price(values: np.ndarray, most: np.ndarray) -> dict[int, int]:
    """The configuration of greatest total value (bounded knapsack); values[k - 1] is that of length k, of which there may
    be most[k - 1]."""
    capacity = len(values)
    best = np.zeros(capacity + 1)
    taken = []
    for length in (np.flatnonzero(most)[::-1] + 1).tolist():
        left, k = min(int(most[length - 1]), capacity // length), 1
        while left > 0:
            n = min(k, left)  # n of a length at a time, for n of 1, 2, 4, ...
            other = best[: capacity + 1 - n * length] + n * values[length - 1]
            better = other > best[n * length :]
            if better.any():
                taken.append((length, n, better))
                best[n * length :] = np.where(better, other, best[n * length :])
            left, k = left - n, 2 * k
    out: dict[int, int] = {}
    c = capacity
    for length, n, better in reversed(taken):
        if c >= n * length and better[c - n * length]:
            out[length] = out.get(length, 0) + n
            c -= n * length
    return out


def learn_prices(need: np.ndarray, start: np.ndarray, share: float, steps: int) -> np.ndarray:
    """Prices of lengths, the mean of the later steps' weights: they rise where a length is covered less than the others."""
    covered, total = np.zeros(len(need)), np.zeros(len(need))
    for t in range(steps):
        values = np.where(need > 0, start * np.exp(-LEARNING * (covered / np.maximum(need, 1) - t / steps)), 0)
        config = price(values, need)
        for length, a in config.items():
            covered[length - 1] += a * share
        if t >= steps // 2:
            total += values / sum(values[k - 1] * a for k, a in config.items())
    return total / (steps - steps // 2) + 1e-9 * start


def relax(hist: dict[int, int], capacity: int, steps: int = STEPS, learned: bool = False) -> dict[tuple[tuple[int, int], ...], float]:
    """A feasible fractional solution: multiplicities of configurations that cover every length's count.

    A length's weight falls exponentially with the part of it that is covered; a covered length has none. The weights
    start a little above proportion to the length for long ones, which are the hardest to place, or at learned prices. A
    step is as wide as the volume bound's share, or half of what its configuration can still cover if that is more, and no
    wider than any of its lengths needs.
    """
    need = np.zeros(capacity)
    for length, n in hist.items():
        need[length - 1] = n
    lengths = np.arange(1, capacity + 1)
    prior = lengths * (1 + LONG_FIRST * lengths / capacity)
    share = max(1.0, float(need.dot(lengths)) / capacity / steps)
    if learned:
        prior = learn_prices(need, prior, share, steps)
    covered = np.zeros(capacity)
    x: dict[tuple[tuple[int, int], ...], float] = {}
    while (short := covered < need).any():
        values = np.where(short, prior * np.exp(-RATE * covered / np.maximum(need, 1)), 0)
        config = price(values, np.where(short, np.ceil((need - covered) / share), 0))
        useful = [(need - covered)[k - 1] / a for k, a in config.items()]
        step = min(max(share, np.floor(min(useful) / 2)), max(useful))
        key = tuple(sorted(config.items(), reverse=True))
        x[key] = x.get(key, 0.0) + step
        for length, a in config.items():
            covered[length - 1] += a * step
    return x


def best_fit(left: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram: sequences that hold the same are one group with a multiplicity, so the work
    depends on the numbers of lengths and gaps and not on the number of pieces."""
    groups: dict[int, list[list]] = {}  # by free space: [configuration, sequences]
    for length in sorted(left, reverse=True):
        n = left[length]
        gaps = sorted(g for g in groups if g >= length) + [capacity]
        while n:
            gap = gaps[0]
            group = groups[gap][-1] if groups.get(gap) else None
            if group is None and gap != capacity:
                gaps.pop(0)
                continue
            # a sequence that still has room for the length is the best fit for the next piece too
            each = min(gap // length, n)
            times = n // each if group is None else min(n // each, group[1])
            config = {} if group is None else group[0]
            if group is not None:
                group[1] -= times
                if not group[1]:
                    groups[gap].pop()
            new = config | {length: config.get(length, 0) + each}
            groups.setdefault(gap - each * length, []).append([new, times])
            n -= each * times
    return [(tuple(sorted(c.items(), reverse=True)), k) for gs in groups.values() for c, k in gs]


def round_off(hist: dict[int, int], capacity: int, steps: int, learned: bool) -> Plan:
    left, plan, waste = dict(hist), [], 0
    size = lambda config: sum(k * a for k, a in config)
    while waste < capacity and sum(k * n for k, n in left.items()) >= 2 * capacity:
        before = len(plan)
        for config, x in sorted(relax(left, capacity, steps, learned).items(), key=lambda c: (-size(c[0]), -c[1])):
            times = min(int(x + 1e-9), *(left.get(k, 0) // a for k, a in config))
            if times > 0 and size(config) >= capacity - waste:
                for k, a in config:
                    left[k] -= a * times
                    if not left[k]:
                        del left[k]
                plan.append((config, times))
        if len(plan) == before:
            waste = 2 * waste + 1
    return plan + (best_fit(left, capacity) if left else [])


def make_plan(hist: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Plan:
    """Configurations with multiplicities that use up the histogram exactly."""
    hist = {k: v for k, v in hist.items() if v}
    count = lambda plan: sum(n for _, n in plan)
    plan = round_off(hist, capacity, steps, False)
    bound = -(-sum(k * n for k, n in hist.items()) // capacity)
    return plan if count(plan) <= 1.002 * bound + 2 else min(plan, round_off(hist, capacity, steps, True), key=count)


class Slots:
    """Places of a plan, by length and rank."""

    def __init__(self, plan: Plan):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        first = 0
        for config, times in plan:
            offset = 0
            for length, a in config:
                rows.setdefault(length, []).append((used.get(length, 0), a, first, offset))
                used[length] = used.get(length, 0) + a * times
                offset += a * length
            first += times
        self.rows = {k: np.array(v, dtype=np.int64) for k, v in rows.items()}

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.rows[length]
        r = r[np.searchsorted(r[:, 0], rank, "right") - 1]
        inside = rank - r[:, 0]
        return r[:, 2] + inside // r[:, 1], r[:, 3] + inside % r[:, 1] * length


def tokenize(docs: DataFrame, vocabulary: str, capacity: int, end: int, with_ids: bool) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its task."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(vocabulary)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        tail = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                packed = encoder.encode(text or "") + tail
                n, a, k = len(packed) // 4, 0, 0
                b = n % capacity or capacity
                while a < n:
                    cut = packed[a * 4 : b * 4]
                    row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(cut)), rank.append(seen[b - a])
                    if with_ids:
                        ids.append(np.frombuffer(cut, "<i4"))
                    seen[b - a] += 1
                    a, b, k = b, b + capacity, k + 1
            out = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part"]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pack documents (doc_id, text); returns doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    prepare(spark)
    work = Workspace(spark, "packing")
    pieces = work.keep(tokenize(docs, vocabulary, capacity, end, with_ids), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # at most `capacity` rows come to the driver: the histogram
    hist = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = Slots(make_plan(hist, capacity))
    # ranks go on from task to task: the window sorts one row per task and length, not pieces
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("rank_in_part")).drop("part", "base", "rank_in_part")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros_like(length), np.zeros_like(length)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(at):
                    seq[at], off[at] = slots.place(int(length[at[0]]), rank[at])
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names[:5]] + [pa.array(seq), pa.array(off)] + [batch.column(n) for n in names[5:]], names[:5] + ["sequence_id", "offset"] + names[5:])

    schema = ", ".join(f"{n} {pieces.schema[n].dataType.simpleString()}" for n in names[:5]) + ", sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return ranked.select(*names, "rank").mapInArrow(place, schema)
