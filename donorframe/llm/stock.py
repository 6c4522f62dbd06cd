"""Packing as a cutting-stock problem, solved by column generation.

Method: documents are cut into full sequences and one rest; the histogram of lengths (at most `capacity` numbers, whatever
the corpus size) defines a linear program over patterns - multisets of lengths that fit one sequence, at the cost of the
padded sequence - which use up every length's count exactly at least cost. A restricted program is solved by the revised
simplex method; its dual prices go to a knapsack dynamic program over the sums of lengths, which finds the patterns that
lower the cost; they are added until none is left, or the cost is within GAP of its lower bound, the volume. The solution is
rounded down, then single patterns are taken by their remaining fractions, and the program of what is left is solved again.

A pattern is kept only if it needs no padding. What no such pattern takes (a number of pieces that depends on the number of
lengths and not on the corpus, unless the lengths do not fit together) is laid end to end and cut at the sequences' ends, so
each of those sequences holds at most two cut pieces; the last tokens of all are cut into sequences of powers of two, which
are not padded. So nothing is padded at all, and what the program saves are cuts.

The plan is a table of patterns with multiplicities and of places in the stream of what is left: a piece finds its place by
its rank among the pieces of its length, in whatever task it is. Ids are written once; only cut pieces read them again.

Defined cases: a null or empty text is the end token alone; a null id stays null; repeated rows are packed as often as they
occur, equal lengths by their rank, which follows the files; texts of any length are cut into pieces; an empty table gives no
rows; other columns are ignored.
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
from .packing import Slots
from .workspace import Workspace, prepare

CAPACITY = 1024
END = 0
#: A sequence costs its padded length and SEQUENCE, so that of two ways without padding the one of fewer sequences counts.
SEQUENCE = 1
#: The program is solved once its cost is this close to the volume's, or after so many pivots (what it then costs too much
#: is cut).
GAP, PIVOTS = 5e-4, 3_000
#: Patterns that one run of the dynamic program adds, and programs that are solved one after the other.
COLUMNS, ROUNDS = 60, 3
#: Most cut pieces that are broadcast (about 60 bytes each).
BROADCAST = 100_000

Pattern = tuple[tuple[int, int], ...]
Plan = list[tuple[Pattern, int]]


def size(pattern: Pattern) -> int:
    return sum(k * a for k, a in pattern)


def padded(total: int, capacity: int) -> int:
    """Tokens of a sequence that holds `total`: the capacity, except at a power of two."""
    return total if total & (total - 1) == 0 else capacity


def cost(pattern: Pattern, capacity: int) -> int:
    return padded(size(pattern), capacity) + SEQUENCE


def first_fit(hist: dict[int, int], capacity: int) -> Plan:
    """Patterns by first-fit decreasing over the histogram; each is repeated while all its lengths last."""
    left, out = {k: n for k, n in sorted(hist.items(), reverse=True) if n}, []
    while left:
        room, pattern = capacity, []
        for k, n in left.items():
            if k <= room and (a := min(n, room // k)):
                pattern.append((k, a))
                room -= a * k
                if not room:
                    break
        times = min(left[k] // a for k, a in pattern)
        for k, a in pattern:
            left[k] -= a * times
            if not left[k]:
                del left[k]
        out.append((tuple(pattern), times))
    return out


def start(hist: dict[int, int], capacity: int) -> list[Pattern]:
    """As many patterns as lengths, which use up all counts: the longest length that is left and what fits beside it, as often
    as the first of them lasts (a fraction, too). Each pattern uses up another length, so none is a sum of others."""
    left, out = {k: float(n) for k, n in sorted(hist.items(), reverse=True)}, []
    while left:
        room, pattern = capacity, []
        for k in left:
            if k <= room:
                pattern.append((k, room // k))
                room %= k
                if not room:
                    break
        times, gone = min((left[k] / a, k) for k, a in pattern)
        for k, a in pattern:
            left[k] = max(left[k] - a * times, 0.0)
        del left[gone]
        out.append(tuple(pattern))
    return out


class Program:
    """The linear program over patterns of one histogram."""

    def __init__(self, hist: dict[int, int], capacity: int):
        self.capacity, self.lengths = capacity, np.array(sorted(hist))
        self.at = {int(k): i for i, k in enumerate(self.lengths)}
        self.need = np.array([hist[int(k)] for k in self.lengths], dtype=float)
        self.patterns: dict[Pattern, int] = {}
        self.costs: list[float] = []
        self.rows = np.zeros((0, 0), dtype=np.int64)  # lengths of each pattern, and how often it takes them
        self.times = np.zeros((0, 0))
        self.add(start(hist, capacity))
        self.basis = np.arange(len(self.lengths))
        self.add([p for p, _ in first_fit(hist, capacity)])
        self.bound = float((self.need * self.lengths).sum()) * (1 + SEQUENCE / capacity)

    def add(self, found: list[Pattern]) -> int:
        """Take up patterns that are new."""
        new = [p for p in dict.fromkeys(found) if p not in self.patterns]
        for p in new:
            self.patterns[p] = len(self.patterns)
            self.costs.append(cost(p, self.capacity))
        width = max([self.rows.shape[1], *map(len, new)], default=1)
        wide = lambda m, more: np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))), more]) if len(m) else more
        rows, times = np.zeros((len(new), width), dtype=np.int64), np.zeros((len(new), width))
        for i, p in enumerate(new):
            rows[i, : len(p)], times[i, : len(p)] = [self.at[k] for k, _ in p], [a for _, a in p]
        if new:
            self.rows, self.times = wide(self.rows, rows), wide(self.times, times)
        return len(new)

    def column(self, j: int) -> np.ndarray:
        out = np.zeros(len(self.lengths))
        np.add.at(out, self.rows[j], self.times[j])
        return out

    def through(self, inverse: np.ndarray, j: int) -> np.ndarray:
        """The inverse times a pattern's column, which has few entries."""
        return (inverse[:, self.rows[j]] * self.times[j]).sum(axis=1)

    def invert(self) -> np.ndarray:
        """The inverse of the basis, column by column (few rows change each time). Library routines are avoided, as their
        threads may stand still in a process that has forked, such as a driver; the basis is put in the order of its rows."""
        m = len(self.lengths)
        inverse, placed, free = np.eye(m), np.zeros(m, dtype=np.int64), np.ones(m, dtype=bool)
        for j in self.basis:
            step = self.through(inverse, j)
            r = int(np.where(free, np.abs(step), -1).argmax())
            pivot_row = inverse[r] / step[r]
            step[r] = 0
            moved = np.flatnonzero(step)
            inverse[moved] -= step[moved, None] * pivot_row
            inverse[r], placed[r], free[r] = pivot_row, j, False
        self.basis = placed
        return inverse

    def price(self, duals: np.ndarray) -> list[Pattern]:
        """Patterns whose lengths are worth more than they cost: the best of every sum by dynamic programming, then the best
        sequence through each length."""
        value = np.full(self.capacity + 1, -np.inf)
        value[self.lengths] = duals
        best, last = np.full(self.capacity + 1, -np.inf), np.zeros(self.capacity + 1, dtype=np.int64)
        best[0] = 0
        for s in range(1, self.capacity + 1):
            worth = best[s - 1 :: -1] + value[1 : s + 1]
            k = int(worth.argmax())
            best[s], last[s] = worth[k], k + 1

        def taken(s: int) -> dict[int, int]:
            out: dict[int, int] = {}
            while s:
                out[int(last[s])] = out.get(int(last[s]), 0) + 1
                s -= int(last[s])
            return out

        costs = np.array([padded(s, self.capacity) + SEQUENCE for s in range(self.capacity + 1)])
        gains = [(float(best[s] - costs[s]), 0, s) for s in range(1, self.capacity + 1) if best[s] > costs[s] + 1e-6]
        through = duals + best[self.capacity - self.lengths] - costs[self.capacity]
        gains += [(float(g), int(k), self.capacity - int(k)) for g, k in zip(through, self.lengths) if g > 1e-6]
        out = []
        for _, k, s in sorted(gains, reverse=True)[:COLUMNS]:
            one = taken(s)
            if k:
                one[k] = one.get(k, 0) + 1
            out.append(tuple(sorted(one.items(), reverse=True)))
        return out

    def solve(self) -> dict[Pattern, float]:
        """Multiplicities of patterns that use up all counts, by the revised simplex method."""
        m = len(self.lengths)
        # counts are moved apart a little, so that no two patterns run out together
        need = self.need * (1 + 1e-7 * np.random.default_rng(0).random(m))
        costs = np.array(self.costs)
        for pivot in range(PIVOTS):
            if pivot % 250 == 0:
                inverse = self.invert()
                x, duals = (inverse * need).sum(axis=1), (costs[self.basis][:, None] * inverse).sum(axis=0)
            if (x * costs[self.basis]).sum() <= self.bound * (1 + GAP):
                break
            reduced = costs - (duals[self.rows] * self.times).sum(axis=1)
            j = int(reduced.argmin())
            if reduced[j] > -1e-6:
                if not self.add(self.price(duals)):
                    break
                costs = np.array(self.costs)
                continue
            step = self.through(inverse, j)
            ratios = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
            r = int(ratios.argmin())
            if not np.isfinite(ratios[r]):
                break
            pivot_row = inverse[r] / step[r]
            x = x - step * ratios[r]
            x[r] = ratios[r]
            step[r] = 0
            moved = np.flatnonzero(step)
            inverse[moved] -= step[moved, None] * pivot_row
            inverse[r] = pivot_row
            duals = duals + reduced[j] * pivot_row
            self.basis[r] = j
        listed = list(self.patterns)
        return {listed[j]: float(v) for j, v in zip(self.basis, x) if v > 1e-9}


def make_plan(hist: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Patterns without padding and how often each is used; they take no more of a length than there is."""
    left, plan = {k: n for k, n in hist.items() if n}, []

    def take(pattern: Pattern, times: int) -> int:
        times = min([times, *(left.get(k, 0) // a for k, a in pattern)])
        if times > 0 and padded(size(pattern), capacity) == size(pattern):
            for k, a in pattern:
                left[k] -= a * times
                if not left[k]:
                    del left[k]
            plan.append((pattern, times))
            return times
        return 0

    take(((capacity, 1),), left.get(capacity, 0))
    for _ in range(ROUNDS):
        if sum(k * n for k, n in left.items()) < capacity:
            break
        found = Program(left, capacity).solve()
        done = sum(take(p, int(x + 1e-6)) for p, x in found.items())
        done += sum(take(p, 1) for p, x in sorted(found.items(), key=lambda f: (int(f[1]) - f[1], f[0])))
        if not done:
            break
    for pattern, times in first_fit(left, capacity):
        if size(pattern) == capacity:
            take(pattern, times)
    return plan


class Places:
    """Where the pieces of a histogram lie, by length and rank: in a pattern, or in the stream of what is left."""

    def __init__(self, hist: dict[int, int], capacity: int = CAPACITY):
        self.capacity, plan = capacity, make_plan(hist, capacity)
        self.slots = Slots(plan)
        self.used = {k: 0 for k in hist}
        for pattern, times in plan:
            for k, a in pattern:
                self.used[k] += a * times
        self.first = sum(times for _, times in plan)
        self.stream, at = {}, 0
        for k in sorted(hist, reverse=True):
            self.stream[k] = at
            at += k * (hist[k] - self.used[k])
        self.left = sum(hist[k] - self.used[k] for k in hist)
        #: Ends of the stream's sequences: full ones, then powers of two.
        tail, ends = at % capacity, [at - at % capacity]
        while tail:
            ends.append(ends[-1] + (1 << (tail.bit_length() - 1)))
            tail -= 1 << (tail.bit_length() - 1)
        self.full, self.tail_ends = ends[0] // capacity, ends[1:]

    def parts(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the piece, length, sequence_id, offset) of a piece that lies in the stream."""
        at = self.stream[length] + (rank - self.used[length]) * length
        end, out = at + length, []
        while at < end:
            n = at // self.capacity
            low, high = n * self.capacity, (n + 1) * self.capacity
            if n >= self.full:
                later = next(i for i, e in enumerate(self.tail_ends) if e > at)
                n, low, high = self.full + later, self.tail_ends[later - 1] if later else self.full * self.capacity, self.tail_ends[later]
            to = min(end, high)
            out.append((length - (end - at), to - at, self.first + n, at - low))
            at = to
        return out


PIECE = ["doc_id", "piece_start", "piece_length", "ids_crc32", "doc_tokens", "part", "rank_in_part"]


def tokenize(docs: DataFrame, vocabulary: str, capacity: int, end: int) -> DataFrame:
    """One row per piece: full ones and the rest, with its rank among the pieces of its length in its task, and its ids as
    bytes (two for an id where the vocabulary allows, else four)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(vocabulary)
        kind = "<u2" if max(encoder.library.get_vocab_size(), end + 1) <= 1 << 16 else "<u4"
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        tail = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            row, columns, ids = [], [[] for _ in range(5)], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                packed = encoder.encode(text or "") + tail
                n = len(packed) // 4
                narrow = np.frombuffer(packed, "<u4").astype(kind)
                for a in range(0, n, capacity):
                    b = min(a + capacity, n)
                    row.append(i)
                    for c, v in zip(columns, (a, b - a, zlib.crc32(packed[4 * a : 4 * b]), n, seen[b - a])):
                        c.append(v)
                    ids.append(narrow[a:b].tobytes())
                    seen[b - a] += 1
            start, length, crc, total, rank = (pa.array(c, pa.int64()) for c in columns)
            out = [batch.column(0).take(pa.array(row, pa.int32())), start, length, crc, total, pa.array([part] * len(row), pa.int32()), rank, pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, [*PIECE, "ids"])

    schema = f"doc_id {id_type}, piece_start long, piece_length long, ids_crc32 long, doc_tokens long, part int, rank_in_part long, ids binary"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def place(ranked: DataFrame, places: Places) -> DataFrame:
    """Pieces with their places: a row per part of a piece, `cut` where it is not the whole piece."""
    more = ["cut_at", "length", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("piece_length", "rank"))
            row, out = [np.zeros(0, dtype=np.int64)], [np.zeros((0, 4), dtype=np.int64)]
            order = np.argsort(lengths, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if not len(at):
                    continue
                k = int(lengths[at[0]])
                inside = ranks[at] < places.used[k]
                if inside.any():
                    seq, off = places.slots.place(k, ranks[at][inside])
                    row.append(at[inside])
                    out.append(np.stack([np.zeros_like(seq), np.full_like(seq, k), seq, off], axis=1))
                for i in at[~inside]:
                    told = places.parts(k, int(ranks[i]))
                    row.append(np.full(len(told), i))
                    out.append(np.array(told, dtype=np.int64))
            rows, cells = np.concatenate(row), np.concatenate(out)
            kept = batch.select(PIECE).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(np.ascontiguousarray(cells[:, i])) for i in range(4)), pa.array(cells[:, 1] < lengths[rows])], [*PIECE, *more, "cut"])

    types = {f.name: f.dataType.simpleString() for f in ranked.schema}
    schema = ", ".join([*(f"{c} {types[c]}" for c in PIECE), *(f"{c} long" for c in more), "cut boolean"])
    return ranked.select(*PIECE, "rank").mapInArrow(run, schema)


def read_ids(rows: DataFrame) -> DataFrame:
    """The rows with the ids of their own part (array) and the checksum of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, crc = [], []
            for packed, whole, at, n in zip(*(batch.column(c).to_pylist() for c in ("ids", "piece_length", "cut_at", "length"))):
                own = np.frombuffer(packed, f"<u{len(packed) // whole}")[at : at + n].astype("<u4")
                ids.append(own.astype(np.int32))
                crc.append(zlib.crc32(own.tobytes()))
            told = {"ids": pa.array(ids, pa.list_(pa.int32())), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.RecordBatch.from_arrays([told.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return rows.mapInArrow(run, ", ".join(f"{f.name} {'array<int>' if f.name == 'ids' else f.dataType.simpleString()}" for f in rows.schema))


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, most: int = BROADCAST) -> DataFrame:
    """Pack documents (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    prepare(spark)
    work = Workspace(spark, "stock")
    pieces = work.keep(tokenize(docs, vocabulary, capacity, end), "pieces")
    counts = pieces.groupBy("piece_length", "part").agg(F.count("*").alias("n"))
    # at most `capacity` rows come to the driver: the histogram
    hist = {r[0]: r[1] for r in counts.groupBy("piece_length").agg(F.sum("n").alias("n")).collect()}
    places = Places(hist, capacity)
    before = Window.partitionBy("piece_length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("piece_length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.drop("ids").join(base, ["piece_length", "part"]).withColumn("rank", F.col("base") + F.col("rank_in_part"))
    placed = work.keep(place(ranked, places), "placed")
    key = ["part", "piece_length", "rank_in_part"]
    names = ["doc_id", (F.col("piece_start") + F.col("cut_at")).alias("start"), "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    if with_ids:
        return read_ids(placed.join(pieces.select(*key, "ids"), key)).select(*names)
    cut = placed.where("cut")
    # a piece has at most two parts, and the last sequences of all only a handful more
    known = pieces.select(*key, "ids").join(F.broadcast(cut) if places.left <= most else cut, key)
    return placed.where("NOT cut").select(*names).unionByName(read_ids(known).select(*names))
