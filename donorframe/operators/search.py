"""The matcher of one cluster: the best pair of subsets of both sides that spell the same donor.

States walk over the cluster's window from sync point to sync point. A state holds, per strand, the bases edited so far and
the donor spelled so far; where it meets an undecided row it branches over the row's choices (leave it out; either
phasing; for a row with a reference allele and two alts also the second alt). States whose strands disagree are dropped,
and at a sync point only the best of those states is kept whose strands are equal and equally long. After SEARCH_BUDGET
states the cluster falls back to exact matching.

All states meet the rows in one order, so they go row by row together: what a choice writes is worked out once a row, and
what a strand spells once for all states that share its edits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from ..functions.alignment import base_edits
from ..model import EASY_SIZE, QUERY, SEARCH_BUDGET, SINGLE_LIMIT, Scoring


@dataclass(frozen=True)
class Row:
    side: int  # 0 baseline, 1 query
    pos: int
    ref: str
    alts: tuple[str, ...]
    het: bool
    multi: bool
    zero_one: bool
    mil: int = 0
    mdl: int = 0

    @property
    def two_alts(self) -> bool:
        return self.multi and not self.zero_one

    @classmethod
    def of(cls, v: dict) -> "Row":
        return cls(int(v["side"] == QUERY), int(v["pos"]), v["ref"], tuple(v["alts"]), bool(v["het"]), bool(v["multi"]), bool(v["zero_one"]), int(v["mil"]), int(v["mdl"]))


@dataclass(frozen=True)
class State:
    score: int
    choices: tuple  # per row: None where it is never used, "" left out, else the choice
    donors: tuple[str, str, str, str]  # baseline 0 and 1, query 0 and 1; of one strand a side, 1 is empty


@lru_cache(maxsize=200_000)
def distance(a: str, b: str) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for k, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[k] + 1, last[k - 1] + (x != y)))
        last = row
    return last[-1]


def edit_share(row: Row, choice: int, mode: int) -> int:
    """Edit distance that a choice accounts for in a score."""
    one = distance(row.ref, row.alts[0])
    two = distance(row.ref, row.alts[1]) if len(row.alts) > 1 else 0
    if mode == 1:
        return two if choice == 1 else one
    return {-1: one, -2: two, 0: one + (two if row.two_alts else 0), 1: one + two}[choice]


def worth(row: Row, choice: int, scoring: Scoring) -> int:
    if scoring.scheme and scoring.scheme - 1 != row.side:
        return 0
    return edit_share(row, choice, scoring.mode) if scoring.unit else 1


def edits_total(row: Row, choice: int, mode: int) -> int:
    return edit_share(row, choice, mode) * (2 if mode == 1 else 1)


@lru_cache(maxsize=100_000)
def phasings(row: Row, mode: int) -> tuple[tuple[int, tuple[str, ...]], ...]:
    """Choices of a row with the allele each strand gets."""
    first = row.alts[0]
    if mode == 1:
        return ((0, (first,)), (1, (row.alts[1],))) if row.multi else ((0, (first,)),)
    other = row.alts[1] if row.two_alts else row.ref if row.het else first
    out = [(0, (first, other))]
    if row.het:
        out.append((1 if row.two_alts else -1, (other, first)))
    if row.multi and row.zero_one:
        out += [(1, (row.alts[1], row.ref)), (-2, (row.ref, row.alts[1]))]
    return tuple(out)


@lru_cache(maxsize=100_000)
def written(ref: str, allele: str) -> tuple[tuple[tuple[int, str, str | None], ...], tuple[int, ...]]:
    """What an allele other than ref does to its bases, counted from its first: (base, what stands for it, what is added if
    the base is edited already and only grows); and the bases that it does not leave as they are."""
    changes = []
    for k, (base, now) in enumerate(zip(ref, base_edits(ref, allele))):
        if now != base:
            grows = k == len(ref) - 1 and len(now) > 1 and now[0] == base
            changes.append((k, now, now[1:] if grows else None))
    return tuple(changes), tuple(k for k, base in enumerate(ref) if k >= len(allele) or allele[k] != base)


def decidable(rows: list[Row]) -> list[bool]:
    """In clusters of over EASY_SIZE rows, one whose change exceeds that of all others together is never used."""
    if len(rows) <= EASY_SIZE:
        return [True] * len(rows)
    total = sum(r.mil + r.mdl for r in rows)
    return [2 * max(r.mil, r.mdl) <= total for r in rows]


def hopeless(rows: list[Row]) -> bool:
    """One side missing, or one row against more than SINGLE_LIMIT whose change it exceeds."""
    by = [[r for r in rows if r.side == s] for s in (0, 1)]
    if not all(by):
        return True
    few, many = sorted(by, key=len)
    return len(few) == 1 and len(many) > SINGLE_LIMIT and max(few[0].mil, few[0].mdl) > max(sum(r.mil for r in many), sum(r.mdl for r in many))


def window_of(rows: list[Row], genome_length: int | None = None) -> tuple[int, int]:
    """Bases (from, to) that the search walks over: one more on either side."""
    end = max(r.pos + len(r.ref) for r in rows) + 1
    return max(min(r.pos for r in rows) - 1, 0), end if genome_length is None else min(end, genome_length)


def sync_points(rows: list[Row], offset: int, length: int) -> list[int]:
    ends: list[list[int]] = []
    for low, high in sorted((r.pos, r.pos + len(r.ref) - 1) for r in rows):
        if ends and ends[-1][1] >= low:
            ends[-1][1] = max(ends[-1][1], high)
        else:
            ends.append([low, high])
    points = [high - offset for _, high in ends]
    return points if points[-1] >= length - 1 else [*points, length - 1]


def agree(donors: tuple, mode: int) -> bool:
    """Whether one donor of each pair of strands begins with the other, and equals it if as long. donors: those of the
    baseline and then those of the query."""
    half = len(donors) // 2
    for a, b in list(zip(donors[:half], donors[half:]))[: 2 - mode]:
        if not (a.startswith(b) or b.startswith(a)):
            return False
    return True


def even(donors: tuple) -> bool:
    half = len(donors) // 2
    return all(len(a) == len(b) for a, b in zip(donors[:half], donors[half:]))


class Write:
    """An allele on one strand: applied to a strand's edits. An allele may go over bases that are edited already only where it
    leaves them as they are."""

    def __init__(self, at: int, ref: str, allele: str):
        changes, over = written(ref, allele)
        self.changes = [(at + k, now, more) for k, now, more in changes]
        self.over = [at + k for k in over]
        self.alone = {k: now for k, now, _ in self.changes}

    def __call__(self, edits: dict) -> dict | None:
        if not edits:
            return self.alone
        for k in self.over:
            if k in edits:
                return None
        out = dict(edits)
        for k, now, more in self.changes:
            out[k] = out[k] + more if more is not None and k in out else now
        return out


#: score, choices in the order of the decisions, edits and donors a strand
Way = tuple[int, tuple, tuple[dict, ...], tuple[str, ...]]


class Search:
    """Best common donor of a cluster's rows (in comparison order) over the bases of their window."""

    def __init__(self, rows: list[Row], window: str, offset: int, scoring: Scoring, budget: int = SEARCH_BUDGET):
        self.rows, self.window, self.offset, self.scoring, self.budget = rows, window.upper(), offset, scoring, budget
        self.points = sync_points(rows, offset, len(window))
        self.strands = 2 - scoring.mode  # of a side
        # rows are decided by position, and at one position the baseline's first
        self.decided = sorted((i for i, ok in enumerate(decidable(rows)) if ok), key=lambda i: (rows[i].pos, rows[i].side))

    def options(self, i: int) -> list[tuple]:
        """Choices of a row: choice, worth, and per strand that it changes what it writes."""
        r = self.rows[i]
        out = []
        for choice, alleles in phasings(r, self.scoring.mode):
            writes = [(self.strands * r.side + y, Write(r.pos - self.offset, r.ref, a)) for y, a in enumerate(alleles) if a != r.ref]
            out.append((choice, worth(r, choice, self.scoring), writes))
        return out

    def spelled(self, ways: list[Way], at: int, to: int) -> list[Way]:
        """The ways gone on from base `at` to base `to`, without those whose strands disagree."""
        mode = self.scoring.mode
        if to <= at:
            return [w for w in ways if agree(w[3], mode)]
        plain = self.window[at + 1 : to + 1]
        told: dict[int, str] = {}  # by the edits' identity: ways hold them
        out = []
        for score, choices, edits, donors in ways:
            more = []
            for e, donor in zip(edits, donors):
                if not e:
                    more.append(donor + plain)
                    continue
                text = told.get(id(e))
                if text is None:
                    text = told[id(e)] = self.text(e, at, to)
                more.append(donor + text)
            if agree(more, mode):
                out.append((score, choices, edits, tuple(more)))
        return out

    def text(self, edits: dict, at: int, to: int) -> str:
        parts, low = [], at + 1
        for k in sorted(k for k in edits if at < k <= to):
            parts += (self.window[low:k], edits[k])
            low = k + 1
        return "".join([*parts, self.window[low : to + 1]])

    @staticmethod
    def branch(ways: list[Way], options: list[tuple]) -> list[Way]:
        out = []
        for way in ways:
            score, choices, edits, donors = way
            out.append((score, (*choices, ""), edits, donors))
            for choice, value, writes in options:
                now = list(edits)
                for s, write in writes:
                    if (e := write(now[s])) is None:
                        break
                    now[s] = e
                else:
                    out.append((score + value, (*choices, choice), tuple(now), donors))
        return out

    def best(self) -> State | None | str:
        """The best state; None without a match; "budget" where the search was given up."""
        untouched = ({},) * (2 * self.strands)
        now: list[Way] = [(0, (), untouched, ("",) * (2 * self.strands))]
        seen, at, k = 0, -1, 0
        for goal in self.points:
            while k < len(self.decided) and (base := self.rows[self.decided[k]].pos - self.offset) <= goal:
                seen += len(now)
                if seen >= self.budget:
                    return "budget"
                now, at = self.branch(self.spelled(now, at, base - 1), self.options(self.decided[k])), max(at, base - 1)
                k += 1
            seen += len(now)
            if seen >= self.budget:
                return "budget"
            now, at = self.spelled(now, at, goal), goal
            if goal != self.points[-1]:
                # rows end before a sync point, so nothing that is edited lies after it
                now = [(score, choices, untouched, donors) for score, choices, _, donors in self.converge(now)]
        found = max((w for w in now if w[0] > 0 and even(w[3])), key=lambda w: w[0], default=None)
        return self.state(found) if found else None

    def state(self, way: Way) -> State:
        score, choices, _, donors = way
        of = dict(zip(self.decided, choices))
        return State(score, tuple(of.get(i) for i in range(len(self.rows))), tuple(donors) if self.strands == 2 else (donors[0], "", donors[1], ""))

    @staticmethod
    def converge(ways: list[Way]) -> list[Way]:
        kept: dict[tuple, tuple[int, Way]] = {}
        open_: list[tuple[int, Way]] = []
        for n, w in enumerate(ways):
            if not even(w[3]):
                open_.append((n, w))
                continue
            # both sides are equally long: the lengths of one side's strands, whichever is which
            key = tuple(sorted(map(len, w[3][: len(w[3]) // 2])))
            if key not in kept or w[0] > kept[key][1][0]:
                kept[key] = n, w
        return [w for _, w in sorted([*open_, *kept.values()], key=lambda x: x[0])]


def equal_rows(b: Row, q: Row) -> bool:
    """Equality with genotype."""
    if (b.pos, b.ref) != (q.pos, q.ref):
        return False
    both = sum(x == y for x in b.alts[:2] for y in q.alts[:2]) >= 2
    if b.het == q.het and b.multi == q.multi and (both if b.multi and b.het else b.alts[0] == q.alts[0]):
        return True
    return b.multi and b.zero_one and q.multi and q.zero_one and both


def direct(rows: list[Row]) -> list[tuple[int, int]]:
    """Each baseline row with the first equal query row."""
    out = []
    for i, b in enumerate(rows):
        if b.side == 0:
            hit = next((k for k, q in enumerate(rows) if q.side == 1 and equal_rows(b, q)), None)
            if hit is not None:
                out.append((i, hit))
    return out
