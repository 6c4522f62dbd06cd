"""Alignment of alleles, for the matcher and for normalisation (plain Python; used inside grouped functions)."""

from __future__ import annotations

from functools import lru_cache


def align(a: str, b: str) -> list[tuple[str, str]]:
    """Columns of a global alignment (match 0, mismatch and gap -1) as pairs with "" for a gap. A diagonal step is taken
    only where it alone is best; else a gap in b comes before a gap in a."""
    cost = [list(range(len(a) + 1))]
    move = [["left"] * (len(a) + 1)]
    for i, y in enumerate(b, 1):
        row, step = [i], ["up"]
        for k, x in enumerate(a, 1):
            diagonal, left, up = cost[-1][k - 1] + (x != y), row[-1] + 1, cost[-1][k] + 1
            if diagonal < min(left, up):
                row.append(diagonal), step.append("both")
            elif left <= up:
                row.append(left), step.append("left")
            else:
                row.append(up), step.append("up")
        cost.append(row), move.append(step)
    i, k, out = len(b), len(a), []
    while i or k:
        at = move[i][k]
        out.append((a[k - 1] if at != "up" else "", b[i - 1] if at != "left" else ""))
        i, k = i - (at != "left"), k - (at != "up")
    return out[::-1]


@lru_cache(maxsize=100_000)
def base_edits(ref: str, alt: str) -> tuple[str, ...]:
    """What stands for each base of ref once alt is applied: an inserted base belongs to the base before it (to the first
    base at the very start), a deleted base is empty."""
    out = [""] * len(ref)
    at = -1
    for x, y in align(ref, alt):
        at += x != ""
        out[max(at, 0)] += y
    return tuple(out)


def shared(texts: list[str]) -> int:
    """How many letters all texts begin with."""
    a, b = min(texts), max(texts)
    least, most = 0, min(len(a), len(b))
    while least < most:
        half = (least + most + 1) // 2
        if a[:half] == b[:half]:
            least = half
        else:
            most = half - 1
    return least


def left_normalize(genome: str, pos: int, ref: str, alts: list[str], start: int = 0) -> tuple[int, str, list[str]]:
    """Shift a variant to the left and trim it. genome holds the bases from `start` on; pos counts from 0."""
    alts = list(alts)
    spare = lambda alleles: min(shared(alleles), min(map(len, alleles)) - 1)
    if (n := spare([x[::-1] for x in [ref, *alts]])) > 0:
        ref, alts = ref[:-n], [x[:-n] for x in alts]
    changed = True
    while changed:
        changed = False
        alleles = [ref, *alts]
        if all(alleles) and len({x[-1] for x in alleles}) == 1:
            ref, alts, changed = ref[:-1], [x[:-1] for x in alts], True
        if not all([ref, *alts]):
            if pos <= start:
                # nothing to the left: give the base back on the right
                base = genome[pos - start + len(ref)]
                return pos, ref + base, [x + base for x in alts]
            pos -= 1
            base = genome[pos - start]
            ref, alts, changed = base + ref, [base + x for x in alts], True
    if (n := spare([ref, *alts])) > 0:
        pos, ref, alts = pos + n, ref[n:], [x[n:] for x in alts]
    return pos, ref, alts
