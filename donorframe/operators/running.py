"""Running maxima, sums and numbers along positions, without one task per chromosome.

A chromosome is cut into stretches of `width` positions. Each stretch is aggregated (partial sums, so this shuffles a row
per stretch and task), a window over the few stretches of a chromosome carries what stands before each of them, and a
window inside every stretch does the rest. So rows are sorted by (chromosome, stretch), and neither a long chromosome nor
a dense one gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import unused

WIDTH = 1 << 16


def running(rows: DataFrame, by: list[str], order: list[Column], at: str = "pos", width: int = WIDTH, **wanted: tuple[str, Column, bool]) -> DataFrame:
    """Add a column per name of `wanted`: ("max" or "sum", value, whether the row itself counts), over the rows of the same
    `by` in order, which begins with the column `at`. Where nothing counts the value is null."""
    stretch = unused(rows, "stretch")
    cut = rows.withColumn(stretch, F.floor(F.col(at) / width))
    total = {"max": F.max, "sum": F.sum}
    before = Window.partitionBy(*by).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, stretch).orderBy(*order)
    sums = cut.groupBy(*by, stretch).agg(*[total[kind](value).alias(name) for name, (kind, value, _) in wanted.items()])
    carried = {name: unused(rows, f"{name}_before") for name in wanted}
    carry = sums.select(*by, stretch, *[total[kind](name).over(before).alias(carried[name]) for name, (kind, _, _) in wanted.items()])
    out = cut.join(carry, [*by, stretch])
    for name, (kind, value, own) in wanted.items():
        here = total[kind](value).over(inside.rowsBetween(Window.unboundedPreceding, 0 if own else -1))
        both = F.greatest(here, carried[name]) if kind == "max" else F.coalesce(here + F.col(carried[name]), here, carried[name])
        out = out.withColumn(name, both)
    return out.drop(stretch, *carried.values())
