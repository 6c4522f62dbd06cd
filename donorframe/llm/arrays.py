"""Array expressions that Spark has no function for, linear (or nearly) in an array of any length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of the blocks that a text is cut into, so that reading at a place does not go through the text before it.
BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, op: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running sums (or what an associative op makes) of an array: in each round every element takes in what stands 1, 2, 4, ...
    before it, so an array of n elements takes log n rounds."""
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")

    def step(acc: Column, r: Column) -> Column:
        return F.transform(acc, lambda x, i: let(F.get(acc, i - F.call_function("shiftleft", F.lit(1), r)), lambda before: F.when(before.isNull(), x).otherwise(op(before, x))))

    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(F.sequence(F.lit(0), rounds), values, step))


def blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(cells: Column, start: Column, end: Column) -> Column:
    """The characters from start to end (not included) of a text, given its blocks()."""
    first, last = (F.floor(x / BLOCK).cast("int") for x in (start, F.greatest(end - 1, F.lit(0))))
    piece = lambda k: F.substr(F.get(cells, k), F.greatest(start - k * BLOCK, F.lit(0)).cast("int") + 1, (F.least(end - k * BLOCK, F.lit(BLOCK)) - F.greatest(start - k * BLOCK, F.lit(0))).cast("int"))
    return F.when(end > start, F.array_join(F.transform(F.sequence(first, last), piece), "")).otherwise("")
