"""Scalar functions over columns. All are built-in expressions unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_nonempty(c: Column, separator: str) -> Column:
    """Split at a literal separator, without empty parts."""
    return F.filter(F.split(c, f"\\Q{separator}\\E", -1), lambda x: x != "")


def leading_int(c: Column) -> Column:
    """The integer that a text begins with, else 0."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?[0-9]{1,9})", 1).try_cast("int"), F.lit(0))


def is_tandem_repeat(s: Column) -> Column:
    """Whether a text is a unit of at most half its length repeated; an incomplete last unit is ignored."""
    n = F.length(s)

    def whole(u: Column) -> Column:
        times = F.floor(n / u).cast("int")
        unit = F.substr(s, F.lit(1), u)
        return F.substr(s, F.lit(1), u * times) == F.repeat(unit, times)

    # most texts don't begin with a unit twice, which one pattern tells without trying each unit in turn
    twice = s.rlike(r"(?s)\A(?:(.)\1+\z|(..+)\2)")
    return F.when(n < 2, n == 1).otherwise(twice & F.exists(F.sequence(F.lit(1), F.greatest(F.floor(n / 2), F.lit(1)).cast("int")), whole))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def mode_index(unit: Column, mode: Column, scheme: Column) -> Column:
    return F.shiftleft(unit, 3).bitwiseOR(F.shiftleft(mode, 2)).bitwiseOR(scheme)


def mode_parts(index: Column) -> tuple[Column, Column, Column]:
    """Unit, mode and scheme of a mode index."""
    return F.shiftright(index, 3).bitwiseAND(1), F.shiftright(index, 2).bitwiseAND(1), index.bitwiseAND(3)


def mode_label(unit: Column, mode: Column, scheme: Column) -> Column:
    return F.concat(F.when(unit == 0, "U").otherwise("E"), F.when(mode == 0, "G").otherwise("V"), F.when(scheme == 0, "T").when(scheme == 1, "B").otherwise("Q"))


def snp_type(ref: Column, alt: Column) -> Column:
    """S, I or D by the lengths."""
    return F.when(F.length(alt) > F.length(ref), "I").when(F.length(alt) < F.length(ref), "D").otherwise("S")


def genotype_normalized(gt: Column) -> Column:
    """Sorted alleles joined by a bar."""
    return F.array_join(F.array_sort(F.split(gt, r"[/|]", -1)), "|")


def phase(choice: Column, het: Column, multi: Column, zero_one: Column) -> Column:
    """Haplotypes of a used row by choice."""
    two = multi & ~zero_one
    return F.when(choice == 0, F.when(~het, "1|1").when(two, "1|2").otherwise("1|0")).when(choice == 1, F.when(two, "2|1").when(multi, "2|0").otherwise("0|1")).when(choice == -1, "0|1").when(choice == -2, "0|2")


def edit_distance_by_choice(ref: Column, alts: Column, choice: Column, multi: Column, zero_one: Column, mode: int = 0) -> Column:
    """Edit distance that a choice accounts for; on one strand (mode 1) it counts twice."""
    one, two = F.levenshtein(ref, F.get(alts, F.lit(0))), F.coalesce(F.levenshtein(ref, F.get(alts, F.lit(1))), F.lit(0))
    if mode == 1:
        return 2 * F.when(choice == 1, two).otherwise(one)
    return F.when(choice == -1, one).when(choice == -2, two).when(choice == 0, one + F.when(multi & ~zero_one, two).otherwise(0)).otherwise(one + two)


def apply_variant(seq: Column, pos: Column, ref_length: Column, alt: Column) -> Column:
    """The sequence with ref_length bases from pos (from 0) replaced."""
    return F.concat(F.substr(seq, F.lit(1), pos), alt, F.substr(seq, pos + ref_length + 1))


def apply_variants(seq: Column, variants: Column) -> Column:
    """Apply an array of (pos, ref, alt) that do not overlap, from right to left."""
    right = F.reverse(F.array_sort(variants))
    return F.aggregate(right, seq, lambda s, v: apply_variant(s, v["pos"], F.length(v["ref"]), v["alt"]))


def trim_alleles(ref: Column, alt: Column) -> Column:
    """(chopped, ref, alt): common suffix, then common prefix, cut off while both keep a base; chopped counts the prefix."""
    named = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731 - so that value is computed once

    def longest(a: Column, b: Column, part) -> Column:
        most = F.least(F.length(a), F.length(b)) - 1
        return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda k: part(a, k) == part(b, k))), F.lit(0))

    def without(x: Column) -> Column:
        """x: ref, alt and the length of their common suffix."""
        return F.struct(*[F.substr(x[c], F.lit(1), F.length(x[c]) - x["tail"]).alias(c) for c in ("ref", "alt")])

    def chopped(x: Column) -> Column:
        head = longest(x["ref"], x["alt"], F.left)
        return named(head, lambda h: F.struct(h.alias("chopped"), F.substr(x["ref"], h + 1).alias("ref"), F.substr(x["alt"], h + 1).alias("alt")))

    texts = F.struct(ref.alias("ref"), alt.alias("alt"))
    tailed = named(texts, lambda x: F.struct(x["ref"].alias("ref"), x["alt"].alias("alt"), longest(x["ref"], x["alt"], F.right).alias("tail")))
    return named(named(tailed, without), chopped)


def same_letters(a: Column, b: Column) -> Column:
    """Equality whatever the case."""
    return F.upper(a) == F.upper(b)


def prefix_match(a: Column, b: Column) -> Column:
    """Whether one of two texts begins with the other, whatever the case."""
    return F.startswith(F.upper(a), F.upper(b)) | F.startswith(F.upper(b), F.upper(a))


def comparison_order() -> list[Column]:
    """Total order of the merged sides: position, query before baseline, row."""
    return [F.col("pos"), F.when(F.col("side") == "query", 0).otherwise(1), F.col("row_id")]
