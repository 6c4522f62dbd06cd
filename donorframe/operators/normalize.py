"""Left normalisation of variants over a genome of any size.

A variant is shifted to the left as far as its bases repeat. How far is not known before, so it asks for some bases to its
left; only where the shift uses them all up does it ask for more, twice as many each time. Every round is one join of the
variants that are still moving with the genome's chunks, and few move far. What neither shares its last base nor can be
trimmed asks for none.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alignment import left_normalize
from ..kept import keep
from ..model import unused
from ..sources.readers import CHUNK, genome_windows

#: Bases to the left that a variant asks for at first.
REACH = 64


def normalize_variants(variants: DataFrame, genome: DataFrame, reach: int = REACH, chunk: int = CHUNK) -> DataFrame:
    """The rows with pos, ref and alts shifted to the left and trimmed, all alts of a row together (so a row with two alts
    moves only as far as both can).

    Rows without alts, with an empty allele or one that is equal to ref, without a chromosome, or whose ref is not what the
    genome has there stay as they are."""
    seq, start, moving, asking = (unused(variants, c) for c in ("window", "start", "moving", "asking"))
    columns = variants.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in variants.schema) + f", `{moving}` boolean"

    def run(batches):
        for frame in batches:
            told = []
            for pos, ref, alts, window, low in zip(frame["pos"], frame["ref"], frame["alts"], frame[seq], frame[start]):
                alts = [] if alts is None else list(alts)
                alleles = [ref, *alts]
                # the window goes one base beyond the ref
                if not alts or not all(alleles) or ref in alts or window[pos - low :][: len(ref)] != ref:
                    told.append((pos, ref, alts, False))
                    continue
                at, new_ref, new_alts = left_normalize(window, pos, ref, alts, low)
                told.append((pos, ref, alts, True) if at <= low and low > 0 else (at, new_ref, new_alts, False))
            for i, c in enumerate(("pos", "ref", "alts", moving)):
                frame[c] = [t[i] for t in told]
            yield frame[[*columns, moving]]

    alleles = F.concat(F.array("ref"), "alts")
    one = lambda end: F.size(F.array_distinct(F.transform(alleles, lambda x: end(x, F.lit(1))))) == 1
    # alleles move where all end with one base, and lose their first ones where all begin with one and none is left empty
    changes = one(F.right) | (F.array_min(F.transform(alleles, F.length)) > 1) & one(F.left)
    asks = F.col("chrom").isNotNull() & F.col("pos").isNotNull() & (F.col("pos") >= 0) & F.col("ref").isNotNull() & (F.size("alts") > 0) & changes
    # told once and written: as a filter it would work out the alleles' columns anew wherever it names them
    rows = keep(variants.withColumn(asking, F.coalesce(asks, F.lit(False))), "asking")
    out, todo = rows.where(~F.col(asking)).drop(asking), rows.where(asking).drop(asking)
    while not todo.isEmpty():
        wide = todo.select(F.struct(*columns).alias("row"), "chrom", F.greatest(F.col("pos") - reach, F.lit(0)).alias("start"), (F.col("pos") + F.length("ref") + 1).alias("end"))
        told = genome_windows(genome, wide, chunk).select("row.*", F.col("start").alias(start), F.col("seq").alias(seq))
        found = keep(told.mapInPandas(run, schema), "normalized")
        out = out.unionByName(found.where(f"NOT `{moving}`").drop(moving))
        todo = found.where(f"`{moving}`").drop(moving)
        reach *= 2
    return out
