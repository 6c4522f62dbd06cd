"""The data model: schemas, modes and scoring."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import types as T

VARIANT = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("side", T.StringType()),
        T.StructField("query_id", T.IntegerType()),
        T.StructField("chrom", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("ref", T.StringType()),
        T.StructField("alts", T.ArrayType(T.StringType())),
        T.StructField("het", T.BooleanType()),
        T.StructField("multi", T.BooleanType()),
        T.StructField("zero_one", T.BooleanType()),
        T.StructField("mil", T.IntegerType()),
        T.StructField("mdl", T.IntegerType()),
        T.StructField("qual", T.DoubleType()),
    ]
)
COLUMNS = VARIANT.fieldNames()

# Fixed values of the comparison.
CHROMOSOMES = [f"{p}{c}" for p in ("", "chr") for c in [*range(1, 23), "X", "Y"]]
MAX_INDEL = 100
MAX_REPEAT = 1000
EASY_SIZE = 5
SINGLE_LIMIT = 4
SEARCH_BUDGET = 30_000
LOW_QUALITY = 0.1
PERCENTAGES = [0.0, 0.1, 0.2, 0.3, 0.9]
BASELINE, QUERY = "baseline", "query"


@dataclass(frozen=True)
class Scoring:
    """How a match is scored: unit 0 counts rows and 1 edit distance; mode 0 compares both strands and 1 one strand;
    scheme 0 counts both sides, 1 the baseline and 2 the query."""

    unit: int = 0
    mode: int = 0
    scheme: int = 0

    @property
    def index(self) -> int:
        return self.unit << 3 | self.mode << 2 | self.scheme

    @property
    def label(self) -> str:
        return "UE"[self.unit] + "GV"[self.mode] + "TBQ"[self.scheme]

    @classmethod
    def decode(cls, index: int) -> "Scoring":
        return cls(index >> 3 & 1, index >> 2 & 1, index & 3)


def scorings(unit: int = -1, mode: int = -1, scheme: int = -1) -> list[Scoring]:
    """All combinations; -1 stands for every value."""
    wide = lambda v, n: range(n) if v < 0 else [v]
    return [Scoring(*x) for x in product(wide(unit, 2), wide(mode, 2), wide(scheme, 3))]


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it new in df."""
    while name in df.columns:
        name = f"_{name}"
    return name
