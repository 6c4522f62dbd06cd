"""Cross-tokenizer alignment: where two tokenizations of one text have common token ends.

Method: the byte ends of both token sequences are summed up into dictionaries from end to index; the sorted intersection of
their keys slices both id lists into groups, and each slice gives its links (all pairs of tokens that end where it ends).
Both vocabularies cut a text at single spaces between other characters (encoders.py), so every such space is a common end:
what stands between two of them is aligned once and kept in a bounded cache, and a document's groups are those of its parts.

Counts of id pairs over all documents: every document gives its distinct pairs with their numbers, which are summed in
Spark; then every document's pairs are joined with the sums. The sums are broadcast only where they are counted and few
(`most` rows); beyond that they are shuffled like any table.

Defined cases: null and empty texts, and texts that the tokens do not spell byte by byte (such as any with U+2581), have
zeros and an empty groups_sha256; texts are encoded whole, however long, and hashed piece by piece; repeated rows count as
often as they occur; a null id stays null; equal counts of a B id are best together; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoders import ByteEncoder, split_parts
from .workspace import Workspace, prepare

#: Parts whose alignment a worker keeps (about 400 bytes each) and their characters, before it begins anew.
CACHE, CHARACTERS = 300_000, 6_000_000
#: Parts that are aligned, joined and hashed at a time.
SLICE = 20_000
#: Most rows of pair counts that are broadcast (about 50 bytes each).
BROADCAST = 500_000
#: A pair of ids is one number, a * WIDTH + b.
WIDTH = 1 << 31

Part = tuple[int, int, int, str, tuple[int, ...]]


def byte_alphabet() -> dict[str, int]:
    """Characters of the byte-level vocabulary and the bytes they stand for: printable Latin-1 stands for itself, all other
    bytes, in order, for the characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Aligns the byte-level vocabulary (A, of a space and the text) with the sentence model (B, of the text)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = ByteEncoder(a_path)
        self.a.library.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        listed = {i: bytes(map(alphabet.__getitem__, t)) for t, i in self.a.library.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [listed[i] for i in range(len(listed))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        if not all(self.a_bytes) or not all(self.b_bytes):
            raise ValueError("a token without bytes ends where another ends")
        self.cache: dict[str, Part | None] = {}
        self.held = 0

    def align(self, parts: list[str]) -> list[Part] | None:
        """For each part of a text (which a space follows, but for the last): numbers of A and B tokens and of groups, the
        groups as text, and the links. None where the tokens do not spell the text."""
        text = " ".join(parts)
        whole = f" {text}".encode()
        ids = np.frombuffer(self.a.encode(f" {text}"), "<u4").tolist(), self.b.encode(text)
        ends = []
        for tokens, names in zip(ids, (self.a_bytes, self.b_bytes)):
            spelled = [names[i] for i in tokens]
            if b"".join(spelled) != whole:
                return None
            ends.append(dict(zip(accumulate(map(len, spelled)), range(1, len(tokens) + 1))))
        a, b = (list(map(str, x)) for x in ids)
        part_ends = accumulate(1 + len(p.encode()) for p in parts)
        told, groups, links, i, k, i_from, k_from = [], [], [], 0, 0, 0, 0
        part_end = next(part_ends)
        for end in sorted(ends[0].keys() & ends[1].keys()):
            i_to, k_to = ends[0][end], ends[1][end]
            groups.append(f"{','.join(a[i:i_to])}|{','.join(b[k:k_to])}")
            links.append(ids[0][i_to - 1] * WIDTH + ids[1][k_to - 1])
            i, k = i_to, k_to
            if end == part_end:
                told.append((i - i_from, k - k_from, len(groups), ";".join(groups), tuple(links)))
                groups, links, i_from, k_from, part_end = [], [], i, k, next(part_ends, None)
        return told

    def learn(self, parts: list[str]) -> None:
        """Take parts up into the cache: all that are new as one text."""
        new = [p for p in dict.fromkeys(parts) if p not in self.cache]
        self.held += sum(map(len, new))
        # parts that begin or end with white space are aligned alone, so that each space between parts is a common end
        apart = [p for p in new if p[:1].isspace() or p[-1:].isspace() or "▁" in (p[:1], p[-1:])]
        together = [p for p in new if p not in set(apart)] if apart else new
        for some in ([together] if together else []) + [[p] for p in apart]:
            told = self.align(some)
            if told is None and len(some) > 1:
                told = [x[0] if (x := self.align([p])) else None for p in some]
            self.cache.update(zip(some, told or [None]))

    def document(self, text: str) -> tuple[int, int, int, str, Counter]:
        """n_a, n_b, n_groups, groups_sha256 and links of a text."""
        none = 0, 0, 0, "", Counter()
        parts = split_parts(text) if text else []
        n, digest, links = [0, 0, 0], hashlib.sha256(), Counter()
        for at in range(0, len(parts), SLICE):
            some = parts[at : at + SLICE]
            if len(self.cache) > CACHE or self.held > CHARACTERS:
                self.cache.clear()
                self.held = 0
            self.learn(some)
            told = list(map(self.cache.__getitem__, some))
            if None in told:
                return none
            *counts, groups, linked = zip(*told)
            n = [x + sum(y) for x, y in zip(n, counts)]
            digest.update(((";" if at else "") + ";".join(groups)).encode())
            links.update(chain.from_iterable(linked))
        return (*n, digest.hexdigest(), links) if parts else none


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def encode(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: row (a number of its own), doc_id, n_a, n_b, n_groups, groups_sha256, pairs (each distinct pair
    of linked ids with its number)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            told = [both.document(t or "") for t in batch.column(1).to_pylist()]
            n_a, n_b, n_groups, digests, links = zip(*told) if told else ((),) * 5
            sizes = np.cumsum([0, *map(len, links)])
            pair, times = (np.fromiter(chain.from_iterable(x), np.int64, sizes[-1]) for x in (links, (c.values() for c in links)))
            pairs = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(pair), pa.array(times)], ["pair", "times"]))
            rows = pa.array(np.arange(row, row + len(told)))
            row += len(told)
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(digests, pa.string()), pairs], ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"])

    schema = f"row long, doc_id {id_type}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<struct<pair: long, times: long>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(told: DataFrame) -> DataFrame:
    """pair, n: how many links of all documents hold a pair of ids."""
    return told.select(F.inline("pairs")).groupBy("pair").agg(F.sum("times").alias("n"))


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, most: int = BROADCAST) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import public_tokenizers

    spark = docs.sparkSession
    prepare(spark)
    work = Workspace(spark, "alignment")
    told = work.keep(encode(docs, a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")), "documents")
    counts = work.keep(pair_counts(told), "counts")
    b = (F.col("pair") % WIDTH).alias("b")
    top = counts.groupBy(b).agg(F.max("n").alias("top"))
    known = counts.withColumn("b", b).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    if counts.count() <= most:
        known = F.broadcast(known)
    each = told.select("row", F.inline("pairs")).join(known, "pair")
    sums = each.groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = told.drop("pairs").join(sums, "row", "left").na.fill(0, ["n_links", "n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
