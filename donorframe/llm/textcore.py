"""Vectorised words, hashes and shingles over Arrow string columns.

Texts are handled as one byte buffer with offsets. A word's hash is a difference of prefix sums of a polynomial in
2**64 arithmetic, so hashing costs a few passes over the bytes whatever the words are. Working memory is bounded: long
buffers are cut into segments at bytes that belong to no word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT = 2 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of near-dedup: everything but space and \x09-\x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Words of license scans: ASCII digits, lower-case letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 1)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            take = min(done, size - done)
            have[done : done + take] = have[:take] * np.uint64(pow(base, done, 1 << 64))
            done += take
        _POWERS[base] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, most: int = SEGMENT):
    """Row ranges [a, b) whose texts hold about `most` bytes, a single longer text on its own."""
    _, offsets = buffers(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


class Words:
    """Words of a run of texts: hash, text number, start and end byte of each, in order."""

    __slots__ = ("data", "offsets", "hash", "doc", "start", "end", "first", "lengths", "prefix")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True, prefixes: tuple[int, ...] = ()):
        """prefixes: lengths in bytes of word beginnings that are hashed too (a shorter word's is the word)."""
        self.data, self.offsets, self.lengths = data, offsets, prefixes
        n, at, parts = len(data), 0, []
        while at < n:
            to = min(n, at + SEGMENT)
            while to < n and not self._cut(to, is_word, lower):
                free = np.flatnonzero(~is_word[LOWER[data[at + 1 : to]] if lower else data[at + 1 : to]])
                to = at + 1 + int(free[-1]) if len(free) else min(n, to + SEGMENT)
            parts.append(self._segment(at, to, is_word, lower))
            at = to
        none = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * (1 + len(prefixes))
        start, end, h, *rest = (np.concatenate(x) for x in zip(*parts)) if parts else none
        self.start, self.end, self.hash, self.prefix = start, end, h, dict(zip(prefixes, rest))
        self.doc = np.searchsorted(offsets, start, "right") - 1
        #: number of the first word of each text, and of all words at the end
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))

    def _cut(self, to: int, is_word: np.ndarray, lower: bool) -> bool:
        c = self.data[to]
        return not is_word[LOWER[c] if lower else c]

    def _segment(self, a: int, b: int, is_word: np.ndarray, lower: bool):
        data = LOWER[self.data[a:b]] if lower else self.data[a:b]
        mask = is_word[data]
        edge = self.offsets[(self.offsets >= a) & (self.offsets < b)] - a
        start = mask.copy()
        start[1:] &= ~mask[:-1]
        start[edge] = mask[edge]
        end = mask.copy()
        end[:-1] &= ~mask[1:]
        inner = edge[edge > 0] - 1
        end[inner] = mask[inner]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(_byte_values()[data] * powers(b - a, BASE), out=sums[1:])
        back = powers(b - a, INVERSE)[s]
        return s + a, e + a, *(mix((sums[to] - sums[s]) * back) for to in (e, *(np.minimum(s + k, e) for k in self.lengths)))

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside one text, and the number of each run's first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        acc = self.hash[:n].copy()
        for j in range(1, k):
            acc *= STEP
            acc += self.hash[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return mix(acc[at] + np.uint64(k)), at

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word shingles and the text of each; a text of fewer words gives all its words as one."""
        g, at = self.grams(k)
        n = self.count()
        few = np.flatnonzero((n > 0) & (n < k))
        if not len(few):
            return g, self.doc[at]
        acc = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            more = np.flatnonzero(n[few] > j)
            acc[more] = acc[more] * STEP + self.hash[self.first[few[more]] + j]
        return np.concatenate([g, mix(acc + n[few].astype(np.uint64))]), np.concatenate([self.doc[at], few])

    def shingle_sets(self, k: int) -> list[np.ndarray]:
        """For each text the sorted distinct hashes of its k-word shingles; of all its words if it has fewer than k."""
        g, doc = self.shingles(k)
        order = np.argsort(doc, kind="stable") if len(doc) and (doc[1:] < doc[:-1]).any() else slice(None)
        g, doc = g[order], doc[order]
        cut = np.searchsorted(doc, np.arange(len(self.offsets)))
        out = []
        for a, b in zip(cut[:-1], cut[1:]):
            x = np.sort(g[a:b])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if b > a else x)
        return out


class HashFilter:
    """Which of many hashes belong to a bounded set: a bit table first, then the exact set."""

    BITS = 20

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values.astype(np.uint64))
        self.table = np.zeros(1 << self.BITS, dtype=bool)
        self.table[self.values >> np.uint64(64 - self.BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the hashes that belong to it, and each one's number in `values`."""
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - self.BITS)])
        if not len(at):
            return at, at
        k = np.searchsorted(self.values, hashes[at])
        ok = k < len(self.values)
        ok[ok] = self.values[k[ok]] == hashes[at[ok]]
        return at[ok], k[ok]


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set of hashes."""
    if not len(values):
        return 0, 0
    a = np.bitwise_xor.reduce(mix(values + np.uint64(0x51)))
    with np.errstate(over="ignore"):
        b = np.add.reduce(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return int(a.astype(np.int64)), int(np.uint64(b).astype(np.int64))


def list_array(parts: list[np.ndarray]) -> pa.Array:
    """list<int64> of uint64 arrays."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def text_key() -> list[Column]:
    """128 bits that stand for a row's text: columns t1 and t2."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]
