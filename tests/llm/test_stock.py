import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from donorframe.llm import stock
from donorframe.llm.queries import op11_packing

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def histogram(seed, n, middle=6.0):
    rng, out = random.Random(seed), defaultdict(int)
    for _ in range(n):
        out[int(rng.lognormvariate(middle, 0.9)) % 1024 + 1] += 1
    return dict(out)


@pytest.mark.parametrize(("hist", "capacity"), [({2: 7, 3: 5, 5: 4, 7: 2}, 10), ({6: 9, 4: 3, 3: 8}, 16), ({9: 4}, 16), ({1: 3, 8: 5, 12: 2}, 16)])
def test_program_against_all_patterns(hist, capacity):
    """Its cost is the least over all patterns: dual prices of the last basis let no pattern at all gain (weak duality)."""
    program = stock.Program(hist, capacity)
    gap, stock.GAP = stock.GAP, -1.0
    try:
        found = program.solve()
    finally:
        stock.GAP = gap
    used = defaultdict(float)
    for pattern, x in found.items():
        assert x > 0 and stock.size(pattern) <= capacity
        for k, a in pattern:
            used[k] += a * x
    assert all(abs(used[k] - n) < 1e-3 for k, n in hist.items())
    basis = np.stack([program.column(j) for j in program.basis], axis=1)
    duals = np.array([program.costs[j] for j in program.basis]) @ np.linalg.inv(basis)
    lengths = program.lengths.tolist()
    for many in itertools.product(*(range(capacity // k + 1) for k in lengths)):
        pattern = tuple((k, a) for k, a in zip(lengths, many) if a)
        if pattern and stock.size(pattern) <= capacity:
            assert sum(d * a for d, a in zip(duals, many)) <= stock.cost(pattern, capacity) + 1e-4
    assert abs(sum(stock.cost(p, capacity) * x for p, x in found.items()) - duals @ program.need) < 1e-2


@pytest.mark.parametrize(("n", "most"), [(300, 0.4), (5_000, 0.1), (300_000, 0.01)])
def test_plan_leaves_little_to_cut(n, most):
    hist = histogram(n, n)
    left = dict(hist)
    for pattern, times in stock.make_plan(hist):
        assert times > 0 and stock.padded(stock.size(pattern), 1024) == stock.size(pattern)
        for k, a in pattern:
            left[k] -= a * times
    assert min(left.values()) >= 0
    assert sum(k * v for k, v in left.items()) <= most * sum(k * v for k, v in hist.items())


def check_places(hist, capacity):
    places = stock.Places(hist, capacity)
    held = defaultdict(list)
    for k, n in hist.items():
        for rank in range(n):
            if rank < places.used[k]:
                seq, off = places.slots.place(k, np.array([rank]))
                held[int(seq[0])].append((int(off[0]), k))
            else:
                parts = places.parts(k, rank)
                assert parts[0][0] == 0 and sum(p[1] for p in parts) == k and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
                for _, length, seq, off in parts:
                    held[seq].append((off, length))
    padding = 0
    for rows in held.values():
        at = 0
        for off, length in sorted(rows):
            assert off == at and length > 0
            at += length
        assert at <= capacity
        padding += stock.padded(at, capacity) - at
    assert padding == 0
    return len(held)


@pytest.mark.parametrize("hist", [{600: 50}, {1024: 3}, {1: 5}, {512: 3, 300: 7, 212: 7}, histogram(1, 80), histogram(2, 700), {1023: 9}, {}])
def test_places_are_gapless_and_unpadded(hist):
    n = check_places(hist, 1024)
    volume = sum(k * v for k, v in hist.items())
    assert n <= -(-volume // 1024) + 10  # the last tokens fill at most ten powers of two


def test_random_capacities():
    rng = random.Random(9)
    for _ in range(60):
        capacity = rng.choice([8, 16, 31, 64])
        check_places({rng.randint(1, capacity): rng.randint(1, 12) for _ in range(rng.randint(1, 9))}, capacity)


@pytest.mark.parametrize("most", [0, stock.BROADCAST])
def test_ids_equal_the_library(spark, most):
    library = Tokenizer.from_file(BYTES)
    texts = [None, "", "a b", "a b", "word " * 3_000, "日本語 x <|endoftext|> y", *("river stone " * n for n in range(40, 90))]
    df = spark.createDataFrame([(None if i == 2 else i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    want = defaultdict(list)
    for i, t in enumerate(texts):
        want[None if i == 2 else i] = library.encode(t or "", add_special_tokens=False).ids + [0]
    rows = stock.pack(df, most=most).collect()
    by, held = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        held[r.sequence_id].append((r.offset, r.length))
    assert by.keys() == want.keys()
    for i, ids in want.items():
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in held.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and stock.padded(ends[-1], 1024) == ends[-1] <= 1024
    whole = stock.pack(df, with_ids=True).collect()
    assert len(whole) == len(rows) and all(list(r.ids) == want[r.doc_id][r.start : r.start + r.length] for r in whole)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in whole)
    assert stock.pack(df.where(F.lit(False))).count() == 0


def test_whole_table(spark):
    rows = op11_packing(spark, "/root/testdata/sf0.001").collect()
    held, docs = defaultdict(list), defaultdict(int)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id, r.doc_tokens] += r.length
    assert all(n == total for (_, total), n in docs.items()) and len(docs) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    tokens = sum(docs.values())
    assert len(held) <= tokens // 1024 + 10
    for parts in held.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert stock.padded(at, 1024) == at
