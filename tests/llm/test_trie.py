import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from donorframe.llm import queries as q
from donorframe.llm.trie import prefix_trie, shared, spine

from .oracle import compare

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The nodes by dictionaries of prefixes."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, cs in members.items():
        words = len(re.findall("[^ \t-\r]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * words
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if built[c] == p))).encode()).hexdigest()
    return sorted(((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p], ends(p)) for p, cs in members.items()), key=str)


def got(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def corpus(seed, convs, deep):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(convs * 2), convs):
        for t in range(rng.choice([1, 1, 2, 3, deep])):
            rows.append((c, t, rng.choice(["user", "user", "assistant"]), rng.choice(["hi", "hi there", "a b  c", "x\ty"]) if t < 4 else "so  it goes"))
    return rows


def test_sql(spark):
    assert compare(spark, q.op12_prefix_trie, q.OP12_SQL, "/root/testdata/sf0.001") > 10
    assert compare(spark, q.op12_prefix_trie, q.OP12_SQL, "/root/testdata/sf0.01") > 100


@pytest.mark.parametrize(("convs", "deep", "partitions"), [(60, 6, None), (60, 6, 1), (150, 9, 7), (400, 5, 31), (25, 40, 50)])
def test_equals_dictionaries(spark, convs, deep, partitions):
    rows = corpus(convs + deep, convs, deep)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).repartition(5)
    assert got(prefix_trie(df, partitions)) == plain(rows)


def test_copies_fill_many_partitions(spark):
    # one first turn and one whole conversation for a third of all, then chains of prefixes of each other
    rows = [(c, t, "user", f"w{t if c % 3 else 0}") for c in range(300) for t in range(1 + (c % 17 if c % 3 else 2))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(prefix_trie(df, 13)) == plain(rows)


def test_cases(spark):
    rows = [(None, 0, "user", "gone"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "user", ""), (40, 0, "user", "same same"), (40, 0, "user", "same same"), (41, 0, "user", "x"), (-7, 0, "user", "a b"), (-7, 1, "assistant", ""), (2, 0, "user", "w " * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    told = got(prefix_trie(df, 4))
    # ties of one turn go by digest, so the plain version takes them in that order
    tied = sorted((r for r in rows if r[0] == 1 and r[1] == 0), key=lambda r: hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    ordered = [r for r in rows if not (r[0] == 1 and r[1] == 0)] + [(1, i, *r[2:]) for i, r in enumerate(tied)]
    assert told == plain(ordered)
    assert prefix_trie(df.where(F.lit(False))).count() == 0
    assert [r[:4] for r in got(prefix_trie(df.where("conv_id = 41")))][0][1:] in ((0, None, 1), (1, 41, 1))


def test_long_conversation(spark):
    rows = [(c, t, "user", f"t{t}" if t < 5_000 or c else "fork") for c in (0, 20, 40) for t in range(6_000)]
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA), 3))[:50] == sorted(dict_free(rows), key=str)[:50]


def dict_free(rows):
    """What plain() finds for three conversations that part at turn 5,000, without prefixes of prefixes."""
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in (0, 20, 40)}
    empty = hashlib.sha256(b"").hexdigest()
    assert max(h.values()) < 5_000
    out = []
    for d in range(6_001):
        for ids in ([[0, 20, 40]] if d <= 5_000 else [[0], [20, 40]]):
            below = (5_000 - max(d, 1) + 1) * 2 + 1_000 if len(ids) == 3 else (6_000 - d + 1) * (len(ids) - 1)
            leaf = 2 if len(ids) == 3 else 1
            end = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if d == 6_000 else empty
            out.append((ids[0], d, None if d == 0 else 0 if d <= 5_001 else ids[0], len(ids), 2 if d == 5_000 else 0 if d == 6_000 else 1, leaf, below, end))
    return out


def test_parts():
    a, b = b"x" * 48, b"x" * 32 + b"y" * 16
    assert shared(a, b) == 2 and shared(a, a[:16]) == 1 and shared(b"", a) == 0 and shared(b"z" * 16, a) == 0
    assert len(spine(a)) == 4 and spine(a)[:3] == spine(b)[:3]
