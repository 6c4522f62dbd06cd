import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from donorframe.llm import repeats
from donorframe.llm.repeats import remove_repeats, text_anchors


def brute(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + n] for r in raw for i in range(len(r) - n + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choice("abcdefgé \n") for _ in range(k))
    passages = [make(rng.choice([n - 5, n, n + 1, 2 * n, 5 * n])) for _ in range(12)]
    texts = [None, "", "short", "a" * (6 * n), "ab" * (3 * n), "xyz" * n]
    for _ in range(120):
        t = make(rng.choice([5, n, 4 * n]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p) + 1), 2)) if rng.random() < 0.4 else (0, len(p))
            t = t[: len(t) // 2] + p[a:b] + t[len(t) // 2 :]
        texts.append(t)
    family = make(12 * n)
    for _ in range(25):
        f = list(family)
        for _ in range(rng.randint(0, 14)):
            f[rng.randrange(len(f))] = rng.choice("QRST")
        texts.append("".join(f))
    return texts + [texts[20], texts[20]]


@pytest.mark.parametrize("n,gram,batches,large", [(400, 160, 4, 20_000), (60, 24, 5, 3), (50, 50, 1, 2)])
def test_equals_brute_force(spark, monkeypatch, n, gram, batches, large):
    monkeypatch.setattr(repeats, "LARGE", large)
    texts = corpus(n, n)
    ids = [*range(len(texts) - 1), len(texts) - 2]
    rows = [(i if i != 9 else None, t, 0) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int").repartition(3)
    got = remove_repeats(df, n, gram, batches).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    want = sorted(((r[0], *b) for r, b in zip(rows, brute(texts, n))), key=key)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == want
    if n == 60:
        again = {r.doc_id: r for r in remove_repeats(df, n, gram, batches, with_text=True).collect()}
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.removed) == r.n_removed for r in again.values())
        assert remove_repeats(df.limit(0), n, gram, batches).count() == 0


def test_pieces_of_a_long_text_give_the_same_anchors(monkeypatch):
    data = np.frombuffer(("".join(random.Random(4).choice("abcd ") for _ in range(30_000)) + "z" * 3_000).encode(), np.uint8)
    whole = text_anchors(data, np.array([0, len(data)]), 100, 40)
    monkeypatch.setattr(repeats, "PIECE", 1_000)
    pieces = text_anchors(data, np.array([0, len(data)]), 100, 40)
    assert all((a == b).all() for a, b in zip(whole, pieces))
