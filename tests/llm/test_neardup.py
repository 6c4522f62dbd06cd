import random
import re

import pytest

from donorframe.llm import neardup
from donorframe.llm.components import components
from donorframe.llm.neardup import deduplicate, near_duplicates
from donorframe.llm.workspace import Workspace


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def corpus(seed, n=90):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "x y"]
    hot = " ".join(rng.choice(vocabulary) for _ in range(25))
    texts = []
    for _ in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 20, 60, 150, 400]))]
        texts.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1, 4, 12])):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            texts.append(" \n".join(v) if rng.random() < 0.3 else " ".join(v).upper().replace("É", "É"))
        if rng.random() < 0.3:
            texts.append(hot + " " + " ".join(rng.choice(vocabulary) for _ in range(20)))
    family = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(60):
        v = list(family)
        for _ in range(rng.randint(0, 8)):
            v[rng.randrange(len(v))] = rng.choice(vocabulary)
        texts.append(" ".join(v))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts)) + [(5000, None), (5001, ""), (5002, " \t"), (5003, "One"), (5004, "one"), (None, texts[3]), (7, texts[9]), (7, texts[9])]


@pytest.mark.parametrize("k,long_list,block", [(4, 128, 96), (5, 8, 7)])
def test_equals_brute_force(spark, monkeypatch, k, long_list, block):
    monkeypatch.setattr(neardup, "LONG", long_list)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus(k)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int").repartition(3)
    got = near_duplicates(df, shingle=k).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows, k), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_deduplicate_and_empty(spark):
    rows = corpus(9, 20)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
    want = {c for d, _, c in brute(rows, 5) if d is not None}
    out = deduplicate(df).collect()
    assert {r.doc_id for r in out if r.doc_id is not None} == want and out[0].asDict().keys() == {"doc_id", "text", "n"}
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(3000 - i, 3001 - i) for i in range(50)] + [(9, 9), (7000, 7000)]
    rng.shuffle(edges)
    got = dict(components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1100)) and got[3001] == 2951 and got[7000] == 7000


def test_ten_thousand_null_ids_and_a_passage_in_every_text(spark):
    rng = random.Random(12)
    common = "a passage of seven words stands everywhere"
    texts = []
    for i in range(5000):
        w = [f"u{rng.randrange(10**7)}" for _ in range(40)]
        texts.append(f"{common} {' '.join(w)}")
        w[-1] = "changed"
        texts.append(f"{common} {' '.join(w)}")
    texts += [f"{common} {' '.join(texts[2 * i].split()[7:12])}" for i in range(300)]  # little besides the passage
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    got = near_duplicates(df, keep_keys=True).groupBy("group_key").count().groupBy("count").count().collect()
    assert {r[0]: r[1] for r in got} == {2: 5000, 1: 300}


def test_one_long_text_and_a_large_family(spark):
    rng = random.Random(13)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(60_000))
    base = [f"b{i}" for i in range(200)]
    rows = [(1, long), (2, long + " end")] + [(10 + i, " ".join(base[: 199 - i % 4] + [f"x{i}"])) for i in range(700)] + [(5000, " ".join(base[::-1]))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1} | {10 + i: 10 for i in range(700)} | {5000: 5000}
