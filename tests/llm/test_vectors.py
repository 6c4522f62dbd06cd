import numpy as np
import pytest

from donorframe.llm.vectors import LADDER, Graph, links_of, near_vectors


def brute(rows, cosine=0.98):
    good = []
    for i, (_, e, label) in enumerate(rows):
        if e and label is not None and None not in e:
            x = np.array(e, dtype=np.float32).astype(float)
            if np.isfinite(x).all() and x.any():
                good.append((i, x / np.linalg.norm(x), label))
    up, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x, p) in enumerate(good):
        for j, y, q in good[:a]:
            if p == q and len(x) == len(y) and x @ y >= cosine:
                n[i] += 1
                n[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i, (v, *_) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(v, least.get(find(i), v))
    return [(v, n[i], least.get(find(i))) for i, (v, *_) in enumerate(rows)]


def vectors(seed, n, d=24):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        x = rng.normal(size=d)
        out.append(x)
        if rng.random() < 0.2:
            out += [x + rng.normal(size=d) * rng.choice([0.05, 0.15, 0.2]) for _ in range(rng.integers(1, 30))]
    return np.array(out[:n], dtype=np.float32)


@pytest.mark.parametrize("shard,queries", [(8192, 2048), (60, 40)])
def test_equals_brute_force(spark, shard, queries):
    v = vectors(1, 420)
    rows = [(1000 - i, x.tolist(), int(i // 7 % 2)) for i, x in enumerate(v)]
    rows += [(5, rows[3][1], rows[3][2]), (2000, None, 1), (2001, [], 1), (2002, [0.0] * 24, 1), (2003, [float("nan")] * 24, 0), (2004, [None, 1.0] * 12, 0), (2005, rows[0][1], None), (2006, rows[0][1][:5], 0), (None, rows[9][1], rows[9][2]), (6, rows[3][1], rows[3][2]), (6, rows[3][1], rows[3][2]), (2007, [x * 1e18 for x in rows[2][1]], rows[2][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, key int").repartition(3)
    got = near_vectors(df, shard=shard, queries=queries).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert near_vectors(df.limit(0)).count() == 0


def test_graph_recall():
    v = vectors(2, 3000, 48)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = Graph.load(Graph(v).save())
    q = v + np.random.default_rng(3).normal(size=v.shape).astype(np.float32) * 0.004
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    q, v = q.astype(float), v.astype(float)
    found = links_of(graph, v, q, np.full(len(q), -1), 0.98, LADDER[0])
    truth = [set(np.flatnonzero(row >= 0.98).tolist()) for row in q @ v.T]
    hit = sum(len(t & set(f.tolist())) for t, f in zip(truth, found))
    assert all(set(f.tolist()) <= t for t, f in zip(truth, found)) and hit >= 0.99 * sum(map(len, truth))
    top, _ = graph.search(q.astype(np.float32), 64)
    assert (top[:, 0] == (q @ v.T).argmax(1)).mean() > 0.9


def test_large_shards_are_answered_by_the_graph(spark):
    v = vectors(5, 2600)
    rows = [(i, x.tolist(), int(i < 1500)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = near_vectors(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows))
    assert {r.beam for r in got} == {LADDER[0]} and all(r.recall >= 0.999 for r in got)


def test_answers_come_from_the_graph():
    v = vectors(6, 1500)
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(float)
    graph, none = Graph(v), np.full(len(v), -1)
    assert sum(map(len, links_of(graph, v, v, none, 0.98, LADDER[0]))) == (v @ v.T >= 0.98).sum()
    graph.search = lambda q, beam, own: (np.full((len(q), 1), -1), np.full((len(q), 1), -np.inf))
    assert not any(map(len, links_of(graph, v, v, none, 0.98, LADDER[0])))


def test_hot_group_is_followed_beyond_the_beam():
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=32) + rng.normal(size=(1200, 32)) * 0.05, rng.normal(size=(800, 32))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    found = links_of(Graph(v), v, v[:200], np.arange(200), 0.98, LADDER[0])
    assert sum(map(len, found)) == (v[:200] @ v.T >= 0.98).sum() > 100_000
