import numpy as np

from donorframe.llm.vectors import LADDER, Graph, audit, beams, common_beam, links_of

AUDITS = "label int, dim int, beam int, truth long, found long"


def test_lone_links_are_found_where_the_graph_misses_them(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(2000, 48))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = Graph(v)
    # two nodes that no link leads to; of all queries only theirs have a partner
    lost = [701, 1302]
    for links in graph.links:
        links[np.isin(links, lost)] = -1
    q = rng.normal(size=(1000, 48))
    q[[101, 502]] = v[lost] + rng.normal(size=(2, 48)) * 0.004
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    none = np.full(len(q), -1)
    truth, found = audit(graph, v, q, none, 0.98)
    assert truth == 2 and found == [0] * len(LADDER)
    table = spark.createDataFrame([(1, 48, b, truth, f) for b, f in zip(LADDER, found)], AUDITS)
    assert common_beam(table) == 0
    (row,) = beams(table, 0).collect()
    found = links_of(graph, v, q, none, 0.98, row.beam)
    assert {i: f.tolist() for i, f in enumerate(found) if len(f)} == {101: [701], 502: [1302]}


def test_beams_widen_per_label_until_the_audit_passes(spark):
    a, b, c = LADDER
    truth = {1: 20_000, 2: 4, 3: 0, 4: 6}
    found = {1: (20_000, 20_000, 20_000), 2: (2, 2, 4), 3: (0, 0, 0), 4: (4, 4, 4)}
    # the links of one label are pooled over its blocks: here two of half each
    rows = [(label, 8, beam, truth[label] // 2, n // 2) for label, x in found.items() for beam, n in zip(LADDER, x)] * 2
    table = spark.createDataFrame(rows, AUDITS)
    assert common_beam(table) == a and common_beam(table.limit(0)) == a
    got = {r.label: (r.beam, r.recall) for r in beams(table, a).collect()}
    assert got == {1: (a, 1.0), 2: (c, 1.0), 3: (a, None), 4: (0, 1.0)}
    assert {r.label: r.beam for r in beams(table, b).collect()}[1] == b
