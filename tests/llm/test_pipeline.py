import re
from collections import defaultdict

import duckdb

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = docs
    ids = []
    for name, stage in cp.STAGES[:-1]:
        before = left
        left = stage(spark, left, SF).cache()
        assert left.columns == docs.columns and left.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        ids.append({r.doc_id for r in left.collect()})
        assert ids[-1] <= {r.doc_id for r in before.collect()}, name
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = {d for d, r in labels.items() if r.quality == 1 and r.toxic == 0}
    assert len(clean - ids[0]) <= 0.02 * len(clean) and len([d for d in labels if labels[d].quality == 0 and d in ids[0]]) <= 2
    # near-dedup against all pairs
    sets = {d: shingles(texts[d]) for d in ids[0]}
    order, up = sorted(sets), {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(order):
        for b in order[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    assert ids[1] == {d for d in sets if find(d) == d}
    items = [x[0] for x in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())] for i in range(len(w) - 4)}
    dirty = {d for d in ids[1] if any(len(grams(s) & grams(texts[d])) >= 0.8 * len(grams(s)) for s in items)}
    assert ids[2] == ids[1] - dirty
    final = {r.doc_id: r for r in left.collect()}
    assert set(final) == ids[2] and not any("@mail" in r.text for r in final.values()) and all(r.n_chars == len(r.text) for r in final.values())
    rows = cp.STAGES[-1][1](spark, left, SF).collect()
    assert {r.doc_id for r in rows} == set(final)
    ends = defaultdict(int)
    for r in rows:
        ends[r.sequence_id] = max(ends[r.sequence_id], r.offset + r.length)
    assert sum(ends.values()) == sum(r.length for r in rows) and max(ends.values()) <= 1024
    assert sorted(map(tuple, cp.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
