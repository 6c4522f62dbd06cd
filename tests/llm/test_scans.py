import random
import re

from donorframe.llm.decontamination import decontaminate, find_items, sketches, sure_hits
from donorframe.llm.licenses import BASE, merge, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_items_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "straße", "Of"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.choice([3, 6, 20, 40, 200]))) for i in range(30)] + [(100, None), (101, ""), (102, "one two"), (0, "one two")]
    docs = []
    for i in range(120):
        t = make(rng.randint(0, 300))
        if i % 2:
            piece = rng.choice(items)[1] or ""
            w = piece.split(" ")
            for _ in range(rng.choice([0, 0, 1, 3])):
                w[rng.randrange(len(w))] = "changed"
            t = t[: len(t) // 2] + " " + ", ".join(w) + ". " + t[len(t) // 2 :]
        docs.append((i, t))
    docs += [(500, None), (501, ""), (502, "One, TWO!"), (None, items[3][1]), (1, docs[1][1])]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((x or -1, y, len(shingles(s)), len(shingles(s) & shingles(t))) for x, t in docs for y, s in items if shingles(s) and len(shingles(s) & shingles(t)) >= 0.8 * len(shingles(s)))
    got = sorted((r.doc_id or -1, r.item_id, r.n_item_shingles, r.n_shared) for r in find_items(d, b).collect())
    assert got == want and len(want) > 20
    assert sorted((r.doc_id or -1, r.item_id, r.n_item_shingles, r.n_shared) for r in find_items(d.repartition(7), b.repartition(5)).collect()) == want
    dirty = {x for x, *_ in want if x != -1}
    assert sorted(r.doc_id or -1 for r in decontaminate(d, b).collect()) == sorted(x or -1 for x, _ in docs if x not in dirty)
    assert find_items(d, b.limit(0)).count() == 0 and find_items(d.limit(0), b).count() == 0


def test_items_with_a_common_phrase_and_long_documents(spark):
    rng = random.Random(4)
    phrase = "which of the following statements about this question is surely true and which of them is not"
    items = [(i, f"{phrase} " + " ".join(f"t{rng.randrange(10**6)}" for _ in range(rng.choice([1, 12, 60, 500])))) for i in range(150)]
    filler = " ".join(f"f{i % 977}" for i in range(30_000))
    docs = [(i, f"{filler} {items[i][1]} {filler}") for i in range(3)] + [(10 + i, f"{phrase} {i} nothing else") for i in range(300)]
    docs += [(1000, " ".join(t for _, t in items))] + [(2000 + i, items[i][1][: len(items[i][1]) * 3 // 4]) for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    sets = [(y, shingles(s)) for y, s in items]
    want = sorted((x, y, len(s), len(s & has)) for x, t in docs for has in [shingles(t)] for y, s in sets if len(s & has) >= 0.8 * len(s))
    assert sorted(map(tuple, find_items(d, b).drop("containment").collect())) == want and len(want) > 150


def test_a_sketch_is_smaller_than_its_set_and_misses_nothing(spark):
    rng = random.Random(6)
    sets = spark.createDataFrame([(n, sorted({rng.randrange(-(2**62), 2**62) for _ in range(n)})) for n in range(1, 400)], "item_key long, values array<bigint>").selectExpr("item_key", "item_key AS item_id", "item_key AS n", "values")
    for r in sketches(sets, 0.8).groupBy("item_key", "need").count().collect():
        n, lacking = r.item_key, r.item_key - -(-8 * r.item_key // 10)
        assert r["count"] <= min(64, n if n < 10 else 0.7 * n) and lacking < n
        assert 1 <= r.need <= max(r["count"] - lacking, sure_hits(64, 0.8))


def test_licenses_equal_brute_force(spark):
    rng = random.Random(5)
    bits = ["Released under the MIT License.", "Apache License, Version 2.0", "CC BY-NC", "cc by nc cc by nc", "under the", "mit", "license", "version 3", "words", "é", "\n", "This work is licensed under the GNU General Public License, version 3."]
    docs = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(150)] + [(900, None), (901, ""), (None, "cc by nc"), (3, "cc-by-nc")]
    got = scan_licenses(spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, key int")).collect()

    def plain(t):
        w = words(t)
        found = [(p, label) for phrase, label in BASE for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        at = [p for p, _ in found]
        return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))

    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(((i, *plain(t)) for i, t in docs), key=key)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in scan_licenses(spark.createDataFrame([(1, "x This work is licensed under the GNU General Public License, version 3. y"), (2, "plain text without any")], "doc_id long, text string")).collect()}
    assert "gpl-3" in by[1].labels and by[1].base_labels == "" and by[2].labels == "" and by[2].score == 0


def test_a_position_of_a_template_counts_once(spark):
    # two neighbouring diagonals vote for the same three of ten positions
    votes = spark.createDataFrame([(1, 4, "x", False, 10, d, 3, 0b111, 5, 9) for d in (5, 6, 7)] + [(2, 4, "x", False, 10, d, 3, m, 5, 9) for d, m in ((5, 0b111), (7, 0b111000))], "key long, template int, label string, base boolean, n_grams int, diagonal long, votes long, held long, low long, high long")
    assert {r.key: r.score for r in merge(votes).collect()} == {1: 0.3, 2: 0.6}
    text = " ".join(["redistribution and use"] * 40)
    rows = scan_licenses(spark.createDataFrame([(1, text), (2, "word " * 60_000 + "CC by-NC"), (3, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.labels) for r in rows} == {1: (120, ""), 2: (60_003, "cc-by-nc"), 3: (0, "")}
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
