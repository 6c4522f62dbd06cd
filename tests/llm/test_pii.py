import hashlib
import itertools
import random
import re

import numpy as np

from pyspark.sql import functions as F

from donorframe.llm.arrays import blocks, cut, let, scan
from donorframe.llm.pii import FEATURES, _value, find, model, redact, training_rows

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2)) for i, c in enumerate(reversed(d))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 10 <= len(d) <= 15


def plain(text):
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if ok(k, m[0]))


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in find(df).collect()}
    for i, t in enumerate(texts):
        want, r = plain(t), rows[i]
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (t, said, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[3] == k for w in want) for k in PLAIN]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    return rows


def test_base_equals_brute_force(spark):
    rng = random.Random(2)
    bits = ["a", "é", "😀", "@", ".", "-", " ", "+", "1", "23", "255", "256", "4111 1111 1111 1111", "4111111111111111", "x@y.org", "_b@c.de", "10.0.0.1", "+1 (017) 555-7713", "(", ")", "\n", "%", "00", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    texts += [None, "", "a" * 50_000, "1" * 30_000, "1 " * 20_000, "a.b." * 20_000 + "@x.y", "x@" + "a." * 20_000 + "b", "+1" + "(" * 50_000, "1." * 30_000, "a@b.c," * 2_000, "000000000001.2.3.4"]
    check(spark, texts)


def test_added_spans_and_redaction(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'so token = "{key}" and on', f"a commit {key} is fine", "plain words 12 only", "mail 34@mail7.example.com, card 4111111111111111", None, ""]
    rows = check(spark, texts)
    assert rows[0].spans == "secret:12:52" and rows[1].spans == "" and rows[2].spans == ""
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, "x@y.org 1.2.3.4", 9)], "doc_id long, text string, found int")
    got = {r.doc_id: r.text for r in redact(df).collect()}
    assert got == {0: 'so token = "[SECRET]" and on', 1: texts[1], 2: texts[2], 3: "mail [EMAIL], card [CARD]", 4: None, 5: "", None: "[EMAIL] [IP]"}
    assert redact(df).columns == df.columns and find(df.limit(0)).count() == 0


def test_one_text_of_very_many_matches(spark):
    rng = random.Random(4)
    text = "".join(rng.choice(["a@b.cd,", "1.2.3.4;", "é😀 ", "+1 (017) 555-7713 "]) for _ in range(120_000))
    check(spark, [text, "x@y.org"])
    df = spark.createDataFrame([(1, text), (2, "a 1.2.3.4@b.org c")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in redact(df).collect()}
    at, out = 0, []
    for start, _, end, kind in plain(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    assert got[1] == "".join(out) + text[at:] and got[2] == "a [EMAIL] c"


def test_arrays(spark):
    rng = random.Random(6)
    rows = [(i, [rng.randint(0, 9) for _ in range(n)], "".join(rng.choice("aé😀\n") for _ in range(n * 40))) for i, n in enumerate([0, 1, 2, 3, 7, 64, 65, 100])]
    df = spark.createDataFrame(rows, "i int, xs array<int>, text string")
    got = {r.i: r for r in df.select("i", scan(F.col("xs")).alias("sums"), scan(F.col("xs"), lambda a, b: F.greatest(a, b)).alias("tops"), let(blocks(F.col("text")), lambda c: F.transform(F.sequence(F.lit(0), F.length("text"), F.lit(97)), lambda k: cut(c, k, F.least(k + 600, F.length("text"))))).alias("cuts")).collect()}
    for i, xs, text in rows:
        assert got[i].sums == list(itertools.accumulate(xs)) and got[i].tops == list(itertools.accumulate(xs, max))
        assert got[i].cuts == [text[k : k + 600] for k in range(0, len(text) + 1, 97)]


def test_model_held_out():
    x, y = training_rows()
    trees, least = model()
    score = sum(rate * _value(t, x) for rate, t in trees)
    held = np.arange(len(x)) % 4 == 0
    picked = score[held] >= least
    assert y[held][picked].mean() >= 0.99 and picked[y[held] == 1].mean() >= 0.95 and x.shape[1] == len(FEATURES)
