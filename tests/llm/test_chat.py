import hashlib
import random

from donorframe.llm import queries as q
from donorframe.llm.chat import digest, examples, read_back, render

from .oracle import compare

SAID = "</s>[INST] ok [/INST]"


def test_sql(spark):
    assert compare(spark, q.op4_chat_formatting, q.OP4_SQL, "/root/testdata/sf0.001") > 10


def test_round_trip_and_expansion(spark):
    rng = random.Random(1)
    bits = ["\\", "<", "[", "\\l", "\\e", "</s>", "<s>[ROLE]", "[/ROLE]", "é😀", "x", "\n", ""]
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "[x"]), "".join(rng.choice(bits) for _ in range(8))))
    rows += [(50, 0, None, None), (50, None, "assistant", None), (51, 1, "assistant", "b"), (51, 1, "assistant", "b"), (51, 1, "assistant", "a"), (None, 0, "user", "q"), (-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, formatted int").repartition(4)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    back = {r.conv_id: r for r in read_back(render(df)).collect()}
    marks = {r.conv_id: r for r in digest(df).collect()}
    assert set(back) == set(by) == set(marks)
    for c, turns in by.items():
        turns = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in turns))
        assert [(t.role, t.text) for t in back[c].turns] == [x[2:] for x in turns]
        trained = [x[3] for x in turns if x[2] == "assistant"]
        assert back[c].trained == trained
        assert marks[c].loss_sha256 == hashlib.sha256("".join(trained).encode()).hexdigest()
        assert marks[c].turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        assert marks[c].formatted_chars == len(back[c].formatted) and marks[c].loss_chars == len("".join(trained))
    for e in examples(df, texts=True).collect():
        whole = back[e.conv_id].formatted
        assert whole.startswith(e.formatted) and len(e.formatted) == e.prefix_chars and e.formatted.endswith("</s>")
        assert e.loss_start + e.loss_chars + 4 == e.prefix_chars and e.formatted.count("</s>") == e.turn + 1
    assert examples(df).count() == sum((r[2] == "assistant") for r in rows)
    assert digest(df.limit(0)).count() == 0


def test_one_long_conversation(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["<s>", "[x] ", "a\\b", "é😀", "plain words "]) * rng.randint(0, 5)) for c, n in ((1, 40_000), (2, 3)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    marks = {r.conv_id: r for r in digest(df).collect()}
    for c in (1, 2):
        turns = [r for r in rows if r[0] == c]
        trained = "".join(r[3] for r in turns if r[2] == "assistant")
        assert marks[c].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in turns).encode()).hexdigest()
        assert marks[c].loss_sha256 == hashlib.sha256(trained.encode()).hexdigest() and marks[c].loss_chars == len(trained) and marks[c].n_turns == len(turns)
