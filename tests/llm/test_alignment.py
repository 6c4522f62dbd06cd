import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from donorframe.llm import alignment
from donorframe.llm.queries import op13_cross_tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "▁a ▁b", "x" * 3000, "日本語 テキスト  です", "<s> </s> [INST] <|endoftext|> hi <0x41>", "a\tb \tc", "it's  we'll\r\n ok", "é 😀😀 😀", "\x1c a \x1d b", "1 2  3   4", "▁", "a ▁", "\x00 \x00a", "“q” – x…", "naïve coöperation, éte"]


def plain(texts):
    """Rows and pair counts by plain loops over the libraries' tokens."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    own = [x for x in range(256) if chr(x).isprintable() and not chr(x).isspace() and x != 173]
    byte = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    rows, all_links = [], []
    for text in texts:
        whole = f" {text}".encode()
        ids = a.encode(f" {text}", add_special_tokens=False).ids if text else [], b.encode(text) if text else []
        spelled = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids[1])]
        if not text or any(b"".join(s) != whole for s in spelled):
            rows.append((0, 0, 0, ""))
            all_links.append([])
            continue
        ends = [[len(b"".join(s[: k + 1])) for k in range(len(s))] for s in spelled]
        cuts = [e for e in ends[0] if e in ends[1]]
        groups, last = [], 0
        for e in cuts:
            groups.append("|".join(",".join(str(i) for i, x in zip(t, n) if last < x <= e) for t, n in zip(ids, ends)))
            last = e
        rows.append((len(ids[0]), len(ids[1]), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        all_links.append([(i, k) for i, x in zip(ids[0], ends[0]) for k, y in zip(ids[1], ends[1]) if x == y])
    count = Counter(p for links in all_links for p in links)
    top = {}
    for (_, k), n in count.items():
        top[k] = max(n, top.get(k, 0))
    return [(n_a, n_b, n_g, len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), sha) for (n_a, n_b, n_g, sha), links in zip(rows, all_links)]


def texts_of(n):
    rng = random.Random(5)
    bits = ["a", "b ", " ", "  ", "\n", "▁", "é", "😀", "1", "'s", ".", "<unk>", "\t", "　", "ß", "word ", "token", " the", "<|endoftext|>"]
    return [t for t in ODD if len(t) < 1000] + ["".join(rng.choice(bits[:5] + bits[6:]) for _ in range(30)) for _ in range(n)] + ["".join(rng.choice(bits) for _ in range(12)) for _ in range(n // 4)]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [0, alignment.BROADCAST])
def test_equals_plain_loops(spark, most):
    texts = texts_of(200)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(df, most=most).collect()}
    want = dict(enumerate(plain(texts)))
    assert got == want
    assert sum(v[0] > 0 for v in got.values()) > 150 and sum(v[0] == 0 for v in got.values()) > 5


def test_whole_table_equals_plain_loops(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    short = [d for d in docs if len(d[1]) < 2500]  # the plain version is quadratic in a text
    got = alignment.align_documents(spark.createDataFrame(short, "doc_id long, text string"))
    assert sorted((r.doc_id, *(r[c] for c in COLUMNS)) for r in got.collect()) == sorted((i, *row) for (i, _), row in zip(short, plain([t for _, t in short])))
    whole = op13_cross_tokenizer(spark, folder).collect()
    assert len(whole) == len(docs) and sum(r.n_groups for r in whole) == sum(r.n_links for r in whole) > 10_000


def test_cases(spark):
    long = "river stone 42, " * 40_000 + "x" * 20_000
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, long), (5, "▁")], "doc_id long, text string")
    rows = alignment.align_documents(df).collect()
    zero = (0, 0, 0, 0, 0, 0, "")
    by = sorted(((r.doc_id or 0, *(r[c] for c in COLUMNS)) for r in rows), key=str)
    assert [r[1:] for r in by if r[0] in (1, 2, 5)] == [zero] * 3
    same = {r[1:] for r in by if r[0] in (0, 3)}
    assert len(by) == 7 and same == {(2, 2, 2, 2, 2, 6, hashlib.sha256(b"257|263;275|289".replace(b"263", str(sentencepiece.SentencePieceProcessor(model_file=B).encode("a")[0]).encode()).replace(b"289", str(sentencepiece.SentencePieceProcessor(model_file=B).encode("b")[0]).encode())).hexdigest())}
    told = next(r for r in by if r[0] == 4)
    lib = Tokenizer.from_file(A)
    assert told[1] == len(lib.encode(f" {long}", add_special_tokens=False).ids) and told[2] == len(sentencepiece.SentencePieceProcessor(model_file=B).encode(long))
    assert alignment.align_documents(df.where(F.lit(False))).count() == 0
