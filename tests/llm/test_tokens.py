import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from donorframe.llm.counting import count_spliced, count_tokens
from donorframe.llm.encoders import byte_encoder, piece_counter
from donorframe.llm.packing import CAPACITY, make_plan, pack, price, relax

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "▁a ▁b", "x" * 3000, "日本語 テキスト  です", "<s> </s> [INST] <|endoftext|> hi", "a\tb \tc", "it's  we'll\r\n ok", "é 😀😀 😀", "\x1c a \x1d b", "1 2  3   4", "▁", "a ▁", "\x00 \x00a", "“q” – x…"]


def odd_texts(n: int) -> list[str]:
    rng = random.Random(0)
    bits = ["a", "b ", " ", "  ", "\n", "▁", "é", "😀", "1", "'s", ".", "<unk>", "\t", "　", "́", "ß", "ñ"]
    return ODD + ["".join(rng.choice(bits) for _ in range(30)) for _ in range(n)]


def test_ids_equal_the_library():
    encoder = byte_encoder(BYTES)
    for t in odd_texts(500) + [f"{a}<|endoftext|>{b}" for a in ("", "x ", "日本 ") for b in ("", " y", "  ")]:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == encoder.library.encode(t, add_special_tokens=False).ids, t


def test_counts_equal_the_library_for_any_chunking():
    counter = piece_counter(PIECES)
    for t in odd_texts(300):
        assert counter.count(t) == len(counter.model.encode(t)), t
    rng = random.Random(1)
    for size in (50, 400, 3000):
        for _ in range(20):
            t = "".join(rng.choice(["ab", "cde ", " ", "\n", "x" * 40, "▁", "é "]) for _ in range(size))
            for chunk, overlap in ((7, 3), (64, 8), (500, 16)):
                assert count_spliced(counter, t, chunk, overlap) == len(counter.model.encode(t)), (chunk, overlap)
    assert count_spliced(counter, "y" * 5000, 100, 10) == len(counter.model.encode("y" * 5000))


def test_count_tokens_cases(spark):
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "a b", "z"), (3, "a b", "z"), (None, "word " * 5000, "z")], "doc_id long, text string, n_tokens string")
    rows = count_tokens(df).collect()
    model = piece_counter(PIECES).model
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == [(0, 25000, len(model.encode("word " * 5000)), True), (1, 0, 0, False), (2, 0, 0, False), (3, 3, 2, False), (3, 3, 2, False)]
    assert count_tokens(df.limit(0)).count() == 0


def test_long_texts_are_spliced(spark):
    rng = random.Random(7)
    bits = ["river ", "bent ", "é ", "日本 ", "x" * 50 + " ", "<s> ", "▁ ", "  ", "\n", "1984, ", "😀 "]
    texts = ["".join(rng.choice(bits) for _ in range(40_000)), "y" * 120_000, "ab " * 50_000, "".join(rng.choice(bits[:4]) for _ in range(60_000)), ("z" * 40_000 + " ") * 4]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = piece_counter(PIECES).model
    assert all(len(t) > 100_000 for t in texts)
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(df).collect()} == {i: (len(t.encode()), len(model.encode(t))) for i, t in enumerate(texts)}


def covered(plan):
    got = defaultdict(int)
    for config, times in plan:
        assert sum(k * a for k, a in config) <= CAPACITY and times > 0
        for k, a in config:
            got[k] += a * times
    return dict(got)


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_exactly_and_is_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(CAPACITY, rng.geometric(1 / 400, 20_000))
    hist = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
    plan = make_plan(hist)
    assert covered(plan) == hist
    bound = -(-sum(k * v for k, v in hist.items()) // CAPACITY)
    assert sum(t for _, t in plan) <= bound * 1.002 + 2


def test_plan_small_against_known_optimum():
    assert sum(t for _, t in make_plan({342: 1000, 341: 500, 683: 300})) == 850
    assert sum(t for _, t in make_plan({600: 3, 424: 3, 1024: 2})) == 5
    assert make_plan({}) == []
    lengths = np.arange(1, CAPACITY + 1)
    assert price(lengths.astype(float), np.isin(lengths, [500, 24]) * np.where(lengths == 500, 2, 1)) == {500: 2, 24: 1}


@pytest.mark.parametrize("learned", [False, True])
def test_the_relaxation_is_feasible(learned):
    rng = np.random.default_rng(9)
    hist = {int(a): int(b) for a, b in zip(*np.unique(np.minimum(CAPACITY, rng.geometric(1 / 300, 50_000)), return_counts=True))}
    x = relax(hist, CAPACITY, learned=learned)
    got = defaultdict(float)
    for config, times in x.items():
        for k, a in config:
            got[k] += a * times
    assert all(got[k] >= n for k, n in hist.items())
    volume = sum(k * n for k, n in hist.items()) / CAPACITY
    assert volume <= sum(x.values()) <= 2 * volume
    assert sum(t for c, t in x.items() if sum(k * a for k, a in c) == CAPACITY) >= 0.8 * volume


def test_pack_reads_back(spark):
    texts = [None, "", "a b c", "a b c", "tok " * 3000, "é" * 700, "x y " * 511 + "z", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> é 日本"] + [f"word{i} " * (i % 60) for i in range(200)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, piece int").repartition(3)
    rows = pack(df, with_ids=True).collect()
    library = Tokenizer.from_file(BYTES)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert sum((r.ids for r in pieces), []) == ids
        assert all(r.length == CAPACITY for r in pieces[1:]) and pieces[0].start == 0
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= CAPACITY
    assert len(by_seq) <= -(-sum(r.length for r in rows) // CAPACITY) + 1
    assert pack(df.limit(0)).count() == 0
