import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import packing as P
from loomline.llm.tokens import tokenizer

PATH = P.default_tokenizer()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(" \n\t\x0bab1é9'.,!sdl　漢²½\U0001F600<|>rev", max_size=40), max_size=20))
def test_ids_are_the_library_s(texts):
    enc = tokenizer(PATH)
    assert [x.tolist() for x in enc.encode(texts)] == [enc.whole(t).tolist() for t in texts]


@pytest.mark.parametrize("text", ["<|endoftext|> a", "it's we've I'll'd ''s", "a  b   ", "\n\n \n x", " ", "'", "x" * 5000, "1" * 40])
def test_ids_of_odd_texts(text):
    enc = tokenizer(PATH)
    assert enc.encode(["pad", text, "pad"])[1].tolist() == enc.whole(text).tolist()


def test_word_store_starts_anew(monkeypatch):
    from loomline.llm import tokens

    monkeypatch.setattr(tokens, "MOST_WORDS", 50)
    enc = tokens.BatchTokenizer(PATH)
    for k in range(5):
        t = [f"word{k}x{i} " * 2 for i in range(30)]
        assert [x.tolist() for x in enc.encode(t)] == [enc.whole(x).tolist() for x in t]


@given(st.lists(st.integers(1, 1024), max_size=200))
def test_best_fit(sizes):
    bins = P.best_fit(sizes)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    loads = [sum(sizes[i] for i in b) for b in bins]
    assert all(x <= 1024 for x in loads)
    assert sum(x <= 512 for x in loads) <= 1


def test_piece_lengths():
    assert [P.piece_lengths(n) for n in (1, 1024, 1025, 2048, 2049)] == [[1], [1024], [1, 1024], [1024, 1024], [1, 1024, 1024]]


def check(rows, docs):
    enc = tokenizer(PATH)
    ids = [np.append(enc.whole(t or ""), 2).astype("<u4") for _, t in docs]
    want = []
    for (d, _), x in zip(docs, ids, strict=True):
        at = 0
        for p, n in enumerate(P.piece_lengths(len(x))):
            want.append((d, p, at, n, zlib.crc32(x[at : at + n].tobytes())))
            at += n
    assert sorted(map(repr, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows))) == sorted(map(repr, want))
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 1024
    return len(by), sum(map(len, ids))


def test_packs_in_rounds(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gam", "d"], k=int(rng.paretovariate(0.8) * 20) % 1500))) for i in range(700)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(20)
    used, tokens = check(P.pack(d, PATH).collect(), docs)
    assert used <= -(-tokens // 1024) * 1.02 + 1


def test_ids_column(spark):
    docs = [(1, "some words here"), (2, "x " * 3000)]
    for r in P.pack(spark.createDataFrame(docs, "doc_id bigint, text string"), PATH, ids=True).collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length


def test_odd_tables(spark, odd_docs, no_docs, odd_rows):
    check(P.pack(odd_docs, PATH).collect(), [x[:2] for x in odd_rows])
    assert P.pack(no_docs, PATH).count() == 0


def test_keeps_an_order(spark, tmp_path):
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gam", "d"], k=rng.randrange(1, 900)))) for i in range(800)]
    d = spark.createDataFrame([(*x, x[0] // 100, x[0] % 100) for x in docs], "doc_id bigint, text string, r bigint, n bigint").repartitionByRange(8, "r")
    rows = P.pack(d, PATH, order=("r", "n")).collect()
    used, tokens = check(rows, docs)
    assert used <= -(-tokens // 1024) * 1.05 + 2
    ranges: dict = {}
    for r in rows:
        ranges.setdefault(r.sequence_id, []).append(r.doc_id // 100)
    for v in ranges.values():
        assert max(v) // P.FAN_IN ** 2 == min(v) // P.FAN_IN ** 2  # neighbours only
    firsts = [min(ranges[s]) for s in sorted(ranges)]
    assert firsts == sorted(firsts)  # sequences in the order of their first documents


def test_an_order_of_one_range_and_of_none(spark):
    docs = [(1, "a b c"), (2, None), (3, "x " * 3000)]
    d = spark.createDataFrame([(*x, 0, i) for i, x in enumerate(docs)], "doc_id bigint, text string, r bigint, n bigint")
    check(P.pack(d, PATH, order=("r", "n")).collect(), docs)
    assert P.pack(d.limit(0), PATH, order=("r", "n")).count() == 0
