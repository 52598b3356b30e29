import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomline.llm import quality_mil as M
from loomline.llm import quality_rules as Q
from loomline.llm.common import py_crc32_mod

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, hit = Counter(tri), set()
    for i, t in enumerate(tri):
        if n[t] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@given(st.text("ab \n\t\x0b\x1c 　#|é\U0001f600", max_size=60))
def test_statistics(text):
    assert Q.statistics(text)[0] == brute(text)


def corpus(seed, n=900):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("aeinrstdhlo", k=rng.randint(2, 9))) for _ in range(600)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(vocabulary, k=rng.randint(60, 400))
        good = rng.random() > 0.2
        if not good:
            kind = i % 3
            w = [x + "###" for x in w] if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else w[:7] * 20
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_forest_finds_junk(spark):
    rows, labels = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    forest = Q.fit(docs, spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id bigint, quality int, toxic int"))
    got = {r.doc_id: r.kept for r in Q.judge(docs, forest).collect()}
    held = [(got[i], q) for i, q, _ in labels if i % 2 == 0]
    assert np.mean([k for k, q in held if q]) > 0.95
    assert np.mean([k for k, q in held if not q]) < 0.05
    assert {r.doc_id for r in Q.keep(docs, forest).collect()} == {i for i, k in got.items() if k}


def test_forest_odd_tables(spark, odd_docs, no_docs, odd_rows):
    forest = Q.fit(odd_docs, None)
    got = Q.judge(odd_docs, forest).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got))) == sorted(repr((x[0], *brute(x[1]))) for x in odd_rows)
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert Q.keep(odd_docs, forest).columns == odd_docs.columns
    empty = Q.fit(no_docs, spark.createDataFrame([(None, None)], "doc_id bigint, quality int"))
    assert Q.judge(no_docs, empty).count() == 0 and Q.judge(odd_docs, empty).count() == len(odd_rows)


def test_all_documents_and_labels_count(spark):
    """Every tree has a draw of its own from all documents, and every labelled document counts for the threshold."""
    n = 20_000
    rows = spark.range(n).selectExpr("id as doc_id", "transform(sequence(1, 11), i -> double(pmod(xxhash64(id, i), 1000))) as x")
    drawn = Q._draws(rows.repartition(7), 128, 256).collect()
    assert Counter(r.tree for r in drawn) == dict.fromkeys(range(128), 256)
    assert len({tuple(r.x) for r in drawn}) > 14_000  # 16,150 expected; the sample of 8,000 had no more
    assert sorted(map(repr, drawn)) == sorted(map(repr, Q._draws(rows, 128, 256).collect()))
    x = np.array([r.x for r in drawn])
    forest = Q.grow(x)
    score, good, count = Q._counted(rows.withColumn("good", rows.doc_id % 10 != 0), forest)
    assert count.sum() == n and count[good].sum() == 0.9 * n
    each = np.array([r.x for r in rows.collect()])
    assert np.allclose(np.repeat(score, count), np.sort(forest.scores(each)), atol=1 / Q.BINS)


def test_calibration_by_counts():
    score, good, n = np.array([0.9, 0.7, 0.5, 0.5, 0.1]), np.array([False, False, True, False, True]), np.array([3, 2, 1, 1, 9])
    assert Q.calibrate(score, good, n) == Q.calibrate(np.repeat(score, n), np.repeat(good, n)) == 0.6
    assert Q.calibrate(score, np.ones(5, bool), np.array([1, 1, 1, 1, 16])) == 0.7


def test_calibration():
    assert Q.calibrate(np.array([0.9, 0.8, 0.2, 0.1]), np.array([False, False, True, True])) == 0.5
    assert Q.calibrate(np.array([0.5, 0.5]), np.array([True, False])) > 0.5


def test_mil_on_held_out(spark):
    rows, labels = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    fold = spark.createDataFrame([x for x in labels if py_crc32_mod(x[0], 5)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.score for r in M.score(docs, M.fit(docs, fold)).collect()}
    held = [((got[i] >= M.LEAST) == q) for i, q, _ in labels if not py_crc32_mod(i, 5)]
    assert np.mean(held) > 0.95


def test_mil_odd_tables(spark, odd_docs, no_docs):
    assert M.fit(odd_docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")) is None
    assert {r.score for r in M.score(odd_docs, None).collect()} == {0.5}
    net = M.fit(odd_docs, spark.createDataFrame([(1, 1), (8, 0), (None, 1), (9, None)], "doc_id bigint, quality int"))
    got = M.score(odd_docs, net).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert M.score(no_docs, net).count() == 0


def test_passages_do_not_cross_texts():
    texts = ["a b", "", None, "c " * 130, "d"]
    (at, x, of), = M.bags(pa.array(texts, pa.string()))
    assert of.tolist() == [0, 1, 2, 3, 3, 3, 4] and x.shape == (7, M.FEATURES)
    alone = [next(M.bags(pa.array([t], pa.string())))[1] for t in texts]
    assert np.allclose(x, np.concatenate(alone))


def test_gradient_of_the_network():
    rng = np.random.default_rng(2)
    x, bag, y, weight = rng.normal(size=(11, M.FEATURES)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3, 3, 4]), np.array([1.0, 0, 1, 0, 1]), rng.uniform(0.5, 2, 5)
    net = M.train(x, bag, y, epochs=1)

    def loss():
        p = net.forward(x, bag, len(y))["score"]
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * weight).mean())

    for name, g in net.gradient(x, bag, y, weight).items():
        for _ in range(5):
            at = tuple(rng.integers(n) for n in net.p[name].shape)
            whole, step = net.p[name][at], 1e-5
            net.p[name][at] = whole + step
            up = loss()
            net.p[name][at] = whole - step
            down = loss()
            net.p[name][at] = whole
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=1e-7, rel=1e-4)


def test_attention_by_its_definition():
    rng = np.random.default_rng(3)
    x, bag = rng.normal(size=(5, M.FEATURES)), np.array([0, 0, 0, 1, 1])
    net = M.train(x, bag, np.array([1.0, 0.0]), epochs=2)
    p, got = net.p, net.forward(x, bag, 2)["score"]
    for d in (0, 1):
        hs = [np.tanh((r - net.mean) / net.dev @ p["w1"] + p["b1"]) for r in x[bag == d]]
        e = [np.exp(p["w"] @ (np.tanh(h @ p["v"] + p["bv"]) / (1 + np.exp(-(h @ p["u"] + p["bu"]))))) for h in hs]
        z = sum(a / sum(e) * h for a, h in zip(e, hs, strict=True))
        assert got[d] == pytest.approx(1 / (1 + np.exp(-(z @ p["w2"] + p["b2"][0]))))
