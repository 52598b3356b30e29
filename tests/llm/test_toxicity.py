import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm import toxicity as T
from loomline.llm.common import py_crc32_mod


def corpus(seed, n=1200):
    rng = random.Random(seed)
    syllables = ["ra", "to", "mi", "len", "as", "er", "in", "ko", "du", "pa"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(900)]
    bad = ["wretch", "clod", *("zorg" + s for s in syllables)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(vocabulary, k=rng.randint(10, 300))
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(2 + len(w) // 40):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w).capitalize() + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out(spark):
    rows, labels = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    fold = spark.createDataFrame([x for x in labels if py_crc32_mod(x[0], 4) != 2], "doc_id bigint, quality int, toxic int")
    model = T.fit(docs, fold)
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    held = [(got[i] >= T.LEAST, t) for i, _, t in labels if py_crc32_mod(i, 4) == 2]
    assert np.mean([p for p, t in held if t]) > 0.9
    assert np.mean([p for p, t in held if not t]) < 0.05


def test_odd_tables(spark, odd_docs, no_docs):
    none = T.fit(odd_docs, spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int"))
    assert {r.score for r in T.score(odd_docs, none).collect()} == {0.0}
    model = T.fit(odd_docs, spark.createDataFrame([(1, 1), (7, 0), (None, 1), (8, None), (9, 5)], "doc_id bigint, toxic int"))
    got = T.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert T.score(no_docs, model).count() == 0


def brute(docs, pairs):
    """Log-likelihood ratio of a word, by the definition: class counts of five letters' context, continuation counts of all documents below."""
    n, d = T.ORDER, T.DISCOUNT
    everywhere = {s[i : i + n] for t in docs for w in T.words(t) for s in ["^" * (n - 1) + w + "$"] for i in range(len(s) - n + 1)}

    def continuations(g):
        return len({x[-len(g) - 1 :] for x in everywhere if x.endswith(g)})

    letters = {x[-1] for x in everywhere}

    def shared(h, letter):
        if h:
            c = {x: continuations(h + x) for x in letters}
            c = {x: v for x, v in c.items() if v}
            return (max(c[letter] - d, 0) + d * len(c) * shared(h[1:], letter)) / sum(c.values())
        c = {x: continuations(x) for x in letters}
        return (max(c[letter] - d, 0) + d) / sum(c.values())

    counts = [Counter(), Counter()]
    for _, w, toxic in pairs:
        s = "^" * (n - 1) + w + "$"
        counts[toxic].update(s[i : i + n] for i in range(len(s) - n + 1))

    def ratio(word):
        s, out = "^" * (n - 1) + word + "$", 0.0
        for i in range(len(s) - n + 1):
            h, letter = s[i : i + n - 1], s[i + n - 1]
            known = h + letter in everywhere
            p = []
            for c in counts:
                after = {g: k for g, k in c.items() if g[:-1] == h}
                total = sum(after.values())
                low = shared(h[1:], letter) if known else 1.0  # cancels out where no class has the letter
                p.append((max(c[h + letter] - d, 0) + (d * len(after) + T.PRIOR) * low) / (total + T.PRIOR) if total else low)
            out += math.log(p[1] / p[0])
        return out

    return ratio


def test_probabilities(spark):
    texts = ["Banana band, ban bandana", "ananas bandit", "zorgan zorg ban", "zorg banzorg", "never labelled zor bananas"]
    labels = [0, 0, 1, 1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = docs.join(spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, toxic int"), "doc_id")
    found = T._pairs(rows)
    pairs = {tuple(r) for r in found.collect()}
    assert pairs == {(v, w, c) for t, c in zip(texts, labels, strict=False) for x in [T.words(t)] for v, w in zip(["", *x], x, strict=False)}
    t = T._ratio_table(found, T._shared(T._corpus_sequences(docs))).toArrow()
    ratio, want = T.Model(t.column("key").combine_chunks(), t.column("ratio").combine_chunks()).ratios(), brute(texts, pairs)
    for w in ["zorg", "banana", "ban", "zor", "bananas", "zorgband", "quite", "b", "ananasananasananasx", "ananasananasananasy"]:
        assert ratio[w] == pytest.approx(want(w), abs=1e-9)
    assert ratio["zorg"] > 1 > 0 > ratio["banana"]


def test_every_letter_counts(monkeypatch):
    monkeypatch.setattr(T, "ORDER", 6)
    monkeypatch.setattr(T, "BEGIN", "^^^^^")
    keys = pa.array(["abcdef", "ghijkz", "ghijky", "ghijk"])
    ratio = T.Model(keys, pa.array([1.0, 2.0, 3.0, 0.5])).ratios()
    assert [ratio["abcdefghijk" + x] for x in "zyx"] == [3.0, 4.0, 1.5]
