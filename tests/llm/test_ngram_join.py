import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from loomline.llm import ngram_join as N
from loomline.llm import shingles as S
from loomline.llm.shingles import expand, shingles, shrink

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = [shingle_set(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    inv = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            inv[g].append(i)
    n = defaultdict(int)
    for ids in inv.values():
        for a in range(len(ids)):
            for b in range(a):
                n[ids[b], ids[a]] += 1
    for (a, b), o in n.items():
        if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
            up[root(a)] = root(b)
    low: dict = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(repr((d, len(sets[i]), low.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(docs))


def got(spark, docs, parts=3):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts)
    return sorted(repr(tuple(r)) for r in N.join(d).collect())


def near_copies(seed, groups=12, most=9):
    rng = random.Random(seed)
    docs = []
    for _ in range(groups):
        w = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 80))]
        for _ in range(rng.randint(1, most)):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = f"x{rng.randint(0, 3)}"
            if rng.random() < 0.3:
                v = v[: rng.randint(1, len(v))]
            docs.append((len(docs), " ".join(v)))
    rng.shuffle(docs)
    return docs


def test_near_copies(spark):
    docs = near_copies(1) + [(9000 + i, " ".join(f"s{k}" for k in range(30))) for i in range(30)]
    assert got(spark, docs) == brute(docs)


def test_common_keys_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(N, "COMMON", 2)
    monkeypatch.setattr(N, "BATCH", 300)
    docs = near_copies(2, 8, 12)
    assert got(spark, docs, 2) == brute(docs)


def test_only_the_last_round(spark, monkeypatch):
    monkeypatch.setattr(N, "ROUNDS", 0)
    docs = near_copies(3, 8)
    assert got(spark, docs) == brute(docs)


def test_odd_tables(spark, odd_docs, no_docs, odd_rows):
    assert sorted(repr(tuple(r)) for r in N.join(odd_docs).collect()) == brute([x[:2] for x in odd_rows])
    assert N.join(no_docs).count() == 0


@given(st.lists(st.text("ab \n\x1c　É", max_size=30), max_size=8))
def test_shingles(texts):
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    d, k = shingles(np.frombuffer(b"".join(raw), np.uint8), off)
    keys: dict = {}
    for i, t in enumerate(texts):
        want = shingle_set(t)
        mine = set(k[d == i].tolist())
        assert len(mine) == len(want)
        keys.setdefault(want, mine)
        assert keys[want] == mine


def test_blobs():
    a, b = np.arange(5, dtype=np.uint32) * 77777, np.arange(5, dtype=np.uint16)
    x, y = expand(shrink(a, b), 5, np.uint32, np.uint16)
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist()


def test_components(spark):
    from loomline.llm.components import components

    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(1000, k) for k in range(1001, 1100)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: root(x) for e in edges for x in e if e[0] != e[1]}


def test_unrelated_documents(spark):
    docs = [(1, "a b c d e f g h"), (2, "i j k l m n o p")]
    assert got(spark, docs, 1) == brute(docs)


class _Task:
    @staticmethod
    def get():
        return _Task()

    def partitionId(self):
        return 0


def _peak(run):
    """What run() gives, and MB that its arrays took at most."""
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_a_worker(monkeypatch):
    """A worker holds a batch's keys once, and temporary arrays of a part of them; a long text leaves nothing behind."""
    monkeypatch.setattr(N, "TaskContext", _Task)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 100_000, 500)) for _ in range(1000)]
    texts += texts
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    sent, peak = _peak(lambda: list(N._sent(8)(iter(table.to_batches()))))
    assert len(sent) == 1 and peak < 60  # 1,000,000 shingles: 115 MB before
    rows = sent[0].to_pandas()
    back = pd.concat([N._counted((b,), g) for b, g in rows.groupby("bucket")])
    reps = pd.DataFrame([(0, 0, N._COUNTS, 0, np.arange(len(texts), dtype=">u2").tobytes())], columns=rows.columns)
    found, peak = _peak(lambda: N._prefixes(8)((0,), pd.concat([back, reps], ignore_index=True)))
    whole = found[found["key"] < 0]
    assert len(whole) == len(texts) and (whole["n"] == 496).all() and (whole["pos"] == 496).all()
    assert len(found) == len(texts) * (1 + 496 - 372 + 1) and peak < 65  # 72 MB before
    before = len(S._powers(1)[0])
    S.shingles(np.frombuffer(("x " * 2_000_000).encode(), np.uint8), np.array([0, 4_000_000]))
    assert len(S._powers(1)[0]) == before
