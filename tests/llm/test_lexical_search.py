import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomline.llm import lexical_search as ls

DOC = "doc_id bigint, text string, item_id bigint, term string, n int, best bigint, score bigint"
MORE = (1, "t", 2, 3, 4)


def terms(text):
    return re.findall(ls.TERM, text.translate(str.maketrans(ls.UPPER, ls.LOWER))) if text else []


def brute(docs, queries, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, c.total()) for i, c in counts if c]
    N, L = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = {}
    for item, text in queries:
        wanted.setdefault(item, set()).update(t for t in terms(text) if t in df)
    out = []
    for item, ts in wanted.items():
        w = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) for t in ts}
        scores = [(-sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * N // L))) for t in ts if t in c), i is None, i) for i, c, n in counts]
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return out


def table(spark, rows, name, folder):
    schema = DOC if name == "documents" else DOC.replace("item_id", "doc2").replace("doc_id", "item_id")
    spark.createDataFrame([(*r, *MORE) for r in rows], schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")


def search(spark, tmp_path, docs, queries):
    folder = str(tmp_path / "t")
    for rows, name in ((docs, "documents"), (queries, "benchmark")):
        table(spark, rows, name, folder)
    df = ls.op11_lexical_search(spark, folder)
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    key = lambda r: tuple((x is None, x) for x in r)
    got, want = sorted((tuple(r) for r in df.collect()), key=key), sorted(db.sql(ls.OP11_SQL).fetchall(), key=key)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    assert got == want
    assert got == sorted(brute(docs, queries), key=key)
    return got


ODD_DOCS = [
    (1, "Apple banana. Apple"),
    (1, "Apple banana. Apple"),
    (2, None),
    (3, ""),
    (4, " .,;\n"),
    (None, "apple"),
    (None, "zebra ÉTÉ été"),
    (5, "x" * 300_000 + " apple"),
    (6, " ".join(f"w{i}" for i in range(50_000)) + " banana"),
    (7, "naïve—apple\U0001f600 7UP"),
    (8, "été"),
    (9, "same same same"),
    (10, "same same same"),
]


def test_odd_rows(spark, tmp_path):
    queries = [(1, "APPLE banana"), (2, None), (3, ""), (4, "nowhere"), (None, "zebra"), (None, "été"), (5, "same Same"), (6, "7up w77 " + "y" * 100_000), (6, "banana")]
    got = search(spark, tmp_path, ODD_DOCS, queries)
    assert {r[0] for r in got} == {1, None, 5, 6}
    assert [r[2] for r in got if r[0] == 5] == [9, 10]


def test_empty_tables(spark, tmp_path):
    assert search(spark, tmp_path / "a", [], [(1, "a")]) == []
    assert search(spark, tmp_path / "b", [(1, "a")], []) == []
    assert search(spark, tmp_path / "c", [(1, " "), (2, None)], [(1, "a")]) == []


def test_several_passes(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    chance = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, chance, k=rng.randrange(1, 60)))) for i in range(1500)] + [(i, "w250 w251 w1") for i in range(2000, 2030)]
    queries = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(30)]
    monkeypatch.setattr(ls, "MOST_TERMS", 40)
    got = search(spark, tmp_path, docs, queries)
    assert len(got) == 300


@pytest.mark.parametrize("block", [1, 4, 128])
def test_walk_finds_the_best_and_skips(block, monkeypatch):
    """The walk over one segment against scoring everything, and blocks that stay compressed."""
    monkeypatch.setattr(ls, "BLOCK", block)
    monkeypatch.setattr(ls, "STRETCHES", 4)
    rng = random.Random(block)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randrange(5, 40)))) for i in range(4000)]
    n, total = len(docs), sum(len(t.split()) for _, t in docs)
    segment = ls.Segment()
    for i, t in docs:
        segment.add(i, t.encode())
    rows = pd.concat([b.to_pandas() for b in segment.blocks(0, n, total)])
    m = ls.norms(segment.sizes, n, total)
    blocks = rows[rows.term.notna()].sort_values(["term", "block"])
    sums, inside = np.zeros(n, np.int64), np.zeros(n, bool)
    for _ in range(20):
        query = [(t, rng.randrange(1, 5000)) for t in set(rng.choices(words, k=5))]
        lists = {t: ls.List(r, m) for t, r in blocks.groupby("term")}
        got = ls.walk_query([(lists[t], w) for t, w in query if t in lists], np.arange(n), 0, 10, sums, inside)
        scores = [(-sum(w * int(ls.impact(np.int64(c[t]), m[i])) for t, w in query if t in c), i) for i, c in ((i, Counter(t.split())) for i, t in docs)]
        assert got == [(i, -s) for s, i in sorted(scores)[:10] if s < 0]
        assert not sums.any() and not inside.any()
    lists = {t: ls.List(r, m) for t, r in blocks[blocks.term.isin(("w0", "w59"))].groupby("term")}
    got = ls.walk_query([(lists["w59"], 9000), (lists["w0"], 10)], np.arange(n), 0, 10, sums, inside)
    assert len(got) == 10
    if block < 128:
        assert len(lists["w0"].open) < 0.5 * len(lists["w0"].first)  # most blocks of the frequent term stay compressed


def test_bytes_round_trip():
    v = np.array([0, 1, 127, 128, 16383, 16384, 1 << 40, 5], np.int64)
    data, at = ls.encode(v)
    assert ls.decode(data.tobytes()).tolist() == v.tolist() and at[-1] == len(data)
    assert ls.decode(ls.encode(v[:2])[0].tobytes()).tolist() == [0, 1]
