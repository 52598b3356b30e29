import random
import re

import pytest

from loomline.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, share=1.5, most=2.0):
    """Targets by resharing the excess until none is left."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > most * sizes[s]}
        if not full:
            out |= {s: level * w[s] for s in free}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= full
    return out


def check(rows, docs):
    sizes: dict = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want, taken = fill(sizes), {}
    assert sorted(repr((r.doc_id, r.size)) for r in rows) == sorted(repr((d, len(WORD.findall(t or "")))) for d, t, _ in docs)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and (r.position is not None) == (r.taken > 0)
        by.setdefault((r.target, r.source_size), 0)
        by[r.target, r.source_size] += r.taken
    assert sorted(t for t, _ in by) == pytest.approx(sorted({x: 0 for x in want.values()}))
    for (t, _), n in by.items():
        taken.setdefault(t, n)
    if len(set(want.values())) == len(want):
        assert all(abs(t - n) <= 0.5 + 1e-6 for t, n in taken.items())


def test_targets_and_takes(spark):
    rng = random.Random(6)
    docs = [(i, "w " * rng.randint(0, 300), rng.choice(["big"] * 12 + ["a", "Z", "é", "zz", None, ""])) for i in range(1500)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    rows = M.mixture(d).collect()
    check(rows, docs)
    assert sorted(map(repr, M.mixture(d.repartition(7)).collect())) == sorted(map(repr, rows))
    placed = [r.position for r in rows if r.position is not None]
    assert placed == sorted(placed)


def test_many_buckets(spark, monkeypatch):
    docs = [(i, "w " * (i % 40), "a" if i % 3 else "b") for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    whole = sorted(map(repr, M.mixture(d).collect()))
    monkeypatch.setattr(M, "ROWS_PER_BUCKET", 10)
    assert sorted(map(repr, M.mixture(d).collect())) == whole


def test_inverse_demand(spark):
    from pyspark.sql import functions as F

    for knots in M.SCHEDULES:
        rows = spark.range(0, 1001).select((F.col("id") / 1000).alias("u")).select("u", M.inverse_demand(F.col("u"), knots).alias("t")).orderBy("u").collect()
        whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
        for r in rows:
            area = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
                x = min(max(r.t, t0), t1) - t0
                area += x * w0 + x * x * (w1 - w0) / (t1 - t0) / 2
            assert area / whole == pytest.approx(r.u, abs=1e-9)


def test_placed_stream(spark, odd_docs):
    out = M.place(odd_docs)
    assert out.columns == odd_docs.columns
    assert all(WORD.search(r.text) for r in out.collect())


def test_odd_tables(spark, odd_docs, no_docs, odd_rows):
    check(M.mixture(odd_docs).collect(), [(x[0], x[1], x[3]) for x in odd_rows])
    assert M.mixture(no_docs).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert {(r.size, r.target, r.taken, r.position) for r in M.mixture(blank).collect()} == {(0, 0.0, 0, None)}
