from pyspark.sql import functions as F

from loomline.llm import quality_mil as M
from loomline.llm import toxicity as T
from loomline.llm.common import bounded_texts


def taken(rows, most_rows, most_bytes):
    return sorted(((r.doc_id, r.toxic, r.text) for r in bounded_texts(rows, "toxic", most_rows, most_bytes).collect()), key=str)


def test_bounded_texts(spark):
    rows = [(i, i % 2, "x" * (10 + i % 7)) for i in range(200)] + [(1, 1, "x" * 11)] * 5 + [(2, 0, None), (2, 0, "é" * 9), (3, 1, "y" * 5000)]
    d = spark.createDataFrame(rows, "doc_id bigint, toxic int, text string")
    every = sorted(set(rows), key=str)
    assert taken(d, 1000, 10**6) == every
    got = taken(d, 1000, 600)
    assert got == taken(d.repartition(7, F.rand(3)), 1000, 600) and set(got) <= set(rows)
    for c in (0, 1):
        sizes = [len((t or "").encode()) for _, k, t in got if k == c]
        assert 600 - 20 < sum(sizes) <= 600  # as many as fit in, without the text that is longer than all
    got = taken(d, 30, 10**6)
    assert [sum(k == c for _, k, _ in got) for c in (0, 1)] == [30, 30]
    assert taken(d.limit(0), 30, 600) == []


def test_samples_of_long_texts_are_bounded(spark, monkeypatch):
    """Labelled texts of 5 MB each, and many rows of one id: what fits in is learned from."""
    text = lambda i, toxic: (("you vile zorg " if toxic else "a calm and sunny day ") + f"w{i} ") * 40
    rows = [(i, text(i, i % 4 == 0)) for i in range(60)] + [(4, text(i, True)) for i in range(60, 90)] + [(100 + i, text(i, i % 2 == 0) * 4000) for i in range(4)]
    assert len(rows[-1][1]) > 3_000_000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 > 0)) for i in [*range(60), *range(100, 104)]], "doc_id bigint, toxic int, quality int")
    monkeypatch.setattr(T, "MOST_BYTES", 20_000)
    monkeypatch.setattr(M, "MOST_BYTES", 20_000)
    ask = spark.createDataFrame([(1, "vile zorg you"), (2, "a sunny and calm day")], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in T.score(ask, T.fit(docs, labels)).collect()}
    assert got[1] > got[2], got  # few documents move the score little
    assert M.fit(docs, labels) is not None
