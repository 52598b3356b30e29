"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Each passage is encoded from its statistics by a small layer;
gated attention, learned from document labels alone, weighs the passages, and the weighted representation gives
the document's score. Training is on a bounded sample of labelled documents; scoring takes every passage of every
document in one pass without a shuffle.

Cases: a null, empty or blank text is a bag of one empty passage; without labels of both classes every score is
0.5; equal texts get equal scores; a very long text has as many passages as it needs, encoded at once; an empty table gives an empty result; columns besides doc_id and text are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, bounded_texts, crc32_mod, table
from .shingles import arrow_text, word_table

#: Words of a passage; labelled documents of each class that training uses at most, with all their passages, and bytes of their texts.
PASSAGE, SAMPLE, MOST_BYTES = 64, 2500, 32_000_000
HIDDEN, GATE, EPOCHS, RATE = 32, 16, 40, 0.01
#: Score from which a document is predicted good.
LEAST = 0.3
#: Bytes of text whose passages are encoded at once.
STEP = 1 << 21

_CLASSES = np.zeros((8, 256), np.int32)  # upper, digit, symbol, bang, bar, beyond ASCII, stop, newline
for _k, _c in enumerate((range(65, 91), range(48, 58), b"#*$%&<>", b"!", b"|", range(128, 256), b".,;:?", b"\n")):
    _CLASSES[_k, list(_c)] = 1
FEATURES = 20


def encode(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, document number of each passage) of texts raw[offsets[i]:offsets[i+1]]."""
    docs = len(offsets) - 1
    a, b, word, doc, first = word_table(raw, offsets)
    empty = np.flatnonzero(np.diff(first) == 0)
    if len(a) == 0:
        return np.zeros((docs, FEATURES)), np.arange(docs)
    at = np.arange(len(a)) - first[doc]
    start = np.flatnonzero(at % PASSAGE == 0)
    of = doc[start]
    n = np.diff(np.append(start, len(a))).astype(float)
    size = (b - a).astype(float)

    def total(x):
        return np.add.reduceat(x.astype(float), start)

    chars = total(size)
    x = np.zeros((len(start), FEATURES))
    x[:, 0] = total(np.log1p(size)) / n
    x[:, 1] = np.sqrt(np.maximum(total(size * size) / n - (chars / n) ** 2, 0)) / 4
    span_a, span_b = a[start], np.append(b[start[1:] - 1], b[-1])
    for k in range(8):
        run = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(_CLASSES[k][raw], out=run[1:])
        x[:, 2 + k] = (run[span_b] - run[span_a]) / (chars if k not in (3, 4, 6, 7) else n)
    for k in range(1, 5):
        same = np.zeros(len(a), bool)
        same[k:] = (word[k:] == word[:-k]) & (doc[k:] == doc[:-k])
        x[:, 9 + k] = total(same) / n
    which = np.repeat(np.arange(len(start)), n.astype(int))
    order = np.lexsort((word, which))
    new = np.append(True, (word[order][1:] != word[order][:-1]) | (which[order][1:] != which[order][:-1]))
    x[:, 14] = np.bincount(which[order], weights=new, minlength=len(start)) / n
    x[:, 15] = np.log1p(n) / 4
    x[:, 16] = total(_CLASSES[0][raw[a]]) / n
    x[:, 17] = np.log1p(np.maximum.reduceat(size, start)) / 4
    x[:, 18] = total(size == 1) / n
    x[:, 19] = 1.0
    x = np.concatenate([x, np.zeros((len(empty), FEATURES))])
    of = np.concatenate([of, empty])
    order = np.argsort(of, kind="stable")
    return x[order], of[order]


def bags(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, features, row number from it) for runs of rows of an Arrow text column."""
    raw, off = arrow_text(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + STEP, "right")) - 1)
        yield at, *encode(raw[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to


@dataclass
class Network:
    p: dict[str, np.ndarray]
    mean: np.ndarray
    dev: np.ndarray

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
        p = self.p
        x = (x - self.mean) / self.dev
        h = np.tanh(x @ p["w1"] + p["b1"])
        v, u = np.tanh(h @ p["v"] + p["bv"]), 1 / (1 + np.exp(-(h @ p["u"] + p["bu"])))
        e = np.exp(np.clip((v * u) @ p["w"], -30, 30))
        a = e / np.bincount(bag, weights=e, minlength=n)[bag]
        z = np.column_stack([np.bincount(bag, weights=a * h[:, k], minlength=n) for k in range(h.shape[1])])
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["w2"] + p["b2"], -30, 30)))}

    def gradient(self, x, bag, y, weight) -> dict[str, np.ndarray]:
        f, p, n = self.forward(x, bag, len(y)), self.p, len(y)
        out = (f["score"] - y) * weight / n
        dz = out[:, None] * p["w2"]
        da = (dz[bag] * f["h"]).sum(1)
        de = f["a"] * (da - np.bincount(bag, weights=f["a"] * da, minlength=n)[bag])
        dg = de[:, None] * p["w"]
        dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
        dh = (f["a"][:, None] * dz[bag] + dv @ p["v"].T + du @ p["u"].T) * (1 - f["h"] ** 2)
        return {
            "w1": f["x"].T @ dh, "b1": dh.sum(0), "v": f["h"].T @ dv, "bv": dv.sum(0), "u": f["h"].T @ du, "bu": du.sum(0),
            "w": (f["v"] * f["u"]).T @ de, "w2": f["z"].T @ out, "b2": out.sum(keepdims=True),
        }


def train(x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 13) -> Network:
    """Adam on the cross-entropy, both classes alike; bag numbers are sorted, one for each label."""
    rng = np.random.default_rng(seed)

    def init(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    net = Network(
        {"w1": init(FEATURES, HIDDEN), "b1": np.zeros(HIDDEN), "v": init(HIDDEN, GATE), "bv": np.zeros(GATE), "u": init(HIDDEN, GATE), "bu": np.zeros(GATE), "w": init(GATE), "w2": init(HIDDEN), "b2": np.zeros(1)},
        x.mean(0), x.std(0) + 1e-3,
    )
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    first = np.searchsorted(bag, np.arange(len(y) + 1))
    m1, m2, t = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in "12"), None, 0
    m1, m2 = list(m1)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), 128):
            pick = order[k : k + 128]
            sizes = first[pick + 1] - first[pick]
            rows = np.repeat(first[pick] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            g = net.gradient(x[rows], np.repeat(np.arange(len(pick)), sizes), y[pick], weight[pick])
            t += 1
            for name, d in g.items():
                d = d + 1e-4 * net.p[name]
                m1[name] = 0.9 * m1[name] + 0.1 * d
                m2[name] = 0.999 * m2[name] + 0.001 * d * d
                net.p[name] = net.p[name] - RATE * (m1[name] / (1 - 0.9**t)) / (np.sqrt(m2[name] / (1 - 0.999**t)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Learn from at most `sample` documents and MOST_BYTES of text of each class among labels (doc_id, quality); None without both classes."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    ids = bounded_sample(known.filter("quality = 1"), "doc_id", sample).unionByName(bounded_sample(known.filter("quality = 0"), "doc_id", sample))
    rows = bounded_texts(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "quality", sample, MOST_BYTES)  # at most 2 * sample ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x, of in bags(b.column(2)):
                first = np.searchsorted(of, np.arange(of[-1] + 2))
                blobs = [x[i:j].astype("<f4").tobytes() for i, j in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(blobs)), b.column(1).slice(at, len(blobs)), pa.array(blobs, pa.binary())], ["doc_id", "quality", "x"])

    got = rows.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x binary").orderBy("doc_id", "x").collect()
    y = np.array([r.quality for r in got], float)
    if len(set(y.tolist())) < 2:
        return None
    parts = [np.frombuffer(r.x, "<f4").reshape(-1, FEATURES).astype(float) for r in got]
    return train(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), y)


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score) of every document; higher: more likely good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full(b.num_rows, 0.5)
            if net is not None:
                for at, x, of in bags(b.column(1)):
                    n = int(of[-1]) + 1
                    out[at : at + n] = net.forward(x, of, n)["score"]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def op9_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(crc32_mod(F.col("doc_id"), 5) != 0)
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
