"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary documents, give the probability of a word letter by letter, each letter
given the ORDER - 1 letters before it in the word. Their counts are of different words before a word, so copies of
a document add nothing. What the discount takes from a class's counts, and a little more (PRIOR), goes to the
backoff that both classes share: an interpolated Kneser-Ney model of the lower orders, down to single letters, whose
counts are continuation counts (of different letters before a sequence) over all documents. So an expression that is
rare in a class is judged by how its letters go on anywhere, and one that neither class has cancels out.

Of the shared counts, kept as tables, only those of sequences that the labelled sample has enter a ratio: elsewhere
both classes have the same backoff. What comes to the driver is therefore bounded by the sample, and nothing is left out.

A document's features are length-normalised log-likelihood ratios of its words: the mean of all, of the highest window,
of the two highest words, and of what words have above a floor, since a few words decide and long texts hide them in
a mean. A logistic function, fitted on labelled documents that the models haven't seen, makes the score of them.

Cases: a null or empty text has no words and gets the score of ratio 0; without labels of both classes every score
is 0; equal texts get equal scores; words are runs of letters and digits, lower-cased, and every letter of every word
counts, in texts of any length (one text is held at a time); an empty table gives an empty result; columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, bounded_texts, crc32_mod, cut, pieces, table

#: Labelled documents of each class that the models learn from, and bytes of their texts, at most; a fifth of them fit the score only.
SAMPLE, MOST_BYTES = 3000, 12_000_000
#: Letters of a sequence; discount; weight of the shared backoff besides the discount.
ORDER, DISCOUNT, PRIOR = 8, 0.75, 2.0
#: Words whose ratio a worker remembers; words and sequences that a worker gathers before it sends them.
MOST_WORDS, HELD = 400_000, 400_000
#: Words of a window, floor of a word's ratio, and the score from which a document is predicted toxic.
WINDOW, FLOOR, LEAST = 6, 2.0, 0.3
#: Letters that stand before and after a word; no word holds them.
BEGIN, END = "^" * (ORDER - 1), "$"

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class _Ratios(dict):
    """Log-likelihood ratio of each word met so far."""

    def __init__(self, table: dict[str, float]):
        self.table = table

    def __missing__(self, word: str) -> float:
        s, known, v = BEGIN + word + END, self.table, 0.0
        for k in range(len(s) - ORDER + 1):
            r = known.get(s[k : k + ORDER])
            v += known.get(s[k : k + ORDER - 1], 0.0) if r is None else r
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = v
        return v


_made: dict[str, _Ratios] = {}


@dataclass
class Model:
    """Log-likelihood ratios, toxic over ordinary, of a last letter, by sequence; by sequence without it, of one that neither class has there."""

    keys: pa.Array = field(default_factory=lambda: pa.array([], pa.string()))
    values: pa.Array = field(default_factory=lambda: pa.array([], pa.float64()))
    weights: list[float] = field(default_factory=list)  # logistic: bias, then one for each feature
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def ratios(self) -> _Ratios:
        """One for each worker process, which keeps it from task to task until another model comes."""
        if self.name not in _made:
            _made.clear()
            _made[self.name] = _Ratios(dict(zip(self.keys.to_pylist(), self.values.to_pylist(), strict=True)))
        return _made[self.name]

    def score(self, x: tuple[float, ...]) -> float:
        if not self.weights:
            return 0.0
        z = self.weights[0] + sum(a * b for a, b in zip(self.weights[1:], x, strict=True))
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def features(text: str | None, ratio: _Ratios) -> tuple[float, float, float, float]:
    w = words(text)
    if not w:
        return 0.0, 0.0, 0.0, 0.0
    r = np.fromiter(map(ratio.__getitem__, w), float, len(w))
    run = np.concatenate([[0.0], np.cumsum(r)])
    k = min(WINDOW, len(w))
    top = np.partition(r, len(r) - 2)[-2:] if len(r) > 1 else r
    return float(run[-1] / len(w)), float((run[k:] - run[:-k]).max() / k), float(top.mean()), float(np.maximum(r - FLOOR, 0).mean())


def _pairs(sample: DataFrame) -> DataFrame:
    """Different pairs of neighbouring words, (v, w, toxic), v empty at the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set = set()

        def batch():
            rows = list(found)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True)], ["v", "w", "toxic"])

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(text)
                found.update(zip(["", *w], w, [toxic] * len(w), strict=False))
                if len(found) > 300_000:
                    yield batch()
                    found.clear()
        if found:
            yield batch()

    return sample.select("text", "toxic").mapInArrow(run, "v string, w string, toxic int").distinct()


def _sequences(w: Column) -> Column:
    whole = F.concat(F.lit(BEGIN), w, F.lit(END))
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda k: F.substr(whole, k, F.lit(ORDER))))


def _corpus_sequences(docs: DataFrame) -> DataFrame:
    """Every different sequence of ORDER letters in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        found: set[str] = set()

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["g"])

        for b in pieces(batches, 64):
            new: set[str] = set()
            for text in b.column(0).to_pylist():
                new.update(words(text))
            new -= known
            for w in new:
                s = BEGIN + w + END
                found.update([s[k : k + ORDER] for k in range(len(w) + 1)])
            if len(known) >= HELD:
                known.clear()
            known |= new
            if len(found) >= HELD:
                yield batch()
                found.clear()
        if found:
            yield batch()

    return docs.select("text").mapInArrow(run, "g string").distinct()


def _shared(sequences: DataFrame) -> DataFrame:
    """(g, s): the shared probability of the last letter of each sequence of ORDER - 1 letters, after those before it."""
    counts = []
    longer = sequences
    for k in range(ORDER - 1, 0, -1):
        longer = cut(longer.groupBy(F.substr("g", F.lit(2), F.lit(k)).alias("g")).agg(F.count("*").alias("c")), f"toxicity-{k}")
        counts.append(longer)
    letters = counts.pop()
    total, types = letters.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    out = letters.selectExpr("g", f"(greatest(c - {DISCOUNT}D, 0D) + {DISCOUNT}D) / {max(total, 1)}D as s") if types else letters.selectExpr("g", "0D as s")
    for k in range(2, ORDER):
        c = counts.pop()
        ahead = F.substr("g", F.lit(1), F.lit(k - 1)).alias("h")
        context = c.groupBy(ahead).agg(F.sum("c").alias("n"), F.count("*").alias("t"))
        c = c.select("g", "c", ahead, F.substr("g", F.lit(2), F.lit(k - 1)).alias("l"))
        out = c.join(context, "h").join(out.withColumnRenamed("g", "l"), "l").selectExpr("g", f"(greatest(c - {DISCOUNT}D, 0D) + {DISCOUNT}D * t * s) / n as s")
    return out


def _ratio_table(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, ratio): log-likelihood ratios by sequence and, for letters that no class has there, by what comes before."""
    each = pairs.groupBy("w", "toxic").agg(F.count("*").alias("n")).select(_sequences(F.col("w")).alias("g"), "toxic", "n")
    both = [F.coalesce(F.sum(F.when(F.col("toxic") == c, F.col("n"))), F.lit(0)).alias(f"k{c}") for c in (0, 1)]
    seen = cut(each.groupBy("g").agg(*both), "toxicity-sample")
    ahead = F.substr("g", F.lit(1), F.lit(ORDER - 1)).alias("h")
    types = [F.count(F.when(F.col(f"k{c}") > 0, 1)).alias(f"t{c}") for c in (0, 1)]
    context = cut(seen.groupBy(ahead).agg(F.sum("k0").alias("n0"), F.sum("k1").alias("n1"), *types), "toxicity-contexts")
    given = seen.select("g", "k0", "k1", ahead, F.substr("g", F.lit(2), F.lit(ORDER - 1)).alias("l"))
    given = given.join(context, "h").join(shared.withColumnRenamed("g", "l"), "l")

    def p(c: int) -> str:
        return f"IF(n{c} > 0, (greatest(k{c} - {DISCOUNT}D, 0D) + ({DISCOUNT}D * t{c} + {PRIOR}D) * s) / (n{c} + {PRIOR}D), s)"

    def rest(c: int) -> str:
        return f"IF(n{c} > 0, ({DISCOUNT}D * t{c} + {PRIOR}D) / (n{c} + {PRIOR}D), 1D)"

    out = given.selectExpr("g as key", f"ln({p(1)}) - ln({p(0)}) as ratio")
    return out.unionByName(context.selectExpr("h as key", f"ln({rest(1)}) - ln({rest(0)}) as ratio"))


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights for (1, x...), ordinary documents three times as heavy as toxic ones; Newton steps with a small ridge."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / dev])
    share = np.where(y == 1, 0.25 / max(1, (y == 1).sum()), 0.75 / max(1, (y == 0).sum())) * len(y)
    b, ridge = np.zeros(z.shape[1]), 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (share * (y - p)) - ridge * b
        h = (z * (share * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b))
        b = b + np.linalg.solve(h, g)
    return [float(b[0] - (b[1:] * mean / dev).sum()), *(b[1:] / dev).tolist()]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most `sample` documents and MOST_BYTES of text of each class among labels (doc_id, toxic)."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = bounded_sample(known.filter("toxic = 1"), "doc_id", sample).unionByName(bounded_sample(known.filter("toxic = 0"), "doc_id", sample))
    rows = bounded_texts(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "toxic", sample, MOST_BYTES)  # at most 2 * sample ids
    rows = cut(rows.repartition(16), "toxicity-sample").withColumn("_fold", F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(5)))
    pairs = cut(_pairs(rows.filter("_fold > 0")), "toxicity-pairs")
    if pairs.select("toxic").distinct().count() < 2:
        return Model()
    found = _ratio_table(pairs, _shared(cut(_corpus_sequences(docs), "toxicity-sequences"))).toArrow()  # bounded by the sample
    model = Model(found.column("key").combine_chunks(), found.column("ratio").combine_chunks())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value.ratios()
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([list(features(t, ratio)) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))], ["toxic", "x"])

    held = rows.filter("_fold = 0").select("text", "toxic").repartition(4)  # a fifth of the sample: few tasks need the ratios
    held = sorted(held.mapInArrow(run, "toxic int, x array<double>").collect())
    y = np.array([r.toxic for r in held])
    model.weights = _logistic(np.array([r.x for r in held], float), y) if len(set(y.tolist())) == 2 else [-4.0, 0.0, 0.0, 1.0, 0.0]
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document, one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        ratio = m.ratios()
        for b in pieces(batches):
            scores = [m.score(features(t, ratio)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(crc32_mod(F.col("doc_id"), 4) != 2)
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
