"""Quality rules: statistics of each text, fixed base rules, and an isolation forest over the statistics.

Trees split random statistics at random values until documents stand alone; documents that few splits isolate are
anomalous. Each tree is grown on a draw of its own from all documents, as the method has it, and the threshold is set on the
scores of all labelled ones, which are counted in bins of equal width; then every document is judged in one pass without
a shuffle. The statistics of all documents are written once as a table, which draws and scores are taken from. Two of the forest's statistics stop growing, as
length alone is no fault: texts of more than 402 words have one length for it, and lines of more than 147 words one width; the
returned statistics don't.

Cases: a null or empty text has no words and fails the base rule; a very long text is read whole, its words and their
windows of three being held while it is judged, one text at a time; equal texts get equal verdicts; without labels
(no table, none left, or of one class) the threshold is the score that `SHARE` of all documents exceed; an empty
table gives an empty result; columns besides doc_id and text are ignored by `judge` and kept by `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pieces, table

TREES, PER_TREE = 128, 256
#: Bins that scores from 0 to 1 are counted in.
BINS = 1 << 18
#: Share of anomalies where no labels tell.
SHARE = 0.1

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50

_WS = [0x20, *range(0x09, 0x0E)]
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "bangs", "bars", "variety", "line_words")


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], tuple[float, ...]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the forest's features."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # on space and 0x09-0x0D only
    n = len(words)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(text) - int(byte[_WS].sum())
    symbols = int(byte[list(SYMBOLS)].sum())
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    dup = len(lines) - len(set(lines))
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            count: dict = {}
            for w in windows:
                count[w] = count.get(w, 0) + 1
            upto = 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeated += i + 3 - max(i, upto)
                    upto = i + 3
    c, w = max(chars, 1), max(n, 1)
    features = (
        min(np.log1p(n), 6.0), chars / w, symbols / c, dup / max(len(lines), 1), repeated / w, int(byte[65:91].sum()) / c,
        int(byte[48:58].sum()) / c, int(byte[33]) / c, int(byte[124]) / w, len(set(words)) / w / max(0.2, 1 - 0.09 * np.log1p(n)), min(np.log1p(n / max(len(lines), 1)), 5.0),
    )
    return (n, chars, symbols, dup, repeated), features


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), split value, children, and at leaves the path length there."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    depth: int
    norm: float
    threshold: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): towards 1 for anomalies."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t][at]
                go = np.where(x[rows, np.maximum(f, 0)] < self.value[t][at], self.left[t][at], self.right[t][at])
                at = np.where(f < 0, at, go)
            total += self.path[t][at]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def _expected(n: int) -> float:
    """Mean path of an unsuccessful search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = 7, drawn: list[np.ndarray] | None = None) -> Forest:
    """Trees on rows of x: those drawn for each, or per_tree at random."""
    rng = np.random.default_rng(seed)
    size = max(map(len, drawn), default=0) if drawn is not None else min(per_tree, len(x))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = 2 ** (depth + 1) - 1
    made = [np.full((trees, nodes), v, d) for v, d in ((-1, np.int64), (0, float), (0, np.int64), (0, np.int64), (0, float))]
    feature, value, left, right, path = made
    for t in range(trees):
        mine = drawn[t] if drawn is not None else rng.choice(len(x), size, replace=False) if size else np.array([], int)
        todo, free = [(0, mine, 0)], 1
        while todo:
            at, rows, d = todo.pop()
            part = x[rows]
            spread = np.flatnonzero(part.max(0) > part.min(0)) if len(rows) > 1 else []
            if d >= depth or len(spread) == 0:
                path[t, at] = d + _expected(len(rows))
                continue
            f = rng.choice(spread)
            v = rng.uniform(part[:, f].min(), part[:, f].max())
            below = part[:, f] < v
            feature[t, at], value[t, at], left[t, at], right[t, at] = f, v, free, free + 1
            todo += [(free, rows[below], d + 1), (free + 1, rows[~below], d + 1)]
            free += 2
    return Forest(feature, value, left, right, path, depth, max(_expected(size), 1.0))


def calibrate(scores: np.ndarray, good: np.ndarray, n: np.ndarray | None = None, step: float = 1e-6) -> float:
    """The threshold with the most anomalies above it, less three for each good document above it, as shares.

    n counts the documents of each score, which are `step` apart at least.
    """
    n = np.ones(len(scores)) if n is None else n
    order = np.argsort(-scores, kind="stable")
    s, g, n = scores[order], good[order], n[order]
    if len(set(good.tolist())) < 2:
        return float(s[np.searchsorted(np.cumsum(n), SHARE * n.sum())]) if len(s) else 1.0
    gain = np.cumsum(~g * n) / (~g * n).sum() - 3 * np.cumsum(g * n) / (g * n).sum()
    ends = np.flatnonzero(np.append(s[1:] < s[:-1], True))  # a threshold doesn't split equal scores
    k = ends[np.argmax(gain[ends])]
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else s[k] - step)) / 2) if gain[k] > 0 else float(s[0]) + step


_STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = [list(map(float, statistics(t)[1])) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, x array<double>")


def _draws(rows: DataFrame, trees: int, per_tree: int) -> DataFrame:
    """(tree, _h, x) of per_tree rows for each tree, any row as likely: those with the smallest hashes, of some eight times as many that come into question."""
    share = min(1.0, 8 * per_tree / max(1, rows.count()))
    least = min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1)
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    d = rows.select("doc_id", "x", F.xxhash64("doc_id", "x").alias("_h")).select("doc_id", "x", "_h", tree)
    d = d.withColumn("_h", F.xxhash64("_h", "tree")).filter(F.col("_h") <= F.lit(least))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("_h", "doc_id", "x"))
    return d.withColumn("_i", place).filter(F.col("_i") <= per_tree).select("tree", "_i", "x")


def _counted(rows: DataFrame, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, good, n): how many of the rows (good, x) have a score, by bins; at most two numbers a bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, len(FEATURES))
            at = np.minimum((forest.scores(x) * BINS).astype(np.int64), BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0)], ["bin", "good"])

    got = rows.select("good", "x").mapInArrow(run, "bin bigint, good boolean").groupBy("bin", "good").count().orderBy("bin", "good").toArrow()
    return (got["bin"].to_numpy() + 0.5) / BINS, got["good"].to_numpy(), got["count"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame | None = None, trees: int = TREES, per_tree: int = PER_TREE) -> Forest:
    """Grow on draws from all documents and calibrate on all of those with a quality label (0 or 1)."""
    rows = cut(_features(docs), "quality-features")
    got = sorted((r.tree, r._i, r.x) for r in _draws(rows, trees, per_tree).collect())  # trees * per_tree
    x = np.array([r[2] for r in got], float).reshape(len(got), len(FEATURES))
    owner = np.array([r[0] for r in got], np.int64)
    forest = grow(x, trees, per_tree, drawn=[np.flatnonzero(owner == t) for t in range(trees)])
    if labels is not None:
        known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q"))
        score, good, n = _counted(rows.join(known, "doc_id").withColumn("good", F.col("_q") == 1), forest)
        if len(set(good.tolist())) == 2:
            forest.threshold = calibrate(score, good, n, 1 / BINS)
            return forest
    score, good, n = _counted(rows.withColumn("good", F.lit(True)), forest)
    forest.threshold = calibrate(score, good, n, 1 / BINS)
    return forest


def _verdicts(texts: list[str | None], forest: Forest):
    both = [statistics(t) for t in texts]
    base = np.array([s for s, _ in both], np.int64).reshape(-1, 5)
    x = np.array([f for _, f in both], float).reshape(-1, len(FEATURES))
    score = forest.scores(x)
    failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
    return base, score, failed, ~failed & (score < forest.threshold)


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and the forest's score."""
    schema = f"doc_id bigint, {_STATS}, base_failed boolean, kept boolean, anomaly double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            base, score, failed, kept = _verdicts(b.column(1).to_pylist(), forest)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(base[:, k]) for k in range(5)], pa.array(failed), pa.array(kept), pa.array(score)], [c.split()[0] for c in schema.split(", ")])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


def keep(docs: DataFrame, forest: Forest) -> DataFrame:
    """The documents that are kept, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield b.filter(pa.array(_verdicts(b.column(at).to_pylist(), forest)[3]))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
