"""Ranked lexical search: Block-Max WAND over an inverted index of compressed posting blocks.

The index is made where the documents lie: each task cuts its documents into segments of a bounded number of postings and
writes their lists as blocks of BLOCK postings (gaps and frequencies as variable-length bytes), each with its first and
last document and its maximum impact, beside a table of the segment's documents. So a term that every document holds is a
few blocks in every segment, never one long list, and no text is shuffled. A search sends the blocks of the wanted terms
to their segment. There each query walks its segment in document order: shallow pointers, on the blocks' ends only, give for
every stretch between ends the sum of the maximum impacts of the blocks over it; stretches whose sum can't reach the
threshold are passed over with their blocks still compressed, the others are decompressed (once a segment, for all
queries) and scored, and the tenth best score so far is the threshold. It begins at a score that ten documents of the whole index surely
have, the tenth largest block maximum of one of the query's terms, and rises with the stretches of the highest sums, which are
looked at first.

Cases: a null text, or one without terms, is no document of the index; rows that repeat an id are documents of their own, and equal in rank but for
chance; a null id comes after others at equal scores; rows that share a query id are one query with all their terms, and those with a
null id are one query; a query without terms or matches gets no rows; an empty table on either side gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pieces, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: UTF-8 bytes of terms stay, A-Z in lower case; all others become spaces.
BYTES = bytes(ord(chr(b).lower()) if chr(b) in UPPER else b if b >= 128 or chr(b) in LOWER + "0123456789" else 32 for b in range(256))
#: Postings of a block, postings and documents of a segment, stretches that are scored together.
BLOCK, MOST_POSTINGS, MOST_DOCS, STRETCHES = 128, 2_000_000, 500_000, 32
#: (query, term) pairs of one pass over the index, which go to all tasks.
MOST_TERMS = 500_000

INDEX = "segment bigint, term string, block int, first int, last int, n int, best bigint, postings binary, ids array<bigint>, sizes array<bigint>"
_INDEX = pa.schema(
    [("segment", pa.int64()), ("term", pa.string()), ("block", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("n", pa.int32()), ("best", pa.int64()), ("postings", pa.binary())]
    + [("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes, seven bits each and the high bit on all but the last, and where each value begins (one place more)."""
    v = values.astype(np.int64)
    size = np.ones(len(v), np.int64)
    for bits in range(7, 63, 7):
        size += v >> bits > 0
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(at[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[at[:-1][has] + k] = (v[has] >> 7 * k & 127) | (size[has] > k + 1) << 7
    return out, at


def decode(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    if len(ends) == len(b):
        return b.astype(np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * place, starts)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def norms(sizes: list[int], documents: int, terms: int) -> np.ndarray:
    return np.array([10 + 90 * n * documents // terms for n in sizes], np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with terms, and their terms."""
    for b in pieces(batches):
        sizes = [len(x.translate(BYTES).split()) for x in b["text"].cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_pydict({"documents": [sum(n > 0 for n in sizes)], "terms": [sum(sizes)]})


class _Names(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = len(self)
        return self[term]


class Segment:
    """Documents that a task gathers, and their blocks."""

    def __init__(self) -> None:
        self.names, self.ids, self.sizes, self.distinct = _Names(), [], [], []
        self.terms, self.tf = array("i"), array("q")

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = Counter(text.translate(BYTES).split())
        if words:
            self.terms.extend(map(self.names.__getitem__, words))
            self.tf.extend(words.values())
            self.ids.append(doc_id)
            self.sizes.append(words.total())
            self.distinct.append(len(words))

    def full(self) -> bool:
        return len(self.terms) >= MOST_POSTINGS or len(self.ids) >= MOST_DOCS

    def blocks(self, number: int, documents: int, terms: int) -> Iterator[pa.RecordBatch]:
        ids = np.frombuffer(self.terms, np.int32)
        order = np.argsort(ids, kind="stable")
        docs, tf = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.distinct)[order], np.frombuffer(self.tf, np.int64)[order]
        ids = ids[order]
        begins = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        inside = np.arange(len(ids)) - np.repeat(begins, np.diff(np.append(begins, len(ids))))
        at = np.flatnonzero(inside % BLOCK == 0)
        best = np.maximum.reduceat(impact(tf, norms(self.sizes, documents, terms)[docs]), at)
        gaps = np.diff(docs, prepend=0)
        gaps[at] = 0
        (gap_bytes, gap_at), (tf_bytes, tf_at) = encode(gaps), encode(tf)
        gap_bytes, tf_bytes, ends = gap_bytes.tobytes(), tf_bytes.tobytes(), np.append(at[1:], len(ids))
        names = [t.decode() for t in self.names]
        yield pa.RecordBatch.from_pylist([{"segment": number, "ids": self.ids, "sizes": self.sizes}], schema=_INDEX)
        for lo in range(0, len(at), 50_000):
            some = slice(lo, lo + 50_000)
            a, e = at[some], ends[some]
            packed = [gap_bytes[p:q] + tf_bytes[r:s] for p, q, r, s in zip(gap_at[a].tolist(), gap_at[e].tolist(), tf_at[a].tolist(), tf_at[e].tolist(), strict=True)]
            cols = [np.full(len(a), number), [names[i] for i in ids[a].tolist()], inside[a] // BLOCK, docs[a], docs[e - 1], e - a, best[some], packed]
            cols = [pa.array(c, f.type) for c, f in zip(cols, _INDEX, strict=False)]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(a), f.type) for f in list(_INDEX)[len(cols) :])], schema=_INDEX)


class Index:
    """documents and terms: the numbers N and L of the whole table; blocks: the written index."""

    def __init__(self, docs: DataFrame) -> None:
        rows = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        sums = rows.select("text").mapInArrow(_count, "documents bigint, terms bigint").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0)))
        self.documents, self.terms = count, length = sums.first()

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made, part, segment = 0, TaskContext.get().partitionId(), Segment()
            for b in pieces(batches):
                for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].cast(pa.large_binary()).to_pylist(), strict=True):
                    segment.add(doc_id, text)
                    if segment.full():
                        yield from segment.blocks((part << 32) + made, count, length)
                        made, segment = made + 1, Segment()
            if segment.ids:
                yield from segment.blocks((part << 32) + made, count, length)

        self.blocks = cut(rows.mapInArrow(build, INDEX), "lexical-index") if count else None

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """item_id, rank, doc_id, score: for each item (item_id, text) its k best documents."""
        spark = queries.sparkSession
        wanted = queries.select("item_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term")).distinct()
        wanted = cut(wanted, "lexical-queries")
        passes = max(1, -(-wanted.count() // MOST_TERMS))
        found = spark.createDataFrame([], f"item_id {queries.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
        for p in range(passes if self.documents else 0):
            found = found.unionByName(self._pass(wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p), k))
        return found

    def _pass(self, wanted: DataFrame, k: int) -> DataFrame:
        spark, N = wanted.sparkSession, self.documents
        terms = F.broadcast(wanted.select("term").distinct())  # MOST_TERMS of them at most
        blocks = self.blocks.filter("term is not null").join(terms, "term", "left_semi")
        df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("best")))
        tops = blocks.select("term", "best", place.alias("place")).filter(F.col("place") <= k).groupBy("term").agg(F.min("best").alias("least"), F.count("*").alias("many"))
        weight = F.floor(1000 * F.log((2.0 * N + 2) / (2 * F.col("df") + 1))).cast("long")
        rows = wanted.join(df, "term").join(tops, "term").select("item_id", "term", weight.alias("w"), F.when(F.col("many") == k, F.col("least")).otherwise(0).alias("least"))
        items: dict[object, list[tuple[str, int, int]]] = {}
        for r in rows.collect():  # MOST_TERMS of them at most
            items.setdefault(r.item_id, []).append((r.term, r.w, r.w * r.least))
        names = list(items)
        sent = spark.sparkContext.broadcast([([(t, w) for t, w, _ in items[i]], max(x for _, _, x in items[i])) for i in names])
        walk = _walker(sent, self.documents, self.terms, k)
        here = self.blocks.filter("term is null").unionByName(blocks.select(*self.blocks.columns))
        hits = here.groupBy("segment").applyInPandas(walk, "item int, doc_id bigint, score bigint")
        order = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        top = hits.withColumn("rank", order).filter(F.col("rank") <= k)
        kind = wanted.schema["item_id"].dataType.simpleString()
        ids = spark.createDataFrame([(n, i) for n, i in enumerate(names)], f"item int, item_id {kind}")
        return top.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


class List:
    """The blocks of one term in one segment; what has been decompressed is kept."""

    def __init__(self, rows: pd.DataFrame, m: np.ndarray) -> None:
        self.first, self.last, self.best = rows["first"].to_numpy(np.int64), rows["last"].to_numpy(np.int64), rows["best"].to_numpy(np.int64)
        self.postings, self.m, self.open = rows["postings"].tolist(), m, {}

    def shallow(self, starts: np.ndarray) -> np.ndarray:
        """The block over each place, or -1."""
        j = np.searchsorted(self.last, starts)
        inside = j < len(self.last)
        inside[inside] = self.first[j[inside]] <= starts[inside]
        return np.where(inside, j, -1)

    def block(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        if j not in self.open:
            v = decode(self.postings[j])
            docs, tf = self.first[j] + np.cumsum(v[: len(v) // 2]), v[len(v) // 2 :]
            self.open[j] = docs, impact(tf, self.m[docs])
        return self.open[j]


def walk_query(lists: list[tuple[List, int]], ids: np.ndarray, theta: int, k: int, sums: np.ndarray, inside: np.ndarray) -> list[tuple[int, int]]:
    """(document, score) of the best k with a score of theta at least; sums and inside are scratch, zero and false before and after."""
    edges = np.unique(np.concatenate([x for li, _ in lists for x in (li.first, li.last + 1)]))
    starts, ends = edges[:-1], edges[1:]
    over = [li.shallow(starts) for li, _ in lists]
    bound = np.zeros(len(starts), np.int64)
    for (li, w), j in zip(lists, over, strict=True):
        bound += np.where(j >= 0, w * li.best[j], 0)
    best: list[tuple[int, int]] = []

    def score(some: np.ndarray) -> None:
        nonlocal best, theta
        docs = np.concatenate([np.arange(a, b) for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
        inside[docs] = True
        for (li, w), j in zip(lists, over, strict=True):
            for b in np.unique(j[some]).tolist():
                if b >= 0:
                    at, value = li.block(b)
                    here = inside[at]
                    sums[at[here]] += w * value[here]
        got = sums[docs]
        sums[docs], inside[docs] = 0, False
        new = np.flatnonzero(got >= theta)
        if len(new) > k:  # only those that tie with the best k, or beat them
            new = new[got[new] >= np.partition(got[new], len(new) - k)[len(new) - k]]
        best = sorted(best + [(-int(got[i]), ids[docs[i]], int(docs[i])) for i in new.tolist()])[:k]
        if len(best) == k:
            theta = max(theta, -best[-1][0])

    theta = max(theta, 1)
    ahead = np.argsort(-bound, kind="stable")[:4]  # the highest sums first, for a threshold to begin with
    ahead = np.sort(ahead[bound[ahead] >= theta])
    if len(ahead):
        score(ahead)
    done = np.zeros(len(starts), bool)
    done[ahead] = True
    at = 0
    while len(todo := at + np.flatnonzero((bound[at:] >= theta) & ~done[at:])[:STRETCHES]):
        score(todo)
        at = int(todo[-1]) + 1
    return [(doc, -s) for s, _, doc in best]


def _walker(sent, documents: int, terms: int, k: int):
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        head, rows = rows[rows["term"].isna()], rows[rows["term"].notna()].sort_values(["term", "block"], kind="stable")
        ids, out = list(head["ids"].iloc[0]), []
        ranks = np.array([(1 << 63) - 1 if i is None or i != i else int(i) for i in ids], np.int64)
        m = norms([int(n) for n in head["sizes"].iloc[0]], documents, terms)
        lists = {t: List(r, m) for t, r in rows.groupby("term", sort=False)}
        sums, inside = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        for item, (query, theta) in enumerate(sent.value):
            mine = [(lists[t], w) for t, w in query if t in lists]
            if mine:
                out += [(item, None if ranks[d] == (1 << 63) - 1 else int(ranks[d]), s) for d, s in walk_query(mine, ranks, theta, k, sums, inside)]
        return pd.DataFrame({"item": pd.Series([r[0] for r in out], dtype="int32"), "doc_id": pd.Series([r[1] for r in out], dtype="Int64"), "score": pd.Series([r[2] for r in out], dtype="int64")})

    return walk


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Index(table(spark, sf_dir, "documents")).search(table(spark, sf_dir, "benchmark"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents WHERE text IS NOT NULL),
size AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
whole AS (SELECT count(*) AS c, sum(n)::BIGINT AS l FROM size),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark WHERE text IS NOT NULL),
weight AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * c + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM wanted) GROUP BY term), whole),
scored AS (SELECT item_id, s.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * c) // l))))::BIGINT AS score
    FROM wanted JOIN weight USING (term) JOIN tf USING (term) JOIN size s ON s.r = tf.r, whole GROUP BY item_id, s.r, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
