"""Approximate nearest neighbours by cosine, over balanced posting lists.

Centroids come from balanced k-means on a bounded sample; every vector is posted to its nearest list, and vectors
near a boundary to several. A query walks a neighbour graph of the centroids held in memory, with links both ways and
an entry in each of its separate parts, so that every list can be reached; a distance ratio, chosen on the sample with
such walks for the wanted recall, prunes the lists it visits. Lists that lie near each other are put together into
parts of a bounded number of rows, and lists that grew past that are split by a hash; a query goes once to each part
that holds any of its lists. Queries are dealt into blocks of a bounded number, so a task holds one part and one block, however
many rows and queries there are, and returns the best few exactly scored rows. Equal vectors are stored once, with the
smallest ids that any query can need.

Cases: null, empty and zero vectors and those with null or non-finite components take no part, nor do vectors of
another length than the most frequent one; ties go to the smaller id; with fewer than k candidates all are
returned; repeated rows (same id and vector) count once; of several vectors under one id, the smallest is the query and
the nearest the candidate; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Lists, and rows of a part, at most (about so many for parts of a list that is split); rows of a list on average.
MOST_LISTS, MOST_PART, PER_LIST = 16_384, 8_192, 256
#: Queries of a block, about; rows that a task sends out at once; queries whose lists one task looks up.
QUERIES, SENT, LOOKED_UP = 16_384, 4_096, 128
#: Vectors that the index is fitted on: this many, or PER_CENTROID for each list where that is more, so 65,536 at most.
SAMPLE, PER_CENTROID = 20_000, 4
#: Numbers of a block of distances to centroids.
BLOCK = 1 << 22
#: Lists that a boundary vector is posted to, and how much farther than the nearest their centroids may be.
COPIES, BOUNDARY = 3, 1.03
#: Recall to reach on the sample, queries for measuring it.
RECALL, PROBES = 0.97, 400
#: Neighbours of a centroid in the graph, besides those that it is a neighbour of; entries, at least.
DEGREE, ENTRIES = 24, 16


@dataclass
class Index:
    centroids: np.ndarray  # unit length
    graph: list[np.ndarray]  # neighbours of each centroid, both ways
    entries: np.ndarray  # centroids where walks begin, some in each part of the graph
    ratio: float  # a list is visited if its distance is at most this times that of the nearest
    k: int

    def lists(self, q: np.ndarray) -> list[np.ndarray]:
        """Lists to visit for each query: a best-first walk that goes on while it finds centroids within the ratio."""
        return [self._walk(x) for x in q]

    def _walk(self, x: np.ndarray) -> np.ndarray:
        c, g = self.centroids, self.graph
        starts = self.entries
        dist = dict(zip(starts.tolist(), np.maximum(2 - 2 * (c[starts] @ x), 1e-9).tolist(), strict=True))
        todo = [(d, i) for i, d in dist.items()]
        heapq.heapify(todo)
        best = min(dist.values())
        limit = self.ratio * self.ratio
        while todo:
            d, i = heapq.heappop(todo)
            if d > best * limit * 1.1 and len(dist) > 64:  # a margin around the pruned region
                break
            new = [j for j in g[i].tolist() if j not in dist]
            if new:
                nd = np.maximum(2 - 2 * (c[new] @ x), 1e-9).tolist()
                for j, e in zip(new, nd, strict=True):
                    dist[j] = e
                    heapq.heappush(todo, (e, j))
                best = min(best, min(nd))
        return np.array([i for i, d in dist.items() if d <= best * limit], np.int64)

    def post(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each posting: the nearest list, and others about as near."""
        rows, lists = [], []
        step = _step(len(self.centroids))
        for at in range(0, len(x), step):
            d = np.sqrt(np.maximum(2 - 2 * (x[at : at + step] @ self.centroids.T), 0))
            m = min(COPIES, d.shape[1])
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            nd = np.take_along_axis(d, near, 1)
            r, c = np.nonzero(nd <= BOUNDARY * nd.min(1, keepdims=True) + 1e-12)
            rows.append(r + at)
            lists.append(near[r, c])
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *lists])


def _step(lists: int) -> int:
    """Rows whose distances to all centroids are held at once."""
    return max(1, min(2048, BLOCK // lists))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means; a centroid's pull shrinks with the share of rows it has, which evens out the lists."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    weight, step = np.zeros(k), _step(k)
    for _ in range(rounds):
        owner = np.concatenate([np.argmax(x[a : a + step] @ c.T - weight, axis=1) for a in range(0, len(x), step)])
        count = np.bincount(owner, minlength=k)
        weight += 0.02 * (count / (len(x) / k) - 1).clip(-1, 4)
        sums = np.zeros_like(c)
        np.add.at(sums, owner, x)
        empty = count == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = _unit(sums + 1e-12)
    return c


def _graph(c: np.ndarray) -> list[np.ndarray]:
    """The nearest centroids of each, and those that it is one of the nearest of."""
    n = len(c)
    m = min(DEGREE, n - 1)
    if not m:
        return [np.zeros(0, np.int64)]
    out: list[np.ndarray] = []
    step = _step(n)
    for at in range(0, n, step):
        s = -(c[at : at + step] @ c.T)
        s[np.arange(len(s)), np.arange(at, at + len(s))] = np.inf  # not itself
        out += list(np.argpartition(s, m - 1, axis=1)[:, :m])
    a, b = np.repeat(np.arange(n), m), np.concatenate(out)
    links = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.split(links % n, np.searchsorted(links // n, np.arange(1, n)))


def _entries(c: np.ndarray, graph: list[np.ndarray]) -> np.ndarray:
    """One centroid in each part of the graph, then those farthest from all entries so far: twice the root of the lists, or ENTRIES."""
    n = len(c)
    part = np.full(n, -1)
    found: list[int] = []
    for i in range(n):
        if part[i] < 0:
            part[i], todo = len(found), [i]
            found.append(i)
            while todo:
                new = graph[todo.pop()]
                new = new[part[new] < 0]
                part[new] = part[i]
                todo += new.tolist()
    near = np.full(n, -2.0)
    for i in found:
        near = np.maximum(near, c @ c[i])
    while len(found) < min(n, max(ENTRIES, 2 * int(n**0.5))):
        near[found] = np.inf
        found.append(int(np.argmin(near)))
        near = np.maximum(near, c @ c[found[-1]])
    return np.array(sorted(found))


def lists_of(rows: int) -> int:
    return max(1, min(MOST_LISTS, rows // PER_LIST))


def sample_of(rows: int, least: int = SAMPLE) -> int:
    """Vectors to fit the lists of a table of so many rows on."""
    return max(least, PER_CENTROID * lists_of(rows))


def fit(sample: np.ndarray, rows: int, k: int, recall: float = RECALL) -> Index:
    """Centroids, their graph, and the ratio with which enough of the sample's own neighbours are found."""
    x = _unit(sample.astype(np.float64))
    lists = int(max(1, min(lists_of(rows), len(x) // PER_CENTROID)))
    probe = np.random.default_rng(9).choice(len(x), min(PROBES, len(x)), replace=False)
    # of the probes, as many take no part in the centroids as of all rows: those in it lie nearer to their list
    apart = probe[: min(round(len(probe) * (1 - min(1, len(x) / rows))), len(x) - lists)]
    c = _k_means(np.delete(x, apart, 0), lists) if lists > 1 else _unit(x.mean(0, keepdims=True) + 1e-9)
    graph = _graph(c)
    index = Index(c, graph, _entries(c, graph), 1.0, k)
    if lists == 1:
        return index
    post_rows, post_lists = index.post(x)
    of: list[list[int]] = [[] for _ in range(len(x))]
    for r, li in zip(post_rows.tolist(), post_lists.tolist(), strict=True):
        of[r].append(li)
    need, wanted = [], []  # by true neighbour: the ratio that reaches one of its lists; by probe: the lists of each
    for q in probe.tolist():
        s = x @ x[q]
        s[q] = -2
        d = np.sqrt(np.maximum(2 - 2 * (c @ x[q]), 1e-9))
        true = np.argsort(-s, kind="stable")[:k].tolist()
        need += [min(d[of[t]]) / d.min() for t in true]
        wanted.append([of[t] for t in true])
    index.ratio = float(np.quantile(need, recall)) * 1.005
    # what the walk itself misses; with a ratio above all others it visits every list
    while True:
        reached = [not seen.isdisjoint(li) for seen, near in zip((set(v.tolist()) for v in index.lists(x[probe])), wanted, strict=True) for li in near]
        if np.mean(reached) >= recall:
            break
        index.ratio *= 1.05
    return index


_HITS = "query_id bigint, vec_id bigint, score double"


def _deal(index: Index, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of the parts of each list: near lists share one while their rows fit in, empty lists have none."""
    c = index.centroids
    step = _step(len(index.entries))
    near = np.concatenate([np.argmax(c[at : at + step] @ c[index.entries].T, axis=1) for at in range(0, len(c), step)])
    first, number = np.zeros(len(c), np.int64), -(-counts // MOST_PART)
    free, held = 0, MOST_PART
    for i in np.argsort(near, kind="stable").tolist():
        if number[i] > 1:
            first[i], free, held = free, free + number[i], MOST_PART
        elif number[i]:
            if held + counts[i] > MOST_PART:
                free, held = free + 1, 0
            first[i], held = free - 1, held + counts[i]
    return first, number


def _visits(index: Index, first: np.ndarray, number: np.ndarray, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(part, vec_id, v) of the parts that each query has to visit, a bounded number of rows at a time."""
    most = max(1, int(number.sum()))
    step = max(1, SENT // most)
    for f in frames:
        for at in range(0, len(f), step):
            some = f.iloc[at : at + step]
            parts = []
            for found in index.lists(_unit(np.stack(some["v"].to_numpy()).astype(np.float64))):
                whole, split = found[number[found] == 1], found[number[found] > 1]
                parts.append(np.unique(np.concatenate([first[whole], *[np.arange(first[i], first[i] + number[i]) for i in split.tolist()]])))
            for b in range(0, sum(map(len, parts)), SENT):  # one query may have more than that
                row = np.repeat(np.arange(len(some)), [len(x) for x in parts])[b : b + SENT]
                yield pd.DataFrame({"part": np.concatenate(parts)[b : b + SENT], "vec_id": some["vec_id"].to_numpy()[row], "v": some["v"].to_numpy()[row]})


def _part(k: int):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The best k of one part for each query of a block, scored on the original vectors."""
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        rows = rows[~pd.Series([v.tobytes() for v in rows["v"]], rows.index).duplicated()]  # copies in several lists of the part
        x = np.stack(rows["v"].to_numpy()).astype(np.float64)
        norm = np.sqrt((x * x).sum(1))
        near = (x / norm[:, None]).astype(np.float32).T
        ids = rows["ids"].tolist()
        out = []
        for at in range(0, len(queries), 256):
            block = queries.iloc[at : at + 256]
            q = np.stack(block["v"].to_numpy()).astype(np.float64)
            qn = np.sqrt((q * q).sum(1))
            s = (q / qn[:, None]).astype(np.float32) @ near
            m = min(k + 1, s.shape[1])
            floor = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m] - np.float32(1e-5)  # more than single precision loses
            for i, me in enumerate(block["vec_id"].tolist()):
                pick = np.flatnonzero(s[i] >= floor[i])
                exact = (x[pick] * q[i]).sum(1) / (norm[pick] * qn[i])
                best: dict = {}
                for e, p in sorted(zip((-exact).tolist(), pick.tolist(), strict=True)):
                    for t in ids[p]:
                        if t != me:
                            best[int(t)] = min(e, best.get(int(t), 2.0))
                out += [(me, t, -e) for e, t in heapq.nsmallest(k, [(e, t) for t, e in best.items()])]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (floats stay floats, half the bytes to move; sums are in doubles) of the rows that take part."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select("vec_id", F.col("embedding").cast(kind).alias("v")).filter("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(~bad & F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("v") == (sizes[0] if sizes else 0))


def search(vectors: DataFrame, is_query, k: int = 5, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of (vec_id, embedding) that is_query selects, its k nearest other rows.

    The index is fitted on `sample` rows, or on PER_CENTROID a list where those are more.
    """
    spark = vectors.sparkSession
    v = cut(usable(vectors), "ann-vectors")
    rows, kind = v.count(), v.schema["v"].dataType.simpleString()
    picked = v.orderBy(F.xxhash64("vec_id", F.lit(31)), "vec_id").limit(sample_of(rows, sample)).select("v").toArrow().column("v").combine_chunks()
    if not len(picked):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index = spark.sparkContext.broadcast(fit(picked.flatten().to_numpy().reshape(len(picked), -1), rows, k))  # at most MOST_LISTS centroids
    # equal vectors once, with the k + 1 smallest ids: a query can be one of them
    order = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))  # map tasks keep the first ones only
    groups = v.withColumn("_rank", order).filter(F.col("_rank") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                r, li = index.value.post(_unit(np.stack(f["v"].to_numpy()).astype(np.float64)))
                out = f.iloc[r].copy()
                out["list"] = li
                yield out[["list", "v", "ids"]]

    posted = cut(groups.mapInPandas(post, f"list bigint, v {kind}, ids array<bigint>"), "ann-lists")
    counts = np.zeros(len(index.value.centroids), np.int64)
    for r in posted.groupBy("list").count().collect():  # at most MOST_LISTS rows
        counts[r["list"]] = r["count"]
    first, number = _deal(index.value, counts)
    dealt = spark.sparkContext.broadcast((first, number))
    asked = v.filter(is_query)
    n_asked = asked.count()
    blocks = max(1, -(-n_asked // QUERIES))
    queries = asked.repartition(max(1, -(-n_asked // LOOKED_UP)), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"))
    visits = queries.mapInPandas(lambda frames: _visits(index.value, *dealt.value, frames), f"part bigint, vec_id bigint, v {kind}")
    visits = visits.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    of = spark.createDataFrame(pd.DataFrame({"list": np.arange(len(first)), "first": first, "number": number}), "list bigint, first bigint, number bigint")
    posted = posted.join(F.broadcast(of), "list")  # at most MOST_LISTS rows
    posted = posted.withColumn("part", F.col("first") + F.pmod(F.xxhash64("v"), F.col("number"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tasks = int(max(1, min(4_096, blocks * ((first + number).max(initial=1)))))
    met = [d.select("part", "block", *own).repartition(tasks, "part", "block").groupBy("part", "block") for d, own in ((posted, ("v", "ids")), (visits, ("vec_id", "v")))]
    hits = met[0].cogroup(met[1]).applyInPandas(_part(k), _HITS)
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "vec_id"))), 1, k).alias("_b"))
    out = best.select("query_id", F.posexplode("_b").alias("_p", "_x"))
    return out.select("query_id", (F.col("_p") + 1).alias("rank"), F.col("_x.vec_id").alias("vec_id"), (-F.col("_x.d")).alias("score"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
