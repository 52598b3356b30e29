"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one vector kept of each group.

Vectors are compared under equal labels only. Every label with more than PER_CELL different vectors gets its own
centroids by spherical k-means, fitted by Spark jobs on a sample that grows with the cells. A vector lives in the
cell of its nearest centroid and is a guest in each other cell that may hold a partner: one within the angle of the
threshold can lie behind the plane between two centroids only if that plane is within the angle (an exact test), so no pair is
lost between cells, and each vector's links are counted once, in its own cell. Cells are cut into blocks of homes and
of members, which bounds what a task holds whatever the cell's size; a block answers with numbers of links and with a
forest of edges instead of all pairs. The core of a cell is made of its vectors within half the angle of the centroid. All of them are links of each
other, and of any vector whose angle to the centroid leaves room for the whole core, which needs no comparison: so a
tight group with a large share of all rows costs counts, not pairs. Equal vectors of a label are compared once, with
their number as weight.

Cases: vectors that are null, empty, zero or hold null or non-finite components, rows without a label and rows without an id link with nothing
(n_links 0, component_id their own id, kept); vectors of another length are never compared; rows repeated with the same
id are links of each other, and the rows under one id are one node of the groups; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, table
from .components import components

THRESHOLD = 0.98
#: Different vectors of a cell on average; cells of one run at most (a broadcast of so many centroids), larger tables get larger cells.
PER_CELL, MOST_CELLS = 4_000, 65_536
#: Rows sampled for each centroid, rounds of k-means.
PER_CENTROID, ROUNDS = 40, 4
#: Homes, and members, of one task.
BLOCK = 4_000
#: Room for rounding in bounds that spare a comparison.
SLACK = 1e-7


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v of the rows that take part; floats stay floats, sums are in doubles."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast(kind).alias("v")).filter("vec_id is not null and label is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter(~bad & F.exists("v", lambda x: x != 0))


def _matrix(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    return x / np.abs(x).max(1, keepdims=True)  # no squares out of range


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cosines(rows: pd.DataFrame, c: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """So many rows of one area at a time, their unit vectors and cosines to its centroids."""
    x, step = _unit(_matrix(rows["v"])), max(1, 4_000_000 // len(c))
    for at in range(0, len(x), step):
        yield rows.iloc[at : at + step], x[at : at + step], x[at : at + step] @ c.T


def fit(different: DataFrame, cells: dict[str, int], rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Centroids by area: spherical k-means over a sample, assignment and sums by Spark, a row a centroid to the driver."""
    spark = different.sparkSession
    wanted = spark.createDataFrame(sorted(cells.items()), "area string, cells int")
    share = different.groupBy("area").count().join(F.broadcast(wanted), "area").selectExpr("area", f"cells * {PER_CENTROID} / count as share")
    dealt = (F.pmod(F.xxhash64("uid", F.lit(77)), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    sample = cut(different.join(F.broadcast(share), "area").filter(dealt < F.col("share")).select("area", "uid", "v"), "dedup-sample")
    first = F.row_number().over(Window.partitionBy("area").orderBy(F.xxhash64("uid", F.lit(5))))
    seeds = sample.withColumn("_n", first).join(F.broadcast(wanted), "area").filter(F.col("_n") <= F.col("cells")).select("area", "v").toPandas()
    centres = {area: _unit(_matrix(rows["v"])) for area, rows in seeds.groupby("area")}
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centres)

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[tuple[str, int], np.ndarray] = {}
            for f in frames:
                for area, rows in f.groupby("area", sort=False):
                    for _, x, s in _cosines(rows, sent.value[area]):
                        own = s.argmax(1)
                        for c in np.unique(own).tolist():
                            total[area, c] = total.get((area, c), 0) + x[own == c].sum(0)
            yield pd.DataFrame([(a, c, v) for (a, c), v in total.items()], columns=["area", "c", "v"])

        parts = sample.mapInPandas(sums, "area string, c int, v array<double>").groupBy("area", "c").agg(F.collect_list("v").alias("vs"))  # a row a task
        summed = F.aggregate(F.slice("vs", 2, F.size("vs")), F.col("vs")[0], lambda x, y: F.zip_with(x, y, lambda p, q: p + q))
        for area, c, v in parts.select("area", "c", summed.alias("v")).toPandas().itertuples(index=False):
            new = np.asarray(v, np.float64)
            if (norm := np.sqrt((new * new).sum())) > 0:
                centres[area][c] = new / norm
    discard(sample)
    return centres


def _block(threshold: float):
    def run(key, visitors: pd.DataFrame, homes: pd.DataFrame) -> pd.DataFrame:
        """Links of each visitor with these homes, by weight, and a forest of edges that joins what links."""
        if not len(visitors) or not len(homes):
            return pd.DataFrame({"uid": [], "links": [], "to": []})
        x, y = _matrix(visitors["v"]), _matrix(homes["home_v"])
        xn, yn = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
        ids, others, weight = visitors["uid"].to_numpy(), homes["home_uid"].to_numpy(), homes["home_n"].to_numpy()
        links, names = np.zeros(len(x), np.int64), np.unique(np.concatenate([ids, others]))
        a, b = np.searchsorted(names, ids), np.searchsorted(names, others)
        root = np.arange(len(names))
        for at in range(0, len(x), 512):
            s = (x[at : at + 512] @ y.T) / xn[at : at + 512, None] / yn
            hit = s >= threshold
            for i, j in zip(*np.nonzero(np.abs(s - threshold) < 1e-12), strict=True):  # close calls one by one
                hit[i, j] = (x[at + i] * y[j]).sum() / (xn[at + i] * yn[j]) >= threshold
            hit &= a[at : at + 512, None] != b
            links[at : at + 512] = hit @ weight
            i, j = np.nonzero(hit)
            root = _join(root, a[at + i], b[j])
        found, linked = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(links)
        return pd.concat([pd.DataFrame({"uid": ids[linked], "links": links[linked], "to": names[root[a[linked]]]}), pd.DataFrame({"uid": names[found], "links": 0, "to": names[root[found]]})], ignore_index=True)

    return run


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots, the smallest of each part, after joining a with b."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, low, high = a[apart], b[apart], np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
        np.minimum.at(root, high, low)
        while (root != (up := root[root])).any():
            root = up
    return root


def links(different: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(uid, links) and edges (a, b) of different vectors (area, uid, n, v)."""
    spark = different.sparkSession
    kind = different.schema["v"].dataType.simpleString()
    per_cell = max(PER_CELL, -(-different.count() // MOST_CELLS))
    large = different.groupBy("area").count().filter(F.col("count") > per_cell).collect()  # fewer than MOST_CELLS
    cells = {r["area"]: -(-r["count"] // per_cell) for r in large}
    sent = spark.sparkContext.broadcast(fit(different, cells) if cells else {})
    angle = float(np.arccos(threshold))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each vector at home, and as a guest where a partner may live."""
        for f in frames:
            small = ~f["area"].isin(sent.value.keys())
            yield f[small].assign(cell=0, home=True, far=np.pi)
            for area, rows in f[~small].groupby("area", sort=False):
                c = sent.value[area]
                for part, _, s in _cosines(rows, c):
                    own = s.argmax(1)
                    gap = np.sqrt(np.maximum(2 - 2 * (c[own] @ c.T), 0))
                    i, j = np.nonzero((s.max(1, keepdims=True) - s <= np.sin(angle) * gap + SLACK) | (np.arange(len(c)) == own[:, None]))
                    yield part.iloc[i].assign(cell=j, home=own[i] == j, far=np.arccos(np.clip(s[i, j], -1, 1)))

    placed = cut(different.select("area", "uid", "n", "v").mapInPandas(place, f"area string, uid bigint, n bigint, v {kind}, cell bigint, home boolean, far double"), "dedup-cells")
    inner = F.col("home") & (F.col("far") <= angle / 2 - SLACK)
    core = lambda x: F.when(inner, x)
    cell = ["area", "cell"]
    stats = placed.groupBy(*cell).agg(F.max(core(F.col("far"))).alias("reach"), F.sum(core(F.col("n"))).alias("mass"), F.min(core(F.col("uid"))).alias("head"), F.count(core(F.lit(1))).alias("_in"), F.count_if(F.col("home") & ~inner).alias("_out"), F.count("*").alias("_all"))
    rows = placed.join(cut(stats, "dedup-stats"), cell).withColumn("core", inner).withColumn("spared", F.coalesce(F.col("far") + F.col("reach") <= angle - SLACK, F.lit(False)))
    # with a core that all of it links with, a vector isn't compared: its weight counts, and one edge joins them
    whole = rows.filter("spared").select("uid", (F.col("mass") - F.when(F.col("core"), F.col("n")).otherwise(0)).alias("links"), F.col("head").alias("to"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    meetings = cut(rows.groupBy(*cell).agg(blocks(F.count_if(~F.col("spared"))).alias("v_in"), blocks(F.first("_in")).alias("h_in"), blocks(F.first("_all")).alias("v_out"), blocks(F.first("_out")).alias("h_out")), "dedup-blocks")
    key, cols = [*cell, "core", "_v", "_h"], ["uid", "n", "v"]
    deal = lambda seed, n: F.pmod(F.xxhash64("uid", F.lit(seed)), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    hits = []
    placed_in = rows.select(*cell, *cols, "home", F.col("core").alias("_core"), "spared").join(meetings, cell)
    for core_homes, v, h in ((True, F.col("v_in"), F.col("h_in")), (False, F.col("v_out"), F.col("h_out"))):
        meet = placed_in.filter((v > 0) & (h > 0)).withColumn("core", F.lit(core_homes))
        visitors = meet.filter(~F.col("spared")) if core_homes else meet
        visitors = visitors.withColumn("_v", deal(3, v)).withColumn("_h", spread(h)).select(*key, *cols)
        homes = meet.filter(F.col("home") & (F.col("_core") == core_homes)).withColumn("_h", deal(9, h)).withColumn("_v", spread(v)).select(*[F.col(c).alias("home_" + c) for c in [*key, *cols]])
        hits.append(visitors.groupBy(*key).cogroup(homes.groupBy(*["home_" + c for c in key])).applyInPandas(_block(threshold), "uid bigint, links bigint, to bigint"))
    out = cut(hits[0].unionByName(hits[1]).unionByName(whole), "dedup-links")
    return out.groupBy("uid").agg(F.sum("links").alias("links")), out.filter("uid <> to").selectExpr("uid as a", "to as b").distinct()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of (vec_id, label, embedding)."""
    v = cut(usable(vectors).withColumn("area", F.concat("label", F.lit("/"), F.size("v").cast("string"))), "dedup-vectors")
    # equal vectors of a label are one node, named by their smallest id; several nodes of that name get others
    groups = cut(v.groupBy("area", "v").agg(F.min("vec_id").alias("head"), F.count("*").alias("n")), "dedup-groups")
    groups = cut(groups.withColumn("uid", F.monotonically_increasing_id()), "dedup-nodes")
    counted, edges = links(groups.select("area", "uid", "n", "v"), threshold)
    node = v.select("vec_id", "area", "v").join(groups.select("area", "v", "uid", "head", "n"), ["area", "v"]).select("vec_id", "uid", "head", "n")
    node = cut(node, "dedup-rows")
    heads = groups.select("uid", "head")
    by_id = edges.join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = components(by_id.unionByName(node.select(F.col("vec_id").alias("a"), F.col("head").alias("b"))))
    rows = node.join(counted, "uid", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.unionByName(_left_out(vectors)).join(found.toDF("vec_id", "_c"), "vec_id", "left")
    component = F.coalesce("_c", "vec_id")
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _left_out(vectors: DataFrame) -> DataFrame:
    """Rows that take no part."""
    v, bad = F.col("embedding"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good: Column = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return vectors.filter(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP13_SQL = r"""
WITH RECURSIVE
good AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit AS (SELECT *, row_number() OVER () AS r, sqrt(list_dot_product(v, v)) AS norm FROM good),
pairs AS (SELECT a.r AS ra, a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
    WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM good UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
part AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT u.vec_id, count(p.b) AS n_links FROM unit u LEFT JOIN pairs p ON p.ra = u.r GROUP BY u.r, u.vec_id)
SELECT n.vec_id, n.n_links::BIGINT AS n_links, component_id, n.vec_id = component_id AS kept FROM n JOIN part USING (vec_id)
UNION ALL
SELECT e.vec_id, 0::BIGINT, coalesce(p.component_id, e.vec_id), coalesce(coalesce(p.component_id, e.vec_id) = e.vec_id, true) FROM embeddings e LEFT JOIN part p USING (vec_id)
WHERE NOT coalesce(e.vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false)
"""
