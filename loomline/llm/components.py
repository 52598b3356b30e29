"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of long ids to (node, component), the component being its smallest node.

    Alternates large and small stars: each node hands its larger, then its smaller neighbours to the smallest one
    it knows, until no edge changes. Minima are aggregated before they are shuffled, so a node with very many
    edges meets no single task but in joins, which Spark splits.
    """
    now = cut(edges.filter("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), "cc-edges")
    told = None
    while True:
        both = now.unionByName(now.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").selectExpr("m as a", "b").filter("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.selectExpr("m as a", "a as b").filter("a <> b").unionByName(small.selectExpr("m as a", "b")).distinct()
        small = cut(small, "cc-stars")
        sums = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = small
        if sums == told:
            break
        told = sums
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(now.selectExpr("a as node", "a as component").distinct())
