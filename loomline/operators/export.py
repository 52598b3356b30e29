"""Nested JSON for exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(key, json): each parent with an ordered list of its children."""
    kids = children.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("_x")))), lambda x: x["_x"]).alias(name))
    d = parents.join(kids, key, "left")
    return d.select(key, F.to_json(F.struct(*[c for c in d.columns])).alias("json"))


def envelope(sections: dict[str, DataFrame]) -> DataFrame:
    """One row: an object that holds each section's JSON as a text. sections: one row with a column json each."""
    out = None
    for name, df in sections.items():
        one = df.select(F.col("json").alias(name))
        out = one if out is None else out.join(one, F.lit(True), "full_outer")
    return out.select(F.to_json(F.struct(*sections)).alias("envelope"))
