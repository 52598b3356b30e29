"""Filters and projections that say what they drop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_text


def at_least(df: DataFrame, **least) -> DataFrame:
    """Rows that reach every threshold; a null doesn't."""
    for c, v in least.items():
        df = df.filter(F.col(c) >= v)
    return df


def flag_below(df: DataFrame, column: str, least, flag: str = "below_minimum") -> DataFrame:
    """All rows, with a flag for those under the threshold; a null isn't under it."""
    return df.withColumn(flag, F.coalesce(F.col(column) < least, F.lit(False)))


def pick_ids(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a wanted id, and the wanted ids that no row has."""
    return df.join(ids, key, "left_semi"), ids.join(df, key, "left_anti")


def half_open(df: DataFrame, key: str, start: int, end: int) -> DataFrame:
    if start > end:
        raise ValueError("start is beyond end")
    return df.filter((F.col(key) >= start) & (F.col(key) < end))


def search(df: DataFrame, query: str, *fields: str) -> DataFrame:
    """Rows whose fields, joined by spaces, hold the query literally in any case; a blank query keeps all."""
    q = query.strip().lower()
    return df.filter(search_text(*fields).contains(q)) if q else df


def categorised(df: DataFrame, key: str, pattern: str, out: str = "category") -> DataFrame:
    """Rows whose key matches from its start, with the first group."""
    return df.withColumn(out, F.nullif(F.regexp_extract(key, "^(?:" + pattern + ")", 1), F.lit(""))).filter(F.col(out).isNotNull())


def only_allowed(df: DataFrame, text: str, allowed: str, keep_empty: bool = False) -> DataFrame:
    """Texts without other characters; those left empty go unless kept. allowed: a character class body."""
    d = df.withColumn(text, F.regexp_replace(text, f"[^{allowed}]", ""))
    return d if keep_empty else d.filter(F.col(text) != "")


def allowlist(df: DataFrame, text: str) -> DataFrame:
    """One row: all characters of all texts in either case, sorted."""
    ch = df.select(F.explode(F.split(text, "")).alias("c")).filter("c <> ''").distinct()
    every = ch.select(F.explode(F.array("c", F.lower("c"), F.upper("c"))).alias("c")).distinct()
    return every.agg(F.array_join(F.array_sort(F.collect_list("c")), "").alias("allowed"))


def unpivot_lines(df: DataFrame, key: Sequence[str], labels: dict[str, str]) -> DataFrame:
    """(key, ord, line): one 'label: value' line for each field that isn't null or empty."""
    items = [F.struct(F.lit(i).alias("ord"), F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), F.concat(F.lit(label + ": "), F.col(c).cast("string"))).alias("line")) for i, (c, label) in enumerate(labels.items())]
    return df.select(*key, F.inline(F.array(*items))).filter("line is not null")


def colour_mask(pixel: Sequence[Column], ranges: Sequence[tuple], background: Sequence[tuple] = ()) -> Column:
    """Whether a pixel is inside one of the inclusive (low, high) ranges and in none of the background's."""

    def inside(rs):
        out = F.lit(False)
        for low, high in rs:
            one = F.lit(True)
            for p, a, b in zip(pixel, low, high, strict=True):
                one = one & p.between(a, b)
            out = out | one
        return out

    return inside(ranges) & ~inside(background)


def single_key(df: DataFrame, map_col: str) -> DataFrame:
    """Rows whose map has exactly one entry, flattened to key and value."""
    e = F.get(F.map_entries(map_col), 0)
    return df.filter(F.size(map_col) == 1).withColumns({"key": e["key"], "value": e["value"]})


def first_kind(rules: list[tuple[Column, str]], default: str = "unknown") -> Column:
    """The kind of the first rule (condition, kind) that holds; a null condition doesn't."""
    return F.coalesce(*[F.when(condition, F.lit(kind)) for condition, kind in rules], F.lit(default))


def with_default(value: Column, default: str, *blank: str) -> Column:
    """value, or the default where it is null or one of the texts that stand for nothing."""
    return F.when(value.isNull() | value.isin(*blank), F.lit(default)).otherwise(value) if blank else F.coalesce(value, F.lit(default))
