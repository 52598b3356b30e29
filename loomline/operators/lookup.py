"""Catalog and locale lookups: joins with stated fallbacks, first- and last-wins merges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: References that travel with each row as one array.
MOST_REFS = 1_000


def resolve(rows: DataFrame, names: DataFrame, on: Sequence[str], name: str, fallback: Column) -> DataFrame:
    """Left join with a name that falls back to an expression. names has one row per key."""
    return rows.join(names, list(on), "left").withColumn(name, F.coalesce(F.col(name), fallback))


def resolve_chain(rows: DataFrame, steps: Sequence[tuple[DataFrame, str, str]], out: str, fallback: Column) -> DataFrame:
    """Several lookups in turn, the first hit wins. steps: (names, key, name column), one row per key each."""
    got = []
    for i, (names, key, name) in enumerate(steps):
        rows = rows.join(names.select(key, F.col(name).alias(f"_lk{i}")), key, "left")
        got.append(F.col(f"_lk{i}"))
    return rows.withColumn(out, F.coalesce(*got, fallback)).drop(*[f"_lk{i}" for i in range(len(steps))])


def matched_and_missing(rows: DataFrame, names: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Inner join, and the rows without a partner for the report."""
    return rows.join(names, list(on)), rows.join(names, list(on), "left_anti")


def _nth(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; Spark keeps one row per key in each task before the shuffle."""
    return _nth(df, keys, [F.col(c).asc() for c in order])


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _nth(df, keys, [F.col(c).desc() for c in order])


def merge_fields(df: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key: of each field the first (or last) value that isn't null."""
    by = F.struct(*order)
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(*[pick(F.col(f), F.when(F.col(f).isNotNull(), by)).alias(f) for f in fields])


def alias_owners(df: DataFrame, alias: str, owner: str, order: Sequence[str]) -> DataFrame:
    """alias, its first owner, and whether other owners claim it."""
    return df.filter(F.col(alias).isNotNull()).groupBy(alias).agg(F.min_by(owner, F.struct(*order)).alias(owner), F.count("*").alias("claims"), (F.min(owner) != F.max(owner)).alias("conflict"))


def override_union(layers: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Later layers win by key."""
    out = None
    for i, layer in enumerate(layers):
        layer = layer.withColumn("_layer", F.lit(i))
        out = layer if out is None else out.unionByName(layer, allowMissingColumns=True)
    return last_wins(out, keys, ["_layer"]).drop("_layer")


def concat_sections(sections: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """All rows of all sections with the section's name and ordinal."""
    out = None
    for i, (name, df) in enumerate(sections):
        df = df.withColumns({"section": F.lit(name), "section_ord": F.lit(i)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def coverage(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are in both, missing and stale."""
    both = expected.select(key).distinct().withColumn("_e", F.lit(True)).join(present.select(key).distinct().withColumn("_p", F.lit(True)), key, "full_outer")
    return both.agg(F.count_if(F.col("_e") & F.col("_p")).alias("present"), F.count_if(F.col("_p").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("stale"))


def unless_present(rows: DataFrame, section: str, stronger: str, components: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Drop rows of component sections where the stronger section is present (in the same group)."""
    found = rows.filter(F.col(section) == stronger)
    weaker = F.col(section).isin(*components)
    if by:
        groups = found.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        suppressed = rows.filter(weaker).join(groups, same, "left_anti")
    else:
        suppressed = rows.filter(weaker).join(found.limit(1).agg((F.count("*") > 0).alias("_has")), F.lit(True)).filter("not _has").drop("_has")  # one row
    return rows.filter(~F.coalesce(weaker, F.lit(False))).unionByName(suppressed)


def nearest(rows: DataFrame, refs: DataFrame, distance: Callable[[Column], Column], row_key: Sequence[str], label: str, order: str) -> DataFrame:
    """row_key, label and distance of the nearest reference of each row, the first in order on ties; distance takes a reference as a struct.

    Up to MOST_REFS references, counted first, go to the rows as one array, so nothing is shuffled; more of them are dealt
    into blocks of that size, a row meets each block, and the best of the blocks is its best.
    """
    blocks = max(1, -(-refs.count() // MOST_REFS))
    listed = refs.groupBy(F.pmod(F.xxhash64(order), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct(*refs.columns)).alias("_refs"))

    def scored(r: Column) -> Column:
        return F.struct(distance(r).alias("distance"), r[order].alias("order"), r[label].alias("label"))

    met = rows.join(listed.select("_refs"), F.lit(True))  # a row for each block
    best = met.select(*row_key, F.array_min(F.transform("_refs", scored)).alias("_b"))
    if blocks > 1:
        best = best.groupBy(*row_key).agg(F.min("_b").alias("_b"))
    return best.select(*row_key, F.col("_b.label").alias(label), F.col("_b.distance").alias("distance"))
