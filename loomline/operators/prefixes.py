"""Names and values found by prefixes, overrides and a chain of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import upper_camel
from .lookup import resolve_chain

#: Different lengths of prefixes in one table, at most.
MOST_LENGTHS = 64


def longest_prefix(rows: DataFrame, key: str, prefixes: DataFrame, prefix: str, value: str, out: str) -> DataFrame:
    """rows with `out`: the value of the longest prefix of the key that the table has, NULL without one.

    Every different key has a row for each length that prefixes have, cut to it, and meets the table in one equi join. The table has one row a prefix.
    """
    lengths = [r[0] for r in prefixes.filter(F.length(prefix) > 0).select(F.length(prefix)).distinct().orderBy(F.length(prefix)).limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"prefixes of more than {MOST_LENGTHS} lengths")
    keys = rows.select(F.col(key).cast("string").alias("_key")).filter("_key is not null").distinct()
    cuts = F.array(*[F.when(F.length("_key") >= n, F.substring("_key", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    met = keys.select("_key", F.explode(F.array_compact(cuts)).alias("_cut")).join(prefixes.select(F.col(prefix).alias("_cut"), F.col(value).alias("_value")), "_cut")
    best = met.groupBy("_key").agg(F.max_by("_value", F.length("_cut")).alias(out))
    return rows.join(best, F.col(key).cast("string") == F.col("_key"), "left").drop("_key")


def overridden(rows: DataFrame, key: str, overrides: DataFrame, of: str, to: str) -> DataFrame:
    """rows whose key is replaced where a table of overrides (one row a key) has it."""
    found = overrides.select(F.col(of).alias(key), F.col(to).alias("_to"))
    return rows.join(found, key, "left").withColumn(key, F.coalesce("_to", F.col(key))).drop("_to")


def slug(name: Column) -> Column:
    """Lower case without apostrophes of either form and without spaces."""
    return F.regexp_replace(F.lower(F.trim(name)), "['’ ]", "")


def slug_join(rows: DataFrame, name: str, names: DataFrame, key: str, overrides: DataFrame | None = None) -> DataFrame:
    """rows that find a key by its slug, with that key: the row's slug, or what it is overridden to (overrides: slug, to); the smaller key if two have one slug."""
    r = rows.withColumn("_slug", slug(F.col(name)))
    if overrides is not None:
        r = overridden(r, "_slug", overrides, "slug", "to")
    known = names.groupBy(slug(F.col(key)).alias("_slug")).agg(F.min(key).alias(key))
    return r.join(known, "_slug").drop("_slug")


def resolve_cost(rows: DataFrame, refs: Sequence[str], known: DataFrame, inferred: Sequence[str], prefixes: DataFrame, given: str, out: str = "cost") -> DataFrame:
    """rows with a cost and the step that found it: metadata (ref, cost) by each of the refs in turn, else the longest prefix (prefix, cost) of each inferred column in turn, else the given value as a whole number.

    A reference that is known without a cost doesn't end the search.
    """
    # each step has a table under its own column names
    steps = [(known.filter("cost is not null").select(F.col("ref").alias(c), F.col("cost").alias("_cost")), c, "_cost") for c in refs]
    d = rows.withColumns({f"_as_{c}": F.col(c) for c in refs}).withColumns({c: F.col(c).cast("string") for c in refs})
    d = resolve_chain(d, steps, "_known", F.lit(None).cast("bigint"))
    d = d.withColumns({c: F.col(f"_as_{c}") for c in refs}).drop(*[f"_as_{c}" for c in refs])
    for i, c in enumerate(inferred):
        d = longest_prefix(d, c, prefixes, "prefix", "cost", f"_prefix{i}")
    by_prefix = F.coalesce(*[F.col(f"_prefix{i}") for i in range(len(inferred))]).cast("bigint")
    own = F.col(given).cast("string").try_cast("bigint")
    step = F.when(F.col("_known").isNotNull(), "metadata").when(by_prefix.isNotNull(), "prefix").when(own.isNotNull(), "given").otherwise("unknown")
    return d.select(*rows.columns, F.coalesce(F.col("_known").cast("bigint"), by_prefix, own).alias(out), step.alias("step"))


def resolve_name(rows: DataFrame, id_col: str, key_col: str, by_id: DataFrame, by_key: DataFrame, out: str = "name") -> DataFrame:
    """rows with a display name and the step: by id (id, name), by the squashed key or alias (alias, name), else the words of the key joined in upper camel case, else NULL."""
    ids = by_id.select(F.col("id").cast("string").alias("_id"), F.col("name").alias("_by_id"))
    keys = by_key.groupBy(F.regexp_replace(F.lower("alias"), r"[^\p{L}\p{N}]", "").alias("_key")).agg(F.min(F.struct("alias", "name"))["name"].alias("_by_key"))
    d = rows.withColumn("_id", F.col(id_col).cast("string")).withColumn("_key", F.nullif(F.regexp_replace(F.lower(F.col(key_col)), r"[^\p{L}\p{N}]", ""), F.lit("")))
    d = d.join(ids, "_id", "left").join(keys, "_key", "left")
    token = F.nullif(upper_camel(F.col(key_col)), F.lit(""))
    step = F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_key").isNotNull(), "key").when(token.isNotNull(), "words").otherwise("none")
    return d.withColumns({out: F.coalesce("_by_id", "_by_key", token), "step": step}).drop("_id", "_key", "_by_id", "_by_key")
