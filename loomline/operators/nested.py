"""Values of any nesting: flattened to paths and leaves, and brought into one canonical form for digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def depth(json: Column) -> Column:
    """How many brackets are open at most in a JSON text, strings left out."""
    bare = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"', "")
    steps = F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, c):
        now = acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(steps, zero, step, lambda acc: acc["most"])


def flatten(rows: DataFrame, key: Sequence[str], json: str) -> DataFrame:
    """key, path (a.b[2].c), kind and leaf (as text) of every leaf of JSON texts, however deep they are nested.

    Each level is one lateral explode, of as many levels as the deepest text has: that is counted first. A null is a leaf, an
    empty object or list has none, a bare value has the empty path; a null or malformed text, or one that names a key twice, has no rows.
    A name that holds a dot or a bracket stands in the path as it is.
    """
    v = rows.select(*key, F.try_parse_json(json).alias("_v"), F.col(json).alias("_j")).filter("_v is not null")
    levels = v.agg(F.max(depth(F.col("_j")))).first()[0] or 0
    v = v.select(*key, F.lit("").alias("path"), "_v")
    for _ in range(levels):
        parts = v.lateralJoin(v.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()).toDF("_pos", "_key", "_value"))
        name = F.when(F.col("path") == "", F.col("_key")).otherwise(F.concat("path", F.lit("."), "_key"))
        place = F.concat("path", F.lit("["), F.col("_pos").cast("string"), F.lit("]"))
        inner = F.col("_pos").isNotNull()  # else a leaf, or empty, which stays as it is
        v = parts.select(*key, F.when(F.col("_key").isNotNull(), name).when(inner, place).otherwise(F.col("path")).alias("path"), F.when(inner, F.col("_value")).otherwise(F.col("_v")).alias("_v"))
    v = v.withColumn("kind", F.schema_of_variant("_v")).filter(~F.col("kind").isin("OBJECT<>", "ARRAY<VOID>"))
    return v.select(*key, "path", "kind", F.try_variant_get("_v", "$", "string").alias("leaf"))


def flatten_columns(rows: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The same for columns of any type: structs, lists and maps."""
    return flatten(rows.select(*key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("_json")), key, "_json")


def ascii_json(text: Column) -> Column:
    r"""JSON text with every character beyond ASCII as \uXXXX, those beyond 16 bits as two."""
    runs = F.regexp_extract_all(text, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]+"), F.lit(0))
    escaped = lambda r: F.regexp_replace(F.lower(F.hex(F.encode(r, "UTF-16BE"))), "(.{4})", r"\\u$1")
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^[\x00-\x7F]"), r).otherwise(escaped(r))), "")


def canonical_json(json: Column) -> Column:
    """JSON text with sorted keys at every level, no space, numbers in their shortest form and only ASCII; NULL if it is no JSON.

    Equal values have one canonical form whatever the order of their keys, their spacing, escapes and trailing zeros.
    """
    return ascii_json(F.to_json(F.try_parse_json(json)))


def record_digest(json: Column, index: Column) -> Column:
    """The first ten hexadecimal digits of the sha1 of a record's canonical form and its index."""
    return F.substring(F.sha1(F.concat(canonical_json(json), F.lit("#"), index.cast("string")).cast("binary")), 1, 10)


def rule_signatures(rules: DataFrame) -> DataFrame:
    """(rule, signature) of rows (rule, setting, value): a rule keeps its signature as long as its settings are the same, in any order; of a setting given twice the largest value counts."""
    once = rules.groupBy("rule", "setting").agg(F.max("value").alias("value"))
    settings = F.map_from_entries(F.sort_array(F.collect_list(F.struct("setting", F.coalesce("value", F.lit("null"))))))
    return once.groupBy("rule").agg(F.sha2(canonical_json(F.to_json(settings)), 256).alias("signature"))
