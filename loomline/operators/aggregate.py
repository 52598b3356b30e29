"""Keyed inventory aggregation, reports, and small statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inventory(rows: DataFrame, key: str, count: str) -> DataFrame:
    """Sum of counts by key; rows without key or count are skipped."""
    return rows.filter(F.col(key).isNotNull() & F.col(count).isNotNull()).groupBy(key).agg(F.sum(count).alias(count))


def merge_inventories(parts: Sequence[DataFrame], key: str, count: str) -> DataFrame:
    return inventory(reduce(DataFrame.unionByName, [p.select(key, count) for p in parts]), key, count)


def restack(rows: DataFrame, key: str, count: str, order: Sequence[str], caps: DataFrame) -> DataFrame:
    """Rewrite rows that repeat a whole total to full stacks and a remainder.

    A key's rows change if there are two or more, all with the same count T above the cap, and as many as stacks
    are needed for T; the first ones become the cap and the last one what is left. caps: (key, cap).
    """
    w = Window.partitionBy(key)
    d = rows.join(caps, key, "left").withColumns({
        "_n": F.count("*").over(w), "_lo": F.min(count).over(w), "_hi": F.max(count).over(w), "_i": F.row_number().over(w.orderBy(*order)),
    })
    need = F.ceil(F.col(count) / F.col("cap"))
    whole = (F.col("_n") > 1) & (F.col("_lo") == F.col("_hi")) & (F.col(count) > F.col("cap")) & (F.col("_n") == need)
    left = F.col(count) - (F.col("_n") - 1) * F.col("cap")
    new = F.when(F.coalesce(whole, F.lit(False)), F.when(F.col("_i") < F.col("_n"), F.col("cap")).otherwise(left)).otherwise(F.col(count))
    return d.withColumn(count, new.cast(rows.schema[count].dataType)).drop("_n", "_lo", "_hi", "_i", "cap")


def counts_by_kind(rows: DataFrame, kind: str, kinds: DataFrame) -> DataFrame:
    """Counts of every known kind, also of those without rows."""
    return kinds.select(kind).join(rows.groupBy(kind).agg(F.count("*").alias("n")), kind, "left").select(kind, F.coalesce("n", F.lit(0)).alias("n"))


def share(part: Column, whole: Column, empty: float = 1.0) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(empty))


def grouped_median(rows: DataFrame, key: str, values: str) -> DataFrame:
    """Element-wise exact median of the arrays of each group: (key, pos, median)."""
    return rows.select(key, F.posexplode(values).alias("pos", "_v")).groupBy(key, "pos").agg(F.median(F.col("_v").cast("double")).alias("median"))


def keep_first_copy(rows: DataFrame, content: Column, order: str) -> DataFrame:
    """(digest, first, copies) by sha256 of the content: the lowest order is kept."""
    return rows.select(F.sha2(content, 256).alias("digest"), F.col(order).alias("_o")).groupBy("digest").agg(F.min("_o").alias("first"), F.count("*").alias("copies"))


def slots(rows: DataFrame, key: Sequence[str], order: Sequence[Column], value: str, n: int, prefix: str) -> DataFrame:
    """The first n rows of each key side by side, in columns prefix0.. Spark limits the groups before the shuffle."""
    d = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_i") <= n)
    return d.groupBy(*key).agg(*[F.max(F.when(F.col("_i") == i + 1, F.col(value))).alias(f"{prefix}{i}") for i in range(n)])


def fingerprint(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One sha256 of all rows whatever their order: the sum of row hashes, so no group is gathered in one place."""
    h = F.conv(F.substr(F.sha2(F.to_json(F.struct(*cols)), 256), F.lit(1), F.lit(15)), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(h), F.lit(0)).cast("string")), 256).alias("fingerprint"))


def ordered_text(rows: DataFrame, key: str, order: Sequence[str], text: str, conf: str, sep: str = " ") -> DataFrame:
    """A group's texts in order, and their mean confidence rounded to 4 digits."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), sep).alias("text"), F.round(F.coalesce(F.avg(conf), F.lit(0.0)), 4).alias("conf"))


def bounding_box(rows: DataFrame, key: Sequence[str], x: Column, y: Column, right: Column, bottom: Column) -> DataFrame:
    return rows.groupBy(*key).agg(F.min(x).alias("x"), F.min(y).alias("y"), (F.max(right) - F.min(x)).alias("w"), (F.max(bottom) - F.min(y)).alias("h"))


def pair_slots(rows: DataFrame, key: Sequence[str], order: Sequence[Column], kind: str, value: str, n: int, prefix: str) -> DataFrame:
    """The first n (kind, value) pairs of each key side by side: prefixType1, prefixValue1, ..."""
    d = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_i") <= n)
    one = lambda i, c: F.max(F.when(F.col("_i") == i, F.col(c)))
    return d.groupBy(*key).agg(*[one(i, c).alias(f"{prefix}{name}{i}") for i in range(1, n + 1) for c, name in ((kind, "Type"), (value, "Value"))])


def family_coverage(planned: DataFrame, existing: DataFrame, family: str, key: str) -> DataFrame:
    """By family, how many keys are planned, how many of them exist, and how many are missing."""
    there = existing.select(key).distinct().withColumn("_e", F.lit(1))
    return planned.join(there, key, "left").groupBy(family).agg(F.count("*").alias("total"), F.count("_e").alias("existing"), (F.count("*") - F.count("_e")).alias("missing"))


def keyed_by_first(rows: DataFrame, names: Sequence[str], order: str, out: str = "key") -> DataFrame:
    """The last row of each key, which is the first of the named columns that isn't null or empty, as text."""
    filled = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in names]
    d = rows.withColumn(out, F.coalesce(*filled)).filter(F.col(out).isNotNull())
    return d.groupBy(out).agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select(out, "_r.*")


def range_midpoint(rows: DataFrame, key: Sequence[str], low: str, high: str, channels: int = 3, default: int = 128) -> DataFrame:
    """key and `midpoint`: by channel, the whole mean of the whole midpoints of ranges (arrays low, high); ranges with fewer channels don't count, and without any each channel is the default."""
    whole = (F.size(low) >= channels) & (F.size(high) >= channels)
    mean = [F.coalesce(F.floor(F.avg(F.when(whole, F.floor((F.get(low, i) + F.get(high, i)) / 2)))), F.lit(default)).cast("bigint") for i in range(channels)]
    return rows.groupBy(*key).agg(F.array(*mean).alias("midpoint"))


def display_stat(stats: Column, fixed: Column, flat: Sequence[str]) -> Column:
    """Of stats (an array of struct name, value, in order): the first that isn't the fixed one, if one is fixed; else the first that isn't flat; else the first."""
    squash = lambda n: F.regexp_replace(F.lower(n), "[^a-z0-9%]", "")
    other = F.when(fixed.isNotNull(), F.get(F.filter(stats, lambda s: squash(s["name"]) != squash(fixed)), 0))
    return F.coalesce(other, F.get(F.filter(stats, lambda s: ~squash(s["name"]).isin(*flat)), 0), F.get(stats, 0))


#: Bytes of files, by Spark's estimate, whose rows one task sorts or groups.
PER_TASK = 1 << 20


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key over as many tasks as their size asks for, so that what a task sorts or groups doesn't grow with the input; steps by key need no further shuffle."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:  # unknown
        return rows.repartition(key)
    return rows.repartition(max(1, min(100_000, -(-size // PER_TASK))), key)
