"""Layouts of screens: by aspect ratio, then by the nearest base size, with rectangles scaled to the screen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of Euclid's algorithm that whole numbers below 2^31 never exceed.
STEPS = 46


def greatest_divisor(a: Column, b: Column) -> Column:
    """The greatest common divisor of two whole numbers above 0."""
    zero = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, step, lambda s: s["a"])


def aspect_ratio(width: Column, height: Column) -> Column:
    """'16:9' of a size; NULL unless both are above 0."""
    d = greatest_divisor(width, height)
    return F.when((width > 0) & (height > 0), F.concat_ws(":", (width / d).cast("bigint"), (height / d).cast("bigint")))


def nearest_base(screens: DataFrame, key: Sequence[str], bases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, width, height, base, base_width, base_height) and the screens without a base of their ratio.

    screens: key, width, height; bases: base, base_width, base_height, ord. Of the bases of the same ratio the one with the smallest sum of
    differences in width and height counts, the first in ord on ties; the screen's own size is a difference of 0.
    """
    s = screens.withColumn("_ratio", aspect_ratio(F.col("width"), F.col("height")))
    b = bases.withColumn("_ratio", aspect_ratio(F.col("base_width"), F.col("base_height"))).groupBy("_ratio").agg(F.collect_list(F.struct("base_width", "base_height", "ord", "base")).alias("_bases"))  # a row a ratio
    met = s.join(b, "_ratio", "left")
    far = lambda x: F.abs(x["base_width"] - F.col("width")) + F.abs(x["base_height"] - F.col("height"))
    best = F.array_min(F.transform("_bases", lambda x: F.struct(far(x).alias("d"), x["ord"].alias("ord"), x.alias("x"))))["x"]
    d = met.withColumn("_x", best)
    found = d.filter("_x is not null").select(*key, "width", "height", "_x.base", "_x.base_width", "_x.base_height")
    return found, d.filter("_x is null").select(*key, "width", "height")


def scaled(found: DataFrame, key: Sequence[str], regions: DataFrame, unscaled: Sequence[str]) -> DataFrame:
    """(key, path, x, y, w, h): the base's rectangles (base, path, x, y, w, h) in the screen's own size; those below an unscaled name, at any level of the path, stay as they are."""
    d = found.join(regions, "base")
    kept = F.arrays_overlap(F.split("path", r"\."), F.array(*[F.lit(n) for n in unscaled])) if unscaled else F.lit(False)
    by = {"x": F.col("width") / F.col("base_width"), "y": F.col("height") / F.col("base_height")}
    size = lambda c, axis: F.when(kept, F.col(c).cast("double")).otherwise(F.col(c) * by[axis]).alias(c)
    return d.select(*key, "path", size("x", "x"), size("y", "y"), size("w", "x"), size("h", "y"))
