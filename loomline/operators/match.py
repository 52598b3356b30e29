"""Exact-then-fuzzy matching and nearest references."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of a dictionary that one worker compares with, and texts that it compares; larger dictionaries are dealt into blocks, more texts over more tasks a block.
MOST_NAMES, MOST_TEXTS, TASKS = 50_000, 2_000, 8


def _ratio_matcher(names: list[str], cutoff: float):
    """The most similar of sorted names, the first on ties; only names of a length that allows the cutoff are compared."""
    from difflib import SequenceMatcher

    by_length: dict[int, list[str]] = {}
    for n in names:
        by_length.setdefault(len(n), []).append(n)

    def best(word: str) -> tuple[str | None, float | None]:
        m, top = SequenceMatcher(autojunk=False), (None, None)
        m.set_seq2(word)
        for length, some in by_length.items():
            if 2 * min(length, len(word)) < cutoff * (length + len(word)) and length + len(word):
                continue
            for n in some:
                m.set_seq1(n)
                if m.quick_ratio() >= cutoff and (r := m.ratio()) >= cutoff and (top[0] is None or (r, top[0]) > (top[1], n)):
                    top = (n, r)
        return top

    return best


def fuzzy_best_match(rows: DataFrame, text: str, names: DataFrame, name: str, cutoff: float = 0.75) -> DataFrame:
    """rows with match and ratio: the equal name, else the most similar one (matching-blocks ratio) from the cutoff on, the first in name order on ties.

    Only distinct texts without an equal name are compared, with blocks of the dictionary of MOST_NAMES names or so, in as many
    tasks a block as their number needs.
    """
    dictionary = names.select(F.col(name).alias("_name")).filter("_name is not null").distinct()
    distinct = rows.select(F.col(text).alias("_text")).filter("_text is not null").distinct()
    exact = distinct.join(dictionary, F.col("_text") == F.col("_name")).select("_text", F.col("_name").alias("match"), F.lit(1.0).alias("ratio"))
    rest = distinct.join(dictionary, F.col("_text") == F.col("_name"), "left_anti")
    blocks = max(1, -(-dictionary.count() // MOST_NAMES))
    tasks = max(TASKS, -(-rest.count() // MOST_TEXTS))
    some = dictionary.withColumn("_block", F.pmod(F.xxhash64("_name"), F.lit(blocks))).withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    asked = rest.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).withColumn("_task", F.pmod(F.xxhash64("_text"), F.lit(tasks)).cast("int"))

    def run(texts: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        best = _ratio_matcher(sorted(listed["_name"]), cutoff)
        got = [(t, *best(t)) for t in texts["_text"]]
        return pd.DataFrame([g for g in got if g[1] is not None], columns=["_text", "match", "ratio"]).astype({"_text": object, "match": object, "ratio": float})

    found = asked.groupBy("_block", "_task").cogroup(some.groupBy("_block", "_task")).applyInPandas(run, "_text string, match string, ratio double")
    found = found.groupBy("_text").agg(F.min_by("match", F.struct(-F.col("ratio"), "match")).alias("match"), F.max("ratio").alias("ratio"))
    return rows.join(exact.unionByName(found), F.col(text) == F.col("_text"), "left").drop("_text")


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """(start from 0, length) of the i-th of so many even segments of a text; the longer ones are the last."""
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    return (base * i + F.greatest(F.lit(0), i - parts + longer)).cast("int"), base + (longer + i >= parts).cast("int")


def edit_distance_best_match(rows: DataFrame, text: str, names: DataFrame, name: str, most: int) -> DataFrame:
    """rows with match and distance: the name with the fewest edits, `most` at most, the first in name order on ties.

    A name cut into most + 1 segments keeps one of them whole in every text that near: so texts meet names on length, segment
    number and segment. Of all places of such a segment only those count where no more edits than segments before it lie on
    its left, and no more on its right than are left over: the first segment that is whole is in one of them.
    """
    parts = most + 1
    d = rows.select(F.col(text).alias("_text")).filter("_text is not null").distinct()
    n = names.select(F.col(name).alias("_name")).filter("_name is not null").distinct()

    def own(i: int) -> Column:
        start, size = _segment(F.length("_name"), i, parts)
        return F.struct(F.length("_name").alias("l"), F.lit(i).alias("i"), F.substr("_name", start + 1, size).alias("s"))

    def seen(i: int, by: int) -> Column:
        start, size = _segment(F.col("_l"), i, parts)
        at, rest = start + by, by - (F.length("_text") - F.col("_l"))
        return F.when(rest.between(i - most, most - i) & (at >= 0) & (at + size <= F.length("_text")), F.struct(F.col("_l").alias("l"), F.lit(i).alias("i"), F.substr("_text", at + 1, size).alias("s")))

    lengths = F.explode(F.sequence(F.greatest(F.length("_text") - most, F.lit(0)), F.length("_text") + most))
    met = F.explode(F.array_distinct(F.array_compact(F.array(*[seen(i, by) for i in range(parts) for by in range(-i, i + 1)]))))
    a = d.withColumn("_l", lengths).select("_text", met.alias("_k"))
    b = n.select("_name", F.explode(F.array(*[own(i) for i in range(parts)])).alias("_k"))
    pairs = a.join(b, "_k").select("_text", "_name").distinct().withColumn("_d", F.levenshtein("_text", "_name", most)).filter("_d >= 0")
    best = pairs.groupBy("_text").agg(F.min_by("_name", F.struct("_d", "_name")).alias("match"), F.min("_d").alias("distance"))
    return rows.join(best, F.col(text) == F.col("_text"), "left").drop("_text")


def _centred(x: Column) -> Column:
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    return F.transform(x, lambda v: v - mean)


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def centred_correlation(a: Column, b: Column) -> Column:
    """Correlation of two arrays of one length."""
    ca, cb = _centred(a), _centred(b)
    return _dot(ca, cb) / F.nullif(F.sqrt(_dot(ca, ca) * _dot(cb, cb)), F.lit(0.0))


def best_by_correlation(rows: DataFrame, key: str, vector: str, refs: DataFrame, ref_vector: str, label: str, cutoff: float) -> DataFrame:
    """key, label and score: the reference with the highest centred correlation, the smaller label on ties; below the cutoff the label is NULL.

    Every row is scored against every reference. Vectors without a correlation (all components equal) have a NULL score.
    """
    # what belongs to one vector is computed once for it, not for each pair
    r = refs.select(F.col(label).alias("_label"), _centred(F.col(ref_vector)).alias("_b")).withColumn("_bb", _dot(F.col("_b"), F.col("_b")))
    v = rows.select(key, F.size(vector).alias("_n"), F.aggregate(vector, F.lit(0.0), lambda s, x: s + x).alias("_sum"), F.col(vector).alias("_v"))
    v = v.withColumn("_mean", F.col("_sum") / F.col("_n")).withColumn("_a", F.transform("_v", lambda x: x - F.col("_mean"))).withColumn("_aa", _dot(F.col("_a"), F.col("_a")))
    score = F.round(_dot(F.col("_a"), F.col("_b")) / F.nullif(F.sqrt(F.col("_aa") * F.col("_bb")), F.lit(0.0)), 9)
    least = F.min(F.struct(F.coalesce(-score, F.lit(float("inf"))).alias("d"), F.col("_label").alias("best")))  # one struct: the score is computed once
    best = v.select(key, "_a", "_aa").join(r, F.lit(True)).groupBy(key).agg(least.alias("_x"))
    found = -F.nullif(F.col("_x.d"), F.lit(float("inf")))
    return best.select(key, F.when(found >= cutoff, F.col("_x.best")).alias(label), found.alias("score"))


def label_or_best(rows: DataFrame, key: str, vector: str, label: str, refs: DataFrame, ref_vector: str, cutoff: float) -> DataFrame:
    """key, label, state and score: the recorded label, else the best reference from the cutoff on, else a skip, which is reported with its score."""
    known = rows.filter(F.col(label).isNotNull()).select(key, label, F.lit("recorded").alias("state"), F.lit(None).cast("double").alias("score"))
    rest = rows.filter(F.col(label).isNull()).select(key, vector)
    found = rest.select(key).distinct().join(best_by_correlation(rest, key, vector, refs, ref_vector, label, cutoff), key, "left")
    state = F.when(F.col(label).isNull(), "skipped").otherwise("matched")
    return known.unionByName(found.select(key, label, state.alias("state"), "score"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def plausible(rows: DataFrame, text: str, names: DataFrame, name: str, cutoff: float = 0.75) -> DataFrame:
    """Rows whose text is, exactly or nearly, in the dictionary; an empty dictionary accepts all."""
    if names.isEmpty():
        return rows
    return fuzzy_best_match(rows, text, names, name, cutoff).filter("match is not null").select(*rows.columns)
