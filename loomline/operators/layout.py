"""Order-dependent operators on sequences: row grouping, early stops, grids, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import dealt


def row_groups(rows: DataFrame, key: Sequence[str], top: Column, bottom: Column, gap, order: Sequence[str]) -> DataFrame:
    """rows with row_no: a new row begins where top is at or below everything before it by the gap."""
    w = Window.partitionBy(*key).orderBy(*order)
    above = F.max(bottom).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = rows.withColumn("_new", F.when(above.isNull() | (top >= above + gap), 1).otherwise(0))
    return d.withColumn("row_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def text_lines(tokens: DataFrame, key: Sequence[str], gap, divisor: str = " ") -> DataFrame:
    """key, row_no, line of tokens (x0, y0, y1, ord, text): rows by row_groups from top to bottom, in each the texts from left to right.

    The order is stable: at equal tops, and at equal left edges, the one that comes first in ord comes first. A null text is left out of its line.
    """
    d = row_groups(tokens, key, F.col("y0"), F.col("y1"), gap, ["y0", "ord"])
    parts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("x0", "y0", "ord", "text"))))
    return d.groupBy(*key, "row_no").agg(F.array_join(F.transform(parts, lambda t: t["text"]), divisor).alias("line"))


def take_while(rows: DataFrame, key: Sequence[str], order: Sequence[str], stop: Column) -> DataFrame:
    """Rows before the first one that stops; an unknown condition doesn't stop."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_s", F.max(F.coalesce(stop, F.lit(False)).cast("int")).over(w)).filter("_s = 0").drop("_s")


def numbered(rows: DataFrame, order: Sequence[Column], folder: str) -> DataFrame:
    """rows with position, from 0, in a total order: range-sorted rows are written once, counted by range, and numbered from the counts of the ranges before."""
    rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(f"{folder}/sorted")
    d = rows.sparkSession.read.parquet(f"{folder}/sorted").withColumn("_range", F.shiftright("_id", 33))
    sizes = d.groupBy("_range").agg(F.max(F.expr("_id & ((1L << 33) - 1)") + 1).alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(sizes.select("_range", before.alias("_before")), "_range")
    return d.withColumn("position", F.col("_before") + F.expr("_id & ((1L << 33) - 1)")).drop("_id", "_range", "_before")


def first_seen(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return rows.withColumn("already_seen", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) > 1)


def grid_position(index: Column, rows: int, cols: int, total: Column) -> dict[str, Column]:
    """page, row, col of an index from 0; on the last page the grid is scrolled to its end, so its rows are counted from there."""
    page = F.floor(index / (rows * cols))
    all_rows = F.ceil(total / cols)
    last = F.ceil(all_rows / rows) - 1
    line = F.floor(index / cols)
    row = F.when((page == last) & (last > 0), line - (all_rows - rows)).otherwise(line - page * rows)
    return {"page": page.cast("int"), "row": row.cast("int"), "col": (index % cols).cast("int")}


def grid_index(page: Column, row: Column, col: Column, rows: int, cols: int, total: Column) -> Column:
    all_rows = F.ceil(total / cols)
    last = F.ceil(all_rows / rows) - 1
    line = F.when((page == last) & (last > 0), all_rows - rows + row).otherwise(page * rows + row)
    return (line * cols + col).cast("bigint")


# Folds: each step depends on what the steps before it decided, so a window can't say them. They run on the sorted
# array of one small group (the tokens of an image), inside the JVM.


def anchored_rows(tokens: Column, height: float) -> Column:
    """Row numbers of tokens (array of struct y, ...) sorted by y: a token within height of its row's first y stays in it."""
    zero = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc, t):
        new = acc["y"].isNull() | (t["y"] - acc["y"] > height)
        n = F.when(new, acc["n"] + 1).otherwise(acc["n"])
        return F.struct(F.when(new, t["y"].cast("double")).otherwise(acc["y"]).alias("y"), n.alias("n"), F.concat(acc["out"], F.array(n)).alias("out"))

    return F.aggregate(tokens, zero, step, lambda acc: acc["out"])


def merge_known(tokens: Column, known: Column) -> Column:
    """Known names in tokens, spaces left out: two neighbours that make one, else the single token if it is one; the others go."""
    squashed = F.transform(tokens, lambda t: F.replace(t, F.lit(" ")))
    zero = F.struct(F.lit(None).cast("string").alias("held"), F.array().cast("array<string>").alias("out"))

    def alone(acc):
        return F.when(F.coalesce(F.array_contains(known, acc["held"]), F.lit(False)), F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"])

    def step(acc, t):
        joined = F.concat(acc["held"], t)
        hit = F.coalesce(F.array_contains(known, joined), F.lit(False))
        return F.when(hit, F.struct(F.lit(None).cast("string").alias("held"), F.concat(acc["out"], F.array(joined)).alias("out"))).otherwise(F.struct(t.alias("held"), alone(acc).alias("out")))

    return F.aggregate(squashed, zero, step, alone)


def merge_wrapped(rows: Column, known: Column) -> Column:
    """(y, name) of the known names in rows (array of struct y, tokens) in order; a row without any is read together with the next one, at its own y."""
    line = "struct<y:double,tokens:array<string>>"
    zero = F.struct(F.lit(None).cast(line).alias("held"), F.array().cast("array<struct<y:double,name:string>>").alias("out"))

    def found(acc, y, names):
        return F.struct(F.lit(None).cast(line).alias("held"), F.concat(acc["out"], F.transform(names, lambda n: F.struct(y.alias("y"), n.alias("name")))).alias("out"))

    def step(acc, r):
        y, own = r["y"].cast("double"), merge_known(r["tokens"], known)
        both = F.when(acc["held"].isNotNull(), merge_known(F.concat(acc["held"]["tokens"], r["tokens"]), known))
        wait = F.struct(F.struct(y.alias("y"), r["tokens"].alias("tokens")).cast(line).alias("held"), acc["out"].alias("out"))
        return F.when(F.size(F.coalesce(both, F.array().cast("array<string>"))) > 0, found(acc, acc["held"]["y"], both)).when(F.size(own) > 0, found(acc, y, own)).otherwise(wait)

    return F.aggregate(rows, zero, step, lambda acc: acc["out"])


def spaced(kept: Column, more: Column, least: float) -> Column:
    """All of `kept`, then in order those of `more` that are farther than `least` from every value kept so far."""
    return F.aggregate(more, kept.cast("array<double>"), lambda acc, v: F.when(F.exists(acc, lambda k: F.abs(k - v) <= least), acc).otherwise(F.concat(acc, F.array(v.cast("double")))))


def greedy_pairs(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, side, ord, y, text): in the order of names, each takes the nearest unused value by y, on ties the upper one, then by text; (key, name, value)."""
    sides = [F.filter(F.array_sort(F.collect_list(F.struct("ord", F.col("y").cast("double").alias("y"), "text", "side"))), lambda t: t["side"] == s).alias(s) for s in ("name", "value")]
    g = rows.groupBy(key).agg(*sides)
    kind = "array<struct<ord:bigint,y:double,text:string>>"
    values = F.transform("value", lambda t: F.struct(t["ord"].cast("bigint").alias("ord"), t["y"].alias("y"), t["text"].alias("text"))).cast(kind)
    zero = F.struct(values.alias("left"), F.array().cast("array<struct<name:string,value:string>>").alias("out"))

    def step(acc, n):
        best = F.array_min(F.transform(acc["left"], lambda v: F.struct(F.abs(v["y"] - n["y"]).alias("d"), v["y"].alias("y"), v["text"].alias("text"), v["ord"].alias("ord"))))
        taken = F.concat(acc["out"], F.array(F.struct(n["text"].alias("name"), best["text"].alias("value"))))
        rest = F.filter(acc["left"], lambda v: v["ord"] != best["ord"])
        return F.when(F.size(acc["left"]) == 0, acc).otherwise(F.struct(rest.alias("left"), taken.alias("out")))

    return g.select(key, F.inline(F.aggregate("name", zero, step, lambda acc: acc["out"])))


def best_chain(rows: DataFrame, key: str, overlap: float = 0.35) -> DataFrame:
    """rows (key, x0, x1, text, conf) to (key, number): the digits of tokens joined from left to right.

    A chain ends where a token strongly overlaps the one before it; of the chains the one that reaches farthest right
    counts, then the one with most digits, the widest, the surest, the first. Any part of a chain reaches no farther
    and has fewer digits than the whole, so whole chains are all that need be compared. 0 where no token has digits.
    """
    d = rows.select(key, F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), F.regexp_replace("text", "[^0-9]", "").alias("t"), F.col("conf").cast("double").alias("conf"))
    d = dealt(d, key)
    w = Window.partitionBy(key).orderBy("x0", "x1", -F.length("t"), -F.col("conf"), "t")
    some = d.filter("t <> ''").withColumn("_n", F.row_number().over(w)).withColumn("_a", F.lag("x0").over(w)).withColumn("_b", F.lag("x1").over(w))
    common = F.least("x1", "_b") - F.greatest("x0", "_a")
    narrow = F.least(F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)), F.greatest(F.col("_b") - F.col("_a"), F.lit(1.0)))
    cut = F.coalesce((common > 0) & (common / narrow >= overlap), F.lit(False))
    chains = some.withColumn("_c", F.sum(cut.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "t"))), lambda x: x["t"]), "")
    chains = chains.groupBy(key, "_c").agg(digits.alias("t"), F.max("x1").alias("x1"), F.min("x0").alias("x0"), F.sum("conf").alias("conf"))
    best = chains.groupBy(key).agg(F.max_by("t", F.struct("x1", F.length("t"), F.col("x1") - F.col("x0"), "conf", -F.col("_c"))).alias("_t"))
    return d.select(key).distinct().join(best, key, "left").select(key, F.coalesce(F.col("_t").try_cast("bigint"), F.lit(0)).alias("number"))
