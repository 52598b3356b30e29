"""Mixing sources to target weights: a time-varying curriculum.

Every source has a target number of words and a weight schedule over training time 0..1. The integral of the
schedule is the source's cumulative token demand; inverting it gives the moment at which each of the source's
words is wanted. Documents of a source stand in an order fixed by a hash of their id and text; the n-th word of that
order (counted on through repeated passes) is wanted at the inverse demand of n, and documents are range-sorted
by that position.

Cases: a null text has no words; a null source is a source of its own, the last; a document without words is
never placed (taken 0, position null); rows are ordered by a hash of id and text, so only rows that are equal in both are
interchangeable; an empty table gives an empty result. Other columns of the input are carried along only by
`place`, and internal names begin with `_mx_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, n_words, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Schedules, one for each of WEIGHTS: knots (time, weight) of a piecewise linear curve. Only their shape counts.
SCHEDULES = (
    ((0.0, 1.6), (0.5, 1.0), (1.0, 0.4)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.4), (0.5, 1.0), (1.0, 1.6)),
)
#: Rows of one source that are ordered together; larger sources are split by hash ranges.
ROWS_PER_BUCKET = 4_000


def inverse_demand(u: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time t at which the integral of the schedule from 0 has reached the share u (0..1) of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, before, out = sum(areas), 0.0, None
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        need = u * whole - before  # area wanted inside this piece
        slope = (w1 - w0) / (t1 - t0)
        t = t0 + (need / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * need)) - w0) / slope)
        before += area
        t = F.least(F.lit(t1), F.greatest(F.lit(t0), t))
        out = F.when(u * whole <= before, t) if out is None else out.when(u * whole <= before, t)
    return out.otherwise(F.lit(knots[-1][0]))


def _keyed(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows with their place in the fixed order (md5 of id and text: rows without an id, or of one id, are dealt by their texts) and the range of that order they fall into."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    h = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    return docs.select(
        "*",
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_mx_key"),
        h.alias("_mx_hash"),
        F.floor(_unit(h) * buckets).cast("int").alias("_mx_bucket"),
    )


def _unit(h: Column) -> Column:
    """The first 28 bits of a hash in hexadecimal, as a share of 1: monotone in the hash."""
    return F.conv(F.substring(h, 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source from (_mx_key, source, _mx_size): its weight class, size and target.

    Shares are weights times a level; targets stop at `most` times the source's size and the excess goes to the
    others, which is the level at which all targets add up: found from the sources in the order in which they
    reach their limit. Only this small table, a row per source, is ordered as a whole.
    """
    s = sizes.groupBy("_mx_key").agg(F.first("source").alias("source"), F.sum("_mx_size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("_mx_class", F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("_mx_class") + 1)
    s = s.withColumn("_mx_w", w).withColumn("_mx_cap", F.lit(float(most)) * F.col("source_size"))
    s = s.withColumn("_mx_reach", F.col("_mx_cap") / F.col("_mx_w"))
    order = Window.orderBy("_mx_reach", "_mx_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    s = s.withColumn("_mx_all", F.lit(float(share)) * F.sum("source_size").over(everything))
    left = F.col("_mx_all") - F.coalesce(F.sum("_mx_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_mx_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("_mx_rank", F.row_number().over(order)).withColumn("_mx_level", left / weight_left)
    level = F.min_by("_mx_level", F.when(F.col("_mx_level") <= F.col("_mx_reach"), F.col("_mx_rank"))).over(everything)
    s = s.withColumn("_mx_final", level)
    target = F.least(F.col("_mx_cap"), F.coalesce(F.col("_mx_final") * F.col("_mx_w"), F.col("_mx_cap")))
    return s.select("_mx_key", "source", "_mx_class", "source_size", target.alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, schedules=SCHEDULES, materialise: bool = True) -> DataFrame:
    """docs (doc_id, source, text, ...) with _mx_size, source_size, target, taken, _mx_start (words of the source before it), _mx_class.

    Two passes: sizes by (source, hash bucket), then a running sum inside each bucket on top of the buckets
    before it; so a source with a third of all rows is ordered by as many tasks as it has buckets.
    materialise: write the narrow (id, source, size) table once and drop the text; else carry all columns.
    """
    sized = docs.withColumn("_mx_size", n_words(F.col("text")))
    rows = docs.count()
    keyed = _keyed(sized, max(1, -(-rows // ROWS_PER_BUCKET)))
    if materialise:
        keyed = cut(keyed.select("doc_id", "source", "_mx_size", "_mx_key", "_mx_hash", "_mx_bucket"), "mix-sizes")
    sums = cut(keyed.groupBy("_mx_key", "_mx_bucket").agg(F.first("source").alias("source"), F.sum("_mx_size").alias("_mx_size")), "mix-buckets")
    goal = targets(sums, weights, share, most)
    ahead = Window.partitionBy("_mx_key").orderBy("_mx_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_mx_key", "_mx_bucket", F.coalesce(F.sum("_mx_size").over(ahead), F.lit(0)).alias("_mx_base"))
    base = base.join(goal.drop("source"), "_mx_key")
    inside = Window.partitionBy("_mx_key", "_mx_bucket").orderBy("_mx_hash", "doc_id", "_mx_size")
    run = F.coalesce(F.sum("_mx_size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = keyed.withColumn("_mx_run", run).join(base, ["_mx_key", "_mx_bucket"])
    goal_words = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.expr("div(cast(round(target) as bigint), source_size)")).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("_mx_start", F.col("_mx_base") + F.col("_mx_run")).withColumn("_mx_goal", goal_words).withColumn("_mx_full", full)
    rest = F.col("_mx_goal") - F.col("_mx_full") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("_mx_size"), rest - F.col("_mx_start"))).cast("long")
    return out.withColumn("_mx_part", part).withColumn("taken", F.col("_mx_full") * F.col("_mx_size") + part)


def position(pass_no: Column, schedules=SCHEDULES) -> Column:
    """Training position (0..1) of a document's first word in the given pass over its source."""
    u = (pass_no * F.col("source_size") + F.col("_mx_start")) / F.greatest(F.col("_mx_goal"), F.lit(1))
    out = F.when(F.col("_mx_class") == 0, inverse_demand(u, schedules[0]))
    for k in range(1, len(schedules)):
        out = out.when(F.col("_mx_class") == k, inverse_demand(u, schedules[k]))
    return out


def mixture(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken and its first position, range-sorted by position (what isn't taken follows, spread by hash)."""
    m = mix(docs.select("doc_id", "source", "text"), **how)
    m = m.withColumn("position", F.when(F.col("taken") > 0, position(F.lit(0))))
    beyond = 1 + _unit(F.col("_mx_hash"))
    m = m.orderBy(F.coalesce(F.col("position"), beyond), "doc_id")
    return m.select("doc_id", F.col("_mx_size").alias("size"), "source_size", "target", "taken", F.round("position", 6).alias("position"))


def place(docs: DataFrame, **how) -> DataFrame:
    """The training stream: each document as often as the mix takes it (a last, partial take counts from half of its words), range-sorted by position, with docs' own columns."""
    m = mix(docs, materialise=False, **how)
    times = F.col("_mx_full") + F.when(2 * F.col("_mx_part") >= F.greatest(F.col("_mx_size"), F.lit(1)), 1).otherwise(0)
    m = m.withColumn("_mx_times", times.cast("int")).filter("_mx_times > 0 and _mx_size > 0")
    m = m.withColumn("_mx_pass", F.explode(F.sequence(F.lit(0), F.col("_mx_times") - 1)))
    m = m.withColumn("_mx_at", position(F.col("_mx_pass")))
    return m.orderBy("_mx_at", "doc_id", "_mx_pass").select(*docs.columns)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def _sql_inverse(knots) -> str:
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, before, out = sum(areas), 0.0, "CASE"
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        slope, need = (w1 - w0) / (t1 - t0), f"(u * {whole!r}::DOUBLE - {before!r}::DOUBLE)"
        t = f"{need} / {w0!r}::DOUBLE" if slope == 0 else f"(sqrt(greatest(0.0::DOUBLE, {w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {need})) - {w0!r}::DOUBLE) / {slope!r}::DOUBLE"
        before += area
        out += f" WHEN u * {whole!r}::DOUBLE <= {before!r}::DOUBLE THEN least({t1!r}::DOUBLE, greatest({t0!r}::DOUBLE, {t0!r}::DOUBLE + {t}))"
    return out + f" ELSE {knots[-1][0]!r}::DOUBLE END"


OP10_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source),
cls AS (SELECT source, s, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 AS k FROM src),
caps AS (SELECT *, [3.0, 1.0, 2.0][k + 1]::DOUBLE AS w, 2.0::DOUBLE * s AS cap FROM cls),
lv AS (SELECT *, cap / w AS reach,
         (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM caps),
fin AS (SELECT *, first_value(lvl) OVER (ORDER BY CASE WHEN lvl <= reach THEN 0 ELSE 1 END, reach, source) AS level FROM lv),
goal AS (SELECT source, s AS source_size, k, least(cap, level * w) AS target,
         round(least(cap, level * w))::BIGINT AS r FROM fin),
run AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.k, g.r,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c,
         CASE WHEN g.source_size > 0 THEN g.r // g.source_size ELSE 0 END AS f
         FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
tk AS (SELECT *, (f * size + greatest(0, least(size, r - f * source_size - c)))::BIGINT AS taken, c::DOUBLE / greatest(r, 1) AS u FROM run)
SELECT doc_id, size, source_size, target, taken,
       round(CASE WHEN taken > 0 THEN CASE k WHEN 0 THEN {_sql_inverse(SCHEDULES[0])} WHEN 1 THEN {_sql_inverse(SCHEDULES[1])}
             ELSE {_sql_inverse(SCHEDULES[2])} END END, 6) AS position FROM tk
"""
