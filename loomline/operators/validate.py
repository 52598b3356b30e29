"""Rules as data: one record to a list of errors and one of warnings.

Rules are small tables: fixed and rolled main values by cost and level, tiers of sub values, sub counts by level.
Each check is a nullable text expression; a record's checks stop early where a first one says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stat_value

# Tolerances of percent and flat values, known costs, levels, and the rarity that is checked.
PERCENT_TOLERANCE, FLAT_TOLERANCE = 0.4, 0.5
COSTS, TOP_LEVEL, RARITY = (1, 3, 4), 25, 5
#: Names that may occur both flat and in percent.
BOTH_FORMS = ("hp", "atk", "def")
# Names that only a record of cost 3, or of cost 4, rolls.
ONLY_THREE = ("er%", "fusion%", "havoc%", "spectro%", "electro%", "aero%", "glacio%")
ONLY_FOUR = ("cr%", "cd%", "healing%")


def _some(*checks: Column) -> Column:
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def tolerance(name: Column) -> Column:
    return F.when(name.endswith("%"), F.lit(PERCENT_TOLERANCE)).otherwise(F.lit(FLAT_TOLERANCE))


def nearest_tier(value: Column, tiers: Column) -> Column:
    """The tier with the smallest distance, the first listed on ties."""
    near = F.array_min(F.transform(tiers, lambda t, i: F.struct(F.abs(t - value).alias("d"), i.alias("i"), t.alias("t"))))
    return near["t"]


def tier_gap(value: Column, tiers: Column) -> Column:
    """How far a value is from the nearest of its tiers."""
    return F.array_min(F.transform(tiers, lambda t: F.abs(t - value)))


def tier_message(name: Column, gap: Column) -> tuple[Column, Column]:
    """(error, warning) of a value that far from its nearest tier: exact is well, within the tolerance warns, beyond is an error."""
    return (
        F.when(gap > tolerance(name), F.concat(F.lit("off tier: "), name)),
        F.when((gap > 1e-9) & (gap <= tolerance(name)), F.concat(F.lit("near tier: "), name)),
    )


def infer_cost(main_names: Column) -> Column:
    """1 for a flat hp; with a flat atk, 3 or 4 by the first name that only one of them rolls; else null."""
    telling = F.get(F.filter(main_names, lambda n: n.isin(*ONLY_THREE, *ONLY_FOUR)), 0)
    by_roll = F.when(telling.isin(*ONLY_FOUR), 4).when(telling.isin(*ONLY_THREE), 3)
    return F.when(F.array_contains(main_names, "hp"), 1).when(F.array_contains(main_names, "atk"), by_roll)


def validate(records: DataFrame, stats: DataFrame, rules_main: DataFrame, rules_sub: DataFrame, rules_max: DataFrame) -> DataFrame:
    """(rec_id, valid, errors, warnings).

    records(rec_id, cost, level, rarity); stats(rec_id, bucket, ord, name, value_raw); rules_main(cost, kind, name,
    level, expected); rules_sub(name, tier_ord, tier); rules_max(level, max_subs). Without main rules every record
    is valid with one warning.
    """
    tiers = rules_sub.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("tier_ord", "tier"))), lambda x: x["tier"]).alias("t"))
    tiers = tiers.agg(F.map_from_entries(F.collect_list(F.struct("name", "t"))).alias("tiers"))  # one row
    # each value meets its tiers once, in its own row
    st = stats.withColumn("_v", stat_value("value_raw")["num"]).join(tiers, F.lit(True), "left").withColumn("_t", F.when(F.col("bucket") == "sub", F.try_element_at("tiers", F.col("name"))))
    st = st.withColumn("_gap", tier_gap(F.col("_v"), F.col("_t"))).withColumn("_known", F.col("_t").isNotNull()).drop("tiers", "_t")

    def listed(bucket):
        return F.filter(F.array_sort(F.collect_list(F.struct("ord", "bucket", "name", F.col("_v").alias("v"), F.col("_gap").alias("gap"), F.col("_known").alias("known")))), lambda x: x["bucket"] == bucket).alias(bucket)

    grouped = st.groupBy("rec_id").agg(listed("main"), listed("sub"))
    main = rules_main.groupBy("cost", "level").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "fixed", F.struct("name", "expected")))).alias("fixed"),
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "rolled", F.struct("name", "expected")))).alias("rolled"),
    )
    loaded = rules_main.agg((F.count("*") > 0).alias("loaded"))
    none = F.array().cast("array<struct<ord:int,bucket:string,name:string,v:double,gap:double,known:boolean>>")
    d = records.join(grouped, "rec_id", "left").join(main, ["cost", "level"], "left").join(rules_max, "level", "left")
    d = d.join(loaded, F.lit(True), "left")  # one row
    d = d.withColumn("main", F.coalesce("main", none)).withColumn("sub", F.coalesce("sub", none))
    fixed_name = F.get(F.map_keys("fixed"), 0)
    fixed = F.get(F.filter("main", lambda x: x["name"] == fixed_name), 0)
    others = F.filter("main", lambda x: ~x["name"].eqNullSafe(fixed_name))
    other = F.get(others, 0)
    roll = F.try_element_at("rolled", other["name"])
    names = F.transform("sub", lambda x: x["name"])

    def per_sub(f):
        return F.filter(F.transform("sub", f), lambda x: x.isNotNull())

    twice = F.filter(F.array_distinct(names), lambda n: F.size(F.filter(names, lambda m: m == n)) > 1)
    both = F.filter(names, lambda n: n.endswith("%") & F.array_contains(names, F.regexp_replace(n, "%$", "")) & ~F.regexp_replace(n, "%$", "").isin(*BOTH_FORMS))
    errors = F.concat(
        _some(
            F.when(F.size("main") != 2, "main count"),
            F.when(fixed.isNull(), "fixed main missing").when(fixed["v"].isNull(), "fixed main not numeric"),
            F.when(F.size(others) != 1, "other main count").when(roll.isNull(), "other main not allowed").when(other["v"].isNull(), "other main not numeric"),
            F.when(F.size("sub") > F.col("max_subs"), "too many subs"),
        ),
        per_sub(lambda x: F.when(~x["known"], F.concat(F.lit("unknown sub: "), x["name"])).when(x["v"].isNull(), F.concat(F.lit("sub not numeric: "), x["name"]))),
        F.transform(twice, lambda n: F.concat(F.lit("duplicate: "), n)),
        F.transform(both, lambda n: F.concat(F.lit("flat and percent: "), n)),
        per_sub(lambda x: tier_message(x["name"], x["gap"])[0]),
    )
    warnings = F.concat(
        _some(
            F.when(F.abs(fixed["v"] - F.try_element_at("fixed", fixed_name)) > tolerance(fixed_name), "fixed main value"),
            F.when(F.abs(other["v"] - roll) > tolerance(other["name"]), "other main value"),
            F.when(F.size("sub") < F.col("max_subs"), "missing subs"),
        ),
        per_sub(lambda x: tier_message(x["name"], x["gap"])[1]),
    )
    empty = F.array().cast("array<string>")
    stop_warn = F.when(~F.col("loaded"), F.array(F.lit("rules not loaded"))).when(~F.col("rarity").eqNullSafe(F.lit(RARITY)), F.array(F.lit("rarity not checked")))
    cost_known, level_known = F.coalesce(F.col("cost").isin(*COSTS), F.lit(False)), F.coalesce(F.col("level").between(0, TOP_LEVEL), F.lit(False))
    stop_error = F.when(~cost_known, F.array(F.lit("unknown cost"))).when(~level_known, F.array(F.lit("level out of range")))
    d = d.withColumn("errors", F.when(stop_warn.isNotNull(), empty).otherwise(F.coalesce(stop_error, errors)))
    d = d.withColumn("warnings", F.coalesce(stop_warn, F.when(stop_error.isNotNull(), empty), warnings))
    return d.select("rec_id", (F.size("errors") == 0).alias("valid"), "errors", "warnings")


def better_retry(first: DataFrame, second: DataFrame) -> DataFrame:
    """Of two validations per rec_id (with sub counts n), the second if it is valid, has fewer errors, or more subs."""
    a, b = first.alias("a"), second.alias("b")
    take = F.col("b.rec_id").isNotNull() & (F.col("b.valid") | (F.size("b.errors") < F.size("a.errors")) | (F.col("b.n") > F.col("a.n")))
    j = a.join(b, F.col("a.rec_id") == F.col("b.rec_id"), "left")
    return j.select(F.col("a.rec_id").alias("rec_id"), *[F.when(take, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in ("valid", "errors", "warnings", "n")], take.alias("retried"))
