"""Caches, upserts, eviction and snapshot differences as keyed tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(requests: DataFrame, cache: DataFrame, keys: Sequence[str], version: str | None, payload: str) -> DataFrame:
    """requests with the payload and a hit flag; another version is a miss."""
    on = [*keys, *([version] if version else [])]
    return requests.join(cache.select(*on, payload).withColumn("hit", F.lit(True)), on, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def two_tier_lookup(requests: DataFrame, memory: DataFrame, store: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """requests with the payload and its tier: memory first, then the store, else a miss."""
    d = requests.join(memory.select(*keys, F.col(payload).alias("_m")), list(keys), "left").join(store.select(*keys, F.col(payload).alias("_s")), list(keys), "left")
    tier = F.when(F.col("_m").isNotNull(), "memory").when(F.col("_s").isNotNull(), "store").otherwise("miss")
    return d.withColumn(payload, F.coalesce("_m", "_s")).withColumn("tier", tier).drop("_m", "_s")


def promoting_lookup(requests: DataFrame, order: str, memory: DataFrame, store: DataFrame, keys: Sequence[str], payload: str) -> tuple[DataFrame, DataFrame]:
    """Lookups in order, which change the memory: the requests with payload and tier, and the memory (keys, payload, hits) after them.

    The first request for a key that only the store has is a hit of the store and brings it into memory, where later
    requests find it; every hit of either tier counts for the key. Misses change nothing. A request with a null key is a miss.
    """
    found = two_tier_lookup(requests, memory, store, keys, payload)
    first = found.filter("tier = 'store'").groupBy(*keys).agg(F.min(order).alias("_first"))  # a key asked for very often is one row from each task
    d = found.join(first, list(keys), "left")
    d = d.withColumn("tier", F.when((F.col("tier") == "store") & (F.col(order) > F.col("_first")), "memory").otherwise(F.col("tier"))).drop("_first")
    hits = d.filter("tier <> 'miss'").groupBy(*keys).agg(F.max(payload).alias("_p"), F.count("*").alias("_h"))
    after = memory.select(*keys, payload, "hits").join(hits, list(keys), "full_outer")
    return d, after.select(*keys, F.coalesce(payload, "_p").alias(payload), (F.coalesce("hits", F.lit(0)) + F.coalesce("_h", F.lit(0))).cast("long").alias("hits"))


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Insert or replace: the newest row of each key stays, a new one wins a tie; a replaced row starts with no hits."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    if "hit_count" in both.columns:
        both = both.withColumn("hit_count", F.when(F.col("_new") == 1, F.lit(0)).otherwise(F.col("hit_count")))
    w = Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def count_hits(log: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return log.groupBy(*keys).agg(F.count("*").alias("hit_count"), F.max(ts).alias("hit_ts"))


def evict(table: DataFrame, ts: str, now: int, days: int) -> tuple[DataFrame, DataFrame]:
    """What stays, and what is older than so many days."""
    old = F.col(ts) < F.lit(now - days * 86_400)
    return table.filter(~F.coalesce(old, F.lit(False))), table.filter(old)


def compute_misses(requests: DataFrame, cache: DataFrame, keys: Sequence[str], payload: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Payloads from the cache, and computed ones for each distinct missing key; (keys, payload)."""
    wanted = requests.select(*keys).distinct()
    hits = wanted.join(cache.select(*keys, payload), list(keys))
    misses = wanted.join(cache.select(*keys), list(keys), "left_anti")
    return hits.unionByName(compute(misses).select(*hits.columns))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change) for keys that are added, changed or removed."""
    d = old.select(key, F.col(digest).alias("_o"), F.lit(True).alias("_ho")).join(new.select(key, F.col(digest).alias("_n"), F.lit(True).alias("_hn")), key, "full_outer")
    change = F.when(F.col("_ho").isNull(), "added").when(F.col("_hn").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return d.select(key, change.alias("change")).filter("change is not null")


def commit_if_complete(planned: DataFrame, done: DataFrame, key: str) -> bool:
    """Whether a new state may be saved: every planned key is done."""
    return planned.join(done, key, "left_anti").isEmpty()


def rescan(queue: DataFrame, attempt: Callable[[DataFrame], DataFrame], most: int, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Try (id, status, attempts) rows that need it again, `most` times at most; attempt returns (id, ok); write cuts the lineage of each round."""
    state = queue
    for _ in range(most):
        todo = state.filter((F.col("status") == "needs_rescan") & (F.col("attempts") < most))
        if todo.isEmpty():
            break
        result = attempt(todo).select("id", "ok")
        state = write(
            state.join(result, "id", "left")
            .withColumn("attempts", F.col("attempts") + F.col("ok").isNotNull().cast("int"))
            .withColumn("status", F.when(F.col("ok"), "rescanned").when(~F.col("ok") & (F.col("attempts") >= most), "failed").otherwise(F.col("status")))
            .drop("ok")
        )
    return state
