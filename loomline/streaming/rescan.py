"""A rescan queue as a stream: the state of each item, its attempts, and a timer for results that don't come.

An item is pending until its first result. A good one makes it scanned, a rejected one failed; a result that asks
for another look makes it needs_rescan while it has attempts left, and the next result makes it rescanned, failed, or asks again.
A result that doesn't come in time fails the item: the timer is one of event time, so it goes by the watermark. Results are
taken in order of time and a due timer goes before a later result, so that the transitions don't depend on how
the stream was cut into micro-batches, as long as nothing comes later than the watermark allows. Final items
ignore what follows.

Items are dealt by a hash into buckets, and the state is kept by bucket, with one timer for the first item that is due: a
micro-batch calls Python once for each bucket that it touches, not for each item. There are many buckets, so one holds few items.

Cases: rows without an item are dropped; rows at one time are taken in order of `ord`; an unknown outcome is a rejected one; a null time is
dropped by the watermark's comparison; an empty stream has no transitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Of the items of a bucket, in order of their names; due is null unless the item is waiting.
STATE = "item array<string>, status array<string>, attempts array<int>, due array<bigint>"
_OUT = "item string, us bigint, status string, attempts int, reason string"
OUT = "item string, at timestamp, status string, attempts int, reason string"
#: Buckets that items are dealt into.
BUCKETS = 16_384
#: Outcomes of a result: taken, taken with the wish for another look, rejected.
TAKEN, AGAIN = "taken", "again"


#: A result without a place among those of its time comes after them.
_LAST = (1 << 63) - 1


def transition(status: str, attempts: int, outcome: str, most: int) -> tuple[str, str | None]:
    """The status after a result, and why; attempts counts this one."""
    if outcome == AGAIN and attempts < most:
        return "needs_rescan", "another look"
    if outcome in (TAKEN, AGAIN):
        return ("scanned" if status == "pending" else "rescanned"), None
    return "failed", "rejected" if status == "pending" else "rejected after rescan"


def _queue(most: int, wait_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The transitions of one bucket: those of new results, then of the items that are due by the watermark."""
        items = {i: (status, attempts, due) for i, status, attempts, due in zip(*state.get, strict=True)} if state.exists else {}
        out: list[tuple] = []
        if not state.hasTimedOut:
            r = pd.concat(list(frames))
            order = np.lexsort((r["ord"].to_numpy(), r["us"].to_numpy()))
            for i, us, outcome in zip(*(r[c].to_numpy()[order].tolist() for c in ("item", "us", "outcome")), strict=True):
                status, attempts, due = items.get(i, ("pending", 0, None))
                at = us // 1000
                if status == "needs_rescan" and at >= due:
                    out.append((i, due * 1000, "failed", attempts, "no result in time"))
                    items[i] = ("failed", attempts, None)
                elif status in ("pending", "needs_rescan"):
                    attempts += 1
                    status, reason = transition(status, attempts, outcome, most)
                    items[i] = (status, attempts, at + wait_ms if status == "needs_rescan" else None)
                    out.append((i, us, status, attempts, reason))
        mark, first = state.getCurrentWatermarkMs(), None
        for i, (_, attempts, due) in items.items():
            if due is not None and due < mark:
                out.append((i, due * 1000, "failed", attempts, "no result in time"))
                items[i] = ("failed", attempts, None)
            elif due is not None and (first is None or due < first):
                first = due
        names = sorted(items)
        state.update((names, *([items[i][k] for i in names] for k in range(3))))
        if first is not None:
            state.setTimeoutTimestamp(max(first, 1))
        if out:
            yield pd.DataFrame(out, columns=["item", "us", "status", "attempts", "reason"])

    return run


def state_session(spark: SparkSession, stores: int = 16) -> SparkSession:
    """A session of its own for a stream with keyed state of any kind, dealt over so many stores; other queries keep their settings."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", str(stores))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def rescans(results: DataFrame, most: int = 3, wait_ms: int = 120_000, late: str = "0 seconds") -> DataFrame:
    """The transitions (item, at, status, attempts, reason) of a stream of results (item, at, ord, outcome)."""
    d = results.select(F.col("item").cast("string").alias("item"), F.col("at").cast("timestamp").alias("at"), F.coalesce(F.col("ord").cast("long"), F.lit(_LAST)).alias("ord"), F.coalesce("outcome", F.lit("rejected")).alias("outcome"))
    d = d.filter("item is not null and at is not null").withWatermark("at", late)
    d = d.withColumns({"us": F.unix_micros("at"), "bucket": F.pmod(F.xxhash64("item"), F.lit(BUCKETS))})
    out = d.groupBy("bucket").applyInPandasWithState(_queue(most, wait_ms), _OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("item", F.timestamp_micros("us").alias("at"), "status", "attempts", "reason")
