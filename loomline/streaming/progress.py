"""Progress of a stream by batch, and a stop that leaves it where it can go on."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener

#: Seconds to wait for the last report of a query that has ended.
PATIENCE = 30


class Progress(StreamingQueryListener):
    """Rows of each batch of one query, told to a function as (batch, rows, rows so far) when the batch is done."""

    def __init__(self, told: Callable[[int, int, int], None] | None = None) -> None:
        self.batches: dict[int, int] = {}
        self.told, self.run, self.ended = told, None, threading.Event()

    def onQueryStarted(self, event) -> None:
        """The run is known from the query itself."""

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) == self.run and p.numInputRows and p.batchId not in self.batches:
            self.batches[p.batchId] = p.numInputRows
            if self.told:
                self.told(p.batchId, p.numInputRows, sum(self.batches.values()))

    def onQueryIdle(self, event) -> None:
        """Nothing was done."""

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run:
            self.ended.set()


class Stopped(Exception):
    """Raised in place of the work on a batch after a stop."""


def drain_until(stream: DataFrame, handle: Callable[[DataFrame, int], None], folder: str, stop: threading.Event, told: Callable[[int, int, int], None] | None = None) -> tuple[bool, dict[int, int]]:
    """Work off the source batch by batch until it is done or stop is set: whether it is done, and the rows of each batch.

    The batch in work when stop is set is finished and kept in the checkpoint, the one after it isn't begun; a later call with
    the same folder goes on there. handle must, as ever, replace what it wrote for a batch that comes again.
    """
    listener, spark = Progress(told), stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        if stop.is_set():
            raise Stopped
        handle(batch, number)

    spark.streams.addListener(listener)
    try:
        q = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        listener.run = str(q.runId)
        try:
            q.awaitTermination()
        except StreamingQueryException:
            if not stop.is_set():
                raise
        listener.ended.wait(PATIENCE)
    finally:
        spark.streams.removeListener(listener)
    return q.exception() is None, dict(listener.batches)
