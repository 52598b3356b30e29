"""Structured Streaming twins of the batch operators: micro-batches, routing by type, keyed state.

Every run works off what its source has (availableNow) and stops; state and progress are kept in the checkpoint
folder, so a restarted run goes on where the last one stopped.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names; where none is named, in the default file system, or a temporary one if all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
        if spark.sparkContext.master.startswith("local"):  # one machine: driver and executors are one process
            folder = tempfile.mkdtemp(prefix="loomline-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            found = "file://" + folder
        elif fs.getScheme() != "file":
            found = f"{fs.getHomeDirectory().toString().rstrip('/')}/.loomline"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{found}/loomline-stream/{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A table's files as a stream, so many files a micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).parquet(f"{sf_dir}/{name}.parqu[e]t")


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], folder: str, mode: str = "append", stores: int = 16) -> None:
    """Hand each micro-batch to a function until the source is worked off; keyed state is dealt over so many stores, for good in this folder."""
    conf, name = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    conf.set(name, str(stores))
    try:  # the query copies the session's settings when it starts
        q = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    q.awaitTermination()


def route(column: str, handlers: dict[str, Callable[[DataFrame, int], None]], failed: Callable[[str, int, Exception], None], other: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A micro-batch handler that gives each type's rows to its own handler, and rows of all other types, or of none, to `other`; the failure of one leaves the others."""

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            rest = ~F.coalesce(F.col(column).isin(*handlers), F.lit(False))
            for kind, f in (handlers | ({"other": other} if other else {})).items():
                try:
                    f(batch.filter(rest if f is other else F.col(column) == kind), number)
                except Exception as e:  # noqa: BLE001 - reported, per type
                    failed(kind, number, e)
        finally:
            batch.unpersist()

    return handle


def append_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch to its own folder: a repeated batch replaces itself."""
    return lambda df, number: df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def merged_entities(stream: DataFrame, key: str, order: str, fields: list[str], last_section: int, section: str) -> DataFrame:
    """Partial records by key, merged field by field (the last in order wins, however late or early it comes); complete once the last section is there.

    A streaming aggregate: the state of a key is each field's value with its place in the order, kept in the JVM.
    Without a watermark on the stream the state of a key stays.
    """
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return stream.groupBy(key).agg(*last, F.max(F.coalesce(F.col(section) == last_section, F.lit(False))).alias("complete"))


def register_text_backends(spark: SparkSession, backends: dict[str, Callable[[pd.Series], pd.Series]]) -> None:
    """Register each text function under its name for SQL."""
    for name, f in backends.items():
        spark.udf.register(name, F.pandas_udf(f, "string"))
