"""What the operators of this subpackage share: tables, cuts in the lineage, words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where none is named, one in the default file system, or a temporary one if all runs in one process."""
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
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Paths that cut() has written, by open scope.
_scopes: list[list[str]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a table in the shared folder and go on from there: it's computed once, and a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/loomline/{name}-{uuid.uuid4().hex}"
    for made in _scopes:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete a table that cut() wrote and that nothing reads any more."""
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if "/loomline/" in f:
            _delete(df.sparkSession, f)


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make(), written as a table by cut(), without the tables that were written on the way to it."""
    _scopes.append([])
    try:
        out = cut(make(), name)
        for path in _scopes[-1][:-1]:  # the last one is the result
            _delete(out.sparkSession, path)
    finally:
        _scopes.pop()
    return out


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a plan's size, from file sizes: for choosing how many buckets to deal rows into."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(batches: Iterable, rows: int = 256) -> Iterator:
    """Arrow batches of few rows, so that few texts at a time become Python strings."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(m)), F.lit(0)).cast("int")


def py_crc32_mod(doc_id: int | None, m: int) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % m


def bounded_sample(labelled: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those with the smallest hash of key: the same rows on every run. The bound is proven by limit()."""
    return labelled.orderBy(F.xxhash64(F.col(key), F.lit(17)), F.col(key)).limit(most)


def bounded_texts(labelled: DataFrame, label: str, most_rows: int, most_bytes: int) -> DataFrame:
    """(doc_id, label, text) of at most most_rows rows, and most_bytes of text, of each label: the same rows on every run.

    Rows are taken in the order of a hash of their ids while their texts fit in together; a text that is longer than all
    that is never one of them, and equal rows count once. Only sizes are sorted, in the map tasks down to most_rows first.
    """
    named = labelled.select("doc_id", label, "text", F.xxhash64("text").alias("_h"))
    sizes = named.groupBy("doc_id", label, "_h").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).cast("bigint").alias("_n")).filter(F.col("_n") <= most_bytes)
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id", "_h")
    first = sizes.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= most_rows)
    fit = first.withColumn("_sum", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_sum") <= most_bytes)
    return named.join(F.broadcast(fit.select("doc_id", label, "_h")), ["doc_id", label, "_h"]).dropDuplicates(["doc_id", "_h"]).select("doc_id", label, "text")  # at most most_rows keys a label
