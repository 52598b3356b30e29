"""Sinks: sections as JSON files, state tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import commit_if_complete, promoting_lookup


def write_sections(sections: dict[str, DataFrame | None], root: str) -> list[str]:
    """One JSON folder per section, without those that are absent, failed (a column error) or empty; the names written."""
    done = []
    for name, df in sections.items():
        if df is None or df.columns == ["error"] or df.isEmpty():
            continue
        df.write.mode("overwrite").json(f"{root}/{name}")
        done.append(name)
    return done


def save_state(state: DataFrame, path: str) -> None:
    """Replace the state, whole or not at all: it is written to a folder of its own, to which a pointer file is then moved; it may be read from the same path."""
    spark = state.sparkSession
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    version = f"state-{uuid.uuid4().hex}"
    state.write.parquet(f"{path}/{version}")
    draft = jvm.org.apache.hadoop.fs.Path(root, f"draft-{version}")
    out = fs.create(draft)
    out.write(bytearray(version.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, jvm.org.apache.hadoop.fs.Path(root, "CURRENT"), how)
    for f in fs.listStatus(root):
        if f.getPath().getName().startswith("state-") and f.getPath().getName() != version:
            fs.delete(f.getPath(), True)


def load_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The state last saved at path; None if there is none."""
    pointer = spark.read.format("binaryFile").option("pathGlobFilter", "CURRENT")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(root, "CURRENT")):
        return None
    version = pointer.load(f"{path}/CURRENT").select(F.col("content").cast("string").alias("v")).first().v
    return spark.read.parquet(f"{path}/{version}")


def sync_sources(planned: DataFrame, state: DataFrame | None, key: str, digest: str, fetch: Callable[[DataFrame], DataFrame], path: str) -> tuple[DataFrame, bool]:
    """Fetch the sources that are new or have another digest than in the state, and save the new state only if all of them are done.

    planned (key, digest, ...); fetch gets the rows to fetch and returns (key) of those it did. The rows fetched for, and whether the state was saved.
    """
    todo = planned
    if state is not None:
        known = state.select(key, F.col(digest).alias("_d"))
        todo = planned.join(known, key, "left").filter(~F.col(digest).eqNullSafe(F.col("_d"))).drop("_d")
    complete = commit_if_complete(todo, fetch(todo).select(key), key)
    if complete:
        save_state(planned, path)
    return todo, complete


def lookup_in_state(requests: DataFrame, order: str, path: str, store: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """Requests looked up in the memory saved at path, then in the store; hits of the store are in the memory from then on, whole or not at all.

    The answers are written beside the memory first, so they are those of the memory as it was. A lost run leaves the memory as it was.
    """
    spark = requests.sparkSession
    memory = load_state(spark, path)
    if memory is None:
        kinds = {f.name: f.dataType.simpleString() for f in store.schema}
        memory = spark.createDataFrame([], ", ".join(f"{c} {kinds[c]}" for c in [*keys, payload]) + ", hits bigint")
    answers, after = promoting_lookup(requests, order, memory, store, keys, payload)
    told = f"{path}/answers-{uuid.uuid4().hex}"
    answers.write.parquet(told)
    save_state(after, path)
    return spark.read.parquet(told)


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Each row (path, content) as a file of its own below root, and the list (path, size) of what was written; a repeated run writes the same files again.

    A null content is an empty file. Files are put in place whole: a draft beside them is moved.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, home = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for f in frames:
            done = []
            for path, content in zip(f["path"], f["content"], strict=True):
                folder, _, name = f"{home}/{path}".rpartition("/")
                data = bytes(content) if content is not None else b""
                store.create_dir(folder, recursive=True)
                draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(data)
                store.move(draft, f"{folder}/{name}")
                done.append((path, len(data)))
            yield pd.DataFrame(done, columns=["path", "size"])

    done = rows.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(run, "path string, size bigint")
    listed = f"{root}/.written-{uuid.uuid4().hex}"
    done.write.parquet(listed)  # once: the list is read from here
    return rows.sparkSession.read.parquet(listed)
