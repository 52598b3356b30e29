"""Tolerant sources: what is missing or malformed becomes an empty, typed table, or a row in a report."""

from __future__ import annotations

import tomllib
import warnings
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..streaming.adapters import work_folder

#: Folders that a task lists or files that it reads, about; tasks for them, and rows that one sends out at once, at most.
PER_TASK, MOST_TASKS, SENT = 256, 1_024, 10_000


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def json_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A JSON document (an object, or a list of them); no rows if it's missing or malformed."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    typed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = spark.read.text(path, wholetext=True).filter(F.try_parse_json("value").isNotNull())
    return whole.select(F.inline(F.from_json("value", ArrayType(typed))))


def json_or_default(spark: SparkSession, path: str, schema: str, default: list[tuple]) -> DataFrame:
    """The same, with a typed default in place of nothing."""
    d = json_or_empty(spark, path, schema)
    return spark.createDataFrame(default, schema) if d.isEmpty() else d


def locale_or_english(spark: SparkSession, root: str, lang: str, name: str, schema: str, fall_through_empty: bool = True) -> DataFrame:
    """A locale's file, or the whole English one: if it's missing, and, where asked for, if it's empty."""
    path = f"{root}/{lang}/{name}.json"
    if path_exists(spark, path):
        d = json_or_empty(spark, path, schema)
        if not fall_through_empty or not d.isEmpty():
            return d
    return json_or_empty(spark, f"{root}/en/{name}.json", schema)


def language_code(name, known: list[str], codes: dict[str, str]):
    """A column of language names to codes: a known code itself, by name, a mapped code itself, else en."""
    out = F.when(name.isin(*known), name) if known else F.when(F.lit(False), name)
    for n, code in codes.items():
        out = out.when(F.lower(name) == n.lower(), code)
    return F.coalesce(out.when(F.lower(name).isin(*[c.lower() for c in codes.values()]), F.lower(name)), F.lit("en"))


def text_table(rows: DataFrame) -> DataFrame:
    """(Id, Content) of rows (ord, Id, Content): the last one of an id."""
    return rows.groupBy("Id").agg(F.max_by("Content", "ord").alias("Content"))


def _store(root: str):
    """The file system of root, and root's path there."""
    from pyarrow import fs

    store, home = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    return store, home.rstrip("/")


def _tasks(n: int) -> int:
    return max(1, min(MOST_TASKS, -(-n // PER_TASK)))


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of the files below root, relative to it; empty and hidden ones, and what is in hidden folders, are left out.

    Tasks list the folders, a level at a time, and write what they find as a table; the driver only gets the number of folders.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, home = _store(root)
        for f in frames:
            for folder in f["path"]:
                seen = store.get_file_info(fs.FileSelector(f"{home}/{folder}" if folder else home))
                # hidden: as Spark's own readers have it
                seen = [x for x in seen if not (x.base_name.startswith(".") or x.base_name.startswith("_") and "=" not in x.base_name or x.base_name.endswith("._COPYING_"))]
                for at in range(0, len(seen), SENT):
                    some = seen[at : at + SENT]
                    paths = [f"{folder}/{x.base_name}" if folder else x.base_name for x in some]
                    yield pd.DataFrame({"path": paths, "size": pd.array([x.size if x.type == fs.FileType.File else None for x in some], "Int64")})

    out, kind, paths = f"{work_folder(spark)}/files", "path string, size bigint", []
    folders = spark.createDataFrame([("",)], "path string")
    while True:
        paths.append(f"{out}/{len(paths)}")
        folders.mapInPandas(run, kind).write.parquet(paths[-1])
        folders = spark.read.schema(kind).parquet(paths[-1]).filter("size is null").select("path")
        n = folders.count()
        if not n:
            return spark.read.schema(kind).parquet(*paths).filter("size > 0")
        folders = folders.repartition(_tasks(n))


def contents(paths: DataFrame, root: str) -> DataFrame:
    """The rows, with the text of the file that path names below root as content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, home = _store(root)
        for f in frames:
            for at in range(0, len(f), PER_TASK):
                some, read = f.iloc[at : at + PER_TASK], []
                for path in some["path"]:
                    with store.open_input_stream(f"{home}/{path}") as file:
                        read.append(file.read().decode("utf-8-sig", "replace"))
                yield some.assign(content=read)

    return paths.repartition(_tasks(paths.count())).mapInPandas(run, StructType(paths.schema.fields).add("content", "string"))


def scan_folders(spark: SparkSession, root: str, needed: tuple[str, ...] = ("meta.json", "full.png"), listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(folder, path, name) of complete folders below root, and incomplete folders with what they lack. Contents aren't read; files() may be given."""
    whole = F.concat(F.lit(root.rstrip("/") + "/"), "path")
    found = (files(spark, root) if listed is None else listed).select(whole.alias("path"))
    f = found.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), "path", F.substring_index("path", "/", -1).alias("name"))
    has = f.groupBy("folder").agg(F.collect_set(F.when(F.col("name").isin(*needed), F.col("name"))).alias("has"))
    lacking = has.withColumn("lacks", F.array_except(F.array(*[F.lit(n) for n in needed]), "has")).filter(F.size("lacks") > 0).select("folder", "lacks")
    return f.join(lacking, "folder", "left_anti"), lacking


def scan_meta(spark: SparkSession, root: str, schema: str, manifest: dict, constants: dict, listed: DataFrame | None = None) -> DataFrame:
    """meta.json of every complete folder: columns it lacks come from the manifest, then from constants. files() may be given."""
    whole, _ = scan_folders(spark, root, listed=listed)
    at = whole.filter("name = 'meta.json'").select("folder", F.substring("path", len(root.rstrip("/")) + 2, 1 << 20).alias("path"))
    typed, text = StructType.fromDDL(schema), F.col("content")
    several = F.coalesce(F.from_json(text, ArrayType(typed)), F.array(F.lit(None).cast(typed)))  # a malformed one is a row of nulls
    records = F.when(F.ltrim(text).startswith("["), several).otherwise(F.array(F.from_json(text, typed)))
    d = contents(at, root).filter(F.trim(text) != "").select("folder", F.inline(records))
    for c in StructType.fromDDL(schema).names:
        value = manifest.get(c, constants.get(c))
        if value is not None:
            d = d.withColumn(c, F.coalesce(F.col(c), F.lit(value)))
    return d.orderBy("folder")


def complete_sections(rows: DataFrame, key: str, section: str, needed: tuple[int, ...] = (0, 1, 3, 4)) -> DataFrame:
    """Keys that have every needed section."""
    have = rows.filter(F.col(section).isin(*needed)).groupBy(key).agg(F.count_distinct(section).alias("_n"))
    return rows.join(have.filter(F.col("_n") == len(needed)), key, "left_semi")


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions below root that have raw files, empty ones not counted, newest first."""
    f = files(spark, root).select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path"))
    return f.select(F.regexp_extract("path", r"/([^/]+)/raw/", 1).alias("session")).filter("session <> ''").distinct().orderBy(F.desc("session"))


def toml_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule, setting, value) of a rules file whose tables nest; a small file that the driver parses."""
    found: list[tuple[str, str, str]] = []

    def walk(prefix: str, node: dict) -> Iterator[tuple[str, str, str]]:
        for k, v in node.items():
            if isinstance(v, dict):
                yield from walk(f"{prefix}.{k}" if prefix else k, v)
            else:
                yield prefix, k, str(v)

    if Path(path).exists():
        found = list(walk("", tomllib.loads(Path(path).read_text())))
    return spark.createDataFrame(found, "rule string, setting string, value string")


def yaml_rules(path: str) -> dict | None:
    """A rules file in YAML; None, with a warning, where it is missing, broken, or nothing can read YAML: rules that aren't there disable validation."""
    try:
        import yaml

        return yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except ImportError:
        warnings.warn("no YAML reader is installed: validation is disabled", stacklevel=2)
    except FileNotFoundError:
        warnings.warn(f"no rules at {path}: validation is disabled", stacklevel=2)
    except yaml.YAMLError as e:
        warnings.warn(f"rules at {path} can't be read ({e}): validation is disabled", stacklevel=2)
    return None


def split_log(lines: DataFrame, line: str, names: tuple[str, ...], sep: str = "\x1f") -> DataFrame:
    """Fields of delimited lines; lines with fewer fields go."""
    parts = F.split(line, sep, len(names))
    d = lines.withColumn("_p", parts).filter(F.size("_p") == len(names))
    return d.select(*[F.get("_p", i).alias(n) for i, n in enumerate(names)])


def tree(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, type, size) of the files and folders below root, relative to it; folders have no size, hidden names are left out, and only what is right below root is listed unless recursive.

    Folders are those that files lie in: an empty one isn't seen. Contents aren't read.
    """
    f = files(spark, root)
    parts = F.split("path", "/")
    inner = f.filter(F.contains("path", F.lit("/")))
    folders = (inner.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")) if recursive else inner.select(F.get(parts, 0).alias("path"))).distinct()
    listed = f if recursive else f.filter(~F.contains("path", F.lit("/")))
    return listed.select("path", F.lit("file").alias("type"), "size").unionByName(folders.select("path", F.lit("dir").alias("type"), F.lit(None).cast("bigint").alias("size")))


def content_search(spark: SparkSession, root: str, query: str, most: int, pattern: str = "*") -> DataFrame:
    """(path, line_no, line) where a line holds the query literally in any case; at most `most`, in order."""
    d = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).withColumn("path", F.col("_metadata.file_path"))
    d = d.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return d.filter(F.lower("line").contains(query.lower())).orderBy("path", "line_no").limit(most)
