"""From raw documents to packed sequences: rules, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs; all but the last return the columns of documents. The mixing stage range-sorts by training position, so
the order is that of its files and of the rows in them, and the packing stage keeps it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import mixing, ngram_join, packing, quality_rules, secrets
from loomline.llm.common import discard, finished, table

#: Ids, at most, that are broadcast to the documents; beyond, the join is by shuffle.
MOST_IDS = 1_000_000


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of similar ones; rows without an id stay, rows repeated under one id stay once."""
    found = finished(lambda: ngram_join.join(docs), "pipeline-components")
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    gone = F.broadcast(gone) if found.filter("doc_id <> component_id").count() <= MOST_IDS else gone
    out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return out
    return out.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(out.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with each secret in their texts replaced; n_chars follows."""
    clean = secrets.redact(docs, secrets.train(secrets.labelled_samples(spark, docs)))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of their training positions."""
    return mixing.place(docs)


def in_order(docs: DataFrame) -> DataFrame | None:
    """docs with the number of its file and its row there, which are the order in which a sorted table was written; None if docs isn't read from files."""
    try:
        d = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return None
    return d.withColumn("_range", F.coalesce(F.regexp_extract("_file", r"^part-(\d+)", 1).try_cast("bigint"), F.lit(0))).drop("_file")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens; sequences are numbered in the order of the documents."""
    ordered = in_order(docs)
    if ordered is None:
        return packing.pack(docs, packing.default_tokenizer())
    return packing.pack(ordered, packing.default_tokenizer(), order=("_range", "_row"))


STAGES = [("quality rules", rules), ("n-gram Jaccard join", near_duplicates), ("secret scans", without_secrets), ("mixing sources", mixed), ("best-fit packing", packed)]

#: The forest, the Markov models and the tokenizer aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written is deleted when the next one is, and only the result stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = finished(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return docs
