import os

import duckdb
import pytest

import corpus_pipeline
from loomline.llm import mixing, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")

COLUMNS = {
    "op1_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op2_html_extraction": "page_id url text n_chars",
    "op3_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_pack_sequences": "doc_id piece start length ids_crc32 sequence_id offset",
    "op5_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op6_nearest_neighbours": "query_id rank vec_id score",
    "op7_ngram_jaccard": "doc_id n_shingles component_id",
    "op8_toxicity": "doc_id held_out score predicted",
    "op9_quality_mil": "doc_id held_out score predicted",
    "op10_mix_sources": "doc_id size source_size target taken",
    "op11_lexical_search": "item_id rank doc_id score",
    "op12_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op13_embedding_dedup": "vec_id n_links component_id kept",
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert got
    if name in registry.ORACLES:
        db = duckdb.connect()
        for t in ("documents", "conversations", "benchmark", "embeddings"):
            db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        rel = db.sql(registry.ORACLES[name])
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, seen, DATA)
        assert out.columns == docs.columns
        assert out.join(seen.select("doc_id"), "doc_id", "left_anti").isEmpty()
        seen = spark.createDataFrame(out.collect(), docs.schema)
    assert 0 < seen.count() < docs.count()
    packed = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(packed.doc_id) <= {r.doc_id for r in seen.collect()}
    assert (packed.groupby("sequence_id").length.sum() <= 1024).all()


def test_pipeline_keeps_the_curriculum_and_only_its_result(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    path = str(tmp_path / "mixed")
    mixing.place(docs).write.parquet(path)
    order = [r.doc_id for r in mixing.place(docs).collect()]
    placed = spark.read.parquet(path)
    assert order == [r.doc_id for r in corpus_pipeline.in_order(placed).orderBy("_range", "_row").collect()]
    assert corpus_pipeline.in_order(spark.createDataFrame([(1, "a")], "doc_id bigint, text string")) is None
    rows = corpus_pipeline.packed(spark, placed, DATA).collect()
    assert {r.doc_id for r in rows} == set(order) and len({r.sequence_id for r in rows}) > 20
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/loomline"
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, DATA).count()
    new = set(os.listdir(folder)) - before
    assert [n.rpartition("-")[0] for n in new] == ["stage-best-fit-packing"]


@pytest.fixture(scope="module")
def odd_table(spark, odd_docs, tmp_path_factory):
    """The odd rows with the columns of documents, and clashing ones, as a folder of tables."""
    folder = str(tmp_path_factory.mktemp("odd"))
    odd_docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, None), (8, None, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, odd_table, stage):
    name, run = corpus_pipeline.STAGES[stage]
    docs = spark.read.parquet(f"{odd_table}/documents.parquet")
    out = run(spark, docs, odd_table)
    rows = out.collect()
    if stage < 4:
        assert out.columns == docs.columns
    else:
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}  # each document has its end token at least
    if stage == 1:  # rows without an id stay; equal texts, and rows repeated under one id, stay once
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8, 10]
        assert sum(r.doc_id is None for r in rows) >= 2
    if stage == 2:
        assert len(rows) == docs.count()
    none = run(spark, docs.limit(0), odd_table)
    assert none.columns == out.columns and none.count() == 0
