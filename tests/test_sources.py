import json

import pytest
from pyspark.sql import functions as F

from loomline.sources import readers as R
from loomline.sources import sinks


def test_tolerant_json(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps([{"id": 1, "n": "a"}]))
    (tmp_path / "bad.json").write_text("{nope")
    assert R.json_or_empty(spark, str(tmp_path / "good.json"), "id int, n string").count() == 1
    assert R.json_or_empty(spark, str(tmp_path / "bad.json"), "id int, n string").count() == 0
    assert R.json_or_empty(spark, str(tmp_path / "none.json"), "id int, n string").count() == 0
    assert R.json_or_default(spark, str(tmp_path / "none.json"), "id int", [(7,)]).first().id == 7


def test_locale_fallback(spark, tmp_path):
    for lang, text in (("en", '[{"k":"a"}]'), ("de", "[]")):
        (tmp_path / lang).mkdir()
        (tmp_path / lang / "items.json").write_text(text)
    assert R.locale_or_english(spark, str(tmp_path), "de", "items", "k string").count() == 1
    assert R.locale_or_english(spark, str(tmp_path), "de", "items", "k string", fall_through_empty=False).count() == 0
    assert R.locale_or_english(spark, str(tmp_path), "fr", "items", "k string").count() == 1


def test_scan_folders(spark, tmp_path):
    for name, files in (("s/raw/1", ("meta.json", "full.png", "x.png")), ("s/raw/2", ("meta.json",))):
        (tmp_path / name).mkdir(parents=True)
        for f in files:
            (tmp_path / name / f).write_text('{"index": 4}' if f == "meta.json" else "x")
    whole, lacking = R.scan_folders(spark, str(tmp_path))
    assert whole.select("folder").distinct().count() == 1
    assert [r.lacks for r in lacking.collect()] == [["full.png"]]
    meta = R.scan_meta(spark, str(tmp_path), "index int, monitor int, page int", {"monitor": 2}, {"page": 0, "monitor": 1}).collect()
    assert [(r["index"], r.monitor, r.page) for r in meta] == [(4, 2, 0)]
    assert [r.session for r in R.sessions(spark, str(tmp_path)).collect()] == ["s"]
    assert R.tree(spark, str(tmp_path)).count() == 4


def test_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver doesn't list files: Spark's own file index isn't asked about the folder; hidden and empty files stay out."""
    monkeypatch.setattr(R, "PER_TASK", 3)
    for k in range(10):
        (tmp_path / f"in/s/raw/{k}").mkdir(parents=True)
        for name in ("meta.json", "full.png", ".x", "_y"):
            (tmp_path / f"in/s/raw/{k}/{name}").write_text(["{", '[{"index": 1}, {"index": 2}]', " ", '{"index": 3}'][k % 4] if name == "meta.json" else "x")
    (tmp_path / "in/s/raw/3/full.png").write_text("")
    root = f"file://{tmp_path}/in"
    listed = R.files(spark, root)
    assert listed.count() == 19 and not any("/in/" in f for f in listed.inputFiles())
    meta = R.scan_meta(spark, root, "index int", {}, {}, listed)
    assert not any("/in/" in f for f in meta.inputFiles())
    assert [(r.folder[-1], r["index"]) for r in meta.orderBy("folder", "index").collect()] == [("0", None), ("1", 1), ("1", 2), ("4", None), ("5", 1), ("5", 2), ("7", 3), ("8", None), ("9", 1), ("9", 2)]
    assert [r.folder for r in R.scan_folders(spark, root)[1].collect()] == [f"{root}/s/raw/3"]
    assert not any("/in/" in f for f in R.tree(spark, root).inputFiles() + R.sessions(spark, root).inputFiles())


def test_complete_sections(spark):
    d = spark.createDataFrame([(1, s) for s in (0, 1, 3, 4)] + [(2, 0), (2, 1)], "id int, section int")
    assert {r.id for r in R.complete_sections(d, "id", "section").collect()} == {1}


def test_rules_and_search(spark, tmp_path):
    (tmp_path / "r.toml").write_text("[a]\nx = 1\n[a.b]\ny = 'z'\n")
    assert sorted(map(tuple, R.toml_rules(spark, str(tmp_path / "r.toml")).collect())) == [("a", "x", "1"), ("a.b", "y", "z")]
    assert R.toml_rules(spark, str(tmp_path / "no.toml")).count() == 0
    hit = R.content_search(spark, str(tmp_path), "Y =", 5).collect()
    assert [(r.line_no, r.line) for r in hit] == [(3, "y = 'z'")]
    assert [tuple(r) for r in R.split_log(spark.createDataFrame([("a\x1fb",), ("a",)], "l string"), "l", ("p", "q")).collect()] == [("a", "b")]
    assert {(r.Id, r.Content) for r in R.text_table(spark.createDataFrame([(0, "a", "x"), (1, "a", "y")], "ord int, Id string, Content string")).collect()} == {("a", "y")}


def test_sections_sink(spark, tmp_path):
    some, none = spark.range(2), spark.range(0)
    assert sinks.write_sections({"a": some, "b": none, "c": None, "e": spark.createDataFrame([("x",)], "error string")}, str(tmp_path)) == ["a"]
    assert spark.read.json(str(tmp_path / "a")).count() == 2


def test_state_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "state")
    assert sinks.load_state(spark, path) is None
    sinks.save_state(spark.createDataFrame([(1, "a")], "k int, sha string"), path)
    sinks.save_state(sinks.load_state(spark, path).withColumn("sha", F.lit("b")), path)  # read from its own path
    assert [tuple(r) for r in sinks.load_state(spark, path).collect()] == [(1, "b")]
    assert len(list((tmp_path / "state").glob("state-*"))) == 1


def test_sync_saves_only_complete_states(spark, tmp_path):
    path = str(tmp_path / "state")
    planned = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, sha string")
    todo, complete = sinks.sync_sources(planned, None, "name", "sha", lambda t: t.filter("name = 'a'"), path)
    assert todo.count() == 2 and not complete and sinks.load_state(spark, path) is None
    assert sinks.sync_sources(planned, None, "name", "sha", lambda t: t, path)[1]
    changed = planned.withColumn("sha", F.when(F.col("name") == "b", "3").otherwise(F.col("sha")))
    todo, complete = sinks.sync_sources(changed, sinks.load_state(spark, path), "name", "sha", lambda t: t, path)
    assert complete and [r.name for r in sinks.load_state(spark, path).filter("sha = '3'").collect()] == ["b"]


def test_yaml_rules(tmp_path):
    with pytest.warns(UserWarning, match="disabled"):
        assert R.yaml_rules(str(tmp_path / "none.yaml")) is None
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("a: {b: [1, 2]}")
    assert R.yaml_rules(str(tmp_path / "r.yaml")) == {"a": {"b": [1, 2]}}
    (tmp_path / "bad.yaml").write_text("a: [")
    with pytest.warns(UserWarning, match="disabled"):
        assert R.yaml_rules(str(tmp_path / "bad.yaml")) is None
