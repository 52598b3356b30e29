import datetime
import json
import os
import threading

import pytest

from loomline.sources import paged
from loomline.streaming import adapters as S
from loomline.streaming import progress as P
from loomline.streaming import rescan as Q

# paged listings


def put(root, listing, page, body):
    os.makedirs(f"{root}/{listing}", exist_ok=True)
    with open(f"{root}/{listing}/{page}", "w") as f:
        f.write(body if isinstance(body, str) else json.dumps(body))


def listed(spark, root, **options):
    rows = paged.read_listings(spark, str(root), **options).collect()
    return sorted((r.listing, r.number, r.ord, r.page, r.item, r.error) for r in rows if r.ord is not None), sorted((r.listing, r.number, r.page, r.error) for r in rows if r.ord is None)


def test_cursor_pages(spark, tmp_path):
    page = lambda items, then=None: {"query": {"all": items}} | ({"continue": {"next": then}} if then else {})
    put(tmp_path, "a", "p0", page([1, {"é": [2]}], "p1"))
    put(tmp_path, "a", "p1", page([], "p2"))
    put(tmp_path, "a", "p2", page(["x"]))
    put(tmp_path, "a", "p3", page(["unlinked"]))
    put(tmp_path, "gone", "p0", page([1], "p9"))
    put(tmp_path, "broken", "p0", page([1], "p1"))
    put(tmp_path, "broken", "p1", "{")
    put(tmp_path, "loop", "p0", page([1], "p1"))
    put(tmp_path, "loop", "p1", page([2], "p0"))
    put(tmp_path, "odd", "p0", [1, 2])
    rows, errors = listed(spark, tmp_path, start="p0", items="query.all", cursor="continue.next")
    assert rows == [
        ("a", 0, 0, "p0", "1", None), ("a", 0, 1, "p0", '{"é": [2]}', None), ("a", 2, 0, "p2", '"x"', None),
        ("broken", 0, 0, "p0", "1", None), ("gone", 0, 0, "p0", "1", None), ("loop", 0, 0, "p0", "1", None), ("loop", 1, 0, "p1", "2", None),
    ]
    assert errors == [("broken", 1, "p1", "malformed page"), ("gone", 1, "p9", "missing page"), ("loop", 2, "p0", "repeated page")]
    assert listed(spark, tmp_path, start="p0", items="query.all", cursor="continue.next", max_pages=1)[1] == []


def test_link_pages(spark, tmp_path):
    for n in range(14):
        link = f'<https://host/x?page=1>; rel="prev", <https://host/list/p{n + 1}>; rel="next"'
        put(tmp_path, "many", f"p{n}", {"headers": {"Link": link}, "body": [n]})
    put(tmp_path, "shapes", "p0", {"headers": {"Link": "<h/p1>; rel=next"}, "body": {"items": [1, 2]}})
    put(tmp_path, "shapes", "p1", {"headers": {}, "body": {"one": 1}})
    rows, errors = listed(spark, tmp_path, style="link", start="p0")
    assert [r[4] for r in rows if r[0] == "many"] == [str(n) for n in range(10)]  # ten pages at most
    assert [r[4] for r in rows if r[0] == "shapes"] == ["1", "2", '{"one": 1}'] and errors == []
    assert paged.next_link('<a>; rel="last"') is None and paged.next_link("") is None


def test_no_listings(spark, tmp_path):
    assert listed(spark, tmp_path / "nothing") == ([], [])


def test_paged_stream_goes_on_after_known_pages(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    put(root, "a", "p0", {"items": [1, 2], "continue": "p1"})

    def run():
        paged.register(spark)
        s = spark.readStream.format(paged.NAME).options(path=str(root), start="p0").load()
        S.drain(s, S.append_parquet(out), str(tmp_path / "work"))
        return sorted((r.listing, r.number, r.item) for r in spark.read.parquet(out).collect())

    assert run() == [("a", 0, "1"), ("a", 0, "2")]
    put(root, "a", "p1", {"items": [3], "continue": "p2"})
    put(root, "b", "p0", {"items": [4]})
    assert run() == [("a", 0, "1"), ("a", 0, "2"), ("a", 1, "3"), ("b", 0, "4")]
    assert len(os.listdir(out)) >= 2


# rescan queue

T0 = datetime.datetime(2024, 1, 1)


def at(s):
    return T0 + datetime.timedelta(seconds=s)


def transitions(spark, tmp_path, batches, most=3):
    own = Q.state_session(spark, 2)
    schema = "item string, at timestamp, ord bigint, outcome string"
    folder = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        own.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
        os.utime(folder)
    s = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    out = str(tmp_path / "out")
    q = Q.rescans(s, most, 120_000).writeStream.foreachBatch(S.append_parquet(out)).option("checkpointLocation", str(tmp_path / "work")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.item, (r.at - T0).total_seconds(), r.status, r.attempts, r.reason) for r in spark.read.parquet(out).collect())


EVENTS = [
    ("a", at(0), 0, "taken"), ("b", at(1), 0, "again"), ("c", at(2), 0, "rejected"), ("d", at(3), 0, "again"), ("e", at(4), 0, "again"), (None, at(5), 0, "taken"),
    ("b", at(60), 0, "taken"), ("a", at(61), 0, "rejected"), ("d", at(100), 0, "again"), ("f", at(101), 0, None),
    ("d", at(150), 1, "rejected"), ("d", at(150), 0, "again"), ("e", at(500), 0, "taken"), ("g", at(500), 0, "again"), ("h", at(501), 0, "again"), ("h", at(505), 0, "rejected"), ("z", at(900), 0, "taken"),
]
EXPECTED = [
    ("a", 0, "scanned", 1, None), ("b", 1, "needs_rescan", 1, "another look"), ("b", 60, "rescanned", 2, None), ("c", 2, "failed", 1, "rejected"),
    ("d", 3, "needs_rescan", 1, "another look"), ("d", 100, "needs_rescan", 2, "another look"), ("d", 150, "rescanned", 3, None),
    ("e", 4, "needs_rescan", 1, "another look"), ("e", 124, "failed", 1, "no result in time"), ("f", 101, "failed", 1, "rejected"),
    ("g", 500, "needs_rescan", 1, "another look"), ("g", 620, "failed", 1, "no result in time"), ("h", 501, "needs_rescan", 1, "another look"), ("h", 505, "failed", 2, "rejected after rescan"), ("z", 900, "scanned", 1, None),
]


@pytest.mark.parametrize("size", [40, 5])
def test_rescans_whatever_the_batches(spark, tmp_path, size):
    batches = [EVENTS[i : i + size] for i in range(0, len(EVENTS), size)]
    assert transitions(spark, tmp_path, batches) == EXPECTED


@pytest.mark.parametrize("size", [40, 3])
def test_rescans_of_items_that_share_a_bucket(spark, tmp_path, monkeypatch, size):
    """Python is called by bucket, not by item: items of one bucket keep their own attempts and times."""
    monkeypatch.setattr(Q, "BUCKETS", 1)
    batches = [EVENTS[i : i + size] for i in range(0, len(EVENTS), size)]
    assert transitions(spark, tmp_path, batches) == EXPECTED
    rows = spark.read.format("statestore").load(str(tmp_path / "work")).selectExpr("size(value.groupState.item) as n").collect()
    assert [r.n for r in rows] == [9]


# progress and cancel


def test_stop_after_a_batch_and_go_on(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{folder}/{i}")
    stream = lambda: spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    out, work, stop, told = str(tmp_path / "out"), str(tmp_path / "work"), threading.Event(), []
    write = S.append_parquet(out)

    def until_second(batch, number):
        write(batch, number)
        if number == 1:
            stop.set()

    done, batches = P.drain_until(stream(), until_second, work, stop, lambda *x: told.append(x))
    assert not done and batches == {0: 10, 1: 10} and told == [(0, 10, 10), (1, 10, 20)]
    assert spark.read.parquet(out).count() == 20
    stop.clear()
    done, batches = P.drain_until(stream(), write, work, stop)
    assert done and batches == {2: 10, 3: 10}
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(40))


def test_a_failing_handler_is_no_stop(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))

    def broken(batch, number):
        raise ValueError("broken")

    with pytest.raises(Exception, match="broken"):
        P.drain_until(spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")), broken, str(tmp_path / "work"), threading.Event())
