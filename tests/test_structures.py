import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import aggregate as A
from loomline.operators import batches as B
from loomline.operators import icons as I
from loomline.operators import incremental as C
from loomline.operators import layout as W
from loomline.operators import nested as N
from loomline.operators import prefixes as P
from loomline.operators import screens as L
from loomline.sources import readers, sinks

# icons


def plain_score(a, am, b, bm):
    """One pair, channel by pixel: correlation over common pixels less 1.5 times the distance of the means."""
    m = (am > 127) & (bm > 127)
    if not m.any():
        return 0.0
    x, y = a[:, m].ravel(), b[:, m].ravel()
    apart = np.sqrt(((a[:, m].mean(1) - b[:, m].mean(1)) ** 2).sum()) / (np.sqrt(3) * 255)
    x, y = x - x.mean(), y - y.mean()
    d = np.sqrt((x @ x) * (y @ y))
    return (0.0 if d < 1e-10 else x @ y / d) - 1.5 * apart


def test_masked_scores_against_plain():
    rng = np.random.default_rng(1)
    icons, refs = rng.integers(0, 256, (12, 3, 9)).astype(float), rng.integers(0, 256, (7, 3, 9)).astype(float)
    im, rm = rng.integers(0, 256, (12, 9)).astype(float), rng.integers(0, 256, (7, 9)).astype(float)
    icons[0], im[1], refs[2] = 5.0, 0.0, refs[3]
    native, swapped = I.masked_scores(icons, im, refs, rm)
    for i in range(12):
        for r in range(7):
            assert native[i, r] == pytest.approx(plain_score(icons[i], im[i], refs[r], rm[r]), abs=1e-9)
            assert swapped[i, r] == pytest.approx(plain_score(icons[i][::-1], im[i], refs[r], rm[r]), abs=1e-9)


ICON = "id int, mask array<double>, b array<double>, g array<double>, r array<double>"


def icon(key, mask, b, g, r):
    return (key, *[[float(x) for x in v] for v in (mask, b, g, r)])


def test_match_icons(spark, monkeypatch):
    on = [255] * 4
    ramp, down, flat = [0, 50, 100, 200], [200, 100, 50, 0], [9, 9, 9, 9]
    refs = spark.createDataFrame([icon(5, on, ramp, down, flat), icon(3, on, down, ramp, ramp), icon(2, on, down, ramp, ramp)], ICON).withColumnRenamed("id", "label")
    icons = spark.createDataFrame([icon(1, on, ramp, down, flat), icon(2, on, flat, down, ramp), icon(3, on, down, ramp, ramp), icon(4, [0] * 4, ramp, ramp, ramp), icon(5, on, [255, 0, 0, 255], [0] * 4, [0] * 4)], ICON)
    for blocks in (1000, 1):
        monkeypatch.setattr(I, "REFS", blocks)
        monkeypatch.setattr(I, "ICONS", 2)
        got = {r.id: (r.label, r.score, r.channel_order) for r in I.match_icons(icons, "id", refs, "label").collect()}
        assert got[1] == (5, 1.0, "native") and got[2] == (5, 1.0, "swapped")  # red and blue changed places
        assert got[3][0] == 2  # the smaller label of equal references
        assert got[4] == (None, 0.0, "native") and got[5][0] is None and got[5][1] < 0.2  # rejected
    none = I.match_icons(icons, "id", refs.limit(0), "label").collect()
    assert len(none) == 5 and all(r.label is None and r.score is None for r in none)


def test_nearest_colour_in_both_orders(spark):
    refs = spark.createDataFrame([("blue", 0, 255, 0, 0), ("grey", 1, 9, 9, 9), ("gray", 2, 9, 9, 9)], "name string, ord int, b int, g int, r int")
    px = spark.createDataFrame([(1, 250, 0, 0), (2, 0, 0, 250), (3, 9, 9, 9), (4, None, 0, 0)], "id int, b int, g int, r int")
    got = {r.id: (r.name, r.channel_order, r.distance) for r in I.nearest_colour(px, ["id"], ["b", "g", "r"], refs, "name", "ord").collect()}
    assert got[1] == ("blue", "BGR", 25.0) and got[2] == ("blue", "RGB", 25.0) and got[3] == ("grey", "BGR", 0.0)


# nested values


def leaves(v, path=""):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from leaves(x, f"{path}.{k}" if path else k)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from leaves(x, f"{path}[{i}]")
    else:
        yield path, v


def nest(rng, depth):
    kind = rng.randrange(6) if depth else 9
    if kind < 2:
        return {f"k{rng.randrange(4)}{i}": nest(rng, depth - 1) for i in range(rng.randrange(4))}
    if kind < 4:
        return [nest(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, 7, -3, "x", "é\U0001f600", "[{", '"\\', ""])


def text(v):
    return None if v is None else {True: "true", False: "false"}.get(v, str(v)) if isinstance(v, bool) else str(v)


def test_flatten_any_nesting(spark):
    rng = random.Random(2)
    docs = [(i, nest(rng, rng.randrange(7))) for i in range(120)]
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0), "extra") for i, v in docs] + [(900, None, "x"), (901, "{", "x"), (902, '{"a":1,"a":2}', "x"), (903, "[" * 20 + "1" + "]" * 20, "x")]
    got = sorted((r.id, r.path, r.leaf) for r in N.flatten(spark.createDataFrame(rows, "id int, j string, path string"), ["id"], "j").collect() if r.leaf is not None)
    want = sorted((i, p, text(v)) for i, d in docs for p, v in leaves(d) if v is not None)
    assert got == sorted([*want, (903, "[0]" * 20, "1")])
    nulls = N.flatten(spark.createDataFrame([(1, '{"a":[null]}')], "id int, j string"), ["id"], "j").collect()
    assert [tuple(r) for r in nulls] == [(1, "a[0]", "VOID", None)]
    assert N.flatten(spark.createDataFrame([], "id int, j string"), ["id"], "j").count() == 0


def test_flatten_columns(spark):
    d = spark.sql("select 1 as id, named_struct('a', array(named_struct('b', 2)), 'c', cast(null as int)) as s, map('k', array(1, 2)) as m")
    assert sorted((r.path, r.leaf) for r in N.flatten_columns(d, ["id"], ["s", "m"]).filter("leaf is not null").collect()) == [("m.k[0]", "1"), ("m.k[1]", "2"), ("s.a[0].b", "2")]


def test_canonical_json_is_that_of_sorted_dumps(spark):
    rng = random.Random(3)
    docs = [nest(rng, 4) for _ in range(80)]
    rows = [(i, json.dumps(v, indent=rng.choice([None, 2]), ensure_ascii=i % 3 == 0), json.dumps(v, sort_keys=True, separators=(",", ":"))) for i, v in enumerate(docs)]
    d = spark.createDataFrame(rows, "i int, j string, want string")
    assert d.select("i", N.canonical_json(F.col("j")).alias("c"), "want").filter("c is null or c <> want").collect() == []
    got = d.select("i", "want", N.record_digest(F.col("j"), F.col("i")).alias("h")).collect()
    assert all(r.h == hashlib.sha1(f"{r.want}#{r.i}".encode()).hexdigest()[:10] for r in got)
    same = spark.createDataFrame([('{"b":1.50,"a":"\\u00e9"}',), ('{ "a" : "é", "b" : 1.5 }',), ("{",), (None,)], "j string").select(N.canonical_json(F.col("j")).alias("c")).collect()
    assert same[0].c == same[1].c == '{"a":"\\u00e9","b":1.5}' and same[2].c is None and same[3].c is None


def test_rule_signatures(spark):
    rows = [("r", "b", "2"), ("r", "a", '1"é'), ("s", "a", '1"é'), ("s", "b", "3"), ("t", "a", None)]
    sign = lambda x: {r.rule: r.signature for r in N.rule_signatures(spark.createDataFrame(x, "rule string, setting string, value string")).collect()}
    one, other = sign(rows), sign([("r", "a", '1"é'), ("r", "b", "2"), ("s", "b", "2"), ("s", "a", '1"é')])
    assert one["r"] == other["r"] == other["s"] == hashlib.sha256(b'{"a":"1\\"\\u00e9","b":"2"}').hexdigest() and one["s"] != one["r"] and len(one["t"]) == 64


# prefixes


def test_longest_prefix_against_plain(spark):
    rng = random.Random(4)
    table = {"".join(rng.choices("123", k=rng.randrange(1, 5))): i for i in range(25)} | {"": -1}
    keys = ["".join(rng.choices("1234", k=rng.randrange(0, 7))) for _ in range(300)] + [None]
    rows = spark.createDataFrame([(i, k, 7) for i, k in enumerate(keys)], "id int, k string, _cut int")
    prefixes = spark.createDataFrame(list(table.items()), "p string, v int")
    best = lambda k: next((table[k[:n]] for n in range(len(k), 0, -1) if k[:n] in table), None) if k else None
    got = P.longest_prefix(rows, "k", prefixes, "p", "v", "found")
    assert {r.id: r.found for r in got.collect()} == {i: best(k) for i, k in enumerate(keys)}
    assert P.longest_prefix(rows, "k", prefixes.limit(0), "p", "v", "found").filter("found is not null").isEmpty()


def test_resolve_cost_takes_each_step(spark):
    known = spark.createDataFrame([("gnat", 4), ("31000", 3), ("33000", None)], "ref string, cost bigint")
    prefixes = spark.createDataFrame([("31", 1), ("33", 3), ("34", 4)], "prefix string, cost bigint")
    rows = [(1, "gnat", 31001, 31002, "9"), (2, "none", 31000, 34001, None), (3, None, None, 33000, "9"), (4, "none", 99, 34001, "9"), (5, None, 99, 99, " 7"), (6, None, None, None, "x")]
    d = spark.createDataFrame(rows, "n int, key string, monster bigint, id bigint, given string")
    got = P.resolve_cost(d, ["key", "monster", "id"], known, ["monster", "id"], prefixes, "given")
    assert {r.n: (r.cost, r.step) for r in got.collect()} == {1: (4, "metadata"), 2: (3, "metadata"), 3: (3, "prefix"), 4: (4, "prefix"), 5: (7, "given"), 6: (None, "unknown")}
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][:5] == [("n", "int"), ("key", "string"), ("monster", "bigint"), ("id", "bigint"), ("given", "string")]


def test_resolve_name_and_slugs(spark):
    by_id = spark.createDataFrame([(1, "Sea Gull")], "id bigint, name string")
    by_key = spark.createDataFrame([("Stone-Wall!", "Wall"), ("stonewall", "Other")], "alias string, name string")
    rows = spark.createDataFrame([(1, "x"), (2, "STONE WALL"), (3, "night heron-mk2"), (4, None), (5, "...")], "id bigint, key string")
    got = {r.id: (r.name, r.step) for r in P.resolve_name(rows, "id", "key", by_id, by_key).collect()}
    assert got == {1: ("Sea Gull", "id"), 2: ("Wall", "key"), 3: ("NightHeronMk2", "words"), 4: (None, "none"), 5: (None, "none")}
    shown = spark.createDataFrame([(1, "Flame's Shadow"), (2, "Old Name"), (3, "unknown")], "n int, shown string")
    keys = spark.createDataFrame([("flame’sshadow",), ("newname",)], "key string")
    over = spark.createDataFrame([("oldname", "newname")], "slug string, to string")
    assert sorted(tuple(r) for r in P.slug_join(shown, "shown", keys, "key", over).select("n", "key").collect()) == [(1, "flame’sshadow"), (2, "newname")]
    assert P.slug_join(shown, "shown", keys, "key").count() == 1


# batches


def test_per_field_keeps_gaps(spark):
    rows = [(1, {"name": ["a", None, "c"], "odd": ["x"]}), (2, {"level": ["7"], "name": []}), (3, {}), (4, None), (5, {"name": None, "level": ["8", "drop"]})]
    d = spark.createDataFrame(rows, "id int, f map<string,array<string>>")
    seen = []
    handlers = {"name": B.batched(lambda s: s.str.upper(), "string", 2), "level": lambda v: v.filter("value <> 'drop'").withColumn("result", F.concat(F.lit("L"), "value"))}
    got = {r.id: r.results for r in B.per_field(d, ["id"], F.col("f"), handlers, lambda v: (seen.append(1), v)[1]).collect()}
    assert got == {1: {"name": ["A", None, "C"], "odd": []}, 2: {"level": ["L7"], "name": []}, 3: {}, 4: {}, 5: {"name": [], "level": ["L8", None]}} and seen == [1]


def test_in_groups_splits_large_groups(spark):
    d = spark.range(1000).selectExpr("id", "case when id < 900 then 5 when id < 950 then id % 3 end as rarity")
    sizes = B.in_groups(d, ["rarity"], "id", lambda key, some: some.assign(n=len(some), k=-1 if key[0] is None or math.isnan(key[0]) else int(key[0])), "id bigint, rarity bigint, n int, k int", 100).collect()
    assert len(sizes) == 1000 and max(r.n for r in sizes) < 200
    assert all((r.rarity if r.rarity is not None else -1) == r.k for r in sizes)


# caches


def test_promotion_in_state(spark, tmp_path):
    path = str(tmp_path / "memory")
    store = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "k string, v string")
    ask = lambda *ks: sinks.lookup_in_state(spark.createDataFrame(list(enumerate(ks)), "n int, k string"), "n", path, store, ["k"], "v")
    assert sorted((r.n, r.v, r.tier) for r in ask("a", "a", "x", "b", "a", None).collect()) == [(0, "A", "store"), (1, "A", "memory"), (2, None, "miss"), (3, "B", "store"), (4, "A", "memory"), (5, None, "miss")]
    store = store.filter("k = 'c'")  # what was promoted is found without the store
    assert sorted((r.n, r.v, r.tier) for r in ask("b", "c", "x").collect()) == [(0, "B", "memory"), (1, "C", "store"), (2, None, "miss")]
    assert sorted(tuple(r) for r in sinks.load_state(spark, path).collect()) == [("a", "A", 3), ("b", "B", 2), ("c", "C", 1)]
    assert ask().count() == 0 and sinks.load_state(spark, path).count() == 3


def test_promoting_lookup_of_a_key_in_both(spark):
    memory, store = spark.createDataFrame([("a", "M", 5)], "k string, v string, hits bigint"), spark.createDataFrame([("a", "S")], "k string, v string")
    told, after = C.promoting_lookup(spark.createDataFrame([(1, "a")], "n int, k string"), "n", memory, store, ["k"], "v")
    assert told.first().v == "M" and told.first().tier == "memory" and tuple(after.first()) == ("a", "M", 6)


# layouts


def test_screens(spark):
    bases = spark.createDataFrame([("hd", 1920, 1080, 0), ("qhd", 2560, 1440, 1), ("wide", 1920, 1200, 2), ("copy", 2240, 1260, 3), ("copy2", 2240, 1260, 4)], "base string, base_width int, base_height int, ord int")
    sizes = [(1, 2560, 1440), (2, 2560, 1600), (3, 3440, 1440), (4, 1280, 720), (5, 2400, 1350), (6, 0, 0), (7, None, 5), (8, 2240, 1260), (9, 2080, 1170)]
    found, unknown = L.nearest_base(spark.createDataFrame(sizes, "id int, width int, height int"), ["id"], bases)
    assert {r.id: r.base for r in found.collect()} == {1: "qhd", 2: "wide", 4: "hd", 5: "qhd", 8: "copy", 9: "hd"}
    assert {r.id for r in unknown.collect()} == {3, 6, 7}
    regions = spark.createDataFrame([("wide", "echoes.card", 10, 20, 30, 40), ("wide", "scroll.page", 0, 500, 0, 0), ("qhd", "echoes.card", 1, 2, 3, 4)], "base string, path string, x int, y int, w int, h int")
    got = {(r.id, r.path): (r.x, r.y, r.w, r.h) for r in L.scaled(found.filter("id in (1, 2)"), ["id"], regions, ["scroll"]).collect()}
    k = 2560 / 1920
    assert got[2, "echoes.card"] == pytest.approx((10 * k, 20 * 1600 / 1200, 30 * k, 40 * 1600 / 1200))
    assert got[2, "scroll.page"] == (0, 500, 0, 0) and got[1, "echoes.card"] == (1, 2, 3, 4)


def test_aspect_ratio(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(1, 1 << 30), rng.randrange(1, 1 << 30)) for _ in range(40)] + [(1836311903, 1134903170), (1920, 1080)]
    got = spark.createDataFrame(pairs, "w int, h int").select("w", "h", L.aspect_ratio(F.col("w"), F.col("h")).alias("r")).collect()
    assert all(r.r == f"{r.w // math.gcd(r.w, r.h)}:{r.h // math.gcd(r.w, r.h)}" for r in got)


def lines(tokens, gap):
    out, bottom = [], None
    for t in sorted(tokens, key=lambda t: t[1]):
        if bottom is None or t[1] < bottom + gap:
            out[-1:] = [[*(out[-1] if out else []), t]]
        else:
            out.append([t])
        bottom = t[2] if bottom is None else max(bottom, t[2])
    return ["|".join(t[4] for t in sorted(row, key=lambda t: t[0])) for row in out]


def test_text_lines_against_plain(spark):
    rng = random.Random(6)
    images = {i: [(rng.randrange(5), y := rng.randrange(60), y + rng.randrange(8), n, f"t{n}") for n in range(rng.randrange(1, 15))] for i in range(60)}
    d = spark.createDataFrame([(i, *t) for i, ts in images.items() for t in ts], "i int, x0 int, y0 int, y1 int, ord int, text string").repartition(4)
    got = {}
    for r in W.text_lines(d, ["i"], 3, "|").orderBy("i", "row_no").collect():
        got.setdefault(r.i, []).append(r.line)
    assert got == {i: lines(ts, 3) for i, ts in images.items()}


def test_small_steps(spark):
    d = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, None, 2.0), (2, 0, "c", None)], "k int, o int, t string, v double")
    got = {r.k: r.asDict() for r in A.pair_slots(d, ["k"], [F.col("o")], "t", "v", 2, "s").collect()}
    assert got[1] == {"k": 1, "sType1": "a", "sValue1": 1.0, "sType2": None, "sValue2": 2.0} and got[2]["sType2"] is None
    keyed = spark.createDataFrame([(0, None, "n", 1), (1, 7, "n", 2), (2, None, "", 3), (3, 7, "z", 4), (4, None, None, None)], "o int, id int, name string, i int")
    assert {r.key: r.o for r in A.keyed_by_first(keyed, ["id", "name", "i"], "o").collect()} == {"n": 0, "7": 3, "3": 2}
    ranges = spark.createDataFrame([(1, [0, 10, 20], [11, 20, 255]), (1, [100, 0, 0], [101, 0, 1]), (2, [1, 2], [3, 4]), (3, None, None)], "k int, low array<int>, high array<int>")
    assert {r.k: r.midpoint for r in A.range_midpoint(ranges, ["k"], "low", "high").collect()} == {1: [52, 7, 68], 2: [128] * 3, 3: [128] * 3}
    stats = "array(named_struct('name', 'HP', 'value', 1), named_struct('name', 'ATK%', 'value', 2), named_struct('name', 'hp', 'value', 3))"
    one = lambda fixed, s=stats: spark.sql(f"select {s} as s, {fixed} as f").select(A.display_stat(F.col("s"), F.col("f"), ["hp", "atk", "def"])["name"]).first()[0]
    assert one("'hp'") == "ATK%" and one("cast(null as string)") == "ATK%" and one("'atk%'") == "HP" and one("cast(null as string)", "filter(" + stats + ", x -> x.name <> 'ATK%')") == "HP"
    covered = A.family_coverage(spark.createDataFrame([("f", 1), ("f", 2), ("g", 3)], "family string, key int"), spark.createDataFrame([(1,), (1,), (9,)], "key int"), "family", "key")
    assert sorted(tuple(r) for r in covered.collect()) == [("f", 2, 1, 1), ("g", 1, 0, 1)]


def test_files_folders_and_sessions(spark, tmp_path):
    root = str(tmp_path / "s")
    files = [("2024-01-01_00-00-00/raw/a/meta.json", b'{"page": 1}'), ("2024-01-01_00-00-00/raw/a/full.png", b"p"), ("2024-01-01_00-00-00/raw/b/meta.json", b"{}"), ("2024-01-02_00-00-00/raw/c/full.png", b"q"), ("2024-01-03_00-00-00/raw/d/full.png", None), ("2023/other.txt", b"x")]
    assert sinks.write_files(spark.createDataFrame(files, "path string, content binary"), root).agg({"size": "sum"}).first()[0] == 16
    # a session whose only file is empty isn't seen: Spark doesn't list empty files
    assert [r.session for r in readers.sessions(spark, root).collect()] == ["2024-01-02_00-00-00", "2024-01-01_00-00-00"]
    whole, lacking = readers.scan_folders(spark, root + "/2024-01-01_00-00-00")
    assert {r.name for r in whole.collect()} == {"meta.json", "full.png"} and [r.lacks for r in lacking.collect()] == [["full.png"]]
    got = readers.scan_meta(spark, root + "/2024-01-01_00-00-00", "page int, row int, col int", {"row": 2}, {"row": 9, "col": 3}).collect()
    assert [(r.page, r.row, r.col) for r in got] == [(1, 2, 3)]


def test_tree(spark, tmp_path):
    for name in ("a.txt", "d/b.txt", "d/e/c.txt", ".hidden"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    listed = lambda **how: sorted((r.path, r.type, r.size) for r in readers.tree(spark, str(tmp_path), **how).collect())
    assert listed() == [("a.txt", "file", 5), ("d", "dir", None), ("d/b.txt", "file", 7), ("d/e", "dir", None), ("d/e/c.txt", "file", 9)]
    assert listed(recursive=False) == [("a.txt", "file", 5), ("d", "dir", None)]
