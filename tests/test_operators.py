import difflib
import json
import random

from pyspark.sql import functions as F

from loomline.operators import aggregate as A
from loomline.operators import export as X
from loomline.operators import filters as P
from loomline.operators import incremental as C
from loomline.operators import layout as W
from loomline.operators import lookup as J
from loomline.operators import match as M
from loomline.operators import records as G
from loomline.operators import validate as V


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_restack(spark):
    items = [(0, "a", 250), (1, "a", 250), (0, "b", 600), (1, "b", 600), (2, "b", 600), (0, "c", 250), (1, "c", 90), (0, "d", 90), (1, "d", 90), (0, "e", 250), (1, "e", 250), (0, "f", 400), (1, "f", 400)]
    caps = [("a", 200), ("b", 200), ("c", 200), ("d", 200), ("f", 200)]
    out = A.restack(spark.createDataFrame(items, "ord int, key string, n bigint"), "key", "n", ["ord"], spark.createDataFrame(caps, "key string, cap bigint"))
    assert rows(out.select("key", "ord", "n")) == sorted(
        [("a", 0, 200), ("a", 1, 50), ("b", 0, 200), ("b", 1, 200), ("b", 2, 200), ("c", 0, 250), ("c", 1, 90), ("d", 0, 90), ("d", 1, 90), ("e", 0, 250), ("e", 1, 250), ("f", 0, 200), ("f", 1, 200)], key=repr
    )


def test_inventory_skips_bad_rows(spark):
    d = spark.createDataFrame([(1, 2), (1, 3), (None, 4), (2, None)], "id int, n int")
    assert rows(A.inventory(d, "id", "n")) == [(1, 5)]


def test_row_groups_against_loop(spark):
    random.seed(3)
    toks = [(k, i, random.randint(0, 60), 0) for k in range(20) for i in range(random.randint(1, 12))]
    toks = [(k, i, y, y + random.randint(1, 12)) for k, i, y, _ in toks]
    d = spark.createDataFrame(toks, "k int, ord int, y0 int, y1 int")
    got = {(r.k, r.ord): r.row_no for r in W.row_groups(d, ["k"], F.col("y0"), F.col("y1"), 3, ["y0", "ord"]).collect()}
    for k in range(20):
        n, low = 0, None
        for _, i, y0, y1 in sorted((t for t in toks if t[0] == k), key=lambda t: (t[2], t[1])):
            if low is None or y0 >= low + 3:
                n += 1
            low = y1 if low is None else max(low, y1)
            assert got[k, i] == n


def test_take_while_null_goes_on(spark):
    d = spark.createDataFrame([(1, 0, 9), (1, 1, None), (1, 2, 3), (1, 3, 9)], "k int, ord int, level int")
    assert rows(W.take_while(d, ["k"], ["ord"], F.col("level") < 5).select("ord")) == [(0,), (1,)]


def test_grid_round_trip(spark):
    for total in (1, 23, 24, 25, 61):
        d = spark.range(total).withColumn("t", F.lit(total)).withColumns(W.grid_position(F.col("id"), 4, 6, F.col("t")))
        back = d.withColumn("b", W.grid_index(F.col("page"), F.col("row"), F.col("col"), 4, 6, F.col("t")))
        assert back.filter("b <> id or row < 0 or row > 3").isEmpty()


def _known(tokens, known):
    out, i = [], 0
    while i < len(tokens):
        both = "".join(tokens[i : i + 2])
        if len(tokens) > i + 1 and both in known:
            out.append(both)
            i += 2
            continue
        out += [t for t in tokens[i : i + 1] if t in known]
        i += 1
    return out


def test_merge_known_against_loop(spark):
    random.seed(5)
    known = ["critrate", "crit", "dmg", "hp", "hpcrit"]
    data = [(k, random.choices(["crit", "rate", "dmg", "hp", "zz", ""], k=random.randint(0, 7))) for k in range(60)]
    got = spark.createDataFrame(data, "k int, t array<string>").select("k", W.merge_known(F.col("t"), F.lit(known)).alias("m")).collect()
    assert {r.k: r.m for r in got} == {k: _known(t, known) for k, t in data}
    assert spark.sql("select array('crit ra', 'te', 'd mg') t").select(W.merge_known(F.col("t"), F.lit(known)).alias("m")).first().m == ["critrate", "dmg"]


def test_merge_wrapped_against_loop(spark):
    random.seed(6)
    known = ["critrate", "dmg", "hp", "energyregen"]
    data = [(k, [(float(y), random.choices(["crit", "rate", "dmg", "energy", "regen", "x"], k=random.randint(1, 3))) for y in range(random.randint(0, 6))]) for k in range(60)]
    want = {}
    for k, lines in data:
        out, i = [], 0
        while i < len(lines):
            y, tokens = lines[i]
            names, used = _known(tokens, known), 1
            if not names and i + 1 < len(lines):
                names = _known(tokens + lines[i + 1][1], known)
                used = 2 if names else 1
            out += [(y, n) for n in names]
            i += used
        want[k] = out
    got = spark.createDataFrame(data, "k int, r array<struct<y:double,tokens:array<string>>>").select("k", W.merge_wrapped(F.col("r"), F.lit(known)).alias("m")).collect()
    assert {r.k: [tuple(x) for x in r.m] for r in got} == want


def test_spaced(spark):
    d = spark.createDataFrame([([1.0, 2.0], [3.0, 9.0, 9.5, 11.0])], "k array<double>, m array<double>")
    assert d.select(W.spaced(F.col("k"), F.col("m"), 1.5).alias("s")).first().s == [1.0, 2.0, 9.0, 11.0]


def test_anchored_rows(spark):
    d = spark.createDataFrame([([(0.0,), (4.0,), (9.0,), (10.0,), (16.0,)],)], "t array<struct<y:double>>")
    assert d.select(W.anchored_rows(F.col("t"), 8.0).alias("r")).first().r == [1, 1, 2, 2, 2]


def test_greedy_pairs_against_loop(spark):
    random.seed(1)
    data = [(k, side, o, float(random.randint(0, 20)), f"{side}{o}") for k in range(30) for side in ("name", "value") for o in range(random.randint(0, 6))]
    expected = []
    for k in range(30):
        free = sorted((r[2], r[3], r[4]) for r in data if r[0] == k and r[1] == "value")
        for _, y, n in sorted((r[2], r[3], r[4]) for r in data if r[0] == k and r[1] == "name"):
            if free:
                b = min(free, key=lambda v: (abs(v[1] - y), v[1], v[2]))
                free.remove(b)
                expected.append((k, n, b[2]))
    d = spark.createDataFrame(data, "k bigint, side string, ord bigint, y double, text string")
    assert rows(W.greedy_pairs(d, "k")) == sorted(expected, key=repr)


def _chain(tokens, overlap=0.35):
    """All runs from each start, to the first strong overlap."""
    t = sorted((x0, x1, -len(d), -c, d) for x0, x1, d, c in ((x0, x1, "".join(filter(str.isdigit, t)), c) for x0, x1, t, c in tokens) if d)
    found = []
    for i in range(len(t)):
        digits, end, sure = "", t[i][1], 0.0
        for j in range(i, len(t)):
            x0, x1, _, c, d = t[j]
            if j > i:
                p0, p1 = t[j - 1][:2]
                common = min(x1, p1) - max(x0, p0)
                if common > 0 and common / min(max(x1 - x0, 1.0), max(p1 - p0, 1.0)) >= overlap:
                    break
            digits, end, sure = digits + d, max(end, x1), sure - c
            found.append((end, len(digits), end - t[i][0], sure, -i, digits))
    return int(max(found)[-1]) if found else 0


def test_best_chain_against_loop(spark):
    random.seed(9)
    data = [(k, float(random.randint(0, 40)), random.choice(["1", "27", "x3", "abc", "90"]), random.randint(1, 9) / 8) for k in range(80) for _ in range(random.randint(1, 6))]
    data = [(k, x, x + random.randint(0, 12), t, c) for k, x, t, c in data]
    got = dict(rows(W.best_chain(spark.createDataFrame(data, "k bigint, x0 double, x1 double, text string, conf double"), "k")))
    assert got == {k: _chain([r[1:] for r in data if r[0] == k]) for k in got} and len(got) == 80
    one = [(1, 0.0, 10.0, "1", 0.9), (1, 9.0, 20.0, "2", 0.9), (1, 2.0, 19.0, "77", 0.5)]
    assert rows(W.best_chain(spark.createDataFrame(one, "k bigint, x0 double, x1 double, text string, conf double"), "k")) == [(1, 2)]


def test_infer_cost(spark):
    cases = {("hp", "hp%"): 1, ("atk", "er%"): 3, ("atk", "fusion%"): 3, ("atk", "cr%"): 4, ("healing%", "atk"): 4, ("atk", "hp%"): None, ("cd%",): None, (): None}
    d = spark.createDataFrame([(i, list(n)) for i, n in enumerate(cases)], "i int, n array<string>")
    assert [r.c for r in d.select("i", V.infer_cost(F.col("n")).alias("c")).orderBy("i").collect()] == list(cases.values())


def test_lookups(spark):
    d = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, None, 1), (2, "z", 3)], "k int, v string, ord int")
    assert rows(J.first_wins(d, ["k"], ["ord"]).select("k", "v")) == [(1, "a"), (2, None)]
    assert rows(J.last_wins(d, ["k"], ["ord"]).select("k", "v")) == [(1, "b"), (2, "z")]
    assert rows(J.merge_fields(d, ["k"], ["v"], ["ord"])) == [(1, "a"), (2, "z")]
    assert rows(J.alias_owners(d.withColumn("alias", F.lit("x")), "alias", "k", ["ord", "k"])) == [("x", 1, 4, True)]
    assert rows(J.override_union([spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")], ["k"])) == [(1, "a"), (2, "c")]


def test_filters(spark):
    d = spark.createDataFrame([(1, "Red", "ring"), (2, None, "x")], "id int, a string, b string")
    assert rows(P.search(d, " ", "a", "b").select("id")) == [(1,), (2,)]
    assert rows(P.search(d, "ed RI", "a", "b").select("id")) == [(1,)]
    assert rows(P.unpivot_lines(d, ["id"], {"a": "A", "b": "B"})) == [(1, 0, "A: Red"), (1, 1, "B: ring"), (2, 1, "B: x")]
    found, missing = P.pick_ids(d, "id", spark.createDataFrame([(1,), (9,)], "id int"))
    assert rows(found.select("id")) == [(1,)] and rows(missing) == [(9,)]


def test_match(spark):
    names = spark.createDataFrame([("small ring",), ("small rung",), ("widget",)], "n string")
    d = spark.createDataFrame([(1, "smal ring"), (2, "widget"), (3, "zzz"), (4, None)], "id int, t string")
    assert [(r.id, r.match) for r in M.fuzzy_best_match(d, "t", names, "n").orderBy("id").collect()] == [(1, "small ring"), (2, "widget"), (3, None), (4, None)]
    assert [(r.id, r.match, r.distance) for r in M.edit_distance_best_match(d, "t", names, "n", 2).orderBy("id").collect()] == [(1, "small ring", 1), (2, "widget", 0), (3, None, None), (4, None, None)]
    assert rows(M.plausible(d, "t", names, "n").select("id")) == [(1,), (2,)]
    assert M.plausible(d, "t", names.limit(0), "n").count() == 4


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_matching_against_loops(spark, monkeypatch):
    random.seed(12)
    names = sorted({"".join(random.choices("abc", k=random.randint(0, 7))) for _ in range(80)})
    texts = sorted({"".join(random.choices("abcd", k=random.randint(0, 8))) for _ in range(60)})
    n, d = spark.createDataFrame([(x,) for x in names], "n string"), spark.createDataFrame([(x,) for x in texts], "t string")
    for most in (1, 2):
        got = {r.t: (r.match, r.distance) for r in M.edit_distance_best_match(d, "t", n, "n", most).collect()}
        want = {t: min((_edits(t, x), x) for x in names) for t in texts}
        assert got == {t: (x, k) if k <= most else (None, None) for t, (k, x) in want.items()}
    monkeypatch.setattr(M, "MOST_NAMES", 25)
    monkeypatch.setattr(M, "MOST_TEXTS", 4)  # some 14 tasks a block
    got = {r.t: (r.match, r.ratio) for r in M.fuzzy_best_match(d, "t", n, "n", 0.7).collect()}
    for t in texts:
        r, x = max(((difflib.SequenceMatcher(None, x, t, autojunk=False).ratio(), [-ord(c) for c in x] + [1], x) for x in names))[::2]
        if t in names:
            assert got[t] == (t, 1.0)
        else:
            assert got[t] == ((x, r) if r >= 0.7 else (None, None))


def test_numbered(spark, tmp_path):
    data = [(i, random.choice([None, 1, 2, 3])) for i in range(200)]
    d = spark.createDataFrame(data, "i int, s int").repartition(5)
    got = {r.i: r.position for r in W.numbered(d, [F.col("s").asc_nulls_last(), F.col("i")], str(tmp_path / "n")).collect()}
    assert got == {i: p for p, (i, s) in enumerate(sorted(data, key=lambda r: (r[1] is None, r[1] or 0, r[0])))}


def test_unless_present(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "b"), (2, None)], "k int, s string")
    assert rows(J.unless_present(d, "s", "a", ["b"], ["k"])) == [(1, "a"), (1, "c"), (2, "b"), (2, None)]
    assert rows(J.unless_present(d, "s", "a", ["b"])) == [(1, "a"), (1, "c"), (2, None)]
    assert rows(J.unless_present(d, "s", "z", ["b"])) == rows(d)


def test_caches_report(spark):
    log = spark.createDataFrame([("a", 3), ("a", 5), ("b", 1)], "k string, ts int")
    assert rows(C.count_hits(log, ["k"], "ts")) == [("a", 2, 5), ("b", 1, 1)]
    assert C.commit_if_complete(log, log, "k") and not C.commit_if_complete(log, log.filter("k = 'a'"), "k")


def test_better_retry(spark):
    kind = "rec_id int, valid boolean, errors array<string>, warnings array<string>, n int"
    first = spark.createDataFrame([(1, False, ["x", "y"], [], 2), (2, False, ["x"], [], 3), (3, False, ["x"], [], 2), (4, True, [], [], 1)], kind)
    second = spark.createDataFrame([(1, False, ["x"], [], 1), (2, False, ["x"], [], 3), (3, True, [], [], 0)], kind)
    assert [(r.rec_id, r.retried, r.valid) for r in V.better_retry(first, second).orderBy("rec_id").collect()] == [(1, True, False), (2, False, False), (3, True, True), (4, False, True)]


def test_envelope(spark):
    one = {k: spark.createDataFrame([(v,)], "json string") for k, v in (("items", '[{"id":1}]'), ("shell", "{}"))}
    assert json.loads(X.envelope(one).first().envelope) == {"items": '[{"id":1}]', "shell": "{}"}


def test_cache(spark):
    old = spark.createDataFrame([("a", 1, 5, "x"), ("b", 9, 2, "y")], "k string, ts int, hit_count int, p string")
    new = spark.createDataFrame([("a", 3, 7, "z"), ("b", 9, 1, "w")], "k string, ts int, hit_count int, p string")
    assert rows(C.upsert(old, new, ["k"], "ts")) == [("a", 3, 0, "z"), ("b", 9, 0, "w")]
    diff = C.snapshot_diff(old.selectExpr("k", "p h"), new.filter("k = 'a'").selectExpr("k", "p h"), "k", "h")
    assert rows(diff) == [("a", "changed"), ("b", "removed")]
    stay, gone = C.evict(spark.createDataFrame([(0,), (None,), (900_000,)], "t int"), "t", 900_000, 1)
    assert rows(stay) == [(900_000,), (None,)] and rows(gone) == [(0,)]
    assert rows(C.two_tier_lookup(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), old.filter("k = 'a'"), new, ["k"], "p")) == [("a", "x", "memory"), ("b", "w", "store"), ("c", None, "miss")]


def test_rescan_gives_up(spark):
    q = spark.createDataFrame([(1, "needs_rescan", 0), (2, "needs_rescan", 0), (3, "scanned", 0)], "id int, status string, attempts int")
    out = C.rescan(q, lambda t: t.select("id", (F.col("id") == 1).alias("ok")), 2, lambda df: df.sparkSession.createDataFrame(df.collect(), df.schema))
    assert rows(out) == [(1, "rescanned", 1), (2, "failed", 2), (3, "scanned", 0)]


def test_nested_export(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "k int, n string")
    c = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "k int, o int, v string")
    assert rows(X.nested(p, c, "k", "kids", ["o"], ["v"])) == [(1, '{"k":1,"n":"a","kids":[{"v":"x"},{"v":"y"}]}'), (2, '{"k":2,"n":"b"}')]


MAIN = [(c, k, n, lv, 10.0 + lv) for c, k, n in ((1, "fixed", "hp"), (1, "rolled", "hp%"), (3, "fixed", "atk"), (3, "rolled", "crit%")) for lv in range(26)]
SUBS = [("hp", 0, 10.0), ("hp", 1, 20.0), ("atk%", 0, 7.0), ("atk", 0, 5.0), ("luck", 0, 1.0), ("luck%", 0, 2.0)]


def check(spark, record, stats):
    r = spark.createDataFrame([(1, *record)], "rec_id int, cost int, level int, rarity int")
    s = spark.createDataFrame([(1, b, i, n, v) for i, (b, n, v) in enumerate(stats)], "rec_id int, bucket string, ord int, name string, value_raw string")
    out = V.validate(
        r, s, spark.createDataFrame(MAIN, "cost int, kind string, name string, level int, expected double"), spark.createDataFrame(SUBS, "name string, tier_ord int, tier double"), spark.createDataFrame([(i, i // 5) for i in range(26)], "level int, max_subs int")
    ).first()
    return out.valid, out.errors, out.warnings


def test_rule_matrix(spark):
    good = [("main", "hp", "15"), ("main", "hp%", "15.0%"), ("sub", "hp", "10")]
    assert check(spark, (1, 5, 5), good) == (True, [], [])
    assert check(spark, (1, 5, 4), good) == (True, [], ["rarity not checked"])
    assert check(spark, (2, 5, 5), good) == (False, ["unknown cost"], [])
    assert check(spark, (1, 26, 5), good) == (False, ["level out of range"], [])
    assert check(spark, (1, -1, 5), good) == (False, ["level out of range"], [])
    assert check(spark, (1, 5, 5), good[:1] + good[2:]) == (False, ["main count", "other main count"], [])
    assert check(spark, (1, 5, 5), [("main", "hp", "%66"), *good[1:]]) == (False, ["fixed main not numeric"], [])
    assert check(spark, (1, 5, 5), [("main", "hp", "17"), *good[1:]]) == (True, [], ["fixed main value"])
    assert check(spark, (1, 5, 5), [good[0], ("main", "crit%", "15"), good[2]]) == (False, ["other main not allowed"], [])
    assert check(spark, (1, 5, 5), [*good, ("sub", "atk%", "7%")]) == (False, ["too many subs"], [])
    assert check(spark, (1, 10, 5), [("main", "hp", "20"), ("main", "hp%", "20"), good[2]]) == (True, [], ["missing subs"])
    assert check(spark, (1, 5, 5), [*good[:2], ("sub", "odd", "1")]) == (False, ["unknown sub: odd"], [])
    assert check(spark, (1, 5, 5), [*good[:2], ("sub", "hp", "10.3")]) == (True, [], ["near tier: hp"])
    assert check(spark, (1, 5, 5), [*good[:2], ("sub", "hp", "12")]) == (False, ["off tier: hp"], [])
    at10 = [("main", "hp", "20"), ("main", "hp%", "20")]
    assert check(spark, (1, 10, 5), [*at10, good[2], good[2]]) == (False, ["duplicate: hp"], [])
    assert check(spark, (1, 10, 5), [*at10, ("sub", "luck", "1"), ("sub", "luck%", "2%")]) == (False, ["flat and percent: luck%"], [])
    assert check(spark, (1, 10, 5), [*at10, ("sub", "atk", "5"), ("sub", "atk%", "7%")]) == (True, [], [])


def test_best_by_correlation(spark):
    refs = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [3.0, 2.0, 1.0]), (3, [1.0, 3.0, 1.0]), (4, [2.0, 4.0, 6.0])], "label int, rv array<double>")
    rows = [(10, None, [2.0, 4.0, 6.5]), (11, None, [9.0, 5.0, 1.0]), (12, 7, [0.0, 1.0, 0.0]), (13, None, [1.0, -1.0, 1.1]), (14, None, [5.0, 5.0, 5.0])]
    e = spark.createDataFrame(rows, "vec_id bigint, label int, v array<double>")
    best = {r.vec_id: (r.label, r.score) for r in M.best_by_correlation(e, "vec_id", "v", refs, "rv", "label", 0.2).collect()}
    assert {i: x[0] for i, x in best.items()} == {10: 1, 11: 2, 12: 3, 13: None, 14: None}
    assert best[11][1] == 1.0 and 0 < best[13][1] < 0.2 and best[14][1] is None
    got = {r.vec_id: (r.label, r.state) for r in M.label_or_best(e, "vec_id", "v", "label", refs, "rv", 0.5).collect()}
    assert got == {10: (1, "matched"), 11: (2, "matched"), 12: (7, "recorded"), 13: (None, "skipped"), 14: (None, "skipped")}
    none = M.label_or_best(e, "vec_id", "v", "label", refs.limit(0), "rv", 0.5).collect()
    assert sorted((r.vec_id, r.state) for r in none) == [(10, "skipped"), (11, "skipped"), (12, "recorded"), (13, "skipped"), (14, "skipped")]


def test_records(spark):
    d = spark.createDataFrame([('{"id":7,"level":"9","maxLevel":60,"rank":null,"weapon_key":"","_equipped":"x"}',), ('{"7":{"level":1}}',), ("[1]",), ("no",), (None,)], "e string")
    assert [r.g for r in d.select(G.canonical_gear(F.col("e")).alias("g")).collect()] == ['{"7":{"level":9,"ascension":3,"rank":1,"maxLevel":60,"_equipped":"x"}}', '{"7":{"level":1}}', "[1]", "no", None]
    u = spark.createDataFrame([('{"id":"w1"}',), ("w1",), ('{"x":1}',)], "v string")
    assert [r.u for r in u.select(G.unwrap_id(F.col("v")).alias("u")).collect()] == ["w1", "w1", '{"x":1}']
    t = spark.sql("select map('normal', '3', 'resonance', 'x', 'intro', '4.9') m").select(G.talents(F.col("m")).alias("t")).first().t
    assert t == {"basic": "3", "intro": "4"}


def test_merge_exports(spark):
    kind = "s string, k int, v int"
    old, new = spark.createDataFrame([("inv", 1, 2), ("inv", 2, 3), ("x", 1, 1), ("y", 5, 5)], kind), spark.createDataFrame([("inv", 1, 5), ("x", 2, 9)], kind)
    assert rows(G.merge_exports(old, new, "s", "k", "v", ["inv"])) == [("inv", 1, 7), ("inv", 2, 3), ("x", 2, 9), ("y", 5, 5)]


def test_nearest_in_blocks(spark, monkeypatch):
    refs = [(i, "abcdefg"[i], float(i * 10 % 37)) for i in range(7)]
    d = spark.createDataFrame([(i, i * 1.7) for i in range(25)], "id int, x double")
    r = spark.createDataFrame(refs, "ord int, name string, at double")
    want = {i: min((abs(i * 1.7 - at), o, n) for o, n, at in refs)[::2] for i in range(25)}
    for most in (1000, 2):
        monkeypatch.setattr(J, "MOST_REFS", most)
        got = J.nearest(d, r, lambda x: F.abs(F.col("x") - x["at"]), ["id"], "name", "ord")
        assert {x.id: (x.distance, x.name) for x in got.collect()} == want
    assert J.nearest(d, r.limit(0), lambda x: F.abs(F.col("x") - x["at"]), ["id"], "name", "ord").count() == 0


def test_first_kind_and_defaults(spark):
    d = spark.createDataFrame([(1, "a.json"), (2, "b"), (3, ""), (4, None)], "i int, s string")
    kind = P.first_kind([(F.col("s").endswith(".json"), "file"), (F.length("s") > 0, "name")])
    assert [r.k for r in d.orderBy("i").select(kind.alias("k")).collect()] == ["file", "name", "unknown", "unknown"]
    some = d.orderBy("i").select(P.with_default(F.col("s"), "none", "", "b").alias("a"), P.with_default(F.col("s"), "none").alias("b")).collect()
    assert [tuple(r) for r in some] == [("a.json", "a.json"), ("none", "b"), ("none", ""), ("none", "none")]


def test_tasks_grow_with_the_input(spark, tmp_path, monkeypatch):
    """A task's rows are bounded by the size of the files, and one shuffle serves all steps by key."""
    from loomline.operators import aggregate, layout, records

    spark.range(20_000).selectExpr("id % 5000 as k", "id % 3 as r", "double(id) as x0", "double(id + 1) as x1", "string(id % 10) as text", "0.5D as conf").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(aggregate, "PER_TASK", 4096)
    assert aggregate.dealt(t.select("k", "r"), "k").rdd.getNumPartitions() > 5
    plan = records.colour_summary(t, "k", ["r"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert records.colour_summary(t, "k", ["r"]).agg({"colours": "sum"}).first()[0] == 3 * 5000
    assert layout.best_chain(t, "k").count() == 5000
