import hashlib

from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.llm import chat as C

CONTROL = ["</s>", "[INST]", "[/INST]", "<|end|>", "<|text|>", "<|turn|>", "<<SYS>>", "<</SYS>>", "<s>", "\\", "<", "[", "|", "a", "\n", "é\U0001f600"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(turns):
    lost = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(lost), sha(lost)


def digests(spark, rows):
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    f = C.format_turns(C.typed_canonical(C.conversations(d), "messages"), "conv_id")
    return {r.conv_id: r for r in C.digest(f, "conv_id").collect()}, {r.conv_id: r for r in f.collect()}


@settings(max_examples=3, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|end|>"]), st.lists(st.sampled_from(CONTROL), max_size=12).map("".join)), min_size=1, max_size=5), min_size=20, max_size=40))
def test_round_trip(spark, convs):
    got, out = digests(spark, [(k, i, r, t) for k, c in enumerate(convs) for i, (r, t) in enumerate(c)])
    for k, c in enumerate(convs):
        r = got[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(c)
        assert r.formatted_chars == len(out[k].formatted)
        assert out[k].formatted.count(C.OPEN) == out[k].formatted.count(C.CLOSE) == len(c)


def test_odd_rows(spark):
    got, _ = digests(spark, [(1, 0, None, None), (1, None, "user", "first"), (None, 0, "assistant", "x"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "assistant", "y" * 200_000)])
    assert (got[1].n_turns, got[1].turns_sha256) == expected([("user", "first"), ("", "")])[:2]
    assert got[None].loss_chars == 1 and got[3].loss_chars == 200_000
    assert got[2].turns_sha256 == expected([("user", "a"), ("user", "a"), ("user", "b")])[1]
    assert digests(spark, [])[0] == {}


def test_layouts(spark):
    want = [("user", "q"), ("assistant", "a")]
    records = {
        '{"messages":[{"role":"user","content":"q"},{"content":"a","role":"assistant"}]}': ("messages", want),
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}': ("shares", want),
        '{"instruction":"q","input":"","output":"a"}': ("instruction", want),
        '{"output":"a","instruction":"q"}': ("instruction_only", want),
        '{"instruction":"q","input":"more","output":"a"}': ("instruction", [("user", "q\nmore"), ("assistant", "a")]),
        '{"prompt":"q","response":"a"}': ("prompt", want),
        '{"prompt":"q","completion":"a"}': ("prompt_completion", want),
        '{"system":"s","prompt":"q","response":"a"}': ("system_prompt", [("system", "s"), *want]),
        '{"role":"user","text":"q"}': ("turn", want[:1]),
        '{"question":"q"}': (None, None),
        "not json": (None, None),
        "[]": (None, None),
    }
    d = spark.createDataFrame([(k,) for k in records], "record string")
    got = {r.record: r for r in C.canonical(d).collect()}
    for k, (layout, turns) in records.items():
        assert (got[k].layout, got[k].turns and [tuple(t) for t in got[k].turns]) == (layout, turns), k
    assert C.canonical(d.limit(0)).count() == 0


def test_paths_are_of_nested_fields(spark):
    d = spark.createDataFrame([('{"a":{"b c":[{"x":1},{"y":[2]}]},"z":null}',)], "r string")
    assert sorted(d.select(C.json_paths(F.col("r")).alias("p")).first().p) == ["a", "a.b c", "a.b c[]", "a.b c[].x", "a.b c[].y", "a.b c[].y[]", "z"]


def test_typed_records_take_their_mapping_by_fingerprint(spark, monkeypatch):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, None, None), (3, 0, "user", None), (3, 1, None, None)]
    d = C.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.conv_id: r for r in C.typed_canonical(d, "messages").collect()}
    assert {r.layout for r in got.values()} == {"messages"} and len({r.fingerprint for r in got.values()}) == 3
    assert [tuple(t) for t in got[1].turns] == [("user", "q"), ("assistant", "a")] and [tuple(t) for t in got[2].turns] == [("", "")]
    same = '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}'
    assert C.canonical(spark.createDataFrame([(same,)], "record string")).first().fingerprint == got[1].fingerprint

    changed = dict(C.LAYOUTS["messages"], role="content", text="role")
    monkeypatch.setitem(C.LAYOUTS, "messages", changed)
    got = {r.conv_id: r for r in C.typed_canonical(d, "messages").collect()}
    assert [tuple(t) for t in got[1].turns] == [("q", "user"), ("a", "assistant")]

    monkeypatch.delitem(C.LAYOUTS, "messages")
    got = C.typed_canonical(d, "messages").collect()
    assert all(r.fingerprint is not None and r.layout is None and r.turns is None for r in got)


def test_records_of_all_layouts_come_back(spark):
    ask = [("user", "q\nmore"), ("assistant", "a")]
    convs = {
        0: ask, 1: ask, 2: ask, 3: ask, -7: ask, 6: [("user", "\nq"), ("assistant", "")], 10: [("user", ""), ("assistant", "a\n")], 14: [("user", "q\n"), ("assistant", "</s>")],
        5: [("system", "s"), *ask], 9: [("system", ""), *ask], 13: [*ask, ("user", "[INST]")], 7: [("human", "q"), ("gpt", "a")], 11: [("user", None), ("assistant", "a")],
        15: [("user", "x")], 17: [("assistant", "a"), ("user", "q")], None: ask,
    }
    d = spark.createDataFrame([(k, i, r, t) for k, c in convs.items() for i, (r, t) in enumerate(c)], "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in C.typed_canonical(C.records(d), *C.FIELDS).collect()}
    assert {k: [tuple(t) for t in r.turns] for k, r in got.items()} == {k: [(r, t or "") for r, t in c] for k, c in convs.items()}
    assert {k: r.layout for k, r in got.items()} == {
        0: "messages", 1: "prompt", 2: "instruction", 3: "prompt_completion", -7: "prompt", 6: "instruction_only", 10: "instruction_only", 14: "instruction_only",
        5: "system_prompt", 9: "shares", 13: "shares", 7: "messages", 11: "messages", 15: "shares", 17: "shares", None: "messages",
    }
    assert C.typed_canonical(C.records(d.limit(0)), *C.FIELDS).count() == 0
