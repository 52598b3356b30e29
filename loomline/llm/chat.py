"""Chat formatting: records of many layouts become canonical turns, and turns a marked text with a loss mask.

A record's layout is told by a fingerprint, the hash of its nested field paths; the fingerprint selects a
declarative mapping that says where turns, roles and texts are. Records with an unknown fingerprint keep it and
get no turns, so nothing is guessed. The query deals the conversations into records of all these layouts first. The template marks turns with control strings; those inside texts, its own
and other common ones, get a backslash after their first character, which is taken off again on reading back.

Cases: null texts and roles are empty; a conversation is sorted by turn (null first), role and text, so ties and
repeated rows give the same result on each run; rows without conv_id form one conversation with a null id; an
empty table gives an empty result; other columns are ignored. The text of one conversation is one value and has
to fit into a row.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .common import table

TURNS = "array<struct<role:string,text:string>>"

# The template's control strings.
OPEN, SEP, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: What follows the first character of a control string, ours or that of another common template.
_REST = r"\||/?s>|/?INST\]|/?SYS>>"
_ESCAPE, _UNESCAPE = rf"([<\[])(\\*)(?={_REST})", rf"([<\[])\\(\\*)(?={_REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


# Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Mappings by layout. paths: the sorted nested field paths that tell it ([] for the elements of an array). Either
#: `fields`, the turns as (role, path) in order, where an empty optional text is no turn; or `list`, `role` and
#: `text`, paths of an array and inside its elements. optional: paths that may lack, as where all their values are null.
LAYOUTS: dict[str, dict] = {
    "messages": {
        "paths": ("messages", "messages[]", "messages[].content", "messages[].role"),
        "optional": ("messages[].content", "messages[].role"),
        "list": "messages", "role": "role", "text": "content",
    },
    "shares": {"paths": ("conversations", "conversations[]", "conversations[].from", "conversations[].value"), "list": "conversations", "role": "from", "text": "value", "roles": ROLES},
    "instruction": {"paths": ("input", "instruction", "output"), "fields": (("user", ("instruction", "input")), ("assistant", ("output",)))},
    "instruction_only": {"paths": ("instruction", "output"), "fields": (("user", ("instruction",)), ("assistant", ("output",)))},
    "prompt": {"paths": ("prompt", "response"), "fields": (("user", ("prompt",)), ("assistant", ("response",)))},
    "prompt_completion": {"paths": ("completion", "prompt"), "fields": (("user", ("prompt",)), ("assistant", ("completion",)))},
    "system_prompt": {"paths": ("prompt", "response", "system"), "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    "turn": {"paths": ("role", "text"), "single": ("role", "text")},
}


def fingerprint(paths: Column) -> Column:
    """Hash of sorted nested field paths."""
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def _known(layout: dict) -> list[Column]:
    """The fingerprints that select a layout: of its paths, with and without each optional one."""
    must, may = [p for p in layout["paths"] if p not in layout.get("optional", ())], layout.get("optional", ())
    some = [must + list(x) for k in range(len(may) + 1) for x in combinations(may, k)]
    return [F.xxhash64(F.lit("\n".join(sorted(paths)))) for paths in some]


def json_paths(record: Column) -> Column:
    """Nested field paths of a JSON text, from the schema of its variant: object keys joined by dots, [] for elements. Values of a JSON null count as present."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    # one token for each key, opening and closing; a fold over them keeps the path down to the present key
    tokens = F.regexp_extract_all(schema, F.lit(r"ARRAY<|OBJECT<|`(?:[^`]|``)*`: |[A-Za-z_0-9$-]+: |>"), F.lit(0))
    zero = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("key"), F.array().cast("array<string>").alias("out"))

    def step(acc, t):
        here = F.coalesce(F.element_at(F.concat(F.array(F.lit("")), acc["open"]), -1), F.lit(""))
        name = F.regexp_replace(F.regexp_replace(t, ": $", ""), "^`|`$", "")
        path = F.when(here == "", name).otherwise(F.concat(here, F.lit("."), name))
        at = F.when(acc["key"] != "", acc["key"]).otherwise(here)
        inside = F.concat(at, F.lit("[]"))
        return (
            F.when(t == "OBJECT<", F.struct(F.concat(acc["open"], F.array(at)).alias("open"), F.lit("").alias("key"), acc["out"].alias("out")))
            .when(t == "ARRAY<", F.struct(F.concat(acc["open"], F.array(inside)).alias("open"), inside.alias("key"), F.concat(acc["out"], F.array(inside)).alias("out")))
            .when(t == ">", F.struct(F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0))).alias("open"), F.lit("").alias("key"), acc["out"].alias("out")))
            .otherwise(F.struct(acc["open"].alias("open"), path.alias("key"), F.concat(acc["out"], F.array(path)).alias("out")))
        )

    return F.array_distinct(F.aggregate(tokens, zero, step, lambda acc: acc["out"]))


def _turn(role: Column, text: Column, layout: dict) -> Column:
    out = F.coalesce(role, F.lit(""))
    for name, stands_for in layout.get("roles", {}).items():
        out = F.when(role == name, F.lit(stands_for)).otherwise(out)
    return F.struct(out.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns_of(m: dict):
    return lambda x: _turn(x[m["role"]], x[m["text"]], m)


def _mapped(d: DataFrame, names: dict, text_of, list_of) -> DataFrame:
    """d (with fingerprint) with layout and turns, by the mapping that the fingerprint selects.

    text_of(path): the text there; list_of(path, role, text): the array there, its elements with these fields.
    """
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, m in names.items():
        hit = F.col("fingerprint").isin(*_known(m))
        layout = F.when(hit, F.lit(name)).otherwise(layout)
        if "list" in m:
            got = F.transform(list_of(m["list"], m["role"], m["text"]), _turns_of(m))
        elif "single" in m:
            got = F.array(_turn(*map(text_of, m["single"]), m))
        else:
            one = [F.struct(F.lit(r).alias("role"), F.array_join(F.filter(F.array(*[text_of(p) for p in ps]), lambda s: s != ""), "\n").alias("text")) for r, ps in m["fields"]]
            got = F.filter(F.array(*one), lambda x: (x["role"] != "system") | (x["text"] != ""))
        turns = F.when(hit, got).otherwise(turns)
    return d.withColumn("layout", layout).withColumn("turns", turns)


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """records with fingerprint, layout (null: unknown) and turns, from a column of JSON texts."""
    v = F.try_parse_json(F.col(record))
    d = records.withColumn("fingerprint", fingerprint(json_paths(F.col(record))))
    return _mapped(
        d, LAYOUTS,
        lambda path: F.coalesce(F.try_variant_get(v, f"$.{path}", "string"), F.lit("")),
        lambda path, role, text: F.try_variant_get(v, f"$.{path}", f"array<struct<{role}:string,{text}:string>>"),
    )


def _has(name: str):
    return lambda x: x[name].isNotNull()


def _present(kind: DataType, value: Column, path: str) -> list[tuple[str, Column]]:
    """Nested field paths of a typed value and whether each is there: not null, or not null in some element."""
    out = [(path, value.isNotNull())]
    if isinstance(kind, ArrayType):
        out.append((path + "[]", F.size(value) > 0))
        if isinstance(kind.elementType, StructType):
            for f in kind.elementType:
                out.append((f"{path}[].{f.name}", F.exists(value, _has(f.name))))
    elif isinstance(kind, StructType):
        for f in kind:
            out += _present(f.dataType, value[f.name], f"{path}.{f.name}")
    return out


def typed_canonical(records: DataFrame, *fields: str) -> DataFrame:
    """The same of records whose fields are columns, without a limit to the size of texts."""
    known = [x for f in fields for x in _present(records.schema[f].dataType, F.col(f), f)]
    paths = F.filter(F.array(*[F.when(there, F.lit(path)) for path, there in known]), lambda x: x.isNotNull())
    names = {path for path, _ in known}
    fits = {name: m for name, m in LAYOUTS.items() if set(m["paths"]) <= names}  # the others need paths that no record has
    d = records.withColumn("fingerprint", fingerprint(paths))
    return _mapped(d, fits, lambda path: F.coalesce(F.col(path), F.lit("")), lambda path, role, text: F.col(path))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(CLOSE))), "")


def loss_spans(turns: Column) -> Column:
    """(start, end) in the rendered text, code points, of each assistant text."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"))

    def step(acc, t):
        s = acc["at"] + F.lit(len(OPEN) + len(SEP)) + F.length(escape(t["role"]))
        e = s + F.length(escape(t["text"]))
        out = F.when(t["role"] == "assistant", F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"))))).otherwise(acc["out"])
        return F.struct((e + len(CLOSE)).alias("at"), out.alias("out"))

    return F.aggregate(turns, zero, step, lambda acc: acc["out"])


def read_back(formatted: Column) -> Column:
    """Turns of a rendered text."""
    parts = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda p: p.startswith(OPEN))

    def turn(p):
        both = F.split(F.substr(p, F.lit(len(OPEN) + 1)), r"<\|text\|>", 2)
        return F.struct(unescape(F.get(both, 0)).alias("role"), unescape(F.get(both, 1)).alias("text"))

    return F.transform(parts, turn)


def format_turns(turns_by_id: DataFrame, *keys: str) -> DataFrame:
    """(keys, turns) to (keys, formatted, loss)."""
    return turns_by_id.select(*keys, render(F.col("turns")).alias("formatted"), loss_spans(F.col("turns")).alias("loss"))


def conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) to records (conv_id, messages) of a role and a content each, in order; nulls stay."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"), F.col("role").isNull().alias("nr"), F.col("text").isNull().alias("nt"))
    g = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("_ch"))
    null = F.lit(None).cast("string")
    item = lambda x: F.struct(F.when(x["nr"], null).otherwise(x["r"]).alias("role"), F.when(x["nt"], null).otherwise(x["t"]).alias("content"))
    return g.select("conv_id", F.transform("_ch", item).alias("messages"))


#: Fields of the records that `records` makes; each record has those of one layout.
FIELDS = ("messages", "conversations", "system", "prompt", "response", "completion", "instruction", "input", "output")
# Roles that the layouts besides `messages` can hold.
PLAIN = ("user", "assistant", "system")


def records(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as a collection of several makers: a record (conv_id, FIELDS) each, in the layout that its id deals it if that can hold it.

    By pmod(conv_id, 4): a question and its answer become a prompt with a response (1), an instruction, with an input if the
    question has a second line (2), or a prompt with a completion (3); a system text before them is one more field (1); other
    conversations become shares (1, 3). What is left, and whatever has a null or another role, stays a list of messages.
    """
    m = F.col("messages")
    k = F.coalesce(F.pmod("conv_id", F.lit(4)), F.lit(0))
    role, text = (lambda i: F.get(m, i)["role"]), (lambda i: F.get(m, i)["content"])
    plain = F.forall(m, lambda x: F.coalesce(x["role"].isin(*PLAIN), F.lit(False)) & x["content"].isNotNull())
    pair = plain & (F.size(m) == 2) & (role(0) == "user") & (role(1) == "assistant")
    three = plain & (F.size(m) == 3) & (role(0) == "system") & (role(1) == "user") & (role(2) == "assistant") & (text(0) != "")
    line = F.locate("\n", text(0))
    kind = (
        F.when(pair & (k == 1), "prompt").when(pair & (k == 3), "prompt_completion").when(three & (k == 1), "system_prompt")
        .when(pair & (k == 2) & (line > 1) & (line < F.length(text(0))), "instruction").when(pair & (k == 2), "instruction_only")
        .when(plain & k.isin(1, 3), "shares").otherwise("messages")
    )
    d = conversations(rows).withColumn("_kind", kind).withColumn("_line", line)

    def at(value: Column, *kinds: str) -> Column:
        return F.when(F.col("_kind").isin(*kinds), value)

    named = F.create_map(*[F.lit(x) for r in PLAIN for x in (r, {"user": "human", "assistant": "gpt"}.get(r, r))])
    shares = F.transform(m, lambda x: F.struct(named[x["role"]].alias("from"), x["content"].alias("value")))
    return d.select(
        "conv_id", at(m, "messages").alias("messages"), at(shares, "shares").alias("conversations"), at(text(0), "system_prompt").alias("system"),
        at(text(0), "prompt", "prompt_completion").when(F.col("_kind") == "system_prompt", text(1)).alias("prompt"),
        at(text(1), "prompt").when(F.col("_kind") == "system_prompt", text(2)).alias("response"), at(text(1), "prompt_completion").alias("completion"),
        at(text(0), "instruction_only").when(F.col("_kind") == "instruction", F.substr(text(0), F.lit(1), F.col("_line") - 1)).alias("instruction"),
        at(F.substr(text(0), F.col("_line") + 1), "instruction").alias("input"), at(text(1), "instruction", "instruction_only").alias("output"),
    )


def digest(formatted: DataFrame, *keys: str) -> DataFrame:
    back = formatted.withColumn("_ch", read_back(F.col("formatted")))
    said = F.array_join(F.transform("_ch", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform("loss", lambda x: unescape(F.substr(F.col("formatted"), (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int")))), "")
    return back.withColumn("_lost", lost).select(
        *keys, F.size("_ch").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("_lost").cast("long").alias("loss_chars"), F.sha2(F.col("_lost").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(t, r)")
    turns = typed_canonical(records(rows.unionByName(odd)), *FIELDS)
    return digest(format_turns(turns, "conv_id", "layout"), "conv_id", "layout")


#: The template adds len(OPEN + SEP + CLOSE) code points a turn and a backslash for each control string.
OP5_SQL = rf"""
WITH r AS (SELECT conv_id, turn, role AS _r, text AS _t, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]', r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)),
e AS (SELECT *, {len(OPEN + SEP + CLOSE)} + length(role) + length(text)
        + len(regexp_extract_all(text, '[<\[]\\*({_REST})')) AS n FROM r),
g AS (SELECT conv_id, count(*) AS n_turns, coalesce((conv_id % 4 + 4) % 4, 0) AS k,
  bool_and(coalesce(_r IN {PLAIN}, false) AND _t IS NOT NULL) AS plain,
  list(role ORDER BY turn NULLS FIRST, role, text) AS roles, list(text ORDER BY turn NULLS FIRST, role, text)[1] AS t,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, CASE WHEN NOT plain OR k = 0 THEN 'messages'
    WHEN roles = ['user', 'assistant'] THEN CASE WHEN k = 1 THEN 'prompt' WHEN k = 3 THEN 'prompt_completion'
      WHEN instr(t, chr(10)) BETWEEN 2 AND length(t) - 1 THEN 'instruction' ELSE 'instruction_only' END
    WHEN roles = ['system', 'user', 'assistant'] AND t <> '' AND k = 1 THEN 'system_prompt'
    WHEN k = 2 THEN 'messages' ELSE 'shares' END AS layout,
  n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM g
"""
