"""Conversation structure repair: a min-plus scan over the turns of each conversation.

The roles of a repaired conversation read (s?(ua)+)?: an optional system turn, then user and assistant in turn. An
automaton of four states accepts that (start, after system, after user, after assistant), so each turn is a 4 x 4 matrix:
element i, j is the cheapest way, as (cost, audit), from state i to state j by keeping, re-roling or deleting the
turn and then inserting any number of empty turns (the insert closure). Products take sums of costs and joined audits, and the least
(cost, audit) of all ways. That is associative: two ways of equal cost between the same states over the same turns differ
before one of them ends, since insertions beyond a common beginning cost more, so what follows can't turn
their order round. Turns are dealt by ranges of (conversation, turn), each task multiplies the runs of turns it holds, as a
tree, and the products of a conversation that spans tasks are multiplied by further rounds of a tree. Going down again,
each run gets its slice of the audit and the state it begins in, so its turns are repaired where they lie.

Cases: a null role or text is one space, a null turn comes first, a null conversation is one of its own; of equal turns
the order is that of role, then text; equal rows are counted and become one row, so they can't pile up in one task; a blank turn has
no character but white space and is deleted, as is a repeated one; roles other than those with the initials s, u
and a can't be kept; a conversation without rows is repaired to none; an empty table gives an empty result; other
columns are ignored, and internal names begin with `_cr_`. The hash of a whole repaired conversation is taken in one pass over
its sorted rows, of which only a batch is in memory: SHA-256 can't be put together from parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SPACE = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: State -> initial -> next state; where an inserted or re-roled turn leads, and its role.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MADE = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
ACCEPTED = (0, 3)
LEGAL = ("su", "ua", "au")
#: Turns that are multiplied one by one before the tree begins; products that one task of a round multiplies.
BLOCK, FAN = 32, 16

Way = tuple[int, str]
Matrix = list[list[Way | None]]


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        got: list[Way | None] = [None] * 4
        for way, onward in zip(row, b, strict=True):
            if way is not None:
                for j, step in enumerate(onward):
                    if step is not None:
                        x = (way[0] + step[0], way[1] + step[1])
                        if got[j] is None or x < got[j]:
                            got[j] = x
        out.append(got)
    return out


def _closure() -> Matrix:
    """Any number of insertions: more than two never help, as the states repeat after two."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        j = i
        for n in range(3):
            if out[i][j] is None:
                out[i][j] = (INSERT * n, "I" * n)
            j = MADE[j][0]
    return out


CLOSURE = _closure()


@cache
def turn_matrix(initial: str, fault: str) -> Matrix:
    """One turn with its insert closure; fault: blank, duplicate, truncated or none."""
    edit: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        ways = [(i, (DELETE, "D"))]
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED * (fault == "truncated")
            ways.append((MADE[i][0], (REROLE + more, "R")))
            if initial in KEPT[i]:
                ways.append((KEPT[i][initial], (more, "K")))
        for j, way in ways:
            edit[i][j] = way if edit[i][j] is None else min(edit[i][j], way)
    return times(edit, CLOSURE)


@cache
def _deletions(n: int) -> Matrix:
    """n deleted turns, by squaring."""
    if n == 1:
        return turn_matrix("", "duplicate")
    half = times(_deletions(n // 2), _deletions(n // 2))
    return times(half, _deletions(1)) if n % 2 else half


class Run:
    """The product of turns that follow each other, kept as a tree of products of blocks."""

    def __init__(self) -> None:
        self.rows, self.illegal, self.head, self.tail = 0, 0, None, ""
        self.now: Matrix | None = None
        self.size, self.tree = 0, []

    def add(self, initial: str, fault: str, copies: int) -> None:
        if self.head is None:
            self.head = initial
        elif self.tail + initial not in LEGAL:
            self.illegal += 1
        self.tail = initial
        self.illegal += copies - 1  # equal roles side by side
        self.rows += copies
        m = turn_matrix(initial, fault)
        if copies > 1:
            m = times(m, _deletions(copies - 1))
        self.now = m if self.now is None else times(self.now, m)
        self.size += 1
        if self.size == BLOCK:
            self._push()

    def _push(self) -> None:
        m, rank = self.now, 0
        while self.tree and self.tree[-1][1] == rank:
            m, rank = times(self.tree.pop()[0], m), rank + 1
        self.tree.append((m, rank))
        self.now, self.size = None, 0

    def product(self) -> Matrix:
        m = self.now
        for x, _ in reversed(self.tree):
            m = x if m is None else times(x, m)
        return m


def _flat(m: Matrix) -> tuple[list[int], list[str | None]]:
    return [-1 if w is None else w[0] for row in m for w in row], [None if w is None else w[1] for row in m for w in row]


def _square(costs, audits) -> Matrix:
    ways = [None if c < 0 else (int(c), a) for c, a in zip(costs, audits, strict=True)]
    return [ways[at : at + 4] for at in range(0, 16, 4)]


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), conv.cast("string")), F.lit("n"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Distinct rows of each conversation: _cr_key, conv_id, turn, role, text, copies and the fault of the first copy.

    A row repeats another if its role and text are there at a smaller turn; copies at its own turn are counted.
    """
    c = rows.select(_key(F.col("conv_id")).alias("_cr_key"), "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies")
    c = c.groupBy("_cr_key", "conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    c = c.withColumn("_cr_what", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    first = c.groupBy("_cr_key", "_cr_what").agg(F.min(F.struct("turn")).alias("_cr_first"))  # a null turn is the least
    c = c.join(first, ["_cr_key", "_cr_what"])
    shown = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(shown == "", "blank").when(~F.col("turn").eqNullSafe(F.col("_cr_first.turn")), "duplicate").when(~F.substring(shown, -1, 1).isin(".", "!", "?"), "truncated").otherwise("none")
    return c.select("_cr_key", "conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def _folded(conv_type, turn_type) -> pa.Schema:
    return pa.schema(
        [("_cr_key", pa.string()), ("conv_id", conv_type), ("turn", turn_type), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("fault", pa.string())]
        + [("_cr_part", pa.int64()), ("_cr_pos", pa.int64()), ("_cr_rows", pa.int64()), ("illegal", pa.int64()), ("_cr_head", pa.string()), ("_cr_tail", pa.string())]
        + [("_cr_costs", pa.list_(pa.int64())), ("_cr_audits", pa.list_(pa.string()))]
    )


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows pass through with their place; after each conversation's rows comes their product, at place -1."""
    part, pos, key, run, schema = TaskContext.get().partitionId(), 0, None, Run(), None

    def product() -> pa.RecordBatch:
        costs, audits = _flat(run.product())
        one = {"_cr_key": key, "_cr_part": part, "_cr_pos": -1, "_cr_rows": run.rows, "illegal": run.illegal, "_cr_head": run.head, "_cr_tail": run.tail, "_cr_costs": costs, "_cr_audits": audits}
        return one

    for b in batches:
        if schema is None:
            schema = _folded(b.schema.field("conv_id").type, b.schema.field("turn").type)
        n, done = b.num_rows, []
        for k, initial, fault, copies in zip(b["_cr_key"].to_pylist(), pa.compute.utf8_slice_codeunits(b["role"], 0, 1).to_pylist(), b["fault"].to_pylist(), b["copies"].to_pylist(), strict=True):
            if k != key:
                if run.rows:
                    done.append(product())
                key, run = k, Run()
            run.add(initial, fault, copies)
        columns = {c: b[c] for c in b.schema.names} | {"_cr_part": pa.array([part] * n, pa.int64()), "_cr_pos": pa.array(range(pos, pos + n), pa.int64())}
        pos += n
        yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if run.rows:
        yield pa.RecordBatch.from_pylist([product()], schema=schema)


_PRODUCT = "_cr_key string, _cr_part bigint, _cr_rows bigint, illegal bigint, _cr_head string, _cr_tail string, _cr_costs array<bigint>, _cr_audits array<string>"


def _multiply(parts: pd.DataFrame) -> pd.DataFrame:
    """The product of up to FAN neighbouring runs."""
    parts = parts.sort_values("_cr_part")
    todo = [_square(c, a) for c, a in zip(parts["_cr_costs"], parts["_cr_audits"], strict=True)]
    while len(todo) > 1:
        todo = [times(*todo[i : i + 2]) if i + 1 < len(todo) else todo[i] for i in range(0, len(todo), 2)]
    heads, tails = parts["_cr_head"].tolist(), parts["_cr_tail"].tolist()
    illegal = int(parts["illegal"].sum()) + sum(a + b not in LEGAL for a, b in zip(tails, heads[1:], strict=False))
    costs, audits = _flat(todo[0])
    return pd.DataFrame([(parts["_cr_key"].iloc[0], int(parts["_cr_up"].iloc[0]), int(parts["_cr_rows"].sum()), illegal, heads[0], tails[-1], costs, audits)], columns=[x.split(" ")[0] for x in _PRODUCT.split(", ")])


def _cheapest(costs: pd.Series, audits: pd.Series) -> pd.DataFrame:
    """The way from the start to an accepted state, insertions before the first turn included."""
    best = [min(w for j in ACCEPTED if (w := times([CLOSURE[0]], _square(c, a))[0][j]) is not None) for c, a in zip(costs, audits, strict=True)]
    return pd.DataFrame(best, columns=["cost", "audit"])


def _slices(parts: pd.DataFrame, whole: pd.DataFrame) -> pd.DataFrame:
    """The audit of each run of one conversation, and the state it begins in."""
    if not len(parts) or not len(whole):
        return pd.DataFrame({"_cr_key": [], "_cr_part": [], "_cr_slice": [], "_cr_state": []})
    parts, audit, at, state, out = parts.sort_values("_cr_part"), whole["audit"].iloc[0], 0, 0, []
    for key, part, n, costs, audits in parts[["_cr_key", "_cr_part", "_cr_rows", "_cr_costs", "_cr_audits"]].itertuples(index=False):
        end, seen = at, 0
        while end < len(audit) and (seen < n or audit[end] == "I"):  # insertions belong to the turn before them, the first ones to the first run
            seen += audit[end] != "I"
            end += 1
        mine = audit[at:end]
        out.append((key, part, mine, state))
        for _ in range(len(mine) - len(mine.lstrip("I"))):
            state = MADE[state][0]
        state = [w[1] if w else None for w in _square(costs, audits)[state]].index(mine.lstrip("I"))
        at = end
    return pd.DataFrame(out, columns=["_cr_key", "_cr_part", "_cr_slice", "_cr_state"])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, conv_id, part, place, turn, role, text, edit) of each repaired row; rows come by run, the run's slice first."""
    audit, at, state = "", 0, 0
    for b in batches:
        for r in zip(*(b[c].to_pylist() for c in ("_cr_key", "conv_id", "_cr_part", "_cr_pos", "turn", "role", "text", "copies", "_cr_slice", "_cr_state")), strict=True):
            key, conv, part, pos, turn, role, text, copies, mine, begins = r
            if pos < 0:
                audit, at, state = mine, 0, begins
                inserted, left, place = True, 0, 0
                row = (key, None, part)
            else:
                inserted, left = False, copies
                row = (key, conv, part)
            while left or inserted and at < len(audit) and audit[at] == "I":
                edit = audit[at]
                at += 1
                if edit == "I":
                    state, made = MADE[state]
                    yield (*row, place, None, made, "", edit)
                elif edit == "D":
                    left -= 1
                else:
                    made = role if edit == "K" else MADE[state][1]
                    state = KEPT[state][role[:1]] if edit == "K" else MADE[state][0]
                    left -= 1
                    yield (*row, place, turn, made, text, edit)
                place += 1
                inserted = True


def _repaired(conv_type, turn_type) -> pa.Schema:
    return pa.schema([("_cr_key", pa.string()), ("conv_id", conv_type), ("run", pa.int64()), ("place", pa.int64()), ("turn", turn_type), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, out = None, []

    def peek():
        nonlocal schema
        for b in batches:
            schema = schema or _repaired(b.schema.field("conv_id").type, b.schema.field("turn").type)
            yield b

    size = 0
    for r in _applied(peek()):
        out.append(r)
        size += len(r[6])
        if len(out) == 1000 or size > 8_000_000:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*out, strict=True), strict=True)), schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*out, strict=True), strict=True)), schema=schema)


_DIGEST = pa.schema([("_cr_key", pa.string()), ("repaired_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, h, out = None, None, []
    for r in _applied(batches):
        if r[0] != key:
            if h is not None:
                out.append((key, h.hexdigest()))
            key, h = r[0], hashlib.sha256()
        else:
            h.update(b"\n")
        h.update(f"{r[5]}:{r[6]}".encode())
        if len(out) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=_DIGEST)
            out = []
    if h is not None:
        out.append((key, h.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=_DIGEST)


class Repair:
    """The repair of all conversations of a table of rows (conv_id, turn, role, text, and copies if rows stand for several)."""

    def __init__(self, rows: DataFrame) -> None:
        copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
        self.faulty = cut(with_faults(rows.select("conv_id", "turn", "role", "text", copies.cast("long").alias("copies"))), "repair-rows")
        kinds = {f.name: f.dataType.simpleString() for f in self.faulty.schema}
        order = ["_cr_key", F.col("turn").asc_nulls_first(), "role", "text"]
        more = "_cr_part bigint, _cr_pos bigint, _cr_rows bigint, illegal bigint, _cr_head string, _cr_tail string, _cr_costs array<bigint>, _cr_audits array<string>"
        schema = ", ".join(f"{c} {kinds[c]}" for c in self.faulty.columns) + ", " + more
        self.folded = cut(self.faulty.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_fold, schema), "repair-runs")
        self.runs = self.folded.filter("_cr_pos = -1").select(*[x.split(" ")[0] for x in _PRODUCT.split(", ")])
        most = self.runs.groupBy("_cr_key").count().agg(F.max("count")).first()[0] or 1
        whole = self.runs
        while most > 1:
            up = F.row_number().over(Window.partitionBy("_cr_key").orderBy("_cr_part")) - 1
            dealt = whole.withColumn("_cr_up", F.floor(up / FAN)).withColumn("_cr_n", F.count("*").over(Window.partitionBy("_cr_key", "_cr_up")))
            lone = dealt.filter("_cr_n = 1").withColumn("_cr_part", F.col("_cr_up"))
            whole = lone.select(*whole.columns).unionByName(dealt.filter("_cr_n > 1").drop("_cr_n").groupBy("_cr_key", "_cr_up").applyInPandas(_multiply, _PRODUCT))
            most = -(-most // FAN)
        best = F.pandas_udf(_cheapest, "struct<cost: bigint, audit: string>")("_cr_costs", "_cr_audits")
        #: _cr_key, illegal, cost, audit of each conversation that has rows.
        self.whole = cut(whole.select("_cr_key", "illegal", best.alias("_cr_best")).select("_cr_key", "illegal", "_cr_best.*"), "repair-audits")

    def _stream(self, by: tuple[str, ...]) -> DataFrame:
        """Rows and slices of the audits, by run: the slice first, at place -1."""
        parts = self.runs.select("_cr_key", "_cr_part", "_cr_rows", "_cr_costs", "_cr_audits")
        parts = parts.withColumn("_cr_n", F.count("*").over(Window.partitionBy("_cr_key")))
        lone = parts.filter("_cr_n = 1").join(self.whole, "_cr_key").select("_cr_key", "_cr_part", F.col("audit").alias("_cr_slice"), F.lit(0).cast("long").alias("_cr_state"))
        many = parts.filter("_cr_n > 1").drop("_cr_n")
        whole = self.whole.join(many.select("_cr_key").distinct(), "_cr_key", "left_semi")
        cuts = many.groupBy("_cr_key").cogroup(whole.groupBy("_cr_key")).applyInPandas(_slices, "_cr_key string, _cr_part bigint, _cr_slice string, _cr_state bigint")
        heads = lone.unionByName(cuts).withColumn("_cr_pos", F.lit(-1).cast("long"))
        rows = self.folded.filter("_cr_pos >= 0").select("_cr_key", "conv_id", "turn", "role", "text", "copies", "_cr_part", "_cr_pos")
        return rows.unionByName(heads, allowMissingColumns=True).repartition(*by).sortWithinPartitions("_cr_key", "_cr_part", "_cr_pos")

    def rows(self) -> DataFrame:
        """conv_id, run, place, turn (null if inserted), role, text, edit (K, R, I) of the repaired rows; (run, place) is their order."""
        kinds = {f.name: f.dataType.simpleString() for f in self.faulty.schema}
        s = f"_cr_key string, conv_id {kinds['conv_id']}, run bigint, place bigint, turn {kinds['turn']}, role string, text string, edit string"
        out = self._stream(("_cr_key", "_cr_part")).mapInArrow(_rows, s)
        names = self.faulty.select("_cr_key", F.col("conv_id").alias("_cr_conv")).distinct()  # inserted rows before the first turn know the key only
        return out.join(names, "_cr_key").select(F.col("_cr_conv").alias("conv_id"), "run", "place", "turn", "role", "text", "edit")

    def digests(self) -> DataFrame:
        """_cr_key and the hash of its repaired rows, `role:text` joined by line feeds; conversations repaired to no rows have no row."""
        return self._stream(("_cr_key",)).mapInArrow(_digests, "_cr_key string, repaired_sha256 string")

    def report(self) -> DataFrame:
        """_cr_key, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows."""
        n, fault = F.col("copies"), F.col("fault")
        many = self.faulty.groupBy("_cr_key").agg(
            (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
            F.sum(F.when(fault == "blank", n).otherwise(0)).alias("blank"),
            F.sum(F.when(fault == "duplicate", n).when(fault == "blank", 0).otherwise(n - 1)).alias("duplicate"),
            F.sum(F.when(fault == "truncated", 1).otherwise(0)).alias("truncated"),
        )
        return many.join(self.whole, "_cr_key")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with `copies`: by the checksum of `conv_id:turn` some are dropped, emptied, robbed of their end marks, repeated or given the role user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    fixed = Repair(damage(conversations))
    all_ids = conversations.select("conv_id").distinct().withColumn("_cr_key", _key(F.col("conv_id")))
    out = all_ids.join(fixed.report(), "_cr_key", "left").join(fixed.digests(), "_cr_key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: One row a turn and state, turn by turn; crc32 bit by bit.
OP12_SQL = r"""
WITH RECURSIVE
rows0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS b FROM conversations),
kinds AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, octet_length(b) + 1), lambda i: ascii(decode(b)[i])::BIGINT),
    lambda c, x: list_reduce([xor(c, x)] || range(8), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 20 AS kind FROM rows0),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM kinds, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
    before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM seen),
made(i, j, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
kept(i, initial, j) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
closure(i, j, cost, audit, text) AS (SELECT i, i, 0, '', '' FROM made
    UNION ALL SELECT i, j, 5, 'I', chr(10) || role || ':' FROM made
    UNION ALL SELECT a.i, b.j, 10, 'II', chr(10) || a.role || ':' || chr(10) || b.role || ':' FROM made a JOIN made b ON a.j = b.i),
edits AS (SELECT conv_id, pos, i, i AS j, 2 AS cost, 'D' AS audit, '' AS text FROM faulty, made
    UNION ALL SELECT conv_id, pos, i, j, 1 + 5 * (fault = 'truncated')::INT, 'R', chr(10) || m.role || ':' || f.text FROM faulty f, made m WHERE fault IN ('none', 'truncated')
    UNION ALL SELECT conv_id, pos, i, j, 5 * (fault = 'truncated')::INT, 'K', chr(10) || role || ':' || text FROM faulty JOIN kept ON initial = left(role, 1) WHERE fault IN ('none', 'truncated')),
steps AS (SELECT conv_id, pos, e.i, c.j, e.cost + c.cost AS cost, e.audit || c.audit AS audit, e.text || c.text AS text FROM edits e JOIN closure c ON e.j = c.i),
walk(conv_id, pos, j, cost, audit, text) AS (
    SELECT conv_id, 0::BIGINT, j, cost, audit, text FROM (SELECT DISTINCT conv_id FROM faulty), closure WHERE i = 0
    UNION ALL
    SELECT conv_id, pos, j, cost, audit, text FROM (
        SELECT s.conv_id, s.pos, s.j, w.cost + s.cost AS cost, w.audit || s.audit AS audit, w.text || s.text AS text,
               row_number() OVER (PARTITION BY s.conv_id, s.j ORDER BY w.cost + s.cost, w.audit || s.audit) AS best
        FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.pos = w.pos + 1 AND s.i = w.j) WHERE best = 1),
counts AS (SELECT conv_id, max(pos) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM faulty GROUP BY conv_id),
ends AS (SELECT c.*, w.cost, w.audit, sha256(substr(w.text, 2)) AS h, row_number() OVER (PARTITION BY c.conv_id ORDER BY w.cost, w.audit) AS best
    FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.pos = c.last AND w.j IN (0, 3))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id AND e.best = 1
"""
