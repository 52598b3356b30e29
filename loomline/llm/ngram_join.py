"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.75 or more, as components.

Rare-first prefix filtering. One pass over the texts makes shingle keys and deals them out by hash ranges, where
document frequencies are counted; only keys that two documents share come back. In the order of frequency, then
key, a document's prefix is what it would have to share with any similar one; keys of one document alone come
first in it, so most documents drop out there. The rest meet on prefix keys under length, positional and suffix
filters, and each pair is verified once on whole sets.

Work on groups of copies is linear: equal sets are one class from the start; documents that meet on a key are
first compared with one leader, which then is done with there, and later rounds only compare what isn't connected
yet, the last one every pair that is left; so no link between different texts is lost, while copies aren't
expanded into pairs. A key that many documents of a batch share travels as a count.

Cases: a null text, or one without words, has no shingles and is linked with nothing; rows without doc_id take
part, and a component without any id has a null one; equal rows share a component; an empty table gives an empty
result; columns besides doc_id and text are ignored by `join`. Keys have 40 bits at least within a comparison,
48 for the size of a set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, input_bytes, pieces, table
from .components import components
from .shingles import arrow_text, expand, mix, shingles, shrink

#: Similarity in percent.
LEAST = 75
#: Shingles of a batch, texts' bytes hashed at once, documents of a batch (their numbers have 16 bits), keys that temporary arrays are made of.
BATCH, STEP, MOST_DOCS, PART = 1_500_000, 1 << 18, 60_000, 1 << 17
#: Documents of a batch from which a key is sent as a count.
COMMON = 16
#: Rounds that compare with leaders before the one that compares all pairs left; rows of a key that meet in one block there.
ROUNDS, BLOCK = 3, 512

_ROWS = "bucket int, batch bigint, kind int, n int, blob binary"
_BACK, _SELF = 0, 1  # kinds on the way back; on the way there _BACK are keys, _COUNTS counts
_COUNTS = 2


def _bits(docs: DataFrame) -> int:
    """Bits of the bucket number: buckets of some 32 MB of input."""
    want = max(1, input_bytes(docs) // (2 << 20))
    return int(min(20, max(8, np.ceil(np.log2(want)))))


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _spans(keys: np.ndarray, low: int) -> Iterator[tuple[int, int]]:
    """Stretches of sorted keys of some PART each; keys that differ in their `low` lowest bits only stay together."""
    at = 0
    while at < len(keys):
        to = min(at + PART, len(keys))
        if to < len(keys):
            to = int(np.searchsorted(keys, keys[to - 1] | np.uint64((1 << low) - 1), "right"))
        yield at, to
        at = to


def _batch_rows(number: int, ids: list, pairs: np.ndarray, bits: int):
    """Rows of one batch: keys and counts by bucket, and one row about the documents. pairs: key << 16 | document, which are sorted in place."""
    pairs.sort()
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
    size, sums = np.zeros(len(ids), np.int64), [np.zeros(len(ids), np.int64) for _ in range(2)]
    rest = min(32, 48 - bits)
    out: list[tuple] = []
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def deal(k: np.ndarray, more: np.ndarray, kind: int):
        if not len(k):
            return
        bucket = (k >> np.uint64(rest)).astype(np.int64)
        low = (k & np.uint64((1 << rest) - 1)).astype(np.uint32)
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(k)], strict=True):
            out.append((int(bucket[a]), number, kind, b - a, shrink(_deltas(low[a:b]), more[a:b])))

    for start, stop in _spans(pairs, 64 - bits):  # whole buckets
        keys, docs = pairs[start:stop] >> np.uint64(16), (pairs[start:stop] & np.uint64(0xFFFF)).astype(np.uint16)
        size += np.bincount(docs, minlength=len(ids))
        m = mix(keys)
        for total, part in zip(sums, (m >> np.uint64(32), m & np.uint64(0xFFFFFFFF)), strict=True):
            total += np.bincount(docs, weights=part.astype(float), minlength=len(ids)).astype(np.int64)
        keys >>= np.uint64(48 - bits - rest)
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        count = np.diff(np.append(edge, len(keys)))
        often = np.repeat(count >= COMMON, count)
        deal(keys[~often], docs[~often], _BACK)
        deal(keys[edge[count >= COMMON]], count[count >= COMMON].astype(np.uint32), _COUNTS)
        kept.append((keys[often], docs[often]))
    known = np.array([x is not None for x in ids], np.uint8)
    named = np.array([x or 0 for x in ids], np.int64)
    about = shrink(named, known, size, *sums)
    keys, docs = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0, np.uint16)), *kept, strict=True))
    blob = len(about).to_bytes(8, "little") + len(keys).to_bytes(8, "little") + about + shrink(keys, docs)
    out.append(((1 << bits) + number % (1 << bits), number, _SELF, len(ids), blob))
    return out


def _about(blob: bytes, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    size, often = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    return expand(blob[16 : 16 + size], n, np.int64, np.uint8, np.int64, np.int64, np.int64), expand(blob[16 + size :], often, np.uint64, np.uint16)


def _sent(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        pairs: list[np.ndarray] = []
        held = 0

        def send():
            nonlocal ids, pairs, held, number
            joined = np.concatenate([np.zeros(0, np.uint64), *pairs])
            pairs = []
            rows = _batch_rows((part << 24) | number, ids, joined, bits)
            ids, held, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], [c.split()[0] for c in _ROWS.split(", ")])

        for b in batches:
            raw, off = arrow_text(b.column(1))
            names = b.column(0).to_pylist()
            at = 0
            while at < len(names):
                to = max(at + 1, int(np.searchsorted(off, off[at] + STEP, "right")) - 1)
                to = min(to, at + MOST_DOCS - len(ids))
                d, k = shingles(raw[off[at] : off[to]], off[at : to + 1] - off[at])
                pairs.append((k << np.uint64(16)) | (d + len(ids)).astype(np.uint64))
                ids += names[at:to]
                held += len(k)
                at = to
                if held >= BATCH or len(ids) >= MOST_DOCS:
                    yield send()
        if ids:
            yield send()

    return run


def _counted(key, rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: document frequencies; what occurs twice or more goes back to its batches."""
    if (rows["kind"] == _SELF).all():
        return rows
    rows = rows.sort_values(["batch", "kind"])
    low, more, weight, ends = [], [], [], [0]
    for kind, n, blob in zip(rows["kind"], rows["n"], rows["blob"], strict=True):
        k, x = expand(blob, n, np.uint32, np.uint32 if kind == _COUNTS else np.uint16)
        low.append(np.cumsum(k, dtype=np.uint32))
        more.append(np.full(n, 0xFFFF, np.uint16) if kind == _COUNTS else x)
        weight.append(x.astype(np.int64) if kind == _COUNTS else np.ones(n, np.int64))
        ends.append(ends[-1] + n)
    low, more, weight = map(np.concatenate, (low, more, weight))
    _, back = np.unique(low, return_inverse=True)
    often = np.minimum(np.bincount(back, weights=weight), 0xFFFF).astype(np.uint16)[back]
    out = []
    for a, b, batch in zip(ends, ends[1:], rows["batch"], strict=False):
        pick = np.flatnonzero(often[a:b] > 1) + a
        if len(pick):
            out.append((key[0], batch, _BACK, len(pick), shrink(_deltas(low[pick]), more[pick], often[pick])))
    return pd.DataFrame(out, columns=["bucket", "batch", "kind", "n", "blob"])


def _documents(rows: DataFrame) -> DataFrame:
    """uid, doc_id, n and two sums that tell a set, of every document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for batch, n, blob in zip(f["batch"], f["n"], f["blob"], strict=True):
                (ids, known, size, s1, s2), _ = _about(blob, n)
                doc = pd.array(ids, dtype="Int64")
                doc[known == 0] = pd.NA
                yield pd.DataFrame({"uid": (np.int64(batch) << 16) | np.arange(n), "doc_id": doc, "n": size, "s1": s1, "s2": s2})

    return rows.filter(F.col("kind") == _SELF).mapInPandas(run, "uid bigint, doc_id bigint, n bigint, s1 bigint, s2 bigint")


_PREFIX = "key bigint, uid bigint, n bigint, pos bigint, h1 bigint, h2 bigint, keys binary"


def _prefixes(bits: int):
    rest = min(32, 48 - bits)

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        """One batch: a row with the shared keys of each document that can have partners, and its prefix rows."""
        empty = pd.DataFrame({c.split()[0]: pd.Series(dtype=object if c.endswith("binary") else "int64") for c in _PREFIX.split(", ")})
        own = rows[rows["kind"] == _SELF]
        reps = rows[rows["kind"] == _COUNTS]
        if not len(reps):
            return empty
        (_, _, size, _, _), (okeys, odocs) = _about(own["blob"].iloc[0], int(own["n"].iloc[0]))
        picked = np.zeros(len(size), bool)
        picked[np.frombuffer(reps["blob"].iloc[0], ">u2")] = True
        most = int(rows["n"][rows["kind"] == _BACK].sum()) + len(okeys)
        # document << 48 | key, and the key's frequency
        pairs, often, n_pairs = np.empty(most, np.uint64), np.empty(most, np.uint16), 0

        def add(k: np.ndarray, d: np.ndarray, f: np.ndarray):
            nonlocal n_pairs
            pairs[n_pairs : n_pairs + len(k)] = (d.astype(np.uint64) << np.uint64(48)) | k
            often[n_pairs : n_pairs + len(k)] = f
            n_pairs += len(k)

        counted: dict[str, list] = {"k": [], "f": []}
        for bucket, kind, n, blob in zip(rows["bucket"], rows["kind"], rows["n"], rows["blob"], strict=True):
            if kind != _BACK:
                continue
            k, d, f = expand(blob, n, np.uint32, np.uint16, np.uint16)
            k = (np.uint64(bucket) << np.uint64(rest)) | np.cumsum(k, dtype=np.uint32).astype(np.uint64)
            many = d == 0xFFFF
            if many.any():
                counted["k"].append(k[many])
                counted["f"].append(f[many])
            use = ~many & picked[np.where(many, 0, d)]
            add(k[use], d[use], f[use])
        if counted["k"]:
            ck, cf = np.concatenate(counted["k"]), np.concatenate(counted["f"])
            order = np.argsort(ck)
            ck, cf = ck[order], cf[order]
            for at in range(0, len(okeys), PART):
                ok, od = okeys[at : at + PART], odocs[at : at + PART]
                use = picked[od]
                ok, od = ok[use], od[use]
                add(ok, od, cf[np.minimum(np.searchsorted(ck, ok), len(ck) - 1)])
        if not n_pairs:
            return empty
        order = np.argsort(pairs[:n_pairs])
        pairs, often = pairs[order], often[order]
        del order
        new = np.append(True, pairs[1:] != pairs[:-1])
        keys, often = pairs[new], often[new]
        del pairs, new
        # keys of a document by frequency, then key; halves of a set by hash range, eight of them, for the suffix filter
        part = np.zeros(8 * len(size), np.int64)
        for start, stop in _spans(keys, 48):  # whole documents
            d, k = (keys[start:stop] >> np.uint64(48)).astype(np.int64), keys[start:stop] & np.uint64((1 << 48) - 1)
            part += np.bincount(d * 8 + (k >> np.uint64(bits + rest - 3)).astype(np.int64), minlength=8 * len(size))
            keys[start:stop] = k[np.argsort((d << 16) | often[start:stop], kind="stable")]
        part = part.reshape(-1, 8)
        shared = part.sum(1)
        part = np.minimum(part, 0x7FFF)
        need = -(-LEAST * size // 100)  # overlap with any similar set
        alone = size - shared
        take = size - need + 1 - alone  # of the shared keys, those in the prefix
        live = (take > 0) & (shared > 0) & picked
        first = np.cumsum(shared) - shared
        halves = [sum(part[:, 4 * h + k] << (16 * k) for k in range(4)) for h in (0, 1)]
        base = (np.int64(key[0]) << 16) | np.arange(len(size))
        at = np.flatnonzero(live)
        if not len(at):
            return empty
        t = np.minimum(take[at], shared[at])
        step = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        per = np.repeat(at, t)
        ahead = pd.DataFrame({"key": keys[first[per] + step].astype(np.int64), "uid": base[per], "n": size[per], "pos": alone[per] + step, "h1": halves[0][per], "h2": halves[1][per], "keys": None})
        blobs = []
        for d in at.tolist():
            s = np.sort(keys[first[d] : first[d] + shared[d]])
            blobs.append((s & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (s >> np.uint64(32)).astype("<u2").tobytes())
        whole = pd.DataFrame({"key": -1, "uid": base[at], "n": size[at], "pos": shared[at], "h1": 0, "h2": 0, "keys": blobs})
        return pd.concat([ahead, whole])

    return run


def _similar(both: DataFrame) -> DataFrame:
    """Pairs (x, y) that pass the length, positional and suffix filters, as (a, b)."""
    both = both.filter(f"100 * least(x.n, y.n) >= {LEAST} * greatest(x.n, y.n)")
    need = f"{LEAST} * (x.n + y.n)"
    both = both.filter(f"{100 + LEAST} * least(x.n - x.pos, y.n - y.pos) >= {need}")

    def share(h: str, k: int) -> str:
        one = [f"(shiftrightunsigned({t}.{h}, {16 * k}) & 32767)" for t in "xy"]
        return f"IF({one[0]} = 32767 OR {one[1]} = 32767, least(x.n, y.n), least({one[0]}, {one[1]}))"

    most = " + ".join(share(h, k) for h in ("h1", "h2") for k in range(4))
    both = both.filter(f"{100 + LEAST} * ({most}) >= {need}")
    return both.selectExpr("least(x.uid, y.uid) a", "greatest(x.uid, y.uid) b").distinct()


def _left(p: DataFrame) -> DataFrame:
    """Candidates among all rows of a key that are in different components.

    Most rows of a frequent key are in one component, its home there; a pair then has a row outside of it. So the
    outsiders meet all rows, which are dealt into blocks by the key's frequency, and outsiders go to each block. Of
    a pair, the smaller set must hold the key among its first (100 - LEAST) / (100 + LEAST) keys, and sizes are in
    the same or neighbouring classes, so rows are met by role and class.
    """
    parts = p.groupBy("key", "comp").count()
    home = parts.groupBy("key").agg(F.max(F.struct("count", "comp"))["comp"].alias("home"), F.sum("count").alias("_f"), F.count("*").alias("_c")).filter("_c > 1")
    rows = p.join(home, "key").withColumn("_blocks", F.ceil(F.col("_f") / BLOCK).cast("int"))
    rows = rows.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.01 * 100 / LEAST))))
    small = F.expr(f"{100 + LEAST} * (n - pos) >= {2 * LEAST} * n")

    def meets(role: int, by: int):
        return F.struct(F.lit(role).alias("role"), (F.col("class") + by).alias("class"))

    bigger, smaller = F.array(meets(1, 0), meets(1, 1)), F.array(meets(0, 0), meets(0, -1))
    keep = ["key", "uid", "comp", "n", "pos", "h1", "h2"]
    x = rows.filter("comp <> home").withColumn("_m", F.explode(F.when(small, F.concat(bigger, smaller)).otherwise(smaller)))
    x = x.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(*keep, "_m.role", "_m.class", "_block")
    own = F.when(small, F.array(meets(0, 0), meets(1, 0))).otherwise(F.array(meets(1, 0)))
    y = rows.withColumn("_m", F.explode(own)).withColumn("_block", F.expr("cast(pmod(xxhash64(uid), _blocks) as int)"))
    y = y.select(*keep, "_m.role", "_m.class", "_block", (F.col("comp") == F.col("home")).alias("inside"))
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "role", "class", "_block")]
    order = F.expr("x.comp <> y.comp and (y.inside or x.uid < y.uid) and if(x.role = 1, x.n <= y.n, x.n > y.n)")
    return _similar(x.alias("x").join(y.alias("y"), [*on, order]))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked) of each pair, from the whole sets of shared keys."""
    one = sets.selectExpr("uid as a", "n as na", "keys as ka")
    other = sets.selectExpr("uid as b", "n as nb", "keys as kb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for few in pieces([b]):
                for na, nb, ka, kb in zip(*(few.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True):
                    x, y = (_keys(k) for k in (ka, kb))
                    o = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * o >= LEAST * (na + nb - o))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return pairs.join(one, "a").join(other, "b").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, "a bigint, b bigint, linked boolean")


def _keys(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return np.frombuffer(blob, "<u4", n).astype(np.uint64) | (np.frombuffer(blob, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    bits = _bits(docs)
    sent = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(_sent(bits), _ROWS)
    back = cut(sent.groupBy("bucket").applyInPandas(_counted, _ROWS), "ngram-counts")
    known = cut(_documents(back), "ngram-documents")
    classes = cut(known.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("uid").alias("rep"), F.min("doc_id").alias("low")), "ngram-classes")
    # at most MOST_DOCS numbers of two bytes for each batch
    reps = classes.groupBy(F.shiftright("rep", 16).alias("batch")).agg(F.array_join(F.transform(F.collect_list(F.expr("rep & 65535")), lambda x: F.lpad(F.hex(x), 4, "0")), "").alias("_h"))
    reps = reps.select(F.lit(0).alias("bucket"), "batch", F.lit(_COUNTS).alias("kind"), F.lit(0).alias("n"), F.unhex("_h").alias("blob"))
    rows = cut(back.unionByName(reps).groupBy("batch").applyInPandas(_prefixes(bits), _PREFIX), "ngram-prefixes")
    discard(back)
    prefix, sets = rows.filter("key >= 0").drop("keys"), rows.filter("key < 0").select("uid", "n", "keys")
    seen: list[DataFrame] = []
    comp = None
    for turn in range(ROUNDS + 1):
        p = prefix
        if comp is None:
            p = p.withColumn("comp", F.col("uid"))
        else:
            p = p.join(comp.withColumnRenamed("node", "uid"), "uid", "left").withColumn("comp", F.coalesce("component", "uid")).drop("component")
        if turn < ROUNDS:
            # first the document with the fewest keys of its own: what others are copies of; then any, then the longest
            first = (F.col("pos"), F.lit(0), -F.col("n"))[turn % 3].cast("bigint")
            lead = F.min(F.struct(first.alias("first"), F.xxhash64("uid", F.lit(turn)).alias("any"), "uid", "comp", "n", "pos", "h1", "h2"))
            several = p.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), lead.alias("_lead")).filter("_lo < _hi").select("key", "_lead")
            # the leader has met all others of its key: it and keys of one component are done with
            left = cut(p.join(several, "key").filter("uid <> _lead.uid"), f"ngram-left-{turn}")
            pairs = _similar(left.filter("comp <> _lead.comp").select(F.struct("uid", "n", "pos", "h1", "h2").alias("x"), F.col("_lead").alias("y")))
            prefix = left.drop("comp", "_lead")
        else:
            pairs = _left(p)
        if seen:
            pairs = pairs.join(reduce(DataFrame.unionByName, seen), ["a", "b"], "left_anti")
        found = cut(_verified(pairs, sets), f"ngram-verified-{turn}")
        seen.append(found)
        links = reduce(DataFrame.unionByName, seen).filter("linked")
        if comp is None or not found.filter("linked").isEmpty():
            comp = cut(components(links), f"ngram-components-{turn}")
    named = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("_c", F.coalesce("component", "rep"))
    low = named.groupBy("_c").agg(F.min("low").alias("component_id"))
    named = named.select("n", "s1", "s2", "_c").join(low, "_c")
    out = known.join(named, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: All pairs by their common shingles, and components by following links; for tables of some thousand documents.
OP7_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS u, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS.upper()}', '{_LETTERS}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT u, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
q AS (SELECT u, i, x, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3, lead(x, 4) OVER o AS x4 FROM p WINDOW o AS (PARTITION BY u ORDER BY i)),
s AS (SELECT DISTINCT u, hash(x, x1, x2, x3, x4) AS g FROM q WHERE x4 IS NOT NULL OR i = 1),
n AS (SELECT u, count(*) AS n FROM s GROUP BY u),
k AS (SELECT u, g AS h FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
o AS (SELECT x.u AS a, y.u AS b, count(*) AS o FROM k x JOIN k y ON x.h = y.h AND x.u <> y.u GROUP BY x.u, y.u),
e AS (SELECT a, b FROM o JOIN n x ON x.u = a JOIN n y ON y.u = b WHERE 100 * o >= {LEAST} * (x.n + y.n - o)),
r(u, v) AS (SELECT u, u FROM n UNION SELECT r.u, e.b FROM r JOIN e ON r.v = e.a),
c AS (SELECT r.u, min(d.doc_id) AS component_id FROM r JOIN d ON d.u = r.v GROUP BY r.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE c.component_id END AS component_id
FROM d LEFT JOIN n ON n.u = d.u LEFT JOIN c ON c.u = d.u
"""
