"""Best-fit packing into sequences of fixed length, by hierarchical residual packing.

Each partition packs its own pieces, so many at a time (`CHUNK`), longest first, each into the fullest bin that
still has room; bins that are nearly full are emitted, the underfull ones become items. Ever fewer and larger
groups of underfull bins are merged by the same rule. A group holds at most about `MOST_ITEMS` of them, as many as
a task should; where several groups of that size are left, bins are dealt anew for further rounds until a round
saves next to nothing. What is underfull then is emitted as it is.

Documents that have an order (a range of positions, and a row in it) keep it: only pieces of one range share a bin, or of a few
small neighbouring ones, underfull bins are merged with those of neighbouring ranges only, and a sequence goes by its first piece, so
sequences sorted by their number follow the order but for the width of a few ranges.

Cases: a null or empty text is the end token alone; a document longer than a sequence is cut so that only its
first piece may be short; with an order, a document's row must be below 2^24 in its range and have fewer than 2^20 pieces; repeated rows are packed as often as they occur; ties go to the earlier item; an empty
table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

LENGTH, END = 1024, 2
#: Free tokens of a bin that counts as nearly full.
SLACK = 4
#: Pieces that are packed at once and documents tokenized at once in a partition; groups of underfull bins that become
#: one; bins in a group; share of the bins that a round over full groups must save for another one.
CHUNK, STEP, FAN_IN, MOST_ITEMS, LEAST_SAVED = 50_000, 256, 8, 50_000, 0.01
#: Pieces below which a range is packed together with its neighbours, FAN_IN in all.
FEW = 2_000
#: Rounds in which FAN_IN neighbouring ranges, then as many of those, are merged where documents have an order.
NEAR_ROUNDS = 2

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, place bigint"
_BINS = "bin bigint, load int, members array<bigint>, places array<int>"


def best_fit(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """Items (their numbers) of each bin, in order of placing: largest first, into the fullest bin with room."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r: some bin has r tokens free
    for i in order:
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = length, len(bins)
            bins.append([i])
        if room - size:
            by_room[room - size].append(k)
            rooms |= 1 << (room - size)
    return bins


def piece_lengths(n: int, length: int = LENGTH) -> list[int]:
    k = -(-n // length)
    return [n - length * (k - 1)] + [length] * (k - 1)


def _local(path: str, with_ids: bool):
    names = [c.split()[0] for c in (_PIECES + (", ids array<int>" if with_ids else "") + ", load int").split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def packed(part: int, first: int, cols: list[list], ids: list, keys: list[int]) -> tuple[pa.RecordBatch, int]:
        """Rows of the pieces, then of underfull bins, and the number of bins so far. A bin goes by its least key, or by a number."""
        lengths = cols[3]
        home, place, under = [0] * len(lengths), [0] * len(lengths), []
        groups: dict[tuple[int, int], list[int]] = {}
        sizes = Counter(k >> 44 for k in keys)
        for i in range(len(lengths)):
            range_ = keys[i] >> 44 if keys else 0
            few = bool(keys) and sizes[range_] < FEW
            groups.setdefault((few, range_ // FAN_IN if few else range_), []).append(i)
        bins = [[some[i] for i in items] for some in groups.values() for items in best_fit([lengths[i] for i in some])]
        for k, items in enumerate(bins, first):
            at, name = 0, min(keys[i] for i in items) if keys else (part << 40) | k
            for i in items:
                home[i], place[i] = name, at
                at += lengths[i]
            if at < LENGTH - SLACK:
                under.append((name, at))
        n, none = len(lengths), len(under)
        arrays = [pa.array(c + [None] * none, t) for c, t in zip(cols, types, strict=True)]
        arrays += [pa.array(home + [x for x, _ in under], pa.int64()), pa.array(place + [None] * none, pa.int64())]
        if with_ids:
            arrays.append(pa.array([*ids, *[None] * none], pa.list_(pa.int32())))
        arrays.append(pa.array([None] * n + [x for _, x in under], pa.int32()))
        return pa.RecordBatch.from_arrays(arrays, names), first + len(bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import tokenizer

        enc, part, bins = tokenizer(path), TaskContext.get().partitionId(), 0
        end = np.array([END], np.uint32)
        cols: list[list] = [[] for _ in types]
        ids_out: list[np.ndarray] = []
        keys: list[int] = []
        for whole in batches:
            for begin in range(0, whole.num_rows, STEP):
                b = whole.slice(begin, STEP)
                places = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True) if b.num_columns > 2 else [(0, -1)] * b.num_rows
                for doc, ids, (range_, row) in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()]), places, strict=True):
                    ids = np.concatenate([ids, end])
                    at = 0
                    for p, n in enumerate(piece_lengths(len(ids))):
                        piece = ids[at : at + n]
                        for c, v in zip(cols, (doc, p, at, n, zlib.crc32(piece.astype("<u4").tobytes())), strict=True):
                            c.append(v)
                        if row >= 0:
                            keys.append(range_ << 44 | row << 20 | p)
                        if with_ids:
                            ids_out.append(piece.astype(np.int32))
                        at += n
                        if len(cols[0]) >= CHUNK:
                            out, bins = packed(part, bins, cols, ids_out, keys)
                            cols, ids_out, keys = [[] for _ in types], [], []
                            yield out
        if cols[0]:
            yield packed(part, bins, cols, ids_out, keys)[0]

    return run


def _merge(key, bins):
    """Underfull bins of one group, as items, into bins; a bin goes by the least name of its members."""
    import pandas as pd

    bins = bins.sort_values("bin")
    loads, names = bins["load"].tolist(), bins["bin"].tolist()
    members, places = bins["members"].tolist(), bins["places"].tolist()
    out = []
    for items in best_fit(loads):
        m, p, at = [], [], 0
        for i in items:
            m += [int(x) for x in members[i]]
            p += [int(x) + at for x in places[i]]
            at += loads[i]
        out.append((min(names[i] for i in items), at, m, p))
    return pd.DataFrame(out, columns=["bin", "load", "members", "places"])


def _near(open_: DataFrame, turn: int) -> DataFrame:
    """Underfull bins merged with those of neighbouring ranges; a group of very many is dealt into several."""
    group = F.expr(f"div(shiftright(bin, 44), {FAN_IN ** (turn + 1)})")
    sizes = open_.groupBy(group.alias("_group")).agg(F.ceil(F.count("*") / MOST_ITEMS).alias("_parts"))
    dealt = open_.withColumn("_group", group).join(sizes, "_group").withColumn("_part", F.pmod(F.xxhash64("bin", F.lit(turn)), F.col("_parts")))
    return cut(dealt.groupBy("_group", "_part").applyInPandas(_merge, _BINS), "pack-near")


def pack(docs: DataFrame, path: str, ids: bool = False, order: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with `ids`, the tokens too.

    path: the file of the tokenizer, on every machine. order: columns with a range of positions and the row in it.
    """
    schema = _PIECES + (", ids array<int>" if ids else "") + ", load int"
    both = cut(docs.selectExpr("cast(doc_id as bigint) doc_id", "text", *[f"cast({c} as bigint) {n}" for c, n in zip(order or (), ("_range", "_row"))]).mapInArrow(_local(path, ids), schema), "pack-local")
    pieces = both.filter("load is null").drop("load")
    open_ = both.filter("load is not null").select("bin", "load", F.array("bin").alias("members"), F.array(F.lit(0)).alias("places"))
    done = []
    # a leaf of the tree is what one task packed
    groups, left = open_.agg(F.countDistinct(F.shiftright("bin", 40)), F.count("*")).first()
    turn = 0
    for near in range(NEAR_ROUNDS if order else 0):
        merged = _near(open_, near)
        done.append(merged.filter(F.col("load") >= LENGTH - SLACK))
        open_ = merged.filter(F.col("load") < LENGTH - SLACK)
    while left > 1 and not order:
        fewest = -(-left // MOST_ITEMS)
        full = groups <= fewest  # no further up the tree: only another deal
        groups = max(fewest, -(-groups // FAN_IN))
        deal = F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)).alias("_group")
        merged = cut(open_.groupBy(deal).applyInPandas(_merge, _BINS), "pack-merge")
        done.append(merged.filter(F.col("load") >= LENGTH - SLACK))
        open_ = merged.filter(F.col("load") < LENGTH - SLACK)
        before, left, turn = left, open_.count(), turn + 1
        if groups == 1 or full and before - left < LEAST_SAVED * before:
            break
    moved = reduce(DataFrame.unionByName, [*done, open_]).filter(F.size("members") > 1)
    moved = moved.select(F.col("bin").alias("_to"), F.explode(F.arrays_zip("members", "places")).alias("m"))
    moved = moved.select(F.col("m.members").alias("bin"), "_to", F.col("m.places").alias("_by"))
    out = pieces.join(moved, "bin", "left")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("_to", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("_by", F.lit(0))).alias("offset"), *(["ids"] if ids else [])
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
