"""Fields of heterogeneous records handled kind by kind, in batches, and put together again."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_values(records: DataFrame, key: Sequence[str], fields: Column) -> DataFrame:
    """key, field, ord, value: a row for each value of a map of lists, nulls too, so that gaps keep their place."""
    d = records.select(*key, F.explode(fields).alias("field", "_values"))
    return d.select(*key, "field", F.posexplode("_values").alias("ord", "value"))


def per_field(records: DataFrame, key: Sequence[str], fields: Column, handlers: dict[str, Callable[[DataFrame], DataFrame]], write: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """key and results, a map of lists like the fields' own: each value replaced by what its field's handler makes of it.

    A handler gets all rows (key, field, ord, value) of its field, from whatever records, without the null values, and returns them with
    `result`, in any order; rows it leaves out, and null values, are NULL at their place. A field without a handler keeps its name with an empty
    list; an empty list stays one, and a record without fields has an empty map. One row per key. write, if given, cuts the lineage of
    the exploded values, which each handler reads.
    """
    values = field_values(records, key, fields)
    values = write(values) if write else values
    got = None
    for field, handle in handlers.items():
        mine = values.filter(F.col("field") == field)
        done = handle(mine.filter("value is not null")).select(*key, "field", "ord", "result")
        got = done if got is None else got.unionByName(done)
    handled = values.filter(F.col("field").isin(*handlers))
    placed = handled.select(*key, "field", "ord").join(got, [*key, "field", "ord"], "left")
    lists = placed.groupBy(*key, "field").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "result"))), lambda x: x["result"]).alias("_results"))
    named = records.select(*key, F.explode(F.map_keys(fields)).alias("field")).join(lists, [*key, "field"], "left")
    whole = named.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", F.coalesce("_results", F.array().cast(lists.schema["_results"].dataType)).alias("_results"))))).alias("results"))
    return records.select(*key).join(whole, list(key), "left").withColumn("results", F.coalesce("results", F.create_map().cast(whole.schema["results"].dataType)))


def batched(function: Callable[[pd.Series], pd.Series], result: str, size: int = 1_000) -> Callable[[DataFrame], DataFrame]:
    """A handler that calls a function on up to so many values at a time, of whatever records lie together."""

    def handle(values: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for at in range(0, len(f), size):
                    some = f.iloc[at : at + size]
                    yield some.assign(result=function(some["value"]).to_numpy())

        schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in values.schema) + f", result {result}"
        return values.mapInPandas(run, schema)

    return handle


def in_groups(rows: DataFrame, group: Sequence[str], spread: str, function: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str, size: int = 5_000) -> DataFrame:
    """A function over batches whose rows agree in the group's columns, each of some `size` rows: a large group is dealt over as many batches as it needs by a hash of `spread`.

    The function gets the group's values and a batch. Null group values are a group. Rows that agree in `spread` stay together.
    """
    sizes = rows.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]).agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]
    d = rows.join(sizes, same).withColumn("_batch", F.pmod(F.xxhash64(spread), F.col("_n")).cast("int"))

    def run(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        return function(key[:-1], some.drop(columns="_batch"))

    return d.select(*rows.columns, "_batch").groupBy(*group, "_batch").applyInPandas(run, schema)
