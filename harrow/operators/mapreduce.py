"""Map to none, one or many pairs, then fold the values of each key.

The column form is planned by Spark. The function form takes Python functions and runs in Arrow batches: values are
folded by key within each task, and once more after a shuffle by key. A reducer must be associative and commutative; it has no zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce as fold

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

#: Distinct keys that a task folds in memory before it passes them on.
HELD = 200_000


def none() -> list:
    return []


def one(key, value) -> list:
    return [(key, value)]


def many(pairs: Iterable) -> list:
    return list(pairs)


def emit_where(rows: DataFrame, predicate: Column) -> DataFrame:
    """Rows that a mapper doesn't map to none."""
    return rows.where(predicate)


def emit_one(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    return rows.select(key.alias("key"), value.alias("value"))


def emit_many(rows: DataFrame, pairs: list[tuple[Column, Column]]) -> DataFrame:
    """A row for each of the pairs of each row."""
    structs = F.array(*[F.struct(k.alias("key"), v.alias("value")) for k, v in pairs])
    return rows.select(F.explode(structs).alias("pair")).select("pair.key", "pair.value")


def reduce_pairs(pairs: DataFrame, reducer: Callable[[Column], Column]) -> DataFrame:
    """(key, value) with an aggregate of the values of each key."""
    return pairs.groupBy("key").agg(reducer(F.col("value")).alias("value"))


def map_reduce(rows: DataFrame, mapper: Callable[[dict], Iterable[tuple]], reducer: Callable, schema: str, partitions: int | None = None, workers: int | None = None) -> DataFrame:
    """(key, value) of the reducer's fold over all pairs that mapper gives for each row. schema: "key <type>, value <type>".

    partitions: result maps; workers: tasks that map, at most. A mapping task passes on each key once for every HELD keys, so a
    key that most rows have comes to its partition a few times from each task, not once for each row.
    """
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def packed(found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), arrow.field(0).type), pa.array(list(found.values()), arrow.field(1).type)], ["key", "value"])

    def folded(pairs: Iterator[tuple], bound: int | None) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for key, value in pairs:
            found[key] = reducer(found[key], value) if key in found else value
            if bound and len(found) >= bound:
                yield packed(found)
                found = {}
        if found:
            yield packed(found)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return folded((pair for batch in batches for row in batch.to_pylist() for pair in mapper(row)), HELD)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key: only one key is held at a time."""
        last, held, out, started = None, None, {}, False
        for batch in batches:
            for key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if started and key == last:
                    held = reducer(held, value)
                    continue
                if started:
                    out[last] = held
                if len(out) >= 8192:
                    yield packed(out)
                    out = {}
                last, held, started = key, value, True
        if started:
            out[last] = held
            yield packed(out)

    pairs = (rows.coalesce(workers) if workers else rows).mapInArrow(first, kind)
    pairs = pairs.repartition(partitions, "key") if partitions else pairs.repartition("key")
    return pairs.sortWithinPartitions("key").mapInArrow(runs, kind)


def map_par_reduce(rows: DataFrame, mapper: Callable, reducer: Callable, schema: str, partitions: int, workers: int | None = None) -> DataFrame:
    """map_reduce() into so many result maps; column partition says which."""
    return map_reduce(rows, mapper, reducer, schema, partitions, workers).withColumn("partition", F.spark_partition_id())


def fold_values(values: Iterable, reducer: Callable):
    """The fold of one key's values, without a zero."""
    return fold(reducer, values)


def filter_count(rows: DataFrame, predicate: Column) -> DataFrame:
    """One row: n, the number of rows that the predicate holds for."""
    return rows.where(predicate).agg(F.count(F.lit(1)).alias("n"))


def foreach(rows: DataFrame, function: Callable) -> None:
    """function called for each row, in parallel, for its effect."""
    rows.foreach(function)
