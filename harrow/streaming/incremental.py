"""Grouped sums kept up to date as chunks arrive. An epoch is a micro-batch; nothing is late, as time is the order of arrival."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from harrow.functions.keys import double_sum
from harrow.operators.multiset import weighted_sums


@dataclass
class Epoch:
    number: int
    seconds: float
    n_groups: int
    total_revenue: float


@dataclass
class Upkeep:
    """A running query, and the result after each epoch so far."""

    query: StreamingQuery | None = None
    epochs: list[Epoch] = field(default_factory=list)

    def settle(self) -> None:
        """Wait until all that has arrived is in the result."""
        self.query.processAllAvailable()

    def stop(self) -> None:
        self.query.stop()


def stream_chunks(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", chunks_per_epoch: int | None = 1) -> DataFrame:
    """Chunks of a folder as a stream, so many in an epoch; all that is there, if None."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", chunks_per_epoch) if chunks_per_epoch else reader).format(fmt).load(folder)


def keep_sums(rows: DataFrame, checkpoint: str, on_epoch: Callable[[Epoch], None] | None = None, sink: str | None = None, available_now: bool = False) -> Upkeep:
    """Weighted sums of a stream (key, value, weight), kept in Spark's state store; the result of each epoch is counted, and written to sink.

    Two stateful aggregates can't be nested in a stream, so the groups are counted in the epoch's own batch, over the sums. checkpoint is a folder that all executors share.
    """
    state, began = Upkeep(), time.monotonic()

    def settled(sums: DataFrame, number: int) -> None:
        if sink:
            sums.write.mode("overwrite").parquet(sink)
        row = sums.agg(F.count(F.lit(1)).alias("n"), double_sum(F.col("total")).alias("total")).first()
        epoch = Epoch(number, time.monotonic() - began, row["n"], row["total"] or 0.0)
        state.epochs.append(epoch)
        if on_epoch:
            on_epoch(epoch)

    writer = weighted_sums(rows).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(settled)
    state.query = (writer.trigger(availableNow=True) if available_now else writer).start()
    return state


def keep_changes(rows: DataFrame, checkpoint: str, sink: str, available_now: bool = False) -> Upkeep:
    """Weighted sums of a stream (key, value, weight); only the groups that an epoch changed are written, to the folder epoch=<number> of sink.

    A group that is taken back whole comes with a weight of 0, so a reader can follow the result without the other groups. An epoch
    that is done again after a failure overwrites its own folder.
    """

    def changed(sums: DataFrame, number: int) -> None:
        sums.write.mode("overwrite").parquet(f"{sink}/epoch={number}")

    sums = rows.groupBy("key").agg(double_sum(F.col("value").cast("double") * F.col("weight")).alias("total"), F.sum("weight").alias("weight"))
    writer = sums.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(changed)
    return Upkeep((writer.trigger(availableNow=True) if available_now else writer).start())


def keep_count(keys: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
    """The number of distinct keys only, without sums: cheaper, and no answer to retractions. The result is the in-memory table `name`."""
    counts = keys.select("key").dropDuplicates(["key"]).groupBy().count()
    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).format("memory").queryName(name).start()


def initial_share(n: int, peers: int = 1) -> int:
    """Chunks of the first epoch: 95 of 100, dealt over peers."""
    return n * 95 // 100 // peers
