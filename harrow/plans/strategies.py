"""Ways of carrying out one grouped sum. All give the same rows (key, total); they differ in what is combined and shuffled.

Sums are in double precision, so the order of adding shows in their last digits. The sum is part of every result, so that no
plan can leave it out by only counting groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.keys import double_sum, hash_bucket, trie_bucket

BUCKETS = 256


def hash_one(pairs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Sums on both sides of a shuffle by key, then one final map: a single partition holds the result. Only the result goes through one task."""
    return hashes_partial(pairs).repartition(1)


def hashes(pairs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Raw rows go to their bucket and are summed there only. Of use where nearly every key is seen once."""
    return pairs.repartition(buckets, "key").groupBy("key").agg(double_sum(F.col("value")).alias("total"))


def hashes_partial(pairs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Sums on both sides of the shuffle: what is moved is at most a row for each key and task. The choice for skewed keys and for scale."""
    return pairs.groupBy("key").agg(double_sum(F.col("value")).alias("total"))


def tries(pairs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows are dealt out by the first two bytes of the key, so that keys that share them lie together, and are summed where they lie: one shuffle."""
    dealt = pairs.withColumn("bucket", trie_bucket(F.col("key"), buckets)).repartition(buckets, "bucket")
    return dealt.groupBy("bucket", "key").agg(double_sum(F.col("value")).alias("total")).select("key", "total")


def exchange(pairs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The dataflow form: raw rows exchanged by the hash of the key, then summed, in as many partitions as there are workers."""
    workers = pairs.sparkSession.sparkContext.defaultParallelism
    return pairs.repartition(workers, "key").groupBy("key").agg(double_sum(F.col("value")).alias("total"))


def sort(pairs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows sorted by key within partitions and equal neighbours merged. Sorting spills and merging holds one group, so memory doesn't grow with keys.

    Spark merges sorted rows where an aggregate's state is of no fixed width, as that of the key's maximum is; the sum alone would be hashed.
    """
    sums = pairs.repartition(buckets, "key").groupBy("key").agg(F.max("key").alias("same"), double_sum(F.col("value")).alias("total"))
    return sums.select(F.col("same").alias("key"), "total")


def weighted(pairs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Every row with a weight of 1, summed as a multiset."""
    from harrow.operators.multiset import weighted_sums

    rows = pairs.select("key", "value", F.lit(1).alias("weight"))
    return weighted_sums(rows).select("key", "total")


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "hash": hash_one,
    "hashes": hashes,
    "hashes_partial": hashes_partial,
    "tries": tries,
    "exchange": exchange,
    "sort": sort,
    "weighted": weighted,
}


def aggregate(pairs: DataFrame, strategy: str = "hashes", partial: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """(key, total) of pairs (key, value). partial, to combine before the shuffle, has a meaning for `hashes` only."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    name = "hashes_partial" if strategy == "hashes" and partial else strategy
    return STRATEGIES[name](pairs, buckets)


def group_count(sums: DataFrame) -> DataFrame:
    """One row: n_groups and the sum of all totals, which keeps the totals in the plan."""
    return sums.agg(F.count(F.lit(1)).alias("n_groups"), double_sum(F.col("total")).alias("total_revenue"))


def bucket_sizes(sums: DataFrame, buckets: int = BUCKETS, bucket: Callable = hash_bucket) -> DataFrame:
    """How evenly keys fall on buckets: buckets in use, least, most and mean number of keys."""
    sizes = sums.groupBy(bucket(F.col("key"), buckets).alias("bucket")).count()
    return sizes.agg(F.count(F.lit(1)).alias("buckets"), F.min("count").alias("least"), F.max("count").alias("most"), F.avg("count").alias("mean"))


def by_partition(sums: DataFrame, buckets: int = BUCKETS, bucket: Callable = hash_bucket) -> DataFrame:
    """The result in as many partitions as buckets, with the number of the partition that each row is in."""
    return sums.repartitionById(buckets, bucket(F.col("key"), buckets)).withColumn("partition", F.spark_partition_id())
