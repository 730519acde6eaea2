"""Collections with a weight for each row: +1 adds a row, -1 takes it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.keys import double_sum


def consolidate(rows: DataFrame) -> DataFrame:
    """Equal rows as one, weights added; rows whose weights add up to 0 are gone."""
    others = [c for c in rows.columns if c != "weight"]
    return rows.groupBy(*others).agg(F.sum("weight").alias("weight")).where("weight <> 0")


def weighted_sums(rows: DataFrame) -> DataFrame:
    """key, total (sum of value x weight, in double precision) and weight of rows (key, value, weight); keys with a weight of 0 are gone."""
    return rows.groupBy("key").agg(double_sum(F.col("value").cast("double") * F.col("weight")).alias("total"), F.sum("weight").alias("weight")).where("weight <> 0")


def weighted_groups(rows: DataFrame) -> DataFrame:
    """One row: n_groups and total_revenue over weighted_sums()."""
    return weighted_sums(rows).agg(F.count(F.lit(1)).alias("n_groups"), double_sum(F.col("total")).alias("total_revenue"))
