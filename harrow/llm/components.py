"""Connected components of a graph given by its links, without collecting any part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import few, written

#: Links that one task works on, about 4 MB.
SHARE = 250_000


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each end of links (a, b); component is the smallest id that can be reached.

    In each round every node hooks on to the smallest of itself and its neighbours, and hooks are followed to their ends, in
    as many joins as the logarithm of the longest chain. Links are then carried over to these ends, and those that became
    loops go; only nodes without a smaller neighbour are left. Nulls in links are left out; repeated links and loops do no
    harm; without links there are no rows. Every shuffle is read by a task for each SHARE links, or by its partitions if these are fewer.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = written(links.distinct(), "links")
    size = links.count()

    def small(df: DataFrame) -> DataFrame:
        return few(df, 2 * size, SHARE)

    links, labels = small(links), None
    while labels is None or size:
        both = links.selectExpr("inline(array(struct(a, b), struct(b as a, a as b)))")
        step = written(small(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to"))), "hooks")
        while True:
            far = step.select(F.col("a").alias("to"), F.col("to").alias("root"))
            jumped = written(small(step.join(far, "to").select("a", "to", "root")), "hooks")
            step = jumped.select("a", F.col("root").alias("to"))
            if jumped.where("root <> to").isEmpty():
                break
        step = step.withColumnRenamed("to", "root")
        if labels is None:
            labels, nodes = step.select(F.col("a").alias("id"), F.col("root").alias("component")), 2 * size
        else:
            joined = labels.join(step, F.col("component") == F.col("a"), "left").select("id", F.coalesce("root", "component").alias("component"))
            labels = written(few(joined, nodes, SHARE), "labels")
        moved = small(links.join(step, "a").select(F.col("root").alias("a"), "b"))
        moved = small(moved.join(step.select(F.col("a").alias("b"), F.col("root").alias("to")), "b").where("a <> to"))
        links = written(small(moved.select(F.least("a", "to").alias("a"), F.greatest("a", "to").alias("b")).distinct()), "links")
        size = links.count()
    return labels
