"""Vectors dealt out to cells, and products of blocks of vectors within cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import checkpoint, training_ids

#: Vectors of a block; a cell with more of them is cut into several blocks, whatever the reason.
ROWS = 4096


def cells_for(number: int) -> int:
    """Cells for so many vectors, an eighth of the root: 3 for 500, 125 for a million. Dealing out and comparing then grow alike."""
    return max(1, round(number**0.5 / 8))


def split(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(id, vec) of the rows with an id and a vector of finite components, not all 0, of the most common length (of several, the least); (id) of all others; that length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = F.coalesce(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    lengths = rows.where(sound).groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    length = lengths[0]["length"] if lengths else 0
    sound = sound & (F.coalesce(F.size("vec"), F.lit(-1)) == length)
    return rows.where(sound), rows.where(~sound).select("id"), length


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows whose vectors can be compared."""
    return split(vectors, id_col, vec_col)[0]


def matrix(column) -> np.ndarray:
    """The rows of an Arrow column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sample(rows: DataFrame, bound: int) -> np.ndarray:
    """Unit vectors of at most `bound` rows (id, vec), chosen by hashes of their ids."""
    chosen = training_ids(rows.select("id", F.lit(0).alias("all")), "all", bound).collect()
    found = rows.where(F.xxhash64("id", F.lit(7)).isin([r["rank"] for r in chosen])) if chosen else rows.limit(0)
    found = found.dropDuplicates(["id"]).orderBy("id").toArrow()
    return unit(matrix(found.column("vec"))) if found.num_rows else np.empty((0, 0))


def within_cells(left: DataFrame, right: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], schema: str, rows: int = ROWS) -> DataFrame:
    """function applied to each pair of blocks of left and right (cell, id, weight, vec) of the same cell.

    Every row of left meets every row of right in its cell exactly once. Cells are cut into blocks of about `rows` rows by a
    hash of the id, so no task holds more than two blocks, however large a cell is. The table of block counts has a row for each cell.
    """
    both = checkpoint(left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))))
    count = lambda side: F.greatest(F.ceil(F.sum((F.col("side") == side).cast("long")) / rows), F.lit(1)).cast("int")
    counts = F.broadcast(both.groupBy("cell").agg(count(0).alias("lefts"), count(1).alias("rights")))
    both = both.join(counts, "cell").withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.when(F.col("side") == 0, F.col("lefts")).otherwise(F.col("rights"))).cast("int"))
    across = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("rights")).otherwise(F.col("lefts")) - 1))
    both = both.withColumn("across", across)
    l, r = (F.when(F.col("side") == 0, F.col(x)).otherwise(F.col(y)) for x, y in (("own", "across"), ("across", "own")))
    both = both.select("cell", l.alias("l"), r.alias("r"), "side", "id", "weight", "vec")
    names = [field.split()[0] for field in schema.split(", ")]

    def run(block: pa.Table) -> pa.Table:
        side = block.column("side").to_numpy()
        return function(block.filter(pa.array(side == 0)), block.filter(pa.array(side == 1))).select(names)

    return both.groupBy("cell", "l", "r").applyInArrow(run, schema)
