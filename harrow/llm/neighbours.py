"""Approximate nearest neighbours by learned partitions.

A graph of near neighbours on a bounded sample is cut into balanced parts with few edges between them. A small network
learns in which parts the neighbours of a vector are. It deals every row out to its most probable part, and sends every query to
several of the most probable ones, where all rows are compared exactly. How many is measured against brute force on some queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harrow.llm.cells import cells_for, matrix, sample, unit, usable, within_cells
from harrow.llm.common import checkpoint, table
from harrow.llm.language import Adam

#: Vectors that the parts are learned on (at least EACH for each part), and queries that the number of probed parts is chosen on.
SAMPLE, EACH, TRIALS = 8192, 32, 128
#: Recall on those queries for which parts are probed.
RECALL = 0.96


def neighbour_graph(x: np.ndarray, k: int = 10) -> np.ndarray:
    """The k nearest other rows of each row of x, by cosine."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for at in range(0, len(x), 1024):
        near = x[at : at + 1024] @ x.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -2
        out[at : at + 1024] = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, turns: int = 15, slack: float = 1.1, seed: int = 8) -> np.ndarray:
    """A part for each node, of at most slack times the mean size: nodes move to the part of most of their neighbours while it has room."""
    rng = np.random.default_rng(seed)
    room = int(np.ceil(slack * len(x) / parts))
    seeds = x[rng.choice(len(x), parts, replace=False)]
    part, sizes = np.full(len(x), -1), np.zeros(parts, np.int64)
    near = x @ seeds.T
    for node in np.argsort(-near.max(axis=1)):
        for p in np.argsort(-near[node]):
            if sizes[p] < room:
                part[node], sizes[p] = p, sizes[p] + 1
                break
    back = [[] for _ in range(len(x))]
    for node, others in enumerate(graph.tolist()):
        for o in others:
            back[o].append(node)
    around = [np.array(list(a) + b) for a, b in zip(graph.tolist(), back, strict=True)]
    for _ in range(turns):
        moved = 0
        for node in rng.permutation(len(x)):
            votes = np.bincount(part[around[node]], minlength=parts)
            best = int(np.where(sizes < room, votes, -1).argmax())
            if votes[best] > votes[part[node]]:
                sizes[part[node]] -= 1
                sizes[best] += 1
                part[node] = best
                moved += 1
        if moved < len(x) // 200:
            break
    return part


@dataclass
class Router:
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.hidden, self.hidden_bias, self.out, self.out_bias]

    def logits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state = np.tanh(x @ self.hidden + self.hidden_bias)
        return state @ self.out + self.out_bias, state


def train(x: np.ndarray, target: np.ndarray, units: int = 128, steps: int = 600, batch: int = 512, seed: int = 4) -> Router:
    """A network from vectors to distributions over parts."""
    rng = np.random.default_rng(seed)
    draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
    net = Router(draw(x.shape[1], units) * np.float32(np.sqrt(x.shape[1])), np.zeros(units, np.float32), draw(units, target.shape[1]), np.zeros(target.shape[1], np.float32))
    x, target, adam = x.astype(np.float32), target.astype(np.float32), Adam(0.01)
    for step in range(steps):
        adam.rate = 0.01 * (1 - step / steps) + 0.0005
        some = rng.integers(0, len(x), min(batch, len(x)))
        logits, state = net.logits(x[some])
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - target[some]) / np.float32(len(some))
        d_state = (d @ net.out.T) * (1 - state * state)
        adam.step(net.parameters(), [x[some].T @ d_state, d_state.sum(axis=0), state.T @ d, d.sum(axis=0)])
    return net


def learn(x: np.ndarray, parts: int) -> Router:
    graph = neighbour_graph(x)
    part = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    for column in [part, *graph.T]:
        target[np.arange(len(x)), part[column] if column is not part else part] += 1
    return train(x, target / target.sum(axis=1, keepdims=True))


def best_of(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k nearest rows of each query other than itself: query_id, vec_id, score; ties to the smaller id."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if queries.num_rows and rows.num_rows:
        q, y = unit(matrix(queries.column("vec"))), unit(matrix(rows.column("vec")))
        q_ids, ids = queries.column("id").to_numpy(), rows.column("id").to_numpy()
        for at in range(0, len(q), 256):
            near = q[at : at + 256] @ y.T
            for i, line in enumerate(near):
                line[ids == q_ids[at + i]] = -2
                kth = np.partition(line, -k)[-k] if len(line) > k else -1.5
                near_ones = np.flatnonzero(line >= max(kth - 1e-9, -1.5))
                exact = (y[near_ones] * q[at + i]).sum(axis=1)  # row by row, so that equal vectors score equally in any block
                order = np.lexsort((ids[near_ones], -exact))[:k]
                out["query_id"].append(np.full(len(order), q_ids[at + i]))
                out["vec_id"].append(ids[near_ones][order])
                out["score"].append(exact[order])
    kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
    return pa.table({c: np.concatenate(x) if x else np.empty(0, kinds[c]) for c, x in out.items()})


FOUND = "query_id long, vec_id long, score double"


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query of what several blocks found; rank counts from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(queries: pa.Table, rows: DataFrame, k: int) -> DataFrame:
    """The exact answer for a bounded table of queries (id, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from best_of(queries, pa.Table.from_batches([batch]), k).to_batches()

    return merged(rows.select("id", "vec").mapInArrow(run, FOUND), k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors found for each row of queries, by cosine in double precision, a query's own id left out.

    Rows with a null id, or with a vector that is null, all 0, has null or non-finite components or another than the most
    common length take no part on either side. Ties go to the smaller id; of rows that repeat an id the one with the least vector counts.
    Other columns are not read. With fewer than k candidates all are given; empty tables give no rows. There are cells_for() parts, learned on a
    sample of SAMPLE vectors, or EACH for each part if that is more; every row of vectors is in exactly one part.
    """
    rows = checkpoint(usable(vectors, id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec")))
    asked = usable(queries, id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec"))
    asked = checkpoint(asked.where(F.size("vec") == F.size(F.lit(rows.select("vec").first()["vec"])) if not rows.isEmpty() else F.lit(False)))
    number = rows.count()
    parts = cells_for(number)
    net = learn(sample(rows, max(SAMPLE, EACH * parts)), parts) if parts > 1 else None

    def routes(x: np.ndarray, many: int) -> np.ndarray:
        """The most probable parts of each vector, most probable first."""
        if net is None:
            return np.zeros((len(x), 1), np.int32)
        return np.argsort(-net.logits(unit(x).astype(np.float32))[0], axis=1, kind="stable")[:, :many].astype(np.int32)

    def dealt(frame: DataFrame, many: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell = routes(matrix(batch.column(1)), many)
                    for column in cell.T:
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(column)), batch.column(0), pa.array(np.ones(batch.num_rows, np.int64)), batch.column(1)], ["cell", "id", "weight", "vec"])

        return frame.select("id", "vec").mapInArrow(run, "cell int, id long, weight long, vec array<double>")

    probes = parts
    homes = checkpoint(dealt(rows, 1))
    if parts > 1:
        ranks = [r[0] for r in asked.select(F.xxhash64("id", F.lit(9)).alias("r")).orderBy("r").limit(TRIALS).collect()]
        trial = asked.where(F.xxhash64("id", F.lit(9)).isin(ranks)).orderBy("id").limit(TRIALS).toArrow() if ranks else None
        if trial is not None and trial.num_rows:
            true = brute_force(trial, rows, k)
            where = true.join(homes.select(F.col("id").alias("vec_id"), "cell"), "vec_id").select("query_id", "cell").collect()
            places = {q: {p: i for i, p in enumerate(order.tolist())} for q, order in zip(trial.column("id").to_pylist(), routes(matrix(trial.column("vec")), parts), strict=True)}
            depth = np.sort([places[r["query_id"]][r["cell"]] for r in where])
            probes = int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) + 1
        sizes = {r["cell"]: r["count"] for r in homes.groupBy("cell").count().collect()}  # a row for each part
        least = np.cumsum(sorted(sizes.get(p, 0) for p in range(parts)))
        probes = max(probes, min(parts, int(np.searchsorted(least, k + 1)) + 1))  # enough for k neighbours, whichever parts they are
    found = within_cells(dealt(asked, probes), homes, lambda q, y: best_of(q, y, k), FOUND)
    return merged(found, k)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
