"""Near duplicates among vectors: spherical k-means deals vectors out to cells, whose blocks are compared by cosine.

A vector lives in the cell of its nearest centroid, and is compared with the vectors of all cells where one that is similar enough
could live: if x and y are unit vectors at a distance of e at most and y lives in h, then x (c - h) <= e |c - h| for the
centroid c of x, as y (c - h) <= 0. So no link is missed, whatever the centroids. Each vector is moved and written once: blocks of a
cell meet others in a product of tables, which reads them again and writes nothing, so disk grows with the rows, not with the visits.
Within two blocks a few coordinates of an orthonormal basis come first: vectors that are too far apart in these are too far apart.
Equal vectors of a block are one row with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.cells import ROWS, cells_for, matrix, sample, split, unit
from harrow.llm.common import LEAST_TASKS, few, mix, table, written
from harrow.llm.components import components

LEAST = 0.95
#: Vectors that centroids are fitted on: so many, and at least EACH for each centroid.
SAMPLE, EACH = 16_384, 8
#: Vectors that a task packs into blocks, and those of each side that a task compares.
PACKED, SIDE = 1 << 16, 1 << 18
#: Rows of a block that are compared at a time, and the share of pairs that the first coordinates may leave.
TILE, PASS = 512, 1e-3


def spherical_k_means(x: np.ndarray, k: int, turns: int = 12, seed: int = 3) -> np.ndarray:
    """k unit centroids of the unit vectors x; a centroid that loses all vectors moves to the vector worst served."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(turns):
        near = x @ centroids.T
        home = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        lost = np.flatnonzero(np.sqrt((sums * sums).sum(axis=1)) < 1e-9)
        if len(lost):
            sums[lost] = x[near.max(axis=1).argsort()[: len(lost)]]
        centroids = unit(sums)
    return centroids


def local_roots(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The smallest node reachable from each of `size` nodes over the links a-b."""
    root = np.arange(size)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def basis_of(x: np.ndarray, far: float) -> tuple[np.ndarray, int]:
    """An orthonormal basis, the directions of most variance in x first, and how many of them tell nearly all pairs of x apart that are further than far."""
    basis = np.linalg.svd(x.T @ x)[0]
    some = x[:: max(1, len(x) // 1024)][:1024] @ basis
    for m in range(8, x.shape[1], 8):
        y = some[:, :m]
        norms = (y * y).sum(axis=1)
        if ((norms[:, None] + norms - 2 * y @ y.T) <= far * far).mean() <= PASS + 2 / len(some):
            return basis, m
    return basis, x.shape[1]


def near_pairs(x: np.ndarray, y: np.ndarray, basis: np.ndarray, m: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i of x and j of y, unit vectors, with a cosine of least or more in double precision, some of them at a time.

    In single precision the first m coordinates in the basis rule out pairs that are too far apart in them, with room for rounding.
    """
    p, q = x @ basis[:, :m], y @ basis[:, :m]
    half = lambda z: (z * z).sum(axis=1, keepdims=True) / 2
    a = np.concatenate((p, -half(p), np.ones((len(p), 1))), axis=1).astype(np.float32)
    b = np.ascontiguousarray(np.concatenate((q, np.ones((len(q), 1)), -half(q)), axis=1).astype(np.float32).T)
    for at in range(0, len(x), TILE):
        hits = np.flatnonzero(a[at : at + TILE] @ b >= np.float32(least - 1 - 1e-4))  # minus half the squared distance
        if len(hits) * 16 > TILE * len(y):
            i, j = np.nonzero(x[at : at + TILE] @ y.T >= least)
            yield i + at, j
            continue
        for some in (hits[k : k + 65_536] for k in range(0, len(hits), 65_536)):
            i, j = np.divmod(some, len(y))
            good = np.einsum("ij,ij->i", x[i + at], y[j]) >= least
            yield i[good] + at, j[good]


def near_groups(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each row of vectors: <id_col>, n_links, component_id, kept.

    Rows link whose vectors have a cosine of `least` or more, in double precision. Rows with a null id, a vector that is
    null, all 0, or has null or non-finite components, or another than the most common length link with nothing and are
    kept. Rows that repeat an id count each for itself; equal cosines need no order. Other columns are not read. An empty table gives no rows.
    There are cells_for() cells; centroids are fitted on a sample of SAMPLE vectors, or EACH for each cell if that is more, and every vector is dealt out.
    """
    rows, others, length = split(vectors, id_col, vec_col)
    alone = others.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    number = rows.count()
    full = alone.unionByName(_groups(rows, number, length, least)) if number else alone
    return full.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _groups(rows: DataFrame, number: int, length: int, least: float) -> DataFrame:
    """id, n_links, component_id of rows (id, vec), `number` of them, whose vectors are usable and have this length."""
    k = cells_for(number)
    sampled = sample(rows, max(SAMPLE, EACH * k))
    centroids = spherical_k_means(sampled, k)
    k, margin = len(centroids), np.sqrt(max(0.0, 2 - 2 * least))
    apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
    basis, m = basis_of(sampled, margin)
    factors = np.random.default_rng(length).integers(1, 1 << 62, length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, n = np.unique((unit(matrix(batch.column(1))) @ centroids.T).argmax(axis=1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n)], ["cell", "n"])

    sizes = np.zeros(k, np.int64)  # a row for each cell
    for r in rows.mapInArrow(homes, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sizes[r["cell"]] = r["n"]
    pieces = np.maximum(1, -(-sizes // ROWS))
    first = np.concatenate(([0], np.cumsum(pieces)))
    tasks = min(int(first[-1]), max(LEAST_TASKS, -(-number // PACKED)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal vectors of a batch once, with all of their ids; in single precision where that is exact."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = matrix(batch.column(1)) + 0.0, batch.column(0).to_numpy()
            order = np.lexsort((ids, mark := mix((x.view(np.uint64) * factors).sum(axis=1, dtype=np.uint64))))
            x, ids, mark = x[order], ids[order], mark[order]
            begins = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1))))
            x, mark = x[begins], mark[begins]
            cell = (unit(x) @ centroids.T).argmax(axis=1)
            block = first[cell] + (mark % pieces[cell].astype(np.uint64)).astype(np.int64)
            with np.errstate(over="ignore"):
                single = x.astype(np.float32)
            exact = (single == x).all(axis=1)
            vecs = [s.tobytes() if e else d.tobytes() for s, d, e in zip(single, x, exact, strict=True)]
            held = [ids[a:b].tobytes() for a, b in zip(begins, [*begins[1:], len(ids)], strict=True)]
            part = (mix(block.astype(np.uint64)) % np.uint64(tasks)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(block), pa.array(cell.astype(np.int32)), pa.array(held, pa.binary()), pa.array(vecs, pa.binary())], ["part", "block", "cell", "ids", "vec"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for block, cell, ids, vec in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                held.setdefault((block, cell), []).append((vec, ids))
        for block, cell in sorted(held):
            equal: dict = {}
            for vec, ids in held.pop((block, cell)):
                equal.setdefault(vec, []).append(ids)
            members = [np.sort(np.frombuffer(b"".join(ids), np.int64)) for ids in equal.values()]
            single = all(len(vec) == 4 * length for vec in equal)
            x = np.stack([np.frombuffer(vec, np.float32 if len(vec) == 4 * length else np.float64).astype(np.float64) for vec in equal])
            near = unit(x) @ centroids.T
            visits = (near[:, [cell]] - near <= margin * apart[cell] + 1e-9).any(axis=0)
            names, weights = np.array([ids[0] for ids in members], np.int64), np.array([len(ids) for ids in members], np.int64)
            blobs = [x.astype(np.float32 if single else np.float64), names, weights, np.concatenate(members)]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([cell], pa.int32()), pa.array([visits.tolist()], pa.list_(pa.bool_())), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], ["block", "cell", "visits", "vecs", "names", "weights", "members"])

    dealt = rows.mapInArrow(deal, "part int, block long, cell int, ids binary, vec binary").repartitionById(tasks, F.col("part"))
    blocks = written(dealt.mapInArrow(pack, "block long, cell int, visits array<boolean>, vecs binary, names binary, weights binary, members binary"), "blocks")

    def read(vecs: bytes, names: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names = np.frombuffer(names, np.int64)
        x = np.frombuffer(vecs, np.float32 if len(vecs) == 4 * length * len(names) else np.float64)
        return unit(x.astype(np.float64).reshape(-1, length)), names, np.frombuffer(weights, np.int64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, ends, tops, last, left = {}, [], [], None, None
        for batch in batches:
            for at in range(batch.num_rows):
                block, cell, *blobs, block2, cell2 = (batch.column(c)[at].as_py() for c in range(7))
                if block != last:
                    last, left = block, read(*blobs)
                x, a, weight = left
                y, b, weight2 = left if block == block2 else read(*(batch.column(c)[at].as_py() for c in range(7, 10)))
                some, some2 = np.arange(len(a)), np.arange(len(b))
                if cell != cell2:
                    some = np.flatnonzero(x @ (centroids[cell] - centroids[cell2]) <= margin * apart[cell, cell2] + 1e-9)
                    some2 = np.flatnonzero(y @ (centroids[cell2] - centroids[cell]) <= margin * apart[cell, cell2] + 1e-9)
                for i, j in near_pairs(x[some], y[some2], basis, m, least):
                    i, j = some[i], some2[j]
                    use = a[i] != b[j]
                    if block == block2:
                        use &= i < j
                    i, j = i[use], j[use]
                    if len(i):
                        for own, of, rows_of, other in ((block, i, a, weight2[j]), (block2, j, b, weight[i])):
                            total = links.setdefault(own, (rows_of, np.zeros(len(rows_of), np.int64)))[1]
                            np.add.at(total, of, other)
                        every, both = np.unique(np.concatenate((a[i], b[j])), return_inverse=True)
                        root = local_roots(both[: len(i)], both[len(i) :], len(every))
                        moved = np.flatnonzero(root != np.arange(len(every)))
                        ends.append(every[moved])
                        tops.append(every[root[moved]])
        if not links:
            return
        pairs = np.unique(np.stack((np.concatenate(ends), np.concatenate(tops)), axis=1), axis=0)
        every, both = np.unique(pairs, return_inverse=True)
        both = both.reshape(-1, 2)
        root = local_roots(both[:, 0], both[:, 1], len(every))
        moved = np.flatnonzero(root != np.arange(len(every)))
        ids, totals = (np.concatenate(x) for x in zip(*links.values(), strict=True))
        linked = totals > 0
        none, blank = np.zeros(len(moved), np.int64), np.zeros(int(linked.sum()), np.int64)
        other = pa.array(np.concatenate((blank, every[root[moved]])), mask=np.concatenate((blank == 0, none == 1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids[linked], every[moved]))), pa.array(np.concatenate((totals[linked], none))), other], ["id", "links", "other"])

    sides = few(blocks.select("block", "cell", "vecs", "names", "weights", "visits"), number, SIDE)
    l, r = sides.alias("l"), sides.alias("r").hint("shuffle_replicate_nl")
    once = ((F.col("l.block") + F.col("r.block")) % 2 == 0) == (F.col("l.block") <= F.col("r.block"))  # each two blocks in one order, as many in either
    meet = F.get("l.visits", F.col("r.cell")) & F.get("r.visits", F.col("l.cell"))
    met = l.join(r, once & meet).select(*(f"l.{c}" for c in ("block", "cell", "vecs", "names", "weights")), *(f"r.{c}" for c in ("block", "cell", "vecs", "names", "weights")))
    met = met.toDF("block", "cell", "vecs", "names", "weights", "block2", "cell2", "vecs2", "names2", "weights2")
    found = written(met.mapInArrow(compare, "id long, links long, other long"), "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links")).where("links > 0")
    groups = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, weights, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                weights = np.frombuffer(weights, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(members, np.int64)), pa.array(np.repeat(np.frombuffer(names, np.int64), weights)), pa.array(np.repeat(weights, weights))], ["id", "name", "weight"])

    members = blocks.select("names", "weights", "members").mapInArrow(unpack, "id long, name long, weight long")
    named = written(links.join(groups, "id", "left").select(F.col("id").alias("name"), "links", "component"), "named")
    full = members.join(named, "name", "left")
    return full.select("id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "name").alias("component_id"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: Cosines and links of all pairs, then the smallest vec_id that links reach.
OP5_SQL = f"""
with recursive v as (
  select vec_id, cast(embedding as double[]) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= {LEAST}
), reach(id, far) as (
  select a, a from links union select r.id, l.b from reach r join links l on l.a = r.far
)
select e.vec_id, cast(coalesce(n, 0) as bigint) n_links, coalesce(c, e.vec_id) component_id, coalesce(c, e.vec_id) = e.vec_id kept
from embeddings e left join (select a, count(*) n from links group by a) l on e.vec_id = l.a left join (select id, min(far) c from reach group by id) r on e.vec_id = r.id
"""
