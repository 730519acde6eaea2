"""Quality of texts: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities.

Every word has a fixed sparse index vector. A word's context vector is the sum of the index vectors of its neighbours over
the whole corpus; words meet in a table of fixed size by their hash, so words that share a row share a vector, more of them
the larger the corpus (the README has the measured loss). A document's features are the mean and spread of
its words' context vectors. A network on top is trained in numpy and its temperature fitted on rows kept aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm.common import fold_of, parts, table, texts_of, tokens_of, training_ids
from harrow.llm.language import Adam, sigmoid

ROWS, WIDTH, TERNARY = 1 << 13, 32, 4
BLOCK = 256  # rows of the table that are summed as one
#: Bound of the training sample: documents of each label.
DOCUMENTS = 3000
THRESHOLD = 0.7

#: Runs of letters and digits, and runs of any other one byte class, are tokens; white space separates.
CLASSES = np.full(256, 2, np.uint8)
CLASSES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
CLASSES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
REPEATED = 1  # the row for a token that is the same as the one before it


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the TERNARY entries of each row's index vector."""
    rng = np.random.default_rng(97)
    return rng.integers(0, WIDTH, (ROWS, TERNARY)), rng.choice(np.array([-1.0, 1.0]), (ROWS, TERNARY))


def word_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words of texts, and for each text where its words begin (and the total at the end)."""
    hashes, begins = tokens_of(texts, CLASSES)
    rows = (hashes >> np.uint64(64 - ROWS.bit_length() + 1)).astype(np.int64)
    same = hashes[1:] == hashes[:-1]
    inner = begins[1:-1]
    same[inner[(inner > 0) & (inner < len(rows))] - 1] = False  # not over the border of two texts
    rows[1:][same] = REPEATED
    return rows, begins


def context_sums(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """The context vectors of all rows of the table, as whole numbers, over all texts of docs; and the number of words.

    Each task adds up its own table; the blocks of all tables are summed by block. What comes to the driver is one table,
    2 MB at any size of the input.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        sums, count = np.zeros(ROWS * WIDTH), 0
        for batch in batches:
            for part in parts(batch, 2048):
                rows, begins = word_rows(texts_of(part.column(0)))
                count += len(rows)
                joined = np.ones(max(0, len(rows) - 1), bool)
                inner = begins[1:-1]
                joined[inner[(inner > 0) & (inner < len(rows))] - 1] = False
                left, right = rows[:-1][joined], rows[1:][joined]
                for a, b in ((left, right), (right, left)):
                    for j in range(TERNARY):
                        sums += np.bincount(a * WIDTH + places[b, j], signs[b, j], ROWS * WIDTH)
        blocks = sums.astype(np.int64).reshape(-1, BLOCK * WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary()), pa.array([count] + [0] * (len(blocks) - 1), pa.int64())], ["block", "sums", "words"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for block, data, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = total.setdefault(block, [np.zeros(BLOCK * WIDTH, np.int64), 0])
                held[0] += np.frombuffer(data, np.int64)
                held[1] += words
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x, _ in total.values()], pa.binary()), pa.array([n for _, n in total.values()], pa.int64())], ["block", "sums", "words"])

    schema = "block int, sums binary, words long"
    blocks = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(gather, schema).repartition("block").mapInArrow(add, schema).collect()
    out, words = np.zeros((ROWS // BLOCK, BLOCK * WIDTH)), 0
    for r in blocks:
        out[r["block"]] = np.frombuffer(r["sums"], np.int64)
        words += r["words"]
    return out.reshape(ROWS, WIDTH), words


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context vectors of length 1, less what all words have in common; unseen words have none."""
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)
    seen = length[:, 0] > 0
    if seen.any():
        unit[seen] -= unit[seen].mean(axis=0)
    return unit.astype(np.float32)


def features(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and the logarithm of its number of words; 0 for an empty text."""
    rows, begins = word_rows(texts)
    count = np.diff(begins)
    out = np.zeros((len(texts), 2 * WIDTH + 1), np.float32)
    full = np.flatnonzero(count)
    if len(full):
        picked = vectors[rows]
        mean = np.add.reduceat(picked, begins[full], axis=0) / count[full, None]
        square = np.add.reduceat(picked * picked, begins[full], axis=0) / count[full, None]
        out[full, :WIDTH] = mean
        out[full, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[full, -1] = np.log(count[full]) / 10
    return out


@dataclass
class Scorer:
    shift: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    temperature: float = 1.0

    def parameters(self) -> list[np.ndarray]:
        return [self.hidden, self.hidden_bias, self.out, self.out_bias]

    def logits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state = np.tanh(((x - self.shift) / self.scale) @ self.hidden + self.hidden_bias)
        return (state @ self.out + self.out_bias)[:, 0], state

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x)[0].astype(np.float64) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, units: int = 24, steps: int = 400, seed: int = 5) -> Scorer:
    """A network for features x and labels y (0 or 1); every fifth row is kept aside to fit the temperature. weight: rows that each row stands for."""
    rng = np.random.default_rng(seed)
    y, weight = y.astype(np.float32), (weight / weight.mean()).astype(np.float32)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    net = Scorer(x.mean(axis=0), x.std(axis=0) + 1e-3, draw(x.shape[1], units), np.zeros(units, np.float32), draw(units, 1), np.zeros(1, np.float32))
    aside = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
    a, b, w, adam = x[~aside], y[~aside], weight[~aside], Adam(0.01)
    inputs = ((a - net.shift) / net.scale).astype(np.float32)
    for step in range(steps):
        adam.rate = 0.01 * (1 - step / steps) + 0.0005
        chosen = slice(None) if len(a) <= 2048 else rng.integers(0, len(a), 2048)
        logits, state = net.logits(a[chosen])
        d = ((sigmoid(logits) - b[chosen]) * w[chosen] / len(logits)).astype(np.float32)[:, None]
        d_state = (d @ net.out.T) * (1 - state * state)
        gradients = [inputs[chosen].T @ d_state + 1e-4 * net.hidden, d_state.sum(axis=0), state.T @ d + 1e-4 * net.out, d.sum(axis=0)]
        adam.step(net.parameters(), [g.astype(np.float32) for g in gradients])
    if aside.any():
        logits = net.logits(x[aside])[0].astype(np.float64)
        trials = np.geomspace(0.25, 8, 61)
        loss = [(weight[aside] * (np.logaddexp(0, logits / t) - y[aside] * logits / t)).mean() for t in trials]
        net.temperature = float(trials[int(np.argmin(loss))])
    return net


@dataclass
class Model:
    vectors: np.ndarray
    scorer: Scorer | None  # None: too few labels to learn from
    prior: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.scorer.score(features(texts, self.vectors)) if self.scorer else np.full(len(texts), self.prior)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", documents: int = DOCUMENTS) -> Model:
    """Word vectors from all texts of docs, and a network from labels (of at most `documents` documents of each label).

    Null ids and null labels are left out; a document with several labels counts as 1 if any of them is. With fewer than
    two labels to learn from, every score is the share of label 1 (0.5 without any).
    """
    vectors = word_vectors(context_sums(docs, text_col)[0])
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    rows = training_ids(known, "label", documents).collect()  # 2 x documents at most
    stood = {r["rank"]: (r["label"], r["n"]) for r in rows}
    ones, total = sum(r["n"] for r in rows if r["label"] == 1), sum(r["n"] for r in rows)
    prior = ones / total if total else 0.5
    if not 0 < ones < total:
        return Model(vectors, None, prior)
    picked = docs.select(F.xxhash64(id_col, F.lit(7)).alias("rank"), F.col(text_col).cast("string").alias("text")).where(F.col("rank").isin(list(stood)))
    picked = picked.groupBy("rank").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))  # of rows that repeat an id one counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                found = features(texts_of(part.column(1)), vectors)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in found], pa.binary())], ["rank", "features"])

    found = {r["rank"]: r["features"] for r in picked.mapInArrow(run, "rank long, features binary").collect()}
    ranks = sorted(found)
    if len({stood[r][0] for r in ranks}) < 2:
        return Model(vectors, None, prior)
    x = np.stack([np.frombuffer(found[r], np.float32) for r in ranks])
    return Model(vectors, train(x, np.array([stood[r][0] for r in ranks]), np.array([float(stood[r][1]) for r in ranks])), prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the text, with score and predicted (1 if score >= threshold).

    Null texts count as empty, and empty ones get the score that the network gives to no words. Repeated rows get equal scores; other columns are carried
    along and never read; columns score and predicted of docs are replaced. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB at any size of the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                s = shared.value.score(texts_of(part.column(part.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    return docs.select(*kept, F.col(text_col).cast("string").alias("\x00text")).mapInArrow(run, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(fold_of("doc_id", 4) != 2))
    return score(docs.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "text"), model)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with docs' columns and values, whatever their names.

    Null texts count as empty and are judged by the score of no words; rows with a null doc_id are judged like others. Repeated rows
    stay or go together. Without labels of both kinds every row has the share of label 1 for its score. An empty table gives no rows.
    """
    model = fit(docs, labels.where(fold_of("doc_id", 4) != 2))
    judged = score(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text")), model, threshold=threshold)
    return judged.where(F.col("predicted") == 1).select("row.*")
