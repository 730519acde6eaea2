"""Language of texts, by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in windows of WINDOW bytes, each by itself, in both directions. Every position gets a
probability for each language; a text's probabilities are the means over all of its positions. The network is trained
in numpy by backpropagation through time, on windows of a bounded, stratified sample of labelled documents.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm.common import checkpoint, fold_of, parts, table, texts_of, training_ids

WINDOW = 64
HIDDEN = 8
#: Bounds of the training sample: documents of each language, and windows of each document, from places all over its text.
DOCUMENTS, WINDOWS = 384, 4
#: Bytes of text that one task learns from where all texts are, windows of a step, the first step's rate, and the most that a rare language's windows weigh.
SHARD, STEP, RATE, RAREST = 8_000_000, 512, 0.002, 10.0
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether text has a character of a category of letters. Numerals such as a half, a superscript or a Roman number are none."""
    return any(map(str.isalpha, text))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Direction:
    """One gated recurrent layer: gates z (keep) and r (reset), candidate c. A byte's input row is its row of byte."""

    byte: np.ndarray  # 256 x 3H
    gates: np.ndarray  # H x 2H
    inner: np.ndarray  # H x H

    @classmethod
    def new(cls, rng: np.random.Generator, hidden: int) -> Direction:
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
        return cls(draw(256, 3 * hidden), draw(hidden, 2 * hidden), draw(hidden, hidden))


@dataclass
class Tagger:
    languages: list[str]
    ahead: Direction
    behind: Direction
    weights: np.ndarray  # 2H x languages
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.byte, self.ahead.gates, self.ahead.inner, self.behind.byte, self.behind.gates, self.behind.inner, self.weights, self.bias]

    def read(self, steps: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each of the steps (time x batch of bytes), those of behind from the last step to the first: time x 2 x H x batch; with keep, what
        backpropagation needs.

        Both directions take a step at once, and a row of numbers runs over the batch, so each call of numpy works on long rows.
        """
        time, batch = steps.shape
        hidden, both = self.ahead.inner.shape[0], (self.ahead, self.behind)
        half = np.repeat(np.array([0.5, 1], np.float32), (2 * hidden, hidden))  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        byte = [np.ascontiguousarray((one.byte * half).T) for one in both]
        gates, inner = np.stack([one.gates.T / 2 for one in both]), np.stack([one.inner.T for one in both])
        places = time if keep else 1
        gated = np.empty((places, 2, 2 * hidden, batch), np.float32)
        held, new = (np.empty((places, 2, hidden, batch), np.float32) for _ in range(2))
        x, out, at = np.empty((2, 3 * hidden, batch), np.float32), np.empty((time, 2, hidden, batch), np.float32), steps.astype(np.intp)
        state = np.zeros((2, hidden, batch), np.float32)
        for t in range(time):
            np.take(byte[0], at[t], axis=1, out=x[0], mode="clip")
            np.take(byte[1], at[time - 1 - t], axis=1, out=x[1], mode="clip")
            g, h, c = (y[t if keep else 0] for y in (gated, held, new))
            np.matmul(gates, state, out=g)
            g += x[:, : 2 * hidden]
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            np.multiply(g[:, hidden:], state, out=h)
            np.matmul(inner, h, out=c)
            c += x[:, 2 * hidden :]
            np.tanh(c, out=c)
            np.subtract(state, c, out=out[t])
            state = out[t]
            state *= g[:, :hidden]
            state += c
        return out, [gated, held, new]

    def back(self, steps: np.ndarray, states: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of byte, gates and inner of both directions, from those of the states, which are written over."""
        (gated, held, new), time, hidden = kept, len(steps), self.ahead.inner.shape[0]
        gates, inner = (np.stack([getattr(one, name) for one in (self.ahead, self.behind)]) for name in ("gates", "inner"))
        d_x = np.empty((time, 2, 3 * hidden, steps.shape[1]), np.float32)
        d_state, start = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        for t in range(time - 1, -1, -1):
            state, z, r, c, d = states[t - 1] if t else start, gated[t, :, :hidden], gated[t, :, hidden:], new[t], d_out[t]
            d_z, d_r, d_c = d_x[t, :, :hidden], d_x[t, :, hidden : 2 * hidden], d_x[t, :, 2 * hidden :]
            d += d_state
            np.multiply(d, 1 - z, out=d_z)
            np.multiply(d_z, 1 - c * c, out=d_c)
            d_z *= z
            d_z *= state - c
            d_held = inner @ d_c
            d_held *= r
            np.multiply(d_held, state, out=d_r)
            d_r *= 1 - r
            np.matmul(gates, d_x[t, :, : 2 * hidden], out=d_state)
            d_state += d_held
            d *= z
            d_state += d
        d_gates = (states[:-1] @ d_x[1:, :, : 2 * hidden].swapaxes(2, 3)).sum(axis=0)
        d_inner = (held @ d_x[:, :, 2 * hidden :].swapaxes(2, 3)).sum(axis=0)
        found = []
        for k, read in enumerate((steps, steps[::-1])):
            at = read.ravel().astype(np.intp)
            d_byte = [np.bincount(at, d_x[:, k, i].astype(np.float64).ravel(), 256) for i in range(3 * hidden)]
            found += [np.array(d_byte, np.float32).T, d_gates[k], d_inner[k]]
        return found

    def positions(self, steps: np.ndarray, keep: bool = False):
        """Probabilities of the languages at every position: time x batch x languages, in memory time x languages x batch."""
        states, kept = self.read(steps, keep)
        one, two = self.weights[: self.ahead.inner.shape[0]].T, self.weights[self.ahead.inner.shape[0] :].T
        p = one @ states[:, 0]
        p += two @ states[::-1, 1]
        p += self.bias[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return (p.swapaxes(1, 2), states, kept) if keep else p.swapaxes(1, 2)

    def gradients(self, steps: np.ndarray, real: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the real positions and its gradients; target: a language for each window."""
        p, states, kept = self.positions(steps, keep=True)
        count, hidden = max(1, int(real.sum())), self.ahead.inner.shape[0]
        picked = p[:, np.arange(steps.shape[1]), target]
        p[:, np.arange(steps.shape[1]), target] -= 1
        p *= (real / np.float32(count))[:, :, None]
        d, d_states = p.swapaxes(1, 2), np.empty_like(states)
        np.matmul(self.weights[:hidden], d, out=d_states[:, 0])
        np.matmul(self.weights[hidden:], d[::-1], out=d_states[:, 1])
        d_weights = [(states[:, 0] @ p).sum(axis=0), (states[::-1, 1] @ p).sum(axis=0)]
        return float(-(np.log(picked + 1e-9) * real).sum() / count), [*self.back(steps, states, kept, d_states), np.concatenate(d_weights), d.sum(axis=(0, 2))]

    def pooled(self, texts: list[bytes], batch: int = 2048) -> np.ndarray:
        """Mean probabilities over all positions of each text; zeros for an empty text."""
        counts = [-(-len(t) // WINDOW) for t in texts]
        sums = np.zeros((len(texts), len(self.languages)))
        if not sum(counts):
            return sums
        data = b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts, strict=True))
        windows = np.frombuffer(data, np.uint8).reshape(-1, WINDOW)
        each = np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), batch):
            steps = np.ascontiguousarray(windows[at : at + batch].T)
            each[at : at + batch] = (self.positions(steps) * (steps != 0)[:, :, None]).sum(axis=0)
        full = np.flatnonzero(counts)
        begins = np.cumsum([0, *counts])[:-1]
        sums[full] = np.add.reduceat(each.astype(np.float64), begins[full], axis=0)
        return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)


@dataclass
class Adam:
    rate: float
    first: list = field(default_factory=list)
    second: list = field(default_factory=list)
    steps: int = 0

    def step(self, parameters: list[np.ndarray], gradients: list[np.ndarray]) -> None:
        if not self.first:
            self.first, self.second = ([np.zeros_like(p) for p in parameters] for _ in range(2))
        self.steps += 1
        for p, g, m, v in zip(parameters, gradients, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-8)


def train(windows: list[bytes], languages: list[str], hidden: int = HIDDEN, steps: int = 500, batch: int = 192, seed: int = 11) -> Tagger:
    """A network trained on windows of at most WINDOW bytes and their languages."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    draw = (rng.standard_normal((2 * hidden, len(names))) / np.sqrt(hidden)).astype(np.float32)
    net = Tagger(names, Direction.new(rng, hidden), Direction.new(rng, hidden), draw, np.zeros(len(names), np.float32))
    if len(names) < 2:
        return net
    data = np.frombuffer(b"".join(w[:WINDOW].ljust(WINDOW, b"\0") for w in windows), np.uint8).reshape(-1, WINDOW)
    target = np.array([names.index(x) for x in languages])
    groups = [np.flatnonzero(target == i) for i in range(len(names))]
    adam = Adam(0.02)
    for step in range(steps):
        adam.rate = 0.02 * (1 - step / steps) + 0.001
        chosen = np.concatenate([rng.choice(g, -(-batch // len(names))) for g in groups])
        at = np.ascontiguousarray(data[chosen].T)
        _, gradients = net.gradients(at, (at != 0).astype(np.float32), target[chosen])
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
        adam.step(net.parameters(), [g * min(1.0, 1.0 / (norm + 1e-9)) for g in gradients])
    return net


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents: int = DOCUMENTS) -> Tagger | None:
    """A network for the rows of docs with id, text and language. None without any.

    Training is on a bounded sample: at most `documents` documents of each language, and WINDOWS windows of WINDOW characters of
    each, from places that a hash spreads over the whole text. Of rows that repeat an id the one with the least language
    and windows counts. Nothing depends on the order of the rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    chosen = training_ids(rows.where(F.col("text").isNotNull()).select("id", "lang"), "lang", documents)
    ranks = [r["rank"] for r in chosen.select("rank").distinct().collect()]  # documents x languages at most
    if not ranks:
        return None
    span = F.greatest(F.length("text") - WINDOW + 1, F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: F.substr("text", (F.pmod(F.xxhash64("id", i), span) + 1).cast("int"), F.lit(WINDOW)))
    picked = rows.where(F.col("lang").isNotNull() & F.xxhash64("id", F.lit(7)).isin(ranks)).select("lang", "id", F.array_sort(F.array_distinct(cut)).alias("windows"))
    picked = picked.groupBy("id").agg(F.min(F.struct("lang", "windows")).alias("row"))  # of rows that repeat an id one counts, so the sample is bounded
    found = sorted((r["row"]["lang"], r["id"], w) for r in picked.collect() for w in r["row"]["windows"] if has_letter(w))
    return train([w.encode() for *_, w in found], [lang for lang, *_ in found]) if found else None


def learn(docs: DataFrame, model: Tagger | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Tagger | None:
    """The network after it has learned from all of docs: every window of every text with an id and a language that it knows.

    Shards by a hash of the id go on from the network's parameters, each by itself and through all of its windows once, and the mean of
    their results, weighted by windows and added up in whole numbers, is returned. Languages weigh alike, up to RAREST times a window. Of rows
    that repeat an id the one with the least language and text counts. Nothing depends on the order of the rows.
    """
    if model is None or len(model.languages) < 2:
        return model
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isin(model.languages) & (F.octet_length("text") > 0))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    unit = 2.0**20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for key, lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts_of(batch.column(3)), strict=True):
                held[key] = min(held.get(key, (lang, text)), (lang, text))
        texts = [held[key] for key in sorted(held)]
        held.clear()
        if not texts:
            return
        counts = [-(-len(t) // WINDOW) for _, t in texts]
        target = np.repeat([model.languages.index(lang) for lang, _ in texts], counts)
        data = np.frombuffer(b"".join(t.ljust(n * WINDOW, b"\0") for (_, t), n in zip(texts, counts, strict=True)), np.uint8).reshape(-1, WINDOW)
        of = np.bincount(target, minlength=len(model.languages))
        weight = np.minimum(RAREST, len(target) / (np.maximum(of, 1) * (of > 0).sum())).astype(np.float32)
        net = pickle.loads(pickle.dumps(model))
        order, adam = np.random.default_rng(17).permutation(len(target)), Adam(RATE)
        for at in range(0, len(order), STEP):
            some = order[at : at + STEP]
            adam.rate = RATE * (1 - at / len(order))
            steps = np.ascontiguousarray(data[some].T)
            _, gradients = net.gradients(steps, (steps != 0) * weight[target[some]], target[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
            adam.step(net.parameters(), [g * min(1.0, 1.0 / (norm + 1e-9)) for g in gradients])
        flat = np.concatenate([p.ravel() for p in net.parameters()]).astype(np.float64)
        whole = np.rint(flat * unit).astype(np.int64) * len(target)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(whole), dtype=np.int32)), pa.array(np.concatenate(([len(target)], whole)))], ["place", "total"])

    dealt = rows.select(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(shards)).cast("int").alias("shard"), "id", "lang", "text").repartitionById(shards, F.col("shard"))
    found = dict(tuple(r) for r in dealt.mapInArrow(run, "place int, total long").groupBy("place").agg(F.sum("total").alias("total")).collect())  # a row for each parameter
    if not found:
        return model
    mean = np.array([found[i] for i in range(len(found) - 1)], np.float64) / (unit * found[-1])
    net, at = pickle.loads(pickle.dumps(model)), 0
    for p in net.parameters():
        p[...] = mean[at : at + p.size].reshape(p.shape)
        at += p.size
    return net


def predict(docs: DataFrame, model: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' <id_col> and other columns except the text, with lang_pred and score.

    A null text, or one without a letter, is `und` with score 0, as is every text if nothing could be learned. Repeated rows get equal results. Other columns are
    carried along and never read; columns lang_pred and score of docs are replaced. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tens of kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for part in parts(batch):
                text = part.column(part.num_columns - 1)
                known = [bool(net) and x.is_valid and has_letter(x.as_py()) for x in text]
                p = net.pooled(texts_of(text)) if net else np.zeros((len(text), 1))
                best = p.argmax(axis=1)
                names = [net.languages[i] if ok else UNKNOWN for i, ok in zip(best, known, strict=True)]
                score = np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    return docs.select(*kept, F.col(text_col).cast("string").alias("\x00text")).mapInArrow(run, schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold_of("doc_id", 3) != 1))
    return predict(docs.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "text"), model)


#: Documents that the pipeline keeps have a mean probability of their language at least this share of the way from chance to 1,
#: and no less than all but this share of held-out documents that were judged right.
LEAST, LOWEST = 0.3, 0.005


def smallest(scores: DataFrame, k: int) -> float:
    """The value of the column score, 0 to 1, that k others come before. Ranges that hold it are cut until one value is left; 256 rows are collected at a time."""
    low, high = 0.0, 1.0
    while low < high:
        place = F.least(F.floor((F.col("score") - low) / ((high - low) / 256)), F.lit(255))
        ranges = scores.where(F.col("score").between(low, high)).groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for r in sorted(ranges.collect(), key=lambda r: r["place"]):
            if k < r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def beyond(scores: list[float]) -> float:
    """The score that a share LOWEST of documents is below, from fewer than 1 / LOWEST scores, in order, of which the least is often too high.

    Log-odds are taken to thin out exponentially below the least one, as fast as the lowest ones, a root of their number, do. A single score tells nothing: 0.
    """
    if len(scores) < 2:
        return 0.0
    p = np.clip(scores, 1e-9, 1 - 1e-9)
    odds, k = np.log(p / (1 - p)), math.isqrt(len(p))
    return float(1 / (1 + np.exp((odds[k] - odds[:k]).mean() * -np.log(LOWEST * len(p)) - odds[0])))


def threshold(held_out: DataFrame, model: Tagger | None, least: float = LEAST, estimate: bool = False) -> float:
    """The least score of a known language, from all held-out documents (doc_id, text, lang); 0 where there is no choice of languages. With estimate, that of fewer than 1 / LOWEST documents is beyond()."""
    if model is None or len(model.languages) < 2:
        return 0.0
    chance = 1 / len(model.languages)
    rows = held_out.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    judged = predict(rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()), model)
    scores = checkpoint(judged.where("lang_pred = lang").groupBy("doc_id").agg(F.min("score").alias("score")).select("score"))
    number = scores.count()
    if estimate and LOWEST * number < 1:
        lowest = beyond(sorted(r["score"] for r in scores.collect()))
    else:
        lowest = smallest(scores, int(LOWEST * number)) if number else 0.0
    return max(chance + least * (1 - chance), lowest)


def keep_known(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs whose language is recognised, with docs' columns and values, whatever their names.

    The network learns from all labelled documents that aren't held out, after a start on fit()'s sample, and the threshold is that of all held-out ones, estimated where they are few.
    Rows with a null or empty text, or one without a letter, go; so do all if nothing can be learned. Rows with a null doc_id or
    language are judged like others. Repeated rows stay or go together. An empty table gives no rows.
    """
    training = docs.where(fold_of("doc_id", 3) != 1)
    model = learn(training, fit(training))
    lowest = threshold(docs.where(fold_of("doc_id", 3) == 1), model, least, estimate=True)
    judged = predict(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text")), model)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= lowest)).select("row.*")
