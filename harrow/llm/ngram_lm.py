"""Scores of texts under an n-gram model, kept as an Elias-Fano trie in shards.

Model, for a word w after the words ... v u (three-grams by default): N(w) = M P(w) with P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)) over the
training tokens, N(u w) = c(u w) + N(w), N(v u w) = c(v u w) + K N(u w), and so on; P(w | v u) = N(v u w) / D(v u), where D, the same
sum over all w, is M, D(u) = c(u) + M, D(v u) = c(v u) + K D(u). So counts of longer contexts outweigh those of shorter ones, and all sums to 1.
The numerator depends on w and on the n-grams that end in w, the denominator on the context's last word and those that end in
it, so a shard that has all tokens w of some words can do its part of every text. The trie goes from a word back to the words before it: level
1 holds the words, each further level for each entry of the one above the words before it, with monotone pointers between them. All levels
are Elias-Fano sequences; an entry below the first is looked up by a search for the successor within the range of its parent. The
logarithms of N and D are kept quantised with each entry.

1. Counts of all words give N, V, the number of shards, and the words so frequent that one shard would be too much for them;
   of the n-grams that end in such words those are counted that are too frequent themselves.
2. Each task packs the tokens of its texts by shard, as a small trie of its own. A shard merges these into its trie and looks up all tokens.
3. The parts of each text's score return to its chunk and are added up.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm.common import fold_of, mix, parts, shards, table, texts_of, tokens_of

#: Longest n-grams; weight of the one-word model, as a number of tokens; weight of the model one word shorter from the third word on.
ORDER, PRIOR, SHORTER = 3, 1000.0, 0.005
#: Bits by which the word before is known within the range of its parent: at level 2, and at the levels below.
BITS, MORE_BITS = 40, 24
#: Tokens that a task packs together, and texts (an index has 15 bits and one for training).
PACKED, TEXTS = 2_000_000, 32_000
#: Mean tokens of a shard, most shards of a task, and most n-grams of a length that are counted as hot (16 bytes each, broadcast).
SHARD, SHARDS, HOT = 1_000_000, 32, 1 << 20
END, START = np.uint64(0x0E17), np.uint64(0x57A7)
LEVELS = 65_535


class Layout:
    """Arrays of several kinds laid out in one buffer, anonymous memory-mapped or a mapped file."""

    def __init__(self, arrays: dict[str, np.ndarray], path: str | None = None):
        places, size = {}, 0
        for name, a in arrays.items():
            places[name] = (size, a.dtype, len(a))
            size += -(-a.nbytes // 8) * 8
        if path:
            with open(path, "w+b") as file:
                file.truncate(max(size, 8))
                self.map = mmap.mmap(file.fileno(), max(size, 8))
        else:
            self.map = mmap.mmap(-1, max(size, 8))
        self.arrays = {name: np.frombuffer(self.map, dtype, n, at) for name, (at, dtype, n) in places.items()}
        for name, a in arrays.items():
            self.arrays[name][:] = a


@dataclass
class EliasFano:
    """A sequence of numbers in ascending order: low bits packed, high bits in unary. All questions are answered for many at once."""

    n: int
    low_bits: int
    low: np.ndarray  # packed low bits, uint64
    high: np.ndarray  # bit high(i) + i is set for the i-th number, uint64
    zeros: np.ndarray  # zeros of high before each of its words

    @classmethod
    def arrays(cls, values: np.ndarray, universe: int) -> tuple[int, dict[str, np.ndarray]]:
        n = len(values)
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        width = np.uint64(low_bits)
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits and n:
            part = values & ((np.uint64(1) << width) - np.uint64(1))
            bit = np.arange(n, dtype=np.uint64) * width
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            np.add.at(low, word, part << shift)  # no two numbers share a bit
            over = np.flatnonzero(shift + width > 64)
            np.add.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> width).astype(np.int64) + np.arange(n)
        top = int(universe >> low_bits) + n + 2
        high = np.zeros(-(-top // 64) + 1, np.uint64)
        np.add.at(high, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        zeros = np.zeros(len(high) + 1, np.int64)
        np.cumsum(64 - np.bitwise_count(high).astype(np.int64), out=zeros[1:])
        return low_bits, {"low": low, "high": high, "zeros": zeros.astype(np.uint32) if zeros[-1] < 1 << 32 else zeros}

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of high, from 0; -1 for k = -1."""
        word = np.searchsorted(self.zeros, np.maximum(k, 0), side="right") - 1
        bits, left = ~self.high[word], np.maximum(k, 0) - self.zeros[word]
        place = np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # halve the word around the zero wanted
            mask = np.uint64((1 << half) - 1)
            count = np.bitwise_count(bits & mask).astype(np.int64)
            up = left >= count
            left = np.where(up, left - count, left)
            bits = np.where(up, bits >> np.uint64(half), bits & mask)
            place += np.where(up, half, 0)
        return np.where(k < 0, -1, word.astype(np.int64) * 64 + place)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        value = self.low[word] >> shift
        value |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return value & ((np.uint64(1) << np.uint64(self.low_bits)) - np.uint64(1))

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first number that is x or more, and whether it is x. n if there is none."""
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        begin, end = self._zero(high - 1) + 1 - high, self._zero(high) - high
        want = x & ((np.uint64(1) << np.uint64(self.low_bits)) - np.uint64(1))
        a, b = begin.copy(), end.copy()
        while (open_ := a < b).any():
            middle = (a + b) >> 1
            less = np.zeros(len(x), bool)
            less[open_] = self.lows(middle[open_]) < want[open_]
            a, b = np.where(open_ & less, middle + 1, a), np.where(open_ & ~less, middle, b)
        hit = a < end
        hit[hit] = self.lows(a[hit]) == want[hit]
        return a, hit

    def select(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        ones = np.arange(len(self.high) + 1, dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(ones, i, side="right") - 1
        bits, left, place = self.high[word], i - ones[word], np.zeros(len(i), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            mask = np.uint64((1 << half) - 1)
            count = np.bitwise_count(bits & mask).astype(np.int64)
            up = left >= count
            left, bits = np.where(up, left - count, left), np.where(up, bits >> np.uint64(half), bits & mask)
            place += np.where(up, half, 0)
        high = (word * 64 + place - i).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self.lows(i)


def bits_of(level: int) -> int:
    """Bits of the keys of a level below the first."""
    return BITS if level == 2 else MORE_BITS


class Trie:
    """A trie of `order` levels: words (64-bit hashes), and below each entry the words before it (hashes of bits_of() bits).

    keys: for each level its keys, ascending within a parent; sizes: for each level but the last the number of children of each
    entry; values: for each level a quantised number for each entry, and contexts: the same for all but the last.
    """

    def __init__(self, keys: list[np.ndarray], sizes: list[np.ndarray], values: list[np.ndarray], contexts: list[np.ndarray], path: str | None = None):
        self.order, self.entries = len(keys), [len(k) for k in keys]
        self.bits, self.scale, arrays, counts = {}, {}, {}, {}

        def put(name: str, numbers: np.ndarray, universe: int) -> None:
            counts[name] = len(numbers)
            self.bits[name], found = EliasFano.arrays(numbers, universe)
            arrays.update({f"{name}.{k}": a for k, a in found.items()})

        # of a word's hash the top bits are in the sequence; the rest is compared exactly
        put("key1", keys[0] >> np.uint64(16), 1 << 48)
        arrays["rest"] = (keys[0] & np.uint64(0xFFFF)).astype(np.uint16)
        for level in range(2, self.order + 1):
            size, bits = sizes[level - 2], bits_of(level)
            put(f"pointer{level}", np.concatenate(([0], np.cumsum(size))).astype(np.uint64), self.entries[level - 1] + 1)
            parent = np.repeat(np.arange(len(size), dtype=np.uint64), size)
            put(f"key{level}", parent << np.uint64(bits) | keys[level - 1], max(1, len(size)) << bits)
        for kind, lists in (("value", values), ("context", contexts)):
            for level, numbers in enumerate(lists, 1):
                least, most = (float(numbers.min()), float(numbers.max())) if len(numbers) else (0.0, 0.0)
                step = (most - least) / LEVELS or 1.0
                self.scale[kind, level] = (least, step)
                arrays[f"{kind}{level}"] = np.rint((numbers - least) / step).astype(np.uint16)
        self.layout = Layout(arrays, path)
        get = self.layout.arrays
        self.sequence = {name: EliasFano(n, self.bits[name], get[f"{name}.low"], get[f"{name}.high"], get[f"{name}.zeros"]) for name, n in counts.items()}

    def number(self, kind: str, level: int, i: np.ndarray) -> np.ndarray:
        """The value or context of entries of a level."""
        least, step = self.scale[kind, level]
        return least + step * self.layout.arrays[f"{kind}{level}"][i]

    def find_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, hit = self.sequence["key1"].successor(words >> np.uint64(16))
        rest = (words & np.uint64(0xFFFF)).astype(np.uint16)
        kept = self.layout.arrays["rest"]
        while True:  # several words may share their top bits
            wrong = hit.copy()
            wrong[hit] = kept[i[hit]] < rest[hit]
            if not wrong.any():
                break
            i[wrong] += 1
            hit &= i < self.entries[0]
            again = np.flatnonzero(wrong & hit)
            hit[again] = self.sequence["key1"].select(i[again]) == words[again] >> np.uint64(16)
        hit[hit] = kept[i[hit]] == rest[hit]
        return i, hit

    def find_before(self, level: int, parent: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of a level below the first, for parents given by their index: the successor of each key in its parent's range."""
        if not len(parent):
            return np.empty(0, np.int64), np.zeros(0, bool)
        i, hit = self.sequence[f"key{level}"].successor(parent.astype(np.uint64) << np.uint64(bits_of(level)) | keys)
        return i, hit & (i < self.sequence[f"pointer{level}"].select(parent + 1).astype(np.int64))


@dataclass
class Totals:
    tokens: int  # N
    distinct: int  # V
    texts: int  # training texts
    ranges: int  # shards
    hot: list[tuple[np.ndarray, np.ndarray]]  # for n-grams of 1, 2, ... words: gram() of those that are very frequent, ascending, and their counts

    @property
    def scale(self) -> float:
        return self.tokens + 0.1 * (self.distinct + 1)


def tokens_in_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts, the index of each one's text, and where each text begins."""
    words, begins = tokens_of(texts)
    counts = np.diff(begins) + 1
    ends = np.cumsum(counts) - 1
    token = np.empty(len(words) + len(texts), np.uint64)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner], token[ends] = words, END
    return token, np.repeat(np.arange(len(texts), dtype=np.int32), counts), np.concatenate(([0], ends[:-1] + 1))


def shifted(values: np.ndarray, firsts: np.ndarray, start, order: int) -> list[np.ndarray]:
    """What stands 1, 2, ... order - 1 tokens before each token; start before the first token of a text."""
    out = [values]
    for _ in range(order - 1):
        moved = np.empty_like(values)
        moved[1:] = out[-1][:-1]
        moved[firsts] = start
        out.append(moved)
    return out[1:]


def cut(before: np.ndarray, level: int) -> np.ndarray:
    """Words before, as the keys of a level."""
    return before >> np.uint64(64 - bits_of(level))


def longer(gram: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams with one more word in front; those of one word are the word's own."""
    return mix(gram ^ mix(before + np.uint64(0x51ED270B)))


def lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def gram_counts(docs: DataFrame, hot: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(gram, n, every): training and all occurrences in docs (train, text) of the n-grams that are one word longer than the last of hot and end in one of these."""
    level = len(hot) + 1
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> list[np.ndarray]:
            gram, *counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(gram, kind="stable")
            gram = gram[order]
            first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            return [gram[first], *(np.add.reduceat(c[order], first) for c in counts)]

        def rows(found: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], ["gram", "n", "every"])

        for batch in batches:
            for part in parts(batch, 1024):
                gram, index, firsts = tokens_in_texts(texts_of(part.column(1)))
                before = shifted(gram, firsts, START, level)
                train = part.column(0).to_numpy(zero_copy_only=False).astype(bool)[index]
                for depth, (keys, _) in enumerate(shared.value):
                    some = lookup(keys, gram)[1]
                    train, before = train[some], [x[some] for x in before]
                    gram = longer(gram[some], cut(before[depth], depth + 2))
                if len(gram):
                    grams, at = np.unique(gram, return_inverse=True)
                    held.append([grams, *(np.bincount(at, w, len(grams)).astype(np.int64) for w in (train, None))])
                    size += len(grams)
                if size > 1_500_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 750_000:
                        yield rows(held[0])
                        held, size = [], 0
        if held:
            yield rows(merged())

    return docs.select("train", "text").mapInArrow(run, "gram long, n long, every long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def totals(docs: DataFrame, order: int, least: int) -> Totals:
    """Counts of the tokens of docs (train, text). Hot is what has as many of all tokens as a shard in the mean, so one for each shard at most, and HOT at most."""
    counts, hot = gram_counts(docs, []).persist(), []
    row = counts.agg(F.sum("n").alias("tokens"), F.sum("every").alias("every"), F.count_if(F.col("n") > 0).alias("distinct"), F.max(F.when(F.col("gram") == int(END), F.col("n"))).alias("texts")).first()
    every = row["every"] or 0
    ranges = max(least, -(-every // SHARD))
    frequent = max(1, every / ranges, every / HOT)
    while True:
        found = counts.where(F.col("every") >= frequent).select("gram", "n").collect()  # one for each shard, and HOT, at most
        counts.unpersist()
        if not found:
            break
        grams = np.array([r["gram"] for r in found], np.int64).view(np.uint64)
        by = np.argsort(grams)
        hot.append((grams[by], np.array([r["n"] for r in found], np.int64)[by]))
        if len(hot) == order:
            break
        counts = gram_counts(docs, hot)
    return Totals(row["tokens"] or 0, row["distinct"], row["texts"] or 0, ranges, hot)


def joined(arrays: list[np.ndarray]) -> bytes:
    """Arrays of little-endian numbers as one value: how many there are, for each the bytes of a number and their count, then all numbers."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.itemsize, len(a)))], "<u4")
    return b"".join([head.tobytes(), *(a.tobytes() for a in arrays)])


def narrow(counts: np.ndarray) -> list[np.ndarray]:
    """Counts, most of which are small, in a byte each; 255 stands for the next of the larger ones, which follow."""
    return [np.minimum(counts, 255).astype("u1"), counts[counts >= 255].astype("<u4")]


def widened(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    counts = small.astype(np.int64)
    counts[small == 255] = large
    return counts


def parted(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    head, at, out = np.frombuffer(data, "<u4", 2 * n, 4).tolist(), 4 + 8 * n, []
    for width, count in zip(head[::2], head[1::2], strict=True):
        out.append(np.frombuffer(data, f"<u{width}", count, at))
        at += width * count
    return out


def level_starts(levels: list[np.ndarray]) -> list[np.ndarray]:
    """For grouped n-grams of 1, 2, ... words, given by their words from the last one on: where each different one begins."""
    new = np.zeros(len(levels[0]), bool)
    new[:1] = True
    out = []
    for keys in levels:
        new[1:] |= keys[1:] != keys[:-1]
        out.append(np.flatnonzero(new))
    return out


def order_of(levels: list[np.ndarray], bits: int) -> np.ndarray:
    """An order in which equal n-grams stand together, and those that end alike; levels: numbers of so many bits. Sorts one key as long as 63 bits do."""
    key, width = levels[0].astype(np.int64), bits
    for more in levels[1:]:
        if width + bits > 63:
            _, key = np.unique(key, return_inverse=True)
            width = int(key.max()).bit_length()
        key, width = key << bits | more, width + bits
    return np.argsort(key)


SENT = "part int, shard int, chunk long, body binary, ids binary"


def packed_tokens(docs: DataFrame, known: Totals, order: int, tasks: int) -> DataFrame:
    """Tokens of docs (id, train, text) packed by shard, and one row with the ids of each chunk's texts.

    A body has, for each word, its number of different words before it, and so on down the levels, for each n-gram its occurrences, and
    for each of these its text in the chunk. Hot words are dealt out with the word before, hot pairs with one more, and the
    longest hot n-grams with the chunk.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def pack(chunk: int, texts: list[bytes], ids: list[pa.RecordBatch], train: np.ndarray) -> Iterator[pa.RecordBatch]:
        ranges = shared.value.ranges
        token, index, firsts = tokens_in_texts(texts)
        words, rank = np.unique(token, return_inverse=True)
        words = np.append(words, START)
        rank = rank.astype(np.int32)
        levels = [rank, *shifted(rank, firsts, len(words) - 1, order)]
        spread, gram, some = token, token, np.arange(len(token))
        for level, (keys, _) in enumerate(shared.value.hot, 1):
            hot = lookup(keys, gram)[1]
            some, gram = some[hot], gram[hot]
            if not len(some):
                break
            gram = longer(gram, cut(words[levels[level][some]], level + 1)) if level < order else mix(gram ^ mix(np.full(len(gram), chunk, np.uint64)))
            spread = spread.copy() if spread is token else spread
            spread[some] = gram
        shard = ((spread >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.uint16 if ranges <= 1 << 16 else np.int32)
        del token, spread, gram
        by = order_of(levels, len(words).bit_length())
        by = by[np.argsort(shard[by], kind="stable")]
        local = (index[by] | (train[index[by]].astype(np.int32) << 15)).astype("<u2")
        shard, levels = shard[by], [x[by] for x in levels]
        del by, index
        edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            mine = [x[a:b] for x in levels]
            starts = level_starts(mine)
            arrays = []
            for level, (ranks, at) in enumerate(zip(mine, starts, strict=True), 1):
                k = words[ranks[at]]
                k = cut(k, level) if level > 1 else k
                arrays += [k] if level == 1 else [k.astype("<u4"), (k >> np.uint64(32)).astype("u1")] if level == 2 else [k.astype("<u2"), (k >> np.uint64(16)).astype("u1")]
                below = np.searchsorted(starts[level], at) if level < order else at
                arrays += narrow(np.diff(below, append=len(starts[level]) if level < order else b - a))
            r = int(shard[a])
            yield row(r * tasks // ranges, r, chunk, joined([*arrays, local[a:b]]), None)
        sink = pa.BufferOutputStream()
        table_of = pa.Table.from_batches(ids)
        with pa.ipc.new_stream(sink, table_of.schema) as out:
            out.write_table(table_of)
        yield row(chunk % tasks, -1, chunk, None, sink.getvalue().to_pybytes())

    def row(part: int, shard: int, chunk: int, body: bytes | None, ids: bytes | None) -> pa.RecordBatch:
        values = (part, pa.int32()), (shard, pa.int32()), (chunk, pa.int64()), (body, pa.binary()), (ids, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], [f.split()[0] for f in SENT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, texts, ids, train, size = TaskContext.get().partitionId() << 24, [], [], [], 0
        for batch in batches:
            for part in parts(batch, 256):
                found = texts_of(part.column(2))
                texts += found
                ids.append(part.select(["id", "train"]))
                train.append(part.column(1).to_numpy(zero_copy_only=False))
                size += sum(map(len, found)) // 6 + len(found)
                if size >= PACKED or len(texts) > TEXTS - 256:
                    yield from pack(chunk, texts, ids, np.concatenate(train))
                    chunk, texts, ids, train, size = chunk + 1, [], [], [], 0
        if texts:
            yield from pack(chunk, texts, ids, np.concatenate(train))

    return docs.select("id", "train", "text").mapInArrow(run, SENT)


BACK = "chunk long, sums binary, ids binary"


class Shard:
    """The n-grams of one shard, out of the bodies of all chunks."""

    def __init__(self, order: int):
        self.order, self.chunks, self.locals, self.keys, self.sizes = order, [], [], [[] for _ in range(order)], [[] for _ in range(order)]

    def add(self, chunk: int, body: bytes) -> None:
        *arrays, local = parted(body)
        at = 0
        for level in range(1, self.order + 1):
            keys, at = arrays[at], at + 1
            if level > 1:
                keys, at = keys.astype(np.uint64) | arrays[at].astype(np.uint64) << np.uint64(32 if level == 2 else 16), at + 1
            self.keys[level - 1].append(keys)
            self.sizes[level - 1].append(widened(arrays[at], arrays[at + 1]))
            at += 2
        self.chunks.append(chunk)
        self.locals.append(local)

    def scored(self, stats: Totals, prior: float, shorter: float) -> Iterator[tuple[int, bytes]]:
        """For each chunk: its texts, and their numbers of tokens and of known ones, base and score in this shard."""
        order, log_k = self.order, np.log10(shorter)
        # the different n-grams of all chunks, level by level: keys, parents, and for each chunk's n-grams which one it is
        groups, parent, which = [], [None], None
        for level in range(1, order + 1):
            keys = np.concatenate(self.keys[level - 1])
            self.keys[level - 1] = None
            if level > 1:
                bits = np.uint64(bits_of(level))
                keys = np.repeat(which.astype(np.uint64), np.concatenate(self.sizes[level - 2])) << bits | keys
                self.sizes[level - 2] = None
            keys, which = np.unique(keys, return_inverse=True)
            if level > 1:
                parent.append((keys >> bits).astype(np.int64))
                keys &= (np.uint64(1) << bits) - np.uint64(1)
            groups.append(keys)
        sizes = np.concatenate(self.sizes[-1])
        train = np.add.reduceat(np.concatenate(self.locals) >> 15, np.cumsum(sizes) - sizes, dtype=np.int64)
        counts = [np.bincount(which, train, len(groups[-1])).astype(np.int64)]
        for level in range(order, 1, -1):
            counts.insert(0, np.bincount(parent[level - 1], counts[0], len(groups[level - 2])).astype(np.int64))
        gram = groups[0]
        for level, (keys, numbers) in enumerate(stats.hot, 1):
            gram = gram if level == 1 else longer(gram[parent[level - 1]], groups[level - 1])
            found, hot = lookup(keys, gram)
            counts[level - 1][hot] = numbers[found[hot]]
        del keys, train, gram, sizes
        # the trie of what the training texts have
        seen, rank, sizes, values, contexts = [c > 0 for c in counts], None, [], [], []
        whole = spread = None
        for level in range(1, order + 1):
            count, mine = counts[level - 1], seen[level - 1]
            if level == 1:
                whole, spread = prior * (count + 0.1) / stats.scale, count + prior
            else:
                sizes.append(np.bincount(rank[parent[level - 1][mine]], minlength=int(seen[level - 2].sum())))
                weight = 1.0 if level == 2 else shorter
                whole, spread = count + weight * whole[parent[level - 1]], count + shorter * spread[parent[level - 1]]
            rank = np.cumsum(mine) - 1
            values.append(np.log10(whole[mine]))
            if level < order:
                contexts.append(np.log10(spread[mine]))
        del whole, spread, rank
        trie = Trie([g[s] for g, s in zip(groups, seen, strict=True)], sizes, values, contexts)
        del values, contexts, sizes, seen
        # what it gives for all n-grams: a longer one that the trie hasn't is worth what its parent is, less the weight
        words, known = trie.find_words(groups[0])
        at, hit = words, known
        score = np.full(len(words), np.log10(prior * 0.1 / stats.scale) + max(0, order - 2) * log_k)
        score[hit] = trie.number("value", 1, at[hit]) + max(0, order - 2) * log_k
        after = np.full(len(words), np.log10(prior) + max(0, order - 2) * log_k)
        after[hit] = trie.number("context", 1, at[hit]) + (order - 2) * log_k
        for level in range(2, order + 1):
            up = parent[level - 1]
            score, after, hit, above = score[up], after[up], hit[up], at[up]
            some = np.flatnonzero(hit)
            found, there = trie.find_before(level, above[some], groups[level - 1][some])
            at, hit = np.zeros(len(up), np.int64), np.zeros(len(up), bool)
            at[some], hit[some] = found, there
            some = np.flatnonzero(hit)
            score[some] = trie.number("value", level, at[some]) + (order - level) * log_k
            if level < order:
                after[some] = trie.number("context", level, at[some]) + (order - 1 - level) * log_k
        # a word is also what the next token follows
        word = np.arange(len(groups[0]))
        for up in parent[1:]:
            word = word[up]
        score -= np.where(groups[0][word] == END, 0.0, after)
        base = np.log10(counts[0] + 0.1)[word]
        here = (counts[0] > 0)[word]
        del groups, counts, parent, after, trie, word, up
        done = 0
        for chunk, local, size in zip(self.chunks, self.locals, self.sizes[-1], strict=True):
            mine = np.repeat(which[done : done + len(size)], size)
            done += len(size)
            local = (local & 0x7FFF).astype(np.int64)
            if len(local) > 2000:
                used, back = None, local
            else:
                used, back = np.unique(local, return_inverse=True)
            sums = [np.bincount(back, w) for w in (None, here[mine], base[mine], score[mine])]
            if used is None:
                used = np.flatnonzero(sums[0])
                sums = [x[used] for x in sums]
            yield chunk, joined([used.astype("<u2"), *narrow(sums[0]), *narrow(sums[1].astype(np.int64)), sums[2].view("<u8"), sums[3].astype("<f4").view("<u4")])


def scored_parts(sent: DataFrame, known: Totals, order: int, tasks: int, prior: float = PRIOR, shorter: float = SHORTER) -> DataFrame:
    """Each shard's part of the counts and scores of the texts of each chunk. A task has one shard at a time in memory."""
    shared = sent.sparkSession.sparkContext.broadcast(known)
    names = [f.split()[0] for f in BACK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(held: Shard) -> Iterator[pa.RecordBatch]:
            for chunk, sums in held.scored(shared.value, prior, shorter):
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sums], pa.binary()), pa.array([None], pa.binary())], names)

        held, at = None, None
        for batch in batches:
            for shard, chunk, body, ids in zip(*batch.columns[1:], strict=True):
                if ids.is_valid:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()], pa.int64()), pa.array([None], pa.binary()), pa.array([ids.as_py()], pa.binary())], names)
                    continue
                if shard.as_py() != at:
                    if held is not None:
                        yield from ended(held)
                    held, at = Shard(order), shard.as_py()
                held.add(chunk.as_py(), body.as_py())
        if held is not None:
            yield from ended(held)

    dealt = sent.repartitionById(tasks, F.col("part"))
    return (dealt.sortWithinPartitions("shard") if known.ranges > tasks else dealt).mapInArrow(run, BACK)


def score_texts(docs: DataFrame, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train", order: int = ORDER, shorter: float = SHORTER) -> DataFrame:
    """One row for each row of docs: <id_col>, train, n_tokens, n_known, train_tokens, base_score, score.

    Counts come from the rows whose <train_col> is true. Tokens are the words [^\\x20\\x09-\\x0D]+, A-Z as a-z, and one end; null and
    empty texts have the end alone. base_score is the sum of log10 P(w), score that of log10 of P(w | the order - 1 words before). Repeated rows count and are scored
    each for itself; a null id stays null, a null <train_col> is false. Other columns are not read. An empty table gives no rows.
    Without any training row both are sums over a model that knows no word. Very long texts are in one chunk whole; order is 2 or more.
    """
    if order < 2:
        raise ValueError("the order must be 2 or more")
    least = shards(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(train_col), F.lit(False)).alias("train"), F.col(text_col).cast("string").alias("text"))
    known = totals(rows, order, least)
    tasks = min(known.ranges, max(least, -(-known.ranges // SHARDS)))
    back = scored_parts(packed_tokens(rows, known, order, tasks), known, order, tasks, prior, shorter)
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType)] + [T.StructField(n, t) for n, t in (("train", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))])
    start = known.texts + prior
    for _ in range(order - 2):
        start = known.texts + shorter * start
    per_token, start = np.log10(known.scale), -np.log10(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by chunk, so one chunk at a time is held."""

        def ended(sums: np.ndarray, ids: bytes) -> Iterator[pa.RecordBatch]:
            whole = pa.ipc.open_stream(ids).read_all().combine_chunks()
            tokens, hits, base, score = sums[:, : whole.num_rows]
            columns = [tokens.astype(np.int64), hits.astype(np.int64), np.full(len(tokens), known.tokens), base - tokens * per_token, score + start]
            yield from pa.table([whole.column(0), whole.column(1), *map(pa.array, columns)], names=[f.name for f in schema.fields]).to_batches(16_384)

        sums, ids, at = np.zeros((4, TEXTS + 1)), None, None
        for batch in batches:
            for chunk, found, named in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != at:
                    if at is not None:
                        yield from ended(sums, ids)
                    sums, ids, at = np.zeros((4, TEXTS + 1)), None, chunk
                if named is not None:
                    ids = named
                    continue
                texts, *counts, base, score = parted(found)
                for total, part in zip(sums, (widened(*counts[:2]), widened(*counts[2:]), base.view(np.float64), score.view("<f4")), strict=True):
                    total[texts] += part
        if at is not None:
            yield from ended(sums, ids)

    return back.repartition(F.col("chunk")).sortWithinPartitions("chunk").mapInArrow(run, schema)


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold_of("doc_id", 10) != 0).alias("train"))
    scored = score_texts(docs)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
