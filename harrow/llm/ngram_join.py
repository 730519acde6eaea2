"""Jaccard self-join of documents on word n-grams: rare-first prefix filtering, with length, positional and suffix filters.

1. Each text becomes the set of hashes of its n-grams. Texts with equal sets are one class, known by a signature of the set.
2. The sets go through one packed shuffle by ranges of the hashes (by class too for n-grams that very many classes have). There every n-gram's number of classes is counted, and
   n-grams of a single class are dropped: they can't be shared. The others return to their classes with their counts,
   which is the global order, rarest first. A class whose prefix holds only n-grams of its own has no partner and ends here.
3. Classes meet on the n-grams of their prefixes. In a few rounds each class is held against one class for each n-gram,
   and classes linked that way become one part. Then all remaining pairs of classes that share an n-gram of their
   prefixes, are in different parts and pass the length, positional and parity filters are verified, once each. So no group
   of copies is written out as all of its pairs, and still no link between two parts is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm.common import checkpoint, few, mix, parts, shards, table, texts_of, tokens_of, written
from harrow.llm.components import components

#: Postings that a task packs together; its memory grows with them.
PACKED = 1_000_000
TOKEN_BITS = 48
#: An n-gram that so many classes of one pack have is heavy: its postings are dealt out by class as well, and it comes last in the global order.
HEAVY = 96
#: The count that stands for heavy n-grams, and the size of the class that stands in a pack's ordinary postings for all of a heavy n-gram's.
MOST, MARK = 65_535, 0xFFFFFFFF
#: Bits of the parity filter, and the columns that hold them.
BITS = 256
WORDS = [f"bits{i}" for i in range(BITS // 64)]
#: Bytes of text whose postings one task takes, some two million n-grams, however many texts there are.
SHARE = 12_000_000
#: Rows of prefixes, and pairs of classes with their n-grams, that one task works on.
PREFIXES, PAIRS = 200_000, 5_000
#: Times that classes are held against one class for each n-gram before all remaining pairs are.
ROUNDS = 4


def n_grams(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams; of all its words together if there are fewer than size."""
    words, begins = tokens_of(texts)
    factors = np.random.default_rng(size).integers(1, 1 << 62, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    joined = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j, f in enumerate(factors):
        joined += words[j : j + len(joined)] * f
    joined = mix(joined)
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(joined[a : b - size + 1])
        elif b > a:
            yield mix(np.array([(words[a:b] * factors[: b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def signature(grams: np.ndarray) -> int:
    """A 64-bit signature of a set; together with the set's size it stands for the set."""
    total = int(mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(grams) else 0
    return int(np.array([(total * 0x2545F4914F6CDD1D + len(grams)) % (1 << 64)], np.uint64).astype(np.int64)[0])


def document_sets(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (size of the set of n-grams) and sig (its signature) of each row."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("sig", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                sets = [(len(g), signature(g)) for g in n_grams(texts_of(part.column(1)), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in sets], pa.int64()), pa.array([s for _, s in sets], pa.int64())], ["id", "n", "sig"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def postings(docs: DataFrame, size: int, ranges: int, text_col: str = "text") -> DataFrame:
    """Packed postings (n-gram, class) by range of the n-gram: low and high parts of n-grams, index of each one's class, signatures and sizes of the classes.

    Equal sets of one task are packed once, so that a large group of copies does not pile up. Postings of heavy n-grams go to
    ranges of a hash of n-gram and class instead, so that a passage of many documents does not pile up either; the n-gram's own
    range gets one posting of the class MARK.
    """
    borders = np.array([(r << TOKEN_BITS) // ranges for r in range(1, ranges)], np.uint64)

    def dealt(token: np.ndarray, index: np.ndarray, place: np.ndarray, sig: np.ndarray, n: np.ndarray, heavy: bool) -> pa.RecordBatch:
        order = np.argsort(place, kind="stable")
        token, index, edges = token[order], index[order], np.searchsorted(place[order], borders)
        shard, blobs = [], [[], [], [], [], []]
        for r, (a, b) in enumerate(zip([0, *edges], [*edges, len(token)], strict=True)):
            if a < b:
                used, local = np.unique(index[a:b], return_inverse=True)
                shard.append(r)
                low, high = (token[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4"), (token[a:b] >> np.uint64(32)).astype("<u2")
                for blob, x in zip(blobs, (low, high, local.astype("<u2"), sig[used], n[used]), strict=True):
                    blob.append(x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([heavy] * len(shard), pa.bool_()), *(pa.array(b, pa.binary()) for b in blobs)], ["shard", "heavy", "low", "high", "local", "sig", "n"])

    def pack(sets: list[np.ndarray], sigs: list[int]) -> Iterator[pa.RecordBatch]:
        token = np.concatenate(sets) >> np.uint64(64 - TOKEN_BITS)
        index = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
        order = np.argsort(token, kind="stable")
        token, index = token[order], index[order]
        sig, n = np.array([*sigs, 0], np.int64), np.array([*map(len, sets), MARK], np.uint32)
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        counts = np.diff(np.concatenate((first, [len(token)])))
        heavy, marks = np.repeat(counts >= HEAVY, counts), token[first[counts >= HEAVY]]
        light = np.concatenate((token[~heavy], marks))
        yield dealt(light, np.concatenate((index[~heavy], np.full(len(marks), len(sets), np.uint16))), light, sig, n, False)
        if len(marks):
            token, index = token[heavy], index[heavy]
            yield dealt(token, index, mix(token ^ mix(sig[index].view(np.uint64))) >> np.uint64(64 - TOKEN_BITS), sig, n, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, sigs, held, seen = [], [], 0, set()
        for batch in batches:
            for part in parts(batch):
                for grams in n_grams(texts_of(part.column(0)), size):
                    if not len(grams) or (sig := signature(grams)) in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(sig)
                    sets.append(grams)
                    sigs.append(sig)
                    held += len(grams)
                    if held >= PACKED or len(sets) == 65_535:
                        yield from pack(sets, sigs)
                        sets, sigs, held = [], [], 0
        if sets:
            yield from pack(sets, sigs)

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "shard int, heavy boolean, low binary, high binary, local binary, sig binary, n binary")


def shared_grams(packed: DataFrame, ranges: int) -> DataFrame:
    """The n-grams that two or more classes have, returned to their classes: packed keys by range of the signature.

    A key is the number of classes (MOST for n-grams that are heavy anywhere) above the n-gram's 48 bits, so the order of keys is
    rarest first. A class may get a heavy n-gram's key twice, by way of the n-gram's own range too.
    """

    def back(sig: np.ndarray, n: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        home = ((sig.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        order = np.lexsort((sig, home))
        sig, n, key, home = sig[order], n[order], key[order], home[order]
        first = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (n[1:] != n[:-1]))))
        counts = np.diff(np.concatenate((first, [len(sig)]))).astype("<u4")
        shard, blobs = [], [[], [], [], []]
        homes, at = np.unique(home[first], return_index=True)
        for r, a, b in zip(homes.tolist(), at, [*at[1:], len(first)], strict=True):
            lo, hi = first[a], first[b] if b < len(first) else len(sig)
            shard.append(r)
            for blob, x in zip(blobs, (sig[first[a:b]], n[first[a:b]], counts[a:b], key[lo:hi]), strict=True):
                blob.append(x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], ["shard", "sig", "n", "counts", "keys"])

    def distinct(token: np.ndarray, sig: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((n, sig, token))
        token, sig, n = token[order], sig[order], n[order]
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (sig[1:] != sig[:-1]) | (n[1:] != n[:-1])))[: len(token)]
        return token[new], sig[new], n[new]

    def joined(pieces: list[np.ndarray]) -> np.ndarray:
        """The pieces in one array; they are let go."""
        whole = np.concatenate(pieces)
        pieces.clear()
        return whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {False: ([], [], []), True: ([], [], [])}
        for batch in batches:
            for heavy, low, high, local, sig, n in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                at = np.frombuffer(local, "<u2")
                tokens, sigs, sizes = held[heavy]
                tokens.append(np.frombuffer(low, "<u4").astype(np.uint64) | np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(32))
                sigs.append(np.frombuffer(sig, np.int64)[at])
                sizes.append(np.frombuffer(n, np.uint32)[at])
        if held[True][0]:
            token, sig, n = distinct(*(joined(x) for x in held.pop(True)))
            yield back(sig, n, np.uint64(MOST << TOKEN_BITS) | token)
        if not held[False][0]:
            return
        token, sig, n = (joined(x) for x in held.pop(False))
        order = np.argsort(token, kind="stable")
        ordered = token[order]
        same = ordered[1:] == ordered[:-1]
        order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        del ordered, same
        token, sig, n = distinct(token[order], sig[order], n[order])
        _, where, count = np.unique(token, return_inverse=True, return_counts=True)
        count = np.minimum(count, MOST - 1)
        count[where[n == MARK]] = MOST
        count = count[where]
        several = (count > 1) & (n != MARK)
        if several.any():
            yield back(sig[several], n[several], count[several].astype(np.uint64) << np.uint64(TOKEN_BITS) | token[several])

    return packed.repartitionById(ranges, F.col("shard")).mapInArrow(run, "shard int, sig binary, n binary, counts binary, keys binary")


def candidates(shared: DataFrame, ranges: int, num: int, den: int) -> DataFrame:
    """Classes that may have a partner: sig, n, keys (binary, their shared n-grams, rarest first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, sizes, keys = [], [], []
        for batch in batches:
            for sig, n, counts, key in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                repeat = np.frombuffer(counts, "<u4")
                sigs.append(np.repeat(np.frombuffer(sig, np.int64), repeat))
                sizes.append(np.repeat(np.frombuffer(n, np.uint32), repeat))
                keys.append(np.frombuffer(key, np.uint64))
        if not keys:
            return
        sig, n, key = np.concatenate(sigs), np.concatenate(sizes).astype(np.int64), np.concatenate(keys)
        order = np.lexsort((key, n, sig))
        sig, n, key = sig[order], n[order], key[order]
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (n[1:] != n[:-1]) | (key[1:] != key[:-1])))
        sig, n, key = sig[new], n[new], key[new]
        first = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (n[1:] != n[:-1]))))
        last = np.concatenate((first[1:], [len(sig)]))
        size = n[first]
        prefix = size + (-num * size // den) + 1  # n less the ceiling of num/den of it, plus 1
        alive = np.flatnonzero(size - (last - first) < prefix)
        for at in range(0, len(alive), 1024):
            some = alive[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(sig[first[some]]), pa.array(size[some]), pa.array([key[a:b].tobytes() for a, b in zip(first[some], last[some], strict=True)], pa.binary())], ["sig", "n", "keys"])

    return shared.repartitionById(ranges, F.col("shard")).mapInArrow(run, "sig long, n long, keys binary")


def parity(keys: np.ndarray) -> np.ndarray:
    """BITS bits, as longs: each says whether an odd number of the keys fall on it. Where two sets' bits differ, the sets differ in a key or more."""
    odd = np.bincount((keys % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(classes: DataFrame, num: int, den: int) -> DataFrame:
    """key, sig, n, rest, own, bits for each shared n-gram in the prefix of a class.

    rest: n-grams of the set from this one on, in the global order; own: n-grams that no other class has; bits: parity() of the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sig, n, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = np.frombuffer(keys, np.uint64)
                own = n - len(key)  # these come before all shared ones
                some = key[: n + (-num * n // den) + 1 - own]
                same = [np.full(len(some), x) for x in (sig, n, own, *parity(key))]
                out.append((some.view(np.int64), *same[:2], n - own - np.arange(len(some)), *same[2:]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["key", "sig", "n", "rest", "own", *WORDS])

    return classes.select("sig", "n", "keys").mapInArrow(run, "key long, sig long, n long, rest long, own long, " + ", ".join(f"{w} long" for w in WORDS))


def overlap_bound(a: np.ndarray, b: np.ndarray, depth: int = 2) -> int:
    """Suffix filter: most elements that two sorted arrays can share, by halving one and splitting the other at the same place."""
    if not len(a) or not len(b) or not depth:
        return min(len(a), len(b))
    half = len(b) // 2
    at = int(np.searchsorted(a, b[half]))
    return overlap_bound(a[:at], b[:half], depth - 1) + overlap_bound(a[at:], b[half:], depth - 1)


def verified(pairs: DataFrame, number: int, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes, `number` at most, whose sets are similar enough."""
    left = classes.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    right = classes.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                good = []
                for na, ka, nb, kb in zip(*(part.column(i).to_pylist() for i in range(2, 6)), strict=True):
                    x, y, need = np.frombuffer(ka, np.uint64), np.frombuffer(kb, np.uint64), num * (na + nb)
                    possible = (num + den) * min(len(x), len(y)) >= need and (num + den) * overlap_bound(x, y) >= need
                    good.append(possible and (num + den) * len(np.intersect1d(x, y, assume_unique=True)) >= need)
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = few(few(pairs.join(left, "a"), number, PAIRS).join(right, "b"), number, PAIRS)
    return both.select("a", "b", "na", "ka", "nb", "kb").mapInArrow(run, "a long, b long")


def _possible(num: int, den: int):
    """Length, positional and parity filters for two prefix rows e and o. Each only rules out pairs that can't be similar enough."""
    total = F.col("e.n") + F.col("o.n")
    length = den * F.least("e.n", "o.n") >= num * F.greatest("e.n", "o.n")
    position = (num + den) * F.least("e.rest", "o.rest") >= num * total
    differ = F.col("e.own") + F.col("o.own")
    for w in WORDS:
        differ = differ + F.bit_count(F.col(f"e.{w}").bitwiseXOR(F.col(f"o.{w}")))
    return length & position & ((num + den) * (total - differ) >= 2 * num * total)


def _pairs(joined: DataFrame) -> DataFrame:
    """Distinct pairs of classes, with the parts that they are in, from prefix rows e joined with o."""
    swap = F.col("e.sig") > F.col("o.sig")
    row = F.when(swap, F.struct(F.col("o.sig").alias("a"), F.col("e.sig").alias("b"))).otherwise(F.struct(F.col("e.sig").alias("a"), F.col("o.sig").alias("b")))
    return joined.select(row.alias("p")).select("p.a", "p.b").distinct()


def _mixed(rows: DataFrame, size: int) -> DataFrame:
    """The rows, `size` at most, of n-grams on which two or more parts meet."""
    found = rows.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most")
    return checkpoint(few(rows.join(checkpoint(few(found.select("key"), size, PREFIXES)), "key", "left_semi"), size, PREFIXES))


def _crossing(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """All rows, with the part that has most rows of their n-gram, and the rows that are not in that part.

    Two rows of different parts aren't both in the largest one, so no group of copies is held against itself, however large.
    """
    counts = few(rows.groupBy("key", "part").count(), size, PREFIXES)
    largest = counts.groupBy("key").agg(F.max(F.struct("count", "part"))["part"].alias("largest"))
    rows = written(few(rows.join(checkpoint(few(largest, size, PREFIXES)), "key"), size, PREFIXES), "prefixes")
    return rows, rows.where("part <> largest")


def linked_classes(docs: DataFrame, size: int, num: int, den: int, text_col: str = "text") -> DataFrame:
    """(sig, component) of all classes of texts with a link to another class; component is the smallest signature.

    Only components are made: two classes that are in one part by way of others are not compared, so links isn't the list of all links.
    """
    every = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    ranges = max(shards(docs.sparkSession), -(-every // SHARE))
    classes = checkpoint(candidates(shared_grams(postings(docs, size, ranges, text_col), ranges), ranges, num, den))
    rows = checkpoint(prefixes(classes, num, den).withColumn("part", F.col("sig")))
    size = rows.count()
    rows = _mixed(few(rows, size, PREFIXES), size)
    value = ("sig", "n", "rest", "own", *WORDS, "part")
    tried, links = None, None

    def verify(joined: DataFrame) -> DataFrame:
        """Links among the pairs of joined that haven't been tried; tried and links are brought up to date."""
        nonlocal tried, links
        pairs = written(joined, "pairs")
        number = pairs.count()
        if tried is not None:
            pairs = checkpoint(few(pairs.join(tried, ["a", "b"], "left_anti"), number, PREFIXES))
        tried = pairs if tried is None else tried.union(pairs)
        new = written(verified(pairs, number, classes, num, den), "links")
        links = new if links is None else links.union(new)
        return new

    for turn in range(ROUNDS):
        # the class with the fewest rarer n-grams is the one least changed; later rounds take others, so that parts meet in new places
        order = F.struct((F.col("n") - F.col("rest") if turn == 0 else F.xxhash64("sig", F.lit(turn))).alias("order"), *value)
        heads = checkpoint(few(rows.groupBy(F.col("key").alias("head")).agg(F.min(order).alias("o")), size, PREFIXES))
        met = rows.alias("e").join(heads, (F.col("key") == F.col("head")) & (F.col("e.part") != F.col("o.part")) & _possible(num, den))
        new = verify(few(_pairs(few(met, size, PREFIXES)), size, PREFIXES))
        if new.isEmpty():
            break
        parts_of = components(links)
        rows = rows.join(parts_of, F.col("sig") == F.col("id"), "left").withColumn("part", F.coalesce("component", "part")).drop("id", "component")
        rows = _mixed(written(few(rows, size, PREFIXES), "prefixes"), size)
    rows, other = _crossing(rows, size)
    other = other.select(F.struct(*value).alias("o"), F.col("key").alias("other"))
    crossing = ((F.col("e.part") == F.col("e.largest")) | (F.col("e.part") < F.col("o.part"))) & (F.col("e.part") != F.col("o.part"))
    verify(_pairs(rows.alias("e").join(other, (F.col("e.key") == F.col("other")) & crossing & _possible(num, den))))
    return components(links).select(F.col("id").alias("sig"), "component")


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: <id_col>, n_shingles, component_id.

    Texts link when den * |intersection| >= num * |union| of their sets of n-grams of `size` words; component_id is the smallest id that
    links reach, the own one included. Null and empty texts and texts without words have an empty set and stand alone.
    Repeated rows and equal sets are one class, whatever their number. Null ids stay null and count as no id: a class of such rows alone
    has a null component_id. Other columns are not read. An empty table gives no rows.
    """
    sets = checkpoint(document_sets(docs, size, id_col, text_col))
    links = linked_classes(docs, size, num, den, text_col)
    least = checkpoint(sets.where("n > 0").groupBy("sig", "n").agg(F.min("id").alias("least")))
    joined = written(least.join(links, "sig", "left").select("sig", "n", "least", F.coalesce("component", "sig").alias("component")), "classes")
    wide = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(joined.join(checkpoint(wide), "component").select("sig", "n", "component_id"), "classes")
    full = sets.where("n > 0").join(named, ["sig", "n"]).select("id", "n", "component_id")
    return full.union(sets.where("n = 0").select("id", "n", "id")).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the smallest doc_id.

    Rows that repeat a doc_id stay or go together; rows with a null doc_id stay. All columns are kept as they are.
    """
    groups = jaccard_components(docs, size, num, den)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85, 100)
