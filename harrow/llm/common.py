"""What the training-data operators share: checkpoints, word hashing, sampling and sharding helpers."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share; where it is unset, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="checkpoints-")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in a new place of the shared folder, read again.

    It cuts the lineage as checkpoint() does, and the estimate of the size too: that of a checkpoint is the one of the plan behind it,
    for a join the product of both sides, so in a loop of joins its digits double with each turn until they fill the driver.
    """
    path = posixpath.join(shared_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of df in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Tasks that small tables are still cut into.
LEAST_TASKS = 8


def few(df: DataFrame, rows: int, share: int) -> DataFrame:
    """df in a task for each `share` of its rows, `rows` at most in all. Put behind a shuffle, it merges small partitions of that shuffle; none are added."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // share)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards(spark: SparkSession) -> int:
    """Number of shards for a packed shuffle: the session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Classes of bytes: 0 separates tokens; neighbouring bytes of one other class belong together.
WORDS = np.ones(256, np.uint8)
WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SLICE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_factors = np.empty(0, np.uint64)


def _factors_to(n: int) -> np.ndarray:
    """An odd factor for each position in a token, each drawn for itself; those below n."""
    global _factors
    if len(_factors) < n:
        _factors = mix(np.arange(1 << (n - 1).bit_length(), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    return _factors


def tokens_of(texts: list[bytes], classes: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of texts, in order, and for each text the index of its first token (and the total at the end).

    A token is a maximal run of bytes of one class other than 0; A-Z count as a-z. A hash is the sum of each byte's random
    number times the random factor of its position, modulo 2**64, then mixed: there is no base whose powers repeat, so no family of words
    meets by construction, and two words meet with a chance of 2**-60 or so. No step goes word by word. Texts are worked on in
    slices that end at a separator.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    hashes, starts, at = [], [], 0
    while at < len(data):
        size = _SLICE
        while True:
            end = min(at + size, len(data))
            kind = classes[data[at:end]]
            gaps = [] if end == len(data) else np.flatnonzero(kind[-4096:] == 0)
            if end == len(data):
                break
            if len(gaps):
                end = at + max(0, len(kind) - 4096) + int(gaps[-1]) + 1
                kind = kind[: end - at]
                break
            size *= 2
        edges = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(kind)]))
        first, counts = edges[:-1], np.diff(edges)
        place = np.arange(len(kind), dtype=np.int32) - np.repeat(first.astype(np.int32), counts)
        values = _VALUES[data[at:end]]
        values *= _factors_to(int(counts.max()))[place]
        keep = kind[first] != 0
        hashes.append(mix(np.add.reduceat(values, first)[keep]))
        starts.append(first[keep] + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begins)


def hash_of(word: bytes) -> int:
    return int(tokens_of([word])[0][0])


def texts_of(column) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null: empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def parts(batch, rows: int = 512):
    """Slices of a record batch, so that what is made from the texts of one slice stays small."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def training_ids(rows: DataFrame, strata: str, per_stratum: int) -> DataFrame:
    """A bounded, stratified sample of rows (id, <strata>): columns <strata>, rank, n.

    Every stratum is split into per_stratum buckets by a hash of the id, and the row with the smallest second hash of the
    id in each bucket is kept, as rank = xxhash64(id, 7); n is the number of rows of the bucket. This is one hash aggregate over fixed-width
    columns, so texts are neither read nor moved, and the result doesn't depend on the order or partitioning of the rows.
    """
    bucket = F.pmod(F.xxhash64("id"), F.lit(per_stratum))
    rows = rows.where(F.col("id").isNotNull() & F.col(strata).isNotNull())
    return rows.groupBy(strata, bucket.alias("bucket")).agg(F.min(F.xxhash64("id", F.lit(7))).alias("rank"), F.count(F.lit(1)).alias("n")).drop("bucket")


def fold_of(column: str, modulus: int):
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
