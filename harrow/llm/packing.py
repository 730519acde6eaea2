"""Packing of documents into windows of a fixed number of tokens by best-fit decreasing.

encode_pieces() turns each document into ids and cuts it into full windows and one remainder. layout() places pieces:
full windows stand alone; remainders are placed, longest first, into the open window with the least sufficient room,
found by a segment tree indexed by remaining capacity. Ids do not move for the layout unless the caller keeps them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm.common import table

WINDOW = 2048
END_ID = 1
#: Pieces placed together; bounds the memory of a task. Each block leaves at most a few windows partly filled.
BLOCK = 1 << 18


class CapacityTree:
    """Open windows by remaining room: a segment tree over 0..capacity whose nodes count the windows below them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: dict[int, list[int]] = {}

    def _add(self, room: int, step: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += step
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows.setdefault(room, []).append(window)
        self._add(room, 1)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """The window with the least room of at least size, removed from the tree, with its room."""
        count, node = self.count, size + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences. lengths must be in descending order, at most window each."""
    tree, opened = CapacityTree(window), 0
    sequence, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        found = tree.take_tightest(size) if size < window else None
        if found is None:
            room, at = window, opened
            opened += 1
        else:
            room, at = found
        sequence[i], offset[i] = at, window - room
        if room > size:
            tree.put(room - size, at)
    return sequence, offset, opened


class Encoder:
    """Ids of texts as little-endian uint32 bytes, the same as the tokenizer file gives for the whole text.

    Common texts go through the byte-level BPE of tiktoken over the file's own vocabulary, which is five times as
    fast and gives the same ids. Texts that may hold a special token, or letters whose class may differ between the two
    libraries' Unicode tables, go through the tokenizers library itself.
    """

    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    PLAIN = re.compile(r"[^\x00-\u024f\u2010-\u2027]|<\|")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(map(shown.__getitem__, token)): i for token, i in self.tokenizer.get_vocab().items() if token not in special}
        self.fast = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def exact(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, text: str) -> bytes:
        ids = self.exact(text) if self.PLAIN.search(text) else self.fast.encode_to_numpy(text, disallowed_special=())
        return ids.astype("<u4", copy=False).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: <id_col>, start, length, doc_tokens, ids (binary, little-endian uint32).

    Null and empty texts give the end id alone. Repeated rows are encoded each for itself. A null id stays null.
    Other columns of docs are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, size = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), 4 * window
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows, start, length, total, ids = [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    data = enc.encode(text or "") + end
                    for at in range(0, len(data), size):
                        piece = data[at : at + size]
                        rows.append(row)
                        start.append(at // 4)
                        length.append(len(piece) // 4)
                        total.append(len(data) // 4)
                        ids.append(piece)
                long = pa.int64()
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array(start, long), pa.array(length, long), pa.array(total, long), pa.array(ids, pa.binary())], [id_col, "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def layout(pieces: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """pieces with sequence_id and offset; all other columns are kept.

    Pieces are dealt out by a hash of all of their fixed-width columns, so neither a hot document nor null ids meet
    in one task, and each task streams blocks of pieces, sorted by these columns, through best_fit_decreasing(). So a task that is
    done again gives the same layout. An empty table gives no rows.
    """
    deal = [f.name for f in pieces.schema.fields if not isinstance(f.dataType, T.BinaryType)]
    schema = T.StructType([f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, opened, held, rows = TaskContext.get().partitionId() << 36, 0, [], 0

        def place(tables: list[pa.RecordBatch], first: int) -> tuple[pa.Table, int]:
            whole = pa.Table.from_batches(tables)
            lengths = whole.column("length").to_numpy()
            order = np.lexsort((np.nan_to_num(whole.column("start").to_numpy()), -lengths))
            sequence, offset, n = best_fit_decreasing(lengths[order], window)
            placed = whole.take(pa.array(order)).select(names)
            return placed.append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset)), n

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block:
                out, n = place(held, base + opened)
                yield from out.to_batches(16_384)
                opened, held, rows = opened + n, [], 0
        if rows:
            yield from place(held, base + opened)[0].to_batches(16_384)

    return pieces.repartition(*[F.col(c) for c in deal]).sortWithinPartitions(*deal).mapInArrow(run, schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Layout of docs (doc_id, text) with a digest of the ids of each piece in place of the ids.

    Null and empty texts are one piece, the end id; rows with a null doc_id, and repeated rows, are packed each for itself; very long texts
    are cut into full windows. Other columns of docs are not read, and an empty table gives no rows.
    """
    pieces = encode_pieces(docs, tokenizer_path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return layout(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
