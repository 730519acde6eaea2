"""Reading and writing of tables: Spark's own readers where a format is one of theirs, a data source of one task a chunk for the others."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from harrow.schemas import schema_of
from harrow.sources import catalog
from harrow.sources.catalog import Format
from harrow.sources.codecs import compress, decompress
from harrow.sources.encodings import RECORDS, Corrupt, column_decode, column_encode

BATCH = 8192
NATIVE = {("text", "none"), ("text", "deflate"), ("csv", "none"), ("json", "none"), ("parquet", "none"), ("orc", "none")}


@dataclass
class Chunk(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class ChunkReader(DataSourceReader):
    """columns: names of the columns that are wanted; with the columns encoding no others are read. mode permissive: a broken chunk ends at the break."""

    def __init__(self, schema: T.StructType, options: dict):
        self.full, self.options = schema_of(options["table"]), options
        self.schema = schema
        self.format = Format.parse(options["format"])

    def partitions(self) -> list[Chunk]:
        limit = self.options.get("chunks")
        found = catalog.chunks(self.options["path"], self.format.name, int(limit) if limit else None)
        if "peers" in self.options:
            found = catalog.shard(found, int(self.options["index"]), int(self.options["peers"]))
        return [Chunk(p) for p in found]

    def read(self, partition: Chunk | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark reads a table without chunks so
            return
        system, _ = catalog.filesystem(self.options["path"])
        names = self.schema.names
        kinds = [{"string": pa.string(), "bigint": pa.int64(), "float": pa.float32()}[f.dataType.simpleString()] for f in self.schema.fields]

        def content(path: str) -> bytes:
            with system.open_input_stream(path, compression=None) as file:
                return decompress(file.read(), self.format.codec)

        def batch(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        if self.format.encoding == "columns":
            columns = []
            for name in names:
                i = self.full.names.index(name)
                columns.append(column_decode(content(posixpath.join(partition.path, f"col-{i:03d}")), self.full.fields[i]))
            if len(set(map(len, columns))) > 1:
                raise Corrupt(f"columns of different lengths in {partition.path}")
            for at in range(0, len(columns[0]) if columns else 0, BATCH):
                yield batch([c[at : at + BATCH] for c in columns])
            return
        wanted, held = [self.full.names.index(n) for n in names], []
        rows = RECORDS[self.format.encoding][1](content(partition.path), self.full)
        while True:
            try:
                held.append(next(rows))
            except StopIteration:
                break
            except Corrupt:
                if self.options.get("mode") != "permissive":
                    raise
                break
            if len(held) == BATCH:
                yield batch([[r[i] for r in held] for i in wanted])
                held = []
        if held:
            yield batch([[r[i] for r in held] for i in wanted])


class ChunkStream(DataSourceStreamReader):
    """Chunks as a stream, in the order of their names: `first` of them (by default all that are there) in the first epoch, then one in each, or what has arrived.

    An offset is a number of chunks, so later chunks must have later names.
    """

    def __init__(self, schema: T.StructType, options: dict):
        self.chunks, self.first, self.given = ChunkReader(schema, options), int(options.get("first", 0)), 0

    def initialOffset(self) -> dict:
        return {"chunks": 0}

    def latestOffset(self) -> dict:
        there = len(self.chunks.partitions())
        if self.first:
            self.given = min(there, self.given + 1 if self.given else self.first)
        return {"chunks": self.given if self.first else there}

    def partitions(self, start: dict, end: dict) -> list[Chunk]:
        self.given = max(self.given, end["chunks"])
        return self.chunks.partitions()[start["chunks"] : end["chunks"]]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        return self.chunks.read(partition)


class ChunkWriter(DataSourceArrowWriter):
    """A chunk for each task with rows. Chunks are written under another name and take their own when all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.schema, self.format = schema_of(options["table"]), Format.parse(options["format"])
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        table = [b for b in iterator if b.num_rows]
        if not table:
            return Written(None)
        columns = pa.Table.from_batches(table).select(self.schema.names)
        if any(c.null_count for c in columns.columns):
            raise ValueError("a null; no column of these tables has any")
        system, root = catalog.filesystem(self.options["path"])
        task = TaskContext.get()
        target = posixpath.join(root, f".{self.job}-{task.partitionId():06d}-{task.attemptNumber()}")

        def put(path: str, data: bytes) -> None:
            with system.open_output_stream(path, compression=None) as file:
                file.write(compress(data, self.format.codec))

        lists = [c.to_pylist() for c in columns.columns]
        if self.format.encoding == "columns":
            system.create_dir(target, recursive=True)
            for i, (values, field) in enumerate(zip(lists, self.schema.fields, strict=True)):
                put(posixpath.join(target, f"col-{i:03d}"), column_encode(values, field))
        else:
            system.create_dir(root, recursive=True)
            put(target, RECORDS[self.format.encoding][0](zip(*lists, strict=True), self.schema))
        return Written(target)

    def commit(self, messages: list) -> None:
        system, root = catalog.filesystem(self.options["path"])
        system.create_dir(root, recursive=True)
        old = catalog.chunks(self.options["path"], self.format.name) if self.overwrite else []
        for i, message in enumerate(sorted((m.path for m in messages if m and m.path))):
            system.move(message, posixpath.join(root, f"{self.job}-{i:06d}.{self.format.extension}"))
        for path in old:  # only now: if this ends halfway, old and new chunks are there, and none is lost
            (system.delete_dir if self.format.encoding == "columns" else system.delete_file)(path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """What attempts of this job left that failed or came second goes."""
        system, root = catalog.filesystem(self.options["path"])
        for i in system.get_file_info(catalog.fs.FileSelector(root, allow_not_found=True)):
            if i.base_name.startswith(f".{self.job}-"):
                (system.delete_dir if i.type == catalog.fs.FileType.Directory else system.delete_file)(i.path)


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "harrow"

    def schema(self) -> T.StructType:
        full, columns = schema_of(self.options["table"]), self.options.get("columns")
        return T.StructType([full[c.strip()] for c in columns.split(",")]) if columns else full

    def reader(self, schema: T.StructType) -> ChunkReader:
        return ChunkReader(schema, dict(self.options))

    def streamReader(self, schema: T.StructType) -> ChunkStream:
        return ChunkStream(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(dict(self.options), overwrite)


#: A quoted field may hold line breaks, so a file is one task, as a chunk is everywhere else. Spark takes an empty field for null. The separator is
#: given, or Spark would guess it from what is quoted too; of lines that end in two characters the last field, a number, has one.
LAST = "duration"
CSV = {"header": False, "multiLine": True, "lineSep": "\n", "charToEscapeQuoteEscaping": "\uffff", "quote": '"', "escape": '"', "emptyValue": "", "positiveInf": "inf", "negativeInf": "-inf", "nanValue": "nan"}


def _whole(field: T.StructField) -> Column:
    """A column of a CSV file as the table has it, without nulls: an empty field is an empty text, and no number."""
    value, text = F.col(field.name), isinstance(field.dataType, T.StringType)
    if field.name == LAST:
        value = F.rtrim(value, F.lit("\r")).cast(field.dataType)
    missing = F.lit("") if text else F.raise_error(F.lit(f"an empty field in {field.name}")).cast(field.dataType)
    return F.coalesce(value, missing).alias(field.name)


def read_table(spark: SparkSession, path: str, table: str, fmt: str, columns: list[str] | None = None, chunks: int | None = None, shard: tuple[int, int] | None = None, mode: str = "strict") -> DataFrame:
    """The table in the folder path. chunks: the first so many only, by name; shard: (index, peers); columns: those wanted, all by default."""
    kind, schema = Format.parse(fmt), schema_of(table)
    wanted = columns or schema.names
    if (kind.encoding, kind.codec) in NATIVE:
        found = catalog.chunks(path, fmt, chunks) if chunks is not None or shard else None
        found = catalog.shard(found, *shard) if shard else found
        if found is not None and not found:
            return spark.createDataFrame([], schema).select(*wanted)
        system = path.partition("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
        if kind.encoding in ("text", "csv"):
            schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == LAST else f for f in schema.fields])
        reader = spark.read.schema(schema).option("mode", "PERMISSIVE" if mode == "permissive" else "FAILFAST")
        encoding = "csv" if kind.encoding == "text" else kind.encoding
        rows = reader.options(**(CSV if encoding == "csv" else {})).format(encoding).load([system + p for p in found] if found is not None else path)
        return rows.select(*[_whole(schema_of(table)[c]) for c in wanted]) if encoding == "csv" else rows.select(*wanted)
    spark.dataSource.register(ChunkSource)
    reader = spark.read.format("harrow").options(path=path, table=table, format=fmt, mode=mode, columns=",".join(wanted))
    if chunks is not None:
        reader = reader.option("chunks", chunks)
    if shard:
        reader = reader.options(index=shard[0], peers=shard[1])
    return reader.load()


def stream_table(spark: SparkSession, path: str, table: str, fmt: str, columns: list[str] | None = None, first: int | None = None, chunks: int | None = None) -> DataFrame:
    """The chunks of a table as a stream, of any format but parquet and orc (which Spark streams itself): `first` chunks in the first epoch, then one in each; without first, what has arrived."""
    if Format.parse(fmt).encoding in ("parquet", "orc"):
        raise ValueError(f"{fmt} is streamed by Spark's own reader")
    spark.dataSource.register(ChunkSource)
    reader = spark.readStream.format("harrow").options(path=path, table=table, format=fmt, columns=",".join(columns or schema_of(table).names))
    for name, value in (("first", first), ("chunks", chunks)):
        reader = reader.option(name, value) if value is not None else reader
    return reader.load()


def write_table(df: DataFrame, path: str, table: str, fmt: str, mode: str = "overwrite") -> None:
    """Write the columns of a table; the old chunks go in mode overwrite. The number of chunks is that of df's partitions."""
    kind, schema = Format.parse(fmt), schema_of(table)
    df = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
    if kind.encoding in ("parquet", "orc"):
        df.write.mode(mode).format(kind.encoding).save(path)
        return
    df.sparkSession.dataSource.register(ChunkSource)
    df.write.format("harrow").mode(mode).options(path=path, table=table, format=fmt).save()


def repack(spark: SparkSession, root: str, dataset: str, table: str, source: str, target: str) -> None:
    """A table of one format written in another, in the same tree."""
    if Format.parse(target).encoding == "text":
        raise ValueError("text is a format of sources only")
    df = read_table(spark, catalog.directory(root, source, dataset, table), table, source)
    write_table(df, catalog.directory(root, target, dataset, table), table, target)
