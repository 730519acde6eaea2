"""Where tables are: <root>/<format>/<set>/<table>/*.<extension>, listed in the order of their names."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession

# Names of encodings and compressors as they stand in format names and paths.
ENCODINGS = ("text", "csv", "json", "bincode", "cbor", "rmp", "cap", "pcap", "mcap", "pbuf", "columns", "parquet", "orc")
CODECS = ("none", "gz", "deflate", "snz", "lz4")
SETS = ("tiny", "1node", "5nodes")


@dataclass(frozen=True)
class Format:
    encoding: str
    codec: str = "none"

    @classmethod
    def parse(cls, name: str) -> Format:
        """A format from its name: an encoding, or an encoding and a codec with a hyphen between."""
        encoding, _, codec = name.partition("-")
        if encoding not in ENCODINGS or (codec or "none") not in CODECS:
            raise ValueError(f"unknown format {name!r}; encodings: {', '.join(ENCODINGS)}; codecs: {', '.join(CODECS)}")
        if encoding in ("parquet", "orc") and codec:
            raise ValueError(f"{encoding} has compression of its own")
        return cls(encoding, codec or "none")

    @property
    def name(self) -> str:
        return self.encoding if self.codec == "none" else f"{self.encoding}-{self.codec}"

    @property
    def extension(self) -> str:
        return self.codec if self.encoding == "text" and self.codec != "none" else self.name


def directory(root: str, fmt: str, dataset: str, table: str) -> str:
    return posixpath.join(root, Format.parse(fmt).name, dataset, table)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def chunks(path: str, fmt: str, limit: int | None = None) -> list[str]:
    """Chunks of a table's folder in the order of their names, the first `limit` only: files, or folders in the columns encoding."""
    kind = Format.parse(fmt)
    system, inside = filesystem(path)
    found = sorted(i.path for i in system.get_file_info(fs.FileSelector(inside)) if i.path.endswith(f".{kind.extension}") and (i.type == fs.FileType.Directory) == (kind.encoding == "columns"))
    return found if limit is None else found[:limit]


def shard(items: list, index: int, peers: int) -> list:
    """Every peers-th item, from the index-th."""
    if not 0 <= index < peers:
        raise ValueError(f"shard {index} of {peers}")
    return items[index::peers]


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return posixpath.join(root or tempfile.gettempdir(), f"harrow-{uuid.uuid4().hex}")
