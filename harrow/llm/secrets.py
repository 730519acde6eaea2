"""Secrets in texts, also inside nested encodings.

A worklist of layers starts with the text itself. Each layer is scanned, and every decoding of it that yields text becomes
a further layer: percent escapes, Unicode escapes (also \\x, \\U and braces) and ASCII in UTF-16 in place, base64 runs (over line breaks, at each alignment) by themselves.
Compressed data in these is unfolded and worked on as a stream of pieces, whatever its length.
A layer keeps, for each of its characters, the span of the original text that it came from, so a finding at any depth maps
back. Bytes that are no text don't spoil the text around them. A layer with the same text from the same place is not worked on twice, which ends cycles; the list is then at a fixpoint.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm.common import parts, table

# Kinds in the order of their listing, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: An escape of one character: four or eight digits, digits in braces, or two digits.
ONE = r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|u\{([0-9A-Fa-f]{1,6})\}|x([0-9A-Fa-f]{2}))"
UNICODE = re.compile(re.sub(r"\((?!\?)", "(?:", ONE) + "(?:" + re.sub(r"\((?!\?)", "(?:", ONE) + ")*")
ONE_ESCAPE = re.compile(ONE)
#: ASCII in UTF-16, with either byte first.
WIDE = re.compile("(?:[\t\n\r -~]\x00){8,}|(?:\x00[\t\n\r -~]){8,}")
#: A run of base64, over line breaks too; it begins with 16 characters in a row or at the end of a line.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-]{1,15}[ \t]*[\r\n])[A-Za-z0-9+/_-]++(?:[ \t]*+[\r\n][ \t\r\n]*+[A-Za-z0-9+/_-]++)*+={0,2}")
#: How compressed data begins.
HEADER = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
LEAST = 16  # characters of a run
#: What decoded bytes need to hold for a finding or a further layer; most decodings at a wrong alignment hold none of it.
NEEDED = re.compile(rb"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}|%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|(?:[\t\n\r -~]\x00){8}|[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-][ \t]*[\r\n]")
LONE = re.compile("[\ud800-\udfff]+")
URL_SAFE = bytes.maketrans(b"-_", b"+/")
#: Compressed data is unfolded and scanned in pieces of so many bytes that overlap by so many; what is read of it at once, and the longest header.
PIECE, OVERLAP, SLICE, HEAD = 1 << 20, 1 << 16, 1 << 12, 6
WINDOW = 1 << 27  # zstd's own bound for what a reader keeps of a frame
SKIPPED = re.compile(rb"[\x50-\x5f]\x2a\x4d\x18")  # a zstd frame without data
IN_BYTES = {kind: re.compile(p.pattern.encode(), p.flags & ~re.UNICODE) for kind, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))}
ZEROS = re.compile(rb"\x00*")
BLANK = b" \t\r\n"
ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})|" + ONE.encode())
PARTIAL = re.compile(rb"(?:%[0-9A-Fa-f]?|\\(?:u[0-9A-Fa-f]{0,3}|u\{[0-9A-Fa-f]{0,6}|U[0-9A-Fa-f]{0,7}|x[0-9A-Fa-f]?)?)\Z")
LONGEST = 10  # characters of an escape
RUN = re.compile(BASE64.pattern.replace("[\\r\\n])", "(?:[\\r\\n]|\\Z))", 1).encode())
MORE = re.compile(rb"(?:[A-Za-z0-9+/_-]++|[ \t]*+[\r\n][ \t\r\n]*+(?=[A-Za-z0-9+/_-]))*+")
LISTED = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("layer", T.StringType())]))


def scan(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each kind as (start, end, kind), by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


@dataclass
class Layer:
    text: str
    path: str  # decoders on the way here, "" for the text itself
    start: np.ndarray | None = None  # for each character, its place in the original text; None: the text itself
    end: np.ndarray | None = None
    made: np.ndarray | None = None  # whether the character came out of a decoder

    def spans(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.start is None:
            at = np.arange(a, b)
            return at, at + 1, np.zeros(b - a, bool)
        return self.start[a:b], self.end[a:b], self.made[a:b]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def byte_counts(text: str) -> np.ndarray:
    """Number of bytes that each character of readable()'s result came from; a lone surrogate stands for one bad byte."""
    codes = code_points(text)
    size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    size[(codes >= 0xDC80) & (codes <= 0xDCFF)] = 1
    return size


def percent_characters(run: str) -> list[tuple[str, int]] | None:
    """Characters of a run of %XX with the number of source characters of each, bad bytes as lone surrogates; None if all are bad."""
    text = readable(bytes.fromhex(run.replace("%", "")))
    return None if LONE.fullmatch(text) else list(zip(text, (3 * byte_counts(text)).tolist(), strict=True))


def unicode_characters(run: str) -> list[tuple[str, int]] | None:
    """Characters of a run of escapes with the number of source characters of each: surrogate pairs joined, lone surrogates and numbers that are no character as lone surrogates; None if all are."""
    out: list[tuple[str, int]] = []
    for m in ONE_ESCAPE.finditer(run):
        code, size = int(next(filter(None, m.groups())), 16), len(m[0])
        if 0xDC00 <= code < 0xE000 and out and "\ud800" <= out[-1][0] < "\udc00":
            high, before = out.pop()
            code, size = 0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00, before + size
        out.append((chr(code) if code <= 0x10FFFF else "\udfff", size))
    return None if LONE.fullmatch("".join(c for c, _ in out)) else out


def wide_characters(run: str) -> list[tuple[str, int]]:
    """Characters of a run of UTF-16, two source characters each."""
    return [(c, 2) for c in run.replace("\x00", "")]


def escaped(m: re.Match) -> bytes:
    """What one escape in bytes stands for; itself, if it is no character."""
    if m[1]:
        return bytes([int(m[1], 16)])
    code = int(next(filter(None, m.groups()[1:])), 16)
    return chr(code).encode("utf-8", "surrogatepass") if code <= 0x10FFFF else m[0]


def in_place(layer: Layer, name: str, pattern: re.Pattern, characters) -> Iterator[Layer]:
    """The layer with all runs of pattern decoded."""
    pieces, arrays, at = [], [], 0
    for m in pattern.finditer(layer.text):
        if (decoded := characters(m[0])) is None:
            continue
        pieces += [layer.text[at : m.start()], "".join(c for c, _ in decoded)]
        arrays.append(layer.spans(at, m.start()))
        begin, finish, _ = layer.spans(m.start(), m.end())
        stop = np.cumsum([n for _, n in decoded])
        arrays.append((begin[stop - [n for _, n in decoded]], finish[stop - 1], np.ones(len(decoded), bool)))
        at = m.end()
    if at:
        pieces.append(layer.text[at:])
        arrays.append(layer.spans(at, len(layer.text)))
        yield Layer("".join(pieces), f"{layer.path}/{name}", *(np.concatenate(x) for x in zip(*arrays, strict=True)))


def reader(head: bytes):
    """A decompressor for data that begins with head; None if there is none."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78":
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd" or SKIPPED.match(head):
        import zstandard

        return zstandard.ZstdDecompressor(max_window_size=WINDOW).decompressobj()
    return None


class Unfolding:
    """Compressed data that comes piece by piece: its members one after the other, as one stream of bytes.

    What the data gave before it broke or ended counts too. But two bytes, as zlib's header has, are met by chance in other
    data, and what that seems to unfold to has runs of one character: where it broke in its first member, hex doesn't count.
    """

    def __init__(self, path: str, found: dict[str, str], met: frozenset[int] = frozenset()):
        self.all, self.found = found, {}
        self.out = Stream(path, self.found, met)
        self.tool, self.held, self.used, self.done, self.doubtful = None, b"", 0, False, False

    def feed(self, data: bytes, last: bool = False, at: int = 0) -> None:
        """Takes data[at:]; used is then the place in data behind the last member that ended there."""
        if self.held:
            data, at, self.held = self.held + data[at:], 0, b""
        while at < len(data) and not self.done:
            if self.tool is None:
                if self.used:
                    at = ZEROS.match(data, at).end()  # padding between members
                if len(data) - at < HEAD and not last:
                    self.held = data[at:]
                    return
                head = data[at : at + HEAD]
                if (HEADER.match(head) or (self.used and SKIPPED.match(head))) is None or (tool := reader(head)) is None:
                    self.done = True
                    break
                self.tool, self.gzip = tool, head[:1] == b"\x1f"
            at = self.member(data, at)
        if last or self.done:
            self.done = True
            self.out.close()
            for kind, path in self.found.items():
                if not (self.doubtful and kind == "hex"):
                    self.all.setdefault(kind, path)

    def member(self, data: bytes, at: int) -> int:
        """Reads on in one member; the place in data behind what was read."""
        tool, zipped = self.tool, hasattr(self.tool, "copy")
        step = SLICE if zipped else 1  # one byte at a time, what stands before a break is not lost
        while at < len(data) and not tool.eof:
            piece, before = data[at : at + step], tool.copy() if zipped and step > 1 else None
            rest = piece
            while rest is not None and not tool.eof:
                try:
                    got, rest = unfold(tool, rest)
                except Exception as error:  # each library has errors of its own for data that only looks compressed
                    if isinstance(error, MemoryError):
                        raise
                    if before is None:
                        self.done, self.doubtful = True, zipped and not self.used and not self.gzip
                        return len(data)
                    tool, step = before, 1
                    break
                self.out.feed(got)
            else:
                at += len(piece)
            self.tool = tool
        if tool.eof:
            at -= len(tool.unused_data)
            self.used, self.tool = at, None
        return at


def unfold(tool, data: bytes) -> tuple[bytes, bytes | None]:
    """At most PIECE bytes out of data (a few hundred thousand with zstd), and what is left to read of it; None if nothing."""
    if hasattr(tool, "copy"):
        got = tool.decompress(data, PIECE)
        return got, tool.unconsumed_tail if tool.unconsumed_tail or len(got) == PIECE else None
    if hasattr(tool, "needs_input"):
        got = tool.decompress(data, PIECE)
        return got, None if tool.needs_input else b""
    return tool.decompress(data), None


class Stream:
    """A layer inside compressed data, worked on in pieces of PIECE bytes that overlap by OVERLAP, at any length of the whole.

    All that is found in it stands at the same place of the original text, so only the first layer with each kind is kept, in
    found. Its decodings are streams too; both kinds of escapes are decoded at once.
    """

    def __init__(self, path: str, found: dict[str, str], met: frozenset[int] = frozenset()):
        self.path, self.found, self.met = path, found, met  # met: compressed data around this, so that what unfolds to itself ends
        self.wait = bytearray()
        self.tail = self.partial = self.edge = b""
        self.inner: Stream | None = None  # with the escapes decoded
        self.run: list[list] | None = None  # a base64 run that goes on: for each alignment its stream and characters to come
        self.open: list[Unfolding] = []

    def feed(self, data: bytes) -> None:
        self.wait += data
        if len(self.wait) >= PIECE:
            self.work(False)

    def close(self) -> None:
        self.work(True)

    def work(self, last: bool) -> None:
        new = bytes(self.wait)
        self.wait.clear()
        for kind in () if len(self.found) == len(KINDS) else kinds_in(self.tail + new):
            self.found.setdefault(kind, self.path)
        self.escapes(new, last)
        self.runs(new, last)
        self.compressed(new, last)
        self.tail = (self.tail + new)[-OVERLAP:]

    def escapes(self, new: bytes, last: bool) -> None:
        before, text, self.partial = self.tail[: len(self.tail) - len(self.partial)], self.partial + new, b""
        if not last and (m := PARTIAL.search(text, max(0, len(text) - LONGEST))):
            text, self.partial = text[: m.start()], m[0]
        if self.inner is None and (m := ESCAPE.search(text)):
            self.inner = Stream(f"{self.path}/{'percent' if m[0][:1] == b'%' else 'unicode'}", self.found, self.met)
            self.inner.feed(before)
        if self.inner is not None:
            self.inner.feed(ESCAPE.sub(escaped, text))
            if last:
                self.inner.close()

    def runs(self, new: bytes, last: bool) -> None:
        data, self.edge, at = self.edge + new, b"", 0
        end = len(data) if last else len(data.rstrip(BLANK))
        blank = (b"\n" if {*data[end:]} & {10, 13} else b" ") if end < len(data) else b""
        if self.run is not None:
            at = MORE.match(data).end()
            going = at >= end and not last
            self.read(data[:at], not going)
            if going:
                self.edge = blank
                return
        for m in RUN.finditer(data, at):
            if m.end() >= end and not last:
                if len(m[0]) < OVERLAP:
                    self.edge = m[0] + blank
                else:
                    self.edge = blank
                    self.read(m[0], False)
            else:
                self.read(m[0], True)

    def read(self, run: bytes, ended: bool) -> None:
        """Reads on in a run of base64, as each alignment has it."""
        run = run.translate(URL_SAFE, BLANK + b"=")
        if self.run is None:
            if ended:
                for _, data in aligned(run) if len(run) >= LEAST else ():
                    if NEEDED.search(data) or HEADER.search(data):
                        child = Stream(f"{self.path}/base64", self.found, self.met)
                        child.feed(data)
                        child.close()
                return
            self.run = [[Stream(f"{self.path}/base64", self.found, self.met), b"", k] for k in range(4)]
        for state in self.run:
            child, rest, skip = state
            text = rest + run[skip:]
            whole = len(text) - len(text) % 4
            child.feed(base64.b64decode(text[:whole]))
            state[1:] = text[whole:], 0
            if ended:
                if len(state[1]) > 1:
                    child.feed(base64.b64decode(state[1] + b"=" * (4 - len(state[1]))))
                child.close()
        if ended:
            self.run = None

    def compressed(self, new: bytes, last: bool) -> None:
        for x in self.open:
            x.feed(new, last)
        self.open = [x for x in self.open if not x.done]
        held = self.tail[len(self.tail) - HEAD + 1 :] if len(self.tail) >= HEAD else self.tail
        data, at = held + new, 0
        for m in HEADER.finditer(data):
            if m.start() < at or m.end() <= len(held):
                continue
            mark = hash(data[m.start() :]) if last else 0
            if mark in self.met:
                continue
            x = Unfolding(f"{self.path}/compressed", self.found, self.met | {mark} if last else self.met)
            x.feed(data, last, m.start())
            if not x.done:
                self.open.append(x)
            at = x.used


def kinds_in(data: bytes) -> Iterator[str]:
    if (b":" in data or b"=" in data) and any(len(m[1]) >= 8 for m in IN_BYTES["assign"].finditer(data)):
        yield "assign"
    if b"AKIA" in data and IN_BYTES["access"].search(data):
        yield "access"
    if IN_BYTES["hex"].search(data):
        yield "hex"


def unfolded(data: bytes, path: str) -> Iterator[tuple[int, int, dict[str, str]]]:
    """The compressed data in data: where it begins and ends, and the kinds of secrets in it with the first layer of each."""
    end = 0
    for m in HEADER.finditer(data):
        if m.start() >= end:
            found: dict[str, str] = {}
            x = Unfolding(path, found)
            x.feed(data, True, m.start())
            end = x.used
            if found:
                yield m.start(), end if end and x.tool is None else len(data), found


def readable(data: bytes) -> str:
    """data as text; each byte that isn't UTF-8 becomes a lone surrogate, which ends any match."""
    return data.decode("utf-8", "surrogateescape")


def aligned(run: bytes) -> Iterator[tuple[int, bytes]]:
    """What a run of base64 without padding holds when read from each of its first four characters, as (character, bytes).

    What stands before the data, such as the path of a URL, is part of the run; every start further on is one of the four.
    """
    for k in range(min(4, len(run))):
        part = run[k : len(run) - ((len(run) - k) % 4 == 1)]
        yield k, base64.b64decode(part + b"=" * (-len(part) % 4))


def apart(layer: Layer, found: dict) -> Iterator[Layer]:
    """A layer for each base64 run and alignment; what the compressed data in them holds goes to found."""
    for m in BASE64.finditer(layer.text):
        characters = np.frombuffer(m[0].rstrip("=").encode(), np.uint8)
        kept = np.flatnonzero(characters > 0x20)
        if len(kept) < LEAST:
            continue
        begins = finishes = None
        for k, data in aligned(characters[kept].tobytes().translate(URL_SAFE)):
            inside = list(unfolded(data, f"{layer.path}/base64/compressed"))
            if not inside and not NEEDED.search(data):
                continue
            if begins is None:
                begins, finishes, _ = layer.spans(m.start(), m.end())
            begin, finish = begins[kept[k:]], finishes[kept[k:]]
            if text := readable(data):
                size = byte_counts(text)
                first = np.cumsum(size) - size
                start = begin[first * 8 // 6]
                end = finish[np.minimum(((first + size) * 8 + 5) // 6, len(begin)) - 1]
                yield Layer(text, f"{layer.path}/base64", start, end, np.ones(len(text), bool))
            for at, stop, kinds in inside:
                last = finishes[-1] if stop == len(data) else finish[(stop * 8 + 5) // 6 - 1]
                for kind, path in kinds.items():
                    found.setdefault((int(begin[at * 8 // 6]), int(last), kind), path)


def decodings(layer: Layer, found: dict) -> Iterator[Layer]:
    if "%" in layer.text:
        yield from in_place(layer, "percent", PERCENT, percent_characters)
    if "\\" in layer.text:
        yield from in_place(layer, "unicode", UNICODE, unicode_characters)
    if "\x00" in layer.text:
        yield from in_place(layer, "utf16", WIDE, wide_characters)
    yield from apart(layer, found)


def secrets_of(text: str) -> list[tuple[int, int, str, str]]:
    """All findings as (start, end, kind, layer) in the text's own code points; layer is empty for those of the text itself."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))  # streams within streams
    found = {(s, e, kind): "" for s, e, kind in scan(text)}
    work, seen = [Layer(text, "")], {(hash(text), len(text), 0, len(text))}
    while work:
        for layer in decodings(work.pop(), found):
            mark = (hash(layer.text), len(layer.text), int(layer.start[0]) if len(layer.start) else 0, int(layer.end[-1]) if len(layer.end) else 0)
            if mark in seen:
                continue
            seen.add(mark)
            work.append(layer)
            for s, e, kind in scan(layer.text):
                if layer.made[s:e].any():
                    found.setdefault((int(layer.start[s:e].min()), int(layer.end[s:e].max()), kind), layer.path)
    return sorted(((s, e, kind, layer) for (s, e, kind), layer in found.items()), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: <id_col>, secrets (array of kind, start, end, layer).

    Null and empty texts have no secrets; repeated rows give repeated results; a null id stays null. Texts, and what they unfold to, may be
    of any length. Raw deflate data, which has no header, is not unfolded, and UTF-16 not read within compressed data.
    Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("secrets", LISTED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layer", pa.string())]))
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e, "layer": layer} for s, e, k, layer in secrets_of(text.as_py() or "")] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], [id_col, "secrets"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def redacted(text: str, mark: str = "[REDACTED]") -> str:
    """text with each finding, overlapping ones as one, replaced by mark."""
    out, at = [], 0
    for s, e, *_ in secrets_of(text):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """docs with the secrets in their texts replaced and the number of characters put right; all other columns stay as they are.

    Null texts stay null with their count; empty texts and those without secrets stay as they are, of any length. Repeated rows give
    repeated results; overlapping findings are replaced as one; an empty table gives no rows.
    """
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                texts = [None if (t := x.as_py()) is None else redacted(t) for x in part.column(at)]
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                if count_col in names:
                    i = names.index(count_col)
                    counts = [n.as_py() if t is None else len(t) for t, n in zip(texts, part.column(i), strict=True)]
                    columns[i] = pa.array(counts, part.column(i).type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    written = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("secrets", lambda x: x["layer"] == "")

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.withColumn("base", base).select("doc_id", *map(count, KINDS), F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("secrets").alias("spans"))
