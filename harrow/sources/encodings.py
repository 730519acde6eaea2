"""Record encodings. Each has encode(rows, schema) and decode(data, schema): rows are tuples in the schema's order.

A reader ends where the data ends between two records. Data that ends or breaks inside of one raises Corrupt.
"""

from __future__ import annotations

import csv
import io
import json
import struct
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import types as T

Rows = Iterable[tuple]
LIMIT = 1 << 63


class Corrupt(ValueError):
    """Data that is no record of the table, or is cut off."""


class Input:
    """Bytes read in order."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def __bool__(self) -> bool:
        return self.at < len(self.data)

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Corrupt(f"data is cut off at byte {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> float:
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]


def _kind(field: T.StructField) -> str:
    return {"string": "str", "bigint": "u64", "float": "f32"}[field.dataType.simpleString()]


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError as error:
        raise Corrupt(str(error)) from error


def _checked(row: list, schema: T.StructType) -> tuple:
    """row with numbers as the schema has them."""
    if len(row) != len(schema.fields):
        raise Corrupt(f"{len(row)} values for {len(schema.fields)} columns")
    out = []
    for value, field in zip(row, schema.fields, strict=True):
        kind = _kind(field)
        try:
            value = str(value) if kind == "str" else int(value) if kind == "u64" else float(value)
        except (TypeError, ValueError) as error:
            raise Corrupt(str(error)) from error
        if kind == "u64" and not 0 <= value < LIMIT:
            raise OverflowError(f"{field.name} = {value} is not from 0 to 2**63 - 1")
        out.append(value)
    return tuple(out)


def _csv_field(value) -> str:
    """A field, quoted where it must be: empty texts too, so that they differ from nulls, and a mark that a reader might take for the file's byte order."""
    text = str(value)
    return '"' + text.replace('"', '""') + '"' if not text or text[0] == "\ufeff" or any(c in text for c in ',"\r\n') else text


def csv_encode(rows: Rows, schema: T.StructType) -> bytes:
    return "".join(",".join(map(_csv_field, row)) + "\n" for row in rows).encode()


def csv_decode(data: bytes, schema: T.StructType) -> Iterator[tuple]:
    """No line is taken as a header."""
    for row in csv.reader(io.StringIO(_text(data), newline="")):
        yield _checked(row, schema)


def json_encode(rows: Rows, schema: T.StructType) -> bytes:
    return "".join(json.dumps(dict(zip(schema.names, r, strict=True)), ensure_ascii=False, separators=(",", ":")) + "\n" for r in rows).encode()


def json_decode(data: bytes, schema: T.StructType) -> Iterator[tuple]:
    for line in _text(data).split("\n"):
        if line.strip():
            try:
                found = json.loads(line)
                yield _checked([found[n] for n in schema.names], schema)
            except (KeyError, TypeError, json.JSONDecodeError) as error:
                raise Corrupt(f"no record: {line[:80]}") from error


def bincode_encode(rows: Rows, schema: T.StructType) -> bytes:
    """Little-endian; texts have their length in 8 bytes in front; records follow each other without framing."""
    out, kinds = [], [_kind(f) for f in schema.fields]
    for row in rows:
        for value, kind in zip(row, kinds, strict=True):
            if kind == "str":
                out += [struct.pack("<Q", len(b := value.encode())), b]
            else:
                out.append(struct.pack("<Q" if kind == "u64" else "<f", value))
    return b"".join(out)


def bincode_decode(data: bytes, schema: T.StructType) -> Iterator[tuple]:
    source, kinds = Input(data), [_kind(f) for f in schema.fields]
    while source:
        yield _checked([_text(source.take(source.number("<Q"))) if k == "str" else source.number("<Q" if k == "u64" else "<f") for k in kinds], schema)


def _cbor_head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, kind, most in ((24, ">B", 1 << 8), (25, ">H", 1 << 16), (26, ">I", 1 << 32), (27, ">Q", 1 << 64)):
        if n < most:
            return bytes([major << 5 | code]) + struct.pack(kind, n)
    raise OverflowError(n)


def cbor_encode(rows: Rows, schema: T.StructType) -> bytes:
    """Records are maps of column names."""
    out, heads = [], [_cbor_head(3, len(n)) + n.encode() for n in schema.names]
    kinds = [_kind(f) for f in schema.fields]
    for row in rows:
        out.append(_cbor_head(5, len(heads)))
        for head, value, kind in zip(heads, row, kinds, strict=True):
            if kind == "str":
                b = value.encode()
                body = _cbor_head(3, len(b)) + b
            else:
                body = _cbor_head(0, value) if kind == "u64" else b"\xfa" + struct.pack(">f", value)
            out += [head, body]
    return b"".join(out)


def _cbor_item(source: Input):
    head = source.take(1)[0]
    major, n = head >> 5, head & 31
    if major == 7:
        if n in (25, 26, 27):
            return source.number({25: ">e", 26: ">f", 27: ">d"}[n])
        if n in (20, 21, 22):
            return {20: False, 21: True, 22: None}[n]
        raise Corrupt(f"CBOR item {head:#x}")
    if n >= 28:
        raise Corrupt(f"CBOR item {head:#x}")
    n = source.number({24: ">B", 25: ">H", 26: ">I", 27: ">Q"}[n]) if n >= 24 else n
    if major == 0:
        return n
    if major == 1:
        return -1 - n
    if major in (2, 3):
        return source.take(n) if major == 2 else _text(source.take(n))
    if major == 4:
        return [_cbor_item(source) for _ in range(n)]
    if major == 5:
        return {_cbor_item(source): _cbor_item(source) for _ in range(n)}
    return _cbor_item(source)  # a tag


def cbor_decode(data: bytes, schema: T.StructType) -> Iterator[tuple]:
    source = Input(data)
    while source:
        item = _cbor_item(source)
        if isinstance(item, dict):
            if not set(schema.names) <= set(item):
                raise Corrupt(f"a record without {', '.join(set(schema.names) - set(item))}")
            item = [item[n] for n in schema.names]
        if not isinstance(item, list):
            raise Corrupt("a record that is neither a map nor an array")
        yield _checked(item, schema)


def _mp_head(n: int, small: int, least: int, codes: tuple) -> bytes:
    if n < small:
        return bytes([least | n])
    for code, kind, most in codes:
        if n < most:
            return bytes([code]) + struct.pack(kind, n)
    raise OverflowError(n)


_MP_TEXT = ((0xD9, ">B", 1 << 8), (0xDA, ">H", 1 << 16), (0xDB, ">I", 1 << 32))
_MP_UINT = ((0xCC, ">B", 1 << 8), (0xCD, ">H", 1 << 16), (0xCE, ">I", 1 << 32), (0xCF, ">Q", 1 << 64))


def rmp_encode(rows: Rows, schema: T.StructType) -> bytes:
    """MessagePack; records are arrays in the order of the columns."""
    out, kinds = [], [_kind(f) for f in schema.fields]
    for row in rows:
        out.append(_mp_head(len(kinds), 16, 0x90, ((0xDC, ">H", 1 << 16),)))
        for value, kind in zip(row, kinds, strict=True):
            if kind == "str":
                b = value.encode()
                out += [_mp_head(len(b), 32, 0xA0, _MP_TEXT), b]
            else:
                out.append(_mp_head(value, 128, 0, _MP_UINT) if kind == "u64" else b"\xca" + struct.pack(">f", value))
    return b"".join(out)


_MP_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_MP_SIZED = {0xD9: ">B", 0xDA: ">H", 0xDB: ">I", 0xC4: ">B", 0xC5: ">H", 0xC6: ">I"}


def _mp_item(source: Input):
    head = source.take(1)[0]
    if head < 0x80:
        return head
    if head >= 0xE0:
        return head - 0x100
    if head in _MP_NUMBERS:
        return source.number(_MP_NUMBERS[head])
    if 0xA0 <= head < 0xC0 or head in _MP_SIZED:
        return _text(source.take(head & 31 if head < 0xC0 else source.number(_MP_SIZED[head])))
    if 0x90 <= head < 0xA0 or head in (0xDC, 0xDD):
        return [_mp_item(source) for _ in range(head & 15 if head < 0xA0 else source.number(">H" if head == 0xDC else ">I"))]
    if head in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[head]
    raise Corrupt(f"MessagePack item {head:#x}")


def rmp_decode(data: bytes, schema: T.StructType) -> Iterator[tuple]:
    source = Input(data)
    while source:
        item = _mp_item(source)
        if not isinstance(item, list):
            raise Corrupt("a record that is no array")
        yield _checked(item, schema)


def _message(row: tuple, kinds: list[str]) -> bytes:
    """A Cap'n Proto message of one struct in one segment. Numbers take a word each, in order; texts a pointer each."""
    numbers = [(v, k) for v, k in zip(row, kinds, strict=True) if k != "str"]
    texts = [v.encode() for v, k in zip(row, kinds, strict=True) if k == "str"]
    words = [struct.pack("<IHH", 0, len(numbers), len(texts))]
    words += [struct.pack("<Q", v) if k == "u64" else struct.pack("<fI", v, 0) for v, k in numbers]
    at, tail = len(texts), []
    for i, b in enumerate(texts):
        size = len(b) + 1
        words.append(struct.pack("<II", (at - i - 1) << 2 | 1, size << 3 | 2))
        padded = -(-size // 8) * 8
        tail.append(b.ljust(padded, b"\0"))
        at += padded // 8
    body = b"".join(words + tail)
    return struct.pack("<II", 0, len(body) // 8) + body


class Message:
    """A Cap'n Proto message: its segments, and reads across them."""

    def __init__(self, source: Input):
        count = source.number("<I") + 1
        if count > 512:
            raise Corrupt(f"{count} segments")
        sizes = [source.number("<I") for _ in range(count)]
        if count % 2 == 0:
            source.take(4)
        self.segments = [source.take(8 * n) for n in sizes]

    def word(self, segment: int, at: int) -> int:
        if segment >= len(self.segments) or not 0 <= at * 8 < len(self.segments[segment]):
            raise Corrupt("a pointer out of its message")
        return int.from_bytes(self.segments[segment][at * 8 : at * 8 + 8], "little")

    def follow(self, segment: int, at: int) -> tuple[int, int, int]:
        """Segment and place of what the pointer at a place is for, and the pointer that describes it. 0 is a null pointer."""
        pointer = self.word(segment, at)
        if pointer & 3 == 2:  # far
            pad, there = pointer >> 3 & 0x1FFFFFFF, pointer >> 32
            if pointer >> 2 & 1:
                far = self.word(there, pad)
                return far >> 32, far >> 3 & 0x1FFFFFFF, self.word(there, pad + 1)
            segment, at, pointer = there, pad, self.word(there, pad)
        offset = (pointer & 0xFFFFFFFF) >> 2
        return segment, at + 1 + (offset - (1 << 30) if offset >= 1 << 29 else offset), pointer

    def row(self, kinds: list[str]) -> list:
        segment, at, pointer = self.follow(0, 0)
        data, pointers = pointer >> 32 & 0xFFFF, pointer >> 48
        out, number, text = [], 0, 0
        for kind in kinds:
            if kind == "str":
                out.append(self.text(segment, at + data + text) if text < pointers else "")
                text += 1
            else:
                raw = self.word(segment, at + number) if number < data else 0
                out.append(raw if kind == "u64" else struct.unpack("<f", (raw & 0xFFFFFFFF).to_bytes(4, "little"))[0])
                number += 1
        return out

    def text(self, segment: int, at: int) -> str:
        where, begin, pointer = self.follow(segment, at)
        if not pointer:
            return ""
        size = pointer >> 35
        found = self.segments[where][8 * begin : 8 * begin + size - 1]
        if len(found) != size - 1:
            raise Corrupt("a text out of its message")
        return _text(found)


def cap_encode(rows: Rows, schema: T.StructType) -> bytes:
    kinds = [_kind(f) for f in schema.fields]
    return b"".join(_message(r, kinds) for r in rows)


def cap_decode(data: bytes, schema: T.StructType) -> Iterator[tuple]:
    source, kinds = Input(data), [_kind(f) for f in schema.fields]
    while source:
        yield _checked(Message(source).row(kinds), schema)


def packed(data: bytes) -> bytes:
    """Packing of words: a byte says which bytes of a word aren't 0, and these follow; then how many words of 0, or of any bytes, follow as they are."""
    out, at = bytearray(), 0
    while at < len(data):
        word = data[at : at + 8]
        at += 8
        tag = sum(1 << i for i, b in enumerate(word) if b)
        out.append(tag)
        out += bytes(b for b in word if b)
        if tag in (0, 0xFF):
            end = at
            while end < len(data) and end - at < 8 * 255 and (not any(data[end : end + 8]) if tag == 0 else data[end : end + 8].count(0) < 2):
                end += 8
            out.append((end - at) // 8)
            out += data[at:end] if tag else b""
            at = end
    return bytes(out)


def unpacked(data: bytes) -> bytes:
    source, out = Input(data), bytearray()
    while source:
        tag = source.take(1)[0]
        out += bytes(source.take(1)[0] if tag >> i & 1 else 0 for i in range(8))
        if tag in (0, 0xFF):
            n = 8 * source.take(1)[0]
            out += source.take(n) if tag else bytes(n)
    return bytes(out)


def pcap_encode(rows: Rows, schema: T.StructType) -> bytes:
    kinds = [_kind(f) for f in schema.fields]
    return b"".join(packed(_message(r, kinds)) for r in rows)


def pcap_decode(data: bytes, schema: T.StructType) -> Iterator[tuple]:
    return cap_decode(unpacked(data), schema)


def mcap_encode(rows: Rows, schema: T.StructType) -> bytes:
    """Messages, each with its length in words in front."""
    kinds = [_kind(f) for f in schema.fields]
    return b"".join(struct.pack("<Q", len(m) // 8) + m for m in (_message(r, kinds) for r in rows))


def mcap_decode(data: bytes, schema: T.StructType) -> Iterator[tuple]:
    source, kinds = Input(data), [_kind(f) for f in schema.fields]
    while source:
        yield _checked(Message(Input(source.take(8 * source.number("<Q")))).row(kinds), schema)


def _uvarint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def pbuf_encode(rows: Rows, schema: T.StructType) -> bytes:
    """Protocol buffers; the fields are numbered from 1; each record has its length in 2 bytes in front."""
    out, kinds = [], [_kind(f) for f in schema.fields]
    for row in rows:
        body = b""
        for i, (value, kind) in enumerate(zip(row, kinds, strict=True), 1):
            if kind == "str":
                b = value.encode()
                body += _uvarint(i << 3 | 2) + _uvarint(len(b)) + b
            else:
                body += _uvarint(i << 3) + _uvarint(value) if kind == "u64" else _uvarint(i << 3 | 5) + struct.pack("<f", value)
        if len(body) > 0xFFFF:
            raise OverflowError(f"a record of {len(body)} bytes; a length has 2 bytes")
        out += [struct.pack("<H", len(body)), body]
    return b"".join(out)


def _read_uvarint(source: Input) -> int:
    value = shift = 0
    while (b := source.take(1)[0]) > 127:
        value, shift = value | (b & 127) << shift, shift + 7
        if shift > 63:
            raise Corrupt("a number of more than 64 bits")
    return value | b << shift


def pbuf_decode(data: bytes, schema: T.StructType) -> Iterator[tuple]:
    source = Input(data)
    while source:
        record, found = Input(source.take(source.number("<H"))), {}
        while record:
            tag = _read_uvarint(record)
            if tag & 7 == 2:
                found[tag >> 3] = _text(record.take(_read_uvarint(record)))
            elif tag & 7 in (0, 1, 5):
                found[tag >> 3] = _read_uvarint(record) if not tag & 7 else record.number("<f" if tag & 7 == 5 else "<d")
            else:
                raise Corrupt(f"wire type {tag & 7}")
        if not set(range(1, len(schema.fields) + 1)) <= set(found):
            raise Corrupt("a record without all of its fields")
        yield _checked([found[i + 1] for i in range(len(schema.fields))], schema)


def column_encode(values: Iterable, field: T.StructField) -> bytes:
    """One column's file: numbers in 8 bytes (floats as doubles), texts with their length in 8 bytes in front."""
    kind = _kind(field)
    if kind == "str":
        return b"".join(struct.pack("<Q", len(b)) + b for b in (v.encode() for v in values))
    return b"".join(struct.pack("<Q" if kind == "u64" else "<d", v) for v in values)


def column_decode(data: bytes, field: T.StructField) -> list:
    source, kind, out = Input(data), _kind(field), []
    while source:
        out.append(_text(source.take(source.number("<Q"))) if kind == "str" else source.number("<Q" if kind == "u64" else "<d"))
    if kind == "u64" and any(v >= LIMIT for v in out):
        raise OverflowError(f"{field.name} is not below 2**63")
    return out


RECORDS: dict[str, tuple[Callable, Callable]] = {
    "text": (csv_encode, csv_decode),
    "csv": (csv_encode, csv_decode),
    "json": (json_encode, json_decode),
    "bincode": (bincode_encode, bincode_decode),
    "cbor": (cbor_encode, cbor_decode),
    "rmp": (rmp_encode, rmp_decode),
    "cap": (cap_encode, cap_decode),
    "pcap": (pcap_encode, pcap_decode),
    "mcap": (mcap_encode, mcap_decode),
    "pbuf": (pbuf_encode, pbuf_decode),
}
