"""Compressors of whole files: gzip, zlib, framed Snappy and LZ4 frames."""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pyarrow as pa

from harrow.sources.catalog import CODECS

SNAPPY_HEAD = b"\xff\x06\x00\x00sNaPpY"
SNAPPY_BLOCK = 65_536


#: Bytes of a piece of a block; the checksums of all pieces are worked out side by side.
PIECE = 256


def _crc32c_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = out >> 1 ^ np.where(out & 1, np.uint32(0x82F63B78), np.uint32(0))
    return out


def _advanced(crc: np.ndarray) -> np.ndarray:
    """Checksums after PIECE more bytes of 0."""
    for _ in range(PIECE):
        crc = crc >> 8 ^ _CRC[crc & 0xFF]
    return crc


_CRC = _crc32c_table()
_STEP = [_advanced(np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)]  # the same for each byte of a checksum


def crc32c(data: bytes) -> int:
    """CRC-32C. It is linear: pieces are taken from 0 each, and joined by advancing what stands before; zeros in front change nothing."""
    if len(data) < 4:
        crc = np.uint32(0xFFFFFFFF)
        for b in data:
            crc = crc >> np.uint32(8) ^ _CRC[(crc ^ np.uint32(b)) & np.uint32(0xFF)]
        return int(crc) ^ 0xFFFFFFFF
    block = np.zeros(-(-len(data) // PIECE) * PIECE, np.uint8)
    block[len(block) - len(data) :] = np.frombuffer(data, np.uint8)
    block[len(block) - len(data) :][:4] ^= 0xFF  # the start value
    pieces = block.reshape(-1, PIECE)
    crcs = np.zeros(len(pieces), np.uint32)
    for column in pieces.T:
        crcs = crcs >> 8 ^ _CRC[(crcs ^ column) & 0xFF]
    crc = 0
    for piece in crcs.tolist():
        crc = int(_STEP[0][crc & 0xFF] ^ _STEP[1][crc >> 8 & 0xFF] ^ _STEP[2][crc >> 16 & 0xFF] ^ _STEP[3][crc >> 24]) ^ piece
    return crc ^ 0xFFFFFFFF


def masked_crc(data: bytes) -> int:
    """CRC-32C as the framing format stores it."""
    crc = crc32c(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def snappy_frames(data: bytes) -> bytes:
    codec, out = pa.Codec("snappy"), [SNAPPY_HEAD]
    for at in range(0, len(data), SNAPPY_BLOCK):
        block = data[at : at + SNAPPY_BLOCK]
        packed = codec.compress(block, asbytes=True)
        kind, body = (0, packed) if len(packed) < len(block) else (1, block)
        out.append(struct.pack("<I", kind | (len(body) + 4) << 8) + struct.pack("<I", masked_crc(block)) + body)
    return b"".join(out)


def _varint(data: bytes) -> int:
    value = 0
    for i, b in enumerate(data[:5]):
        value |= (b & 0x7F) << 7 * i
        if b < 128:
            return value
    raise ValueError("length of a Snappy block")


def snappy_unframed(data: bytes) -> bytes:
    """Checksums are not looked at."""
    codec, out, at = pa.Codec("snappy"), [], 0
    while at < len(data):
        if at + 4 > len(data):
            raise EOFError("a Snappy chunk is cut off")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if len(body) < size:
            raise EOFError("a Snappy chunk is cut off")
        if kind == 0:
            out.append(codec.decompress(body[4:], _varint(body[4:]), asbytes=True))
        elif kind == 1:
            out.append(body[4:])
        elif 2 <= kind < 128:
            raise ValueError(f"unknown Snappy chunk {kind}")
    return b"".join(out)


def compress(data: bytes, codec: str) -> bytes:
    if codec == "gz":
        return gzip.compress(data, mtime=0)
    if codec == "deflate":
        return zlib.compress(data)
    if codec == "snz":
        return snappy_frames(data)
    if codec == "lz4":
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "lz4") as out:
            out.write(data)
        return sink.getvalue().to_pybytes()
    return _plain(data, codec)


def decompress(data: bytes, codec: str) -> bytes:
    if codec == "gz":
        return gzip.decompress(data)
    if codec == "deflate":
        return zlib.decompress(data)
    if codec == "snz":
        return snappy_unframed(data)
    if codec == "lz4":
        return pa.CompressedInputStream(pa.BufferReader(data), "lz4").read() if data else b""
    return _plain(data, codec)


def _plain(data: bytes, codec: str) -> bytes:
    if codec != "none":
        raise ValueError(f"unknown codec {codec!r}; known: {', '.join(CODECS)}")
    return data
