"""Keys: the first k bytes of a text, padded with blanks; and the small functions that the queries use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTHS = range(8, 13)


def check_width(k: int) -> int:
    if k not in WIDTHS:
        raise ValueError(f"key width {k}; it must be from {WIDTHS[0]} to {WIDTHS[-1]}")
    return k


def prefix_key(text: Column, k: int) -> Column:
    """The first k bytes of the UTF-8 text, padded to k with blanks, as binary. A character may be cut. Null stays null."""
    return F.rpad(F.encode(text, "UTF-8"), check_width(k), F.lit(b" "))


def empty_key(k: int) -> Column:
    """The key of an empty text: k blanks."""
    return prefix_key(F.lit(""), k)


def prefix_text(text: Column, k: int) -> Column:
    """The key as a text, for ASCII data."""
    return prefix_key(text, k).cast("string")


def key_bytes(key: Column) -> Column:
    """The bytes of a key, as an array of numbers from 0 to 255."""
    return F.transform(F.sequence(F.lit(1), F.octet_length(key)), lambda i: F.conv(F.hex(F.substring(key, i, F.lit(1))), 16, 10).cast("int"))


def byte_at(key: Column, place: int) -> Column:
    """One byte of a key as a number, from 0; 0 beyond its end."""
    return F.coalesce(F.conv(F.nullif(F.hex(F.substring(key, place + 1, 1)), F.lit("")), 16, 10).cast("int"), F.lit(0))


def hash_bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def trie_bucket(key: Column, buckets: int) -> Column:
    """Bucket by the first two bytes of a key, taken as one number."""
    return F.pmod(byte_at(key, 0) * 256 + byte_at(key, 1), F.lit(buckets)).cast("int")


def double_sum(value: Column) -> Column:
    """The sum in double precision, whatever the type of the amounts. NaN and infinities carry over; nulls count for nothing.

    The order of adding isn't fixed, so the last digits of two runs may differ.
    """
    return F.sum(value.cast("double"))
