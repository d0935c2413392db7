"""Key codecs as column expressions and, where bounds and names need them, as Python functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_key(c: Column, size: int) -> Column:
    """Bytes as ``2 * size`` upper-case hex digits, padded with zeros on the left."""
    return F.lpad(F.hex(c), 2 * size, "0")


def hex_bytes(c: Column) -> Column:
    """Bytes of a hex key."""
    return F.unhex(c)


def is_hex_id(c: Column, size: int) -> Column:
    """Whether a string is an identifier of exactly ``size`` bytes in hex; null for null."""
    return c.rlike(f"^[0-9A-Fa-f]{{{2 * size}}}$")


def decimal_key(c: Column, width: int) -> Column:
    """A non-negative integer as ``width`` decimal digits; an error if it needs more."""
    text = c.cast("bigint").cast("string")
    return F.when((c < 0) | (F.length(text) > width), F.raise_error(F.concat(F.lit("no key of the width: "), text))).otherwise(F.lpad(text, width, "0"))


def decimal_value(c: Column, start: int, width: int) -> Column:
    """The integer in ``width`` decimal digits of a composite key, from ``start`` (counted from 0)."""
    return F.substring(c, start + 1, width).cast("bigint")


def composite_key(*parts: Column) -> Column:
    """Keys of fixed width one after the other; its order is that of the parts. Null if a part is null."""
    return F.concat(*parts)


def encode_path(dims: list[str]) -> str:
    """Path of a cuboid."""
    return "/".join(dims)


def decode_path(path: str) -> list[str]:
    """Dimensions of a cuboid's path."""
    return path.split("/")


def cut_utf8(c: Column, length: int) -> Column:
    """Text of at most ``length`` UTF-8 bytes: longer text is cut before the code point that does not fit.

    A cut is between code points where the byte behind it does not continue one.
    """
    raw = c.cast("binary")
    between = lambda n: ~F.hex(F.substring(raw, n + 1, 1)).between("80", "BF")
    cuts = (F.when(between(n), F.substring(raw, 1, n).cast("string")) for n in range(length, max(length - 4, -1), -1))
    return F.when(F.octet_length(c) > length, F.coalesce(*cuts)).otherwise(c)
