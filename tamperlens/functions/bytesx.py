"""Columns over BINARY content.

Bytes are viewed as ISO-8859-1 text: one character per byte, so offsets and
regular expressions are exact, and every operation stays in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamperlens.schema import U64


def latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def utf8(content: Column) -> Column:
    """Text of bytes that should be UTF-8; malformed bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def literal_text(raw: bytes) -> Column:
    """A byte pattern as it reads in the ISO-8859-1 view."""
    return F.lit(raw.decode("latin-1"))


def raw_literal(raw: bytes) -> Column:
    return F.unhex(F.lit(raw.hex()))


def starts_with(content: Column, raw: bytes) -> Column:
    return F.startswith(content, raw_literal(raw))


def unsigned_le(content: Column, offset: int, width: int) -> Column:
    """Little-endian unsigned integer at a 0-based offset; NULL when cut short."""
    digits = F.concat(
        *[F.hex(F.substring(content, offset + i + 1, 1)) for i in reversed(range(width))]
    )
    return F.when(
        F.octet_length(content) >= offset + width, F.conv(digits, 16, 10).cast(U64)
    )


def char_code(text: Column, position: Column | int) -> Column:
    """Value 0-255 of one character (1-based position) of an ISO-8859-1 view."""
    position = F.lit(position) if isinstance(position, int) else position
    return F.ascii(F.substr(text, position, F.lit(1)))


def char_u16(text: Column, offset: int) -> Column:
    return char_code(text, offset + 1) + char_code(text, offset + 2) * 256


def char_u32(text: Column, offset: int) -> Column:
    return reduce(
        lambda total, i: total + char_code(text, offset + 1 + i).cast("bigint") * (256**i),
        range(1, 4),
        char_code(text, offset + 1).cast("bigint"),
    )


def find_offset(text: Column, raw: bytes, start: int = 0) -> Column:
    """0-based offset of the first occurrence at or after ``start``; NULL if none."""
    at = F.locate(raw.decode("latin-1"), text, start + 1)
    return F.when(at > 0, at - 1)
