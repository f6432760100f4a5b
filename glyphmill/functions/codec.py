"""Token bytes in printable and hexadecimal form, in Python and as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_REST = [b for b in range(256) if b not in set(_PLAIN)]
#: Byte to printable character: 188 stand for themselves, the others follow from U+0100 on.
TO_CHAR = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(_REST)}
TO_BYTE = {c: b for b, c in TO_CHAR.items()}
_FROM, _TO = "".join(map(chr, _REST)), "".join(TO_CHAR[b] for b in _REST)
#: Bytes that occur in valid UTF-8 as counted for the initial vocabulary.
INITIAL_BYTES = [*range(192), *range(194, 245)]


def printable(token: bytes) -> str:
    return "".join(TO_CHAR[b] for b in token)


def unprintable(text: str) -> bytes:
    """Inverse of printable; a character that stands for no byte is a KeyError."""
    return bytes(TO_BYTE[c] for c in text)


def printable_column(token: Column) -> Column:
    return F.translate(F.decode(token, "ISO-8859-1"), _FROM, _TO)


def unprintable_column(text: Column) -> Column:
    return F.encode(F.translate(text, _TO, _FROM), "ISO-8859-1")


def hex_column(token: Column) -> Column:
    return F.lower(F.hex(token))


def unhex_column(text: Column) -> Column:
    return F.unhex(text)


def byte_tokens(text: Column) -> Column:
    """Text or bytes as an array of single bytes; an empty value gives an empty array."""
    data = text.cast("binary")
    some = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.substring(data, i, F.lit(1)))
    return F.when(F.octet_length(data) > 0, some).otherwise(F.array().cast("array<binary>"))


def is_all_digits(token: bytes) -> bool:
    """Whether every byte is an ASCII digit; true of no bytes."""
    return set(token) <= _DIGITS


def can_supermerge(token: bytes) -> bool:
    """Whether every byte is an ASCII letter, a space, an underscore or an apostrophe; true of no bytes."""
    return set(token) <= _WORDLIKE


_DIGITS = frozenset(range(48, 58))
_WORDLIKE = frozenset((*range(65, 91), *range(97, 123), *b" _'"))
