"""Shared pieces of the operators: text columns as UTF-8 bytes, and the words of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that separate words of letters and digits: every ASCII byte but 0-9 and a-z.
_NOT_ALNUM = bytes(32 if b < 48 or 57 < b < 97 or 122 < b < 128 else b for b in range(256))


def utf8(name: str) -> Column:
    """A text column as bytes, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def spaced_words(text: bytes) -> list[bytes]:
    r"""Words `[^\x20\x09-\x0D]+` of the text with A-Z in lower case."""
    return text.lower().split()


def plain_words(text: bytes) -> list[bytes]:
    """Runs of 0-9, a-z and everything beyond ASCII, after A-Z went to lower case."""
    return text.lower().translate(_NOT_ALNUM).split()


def to_str(data: bytes) -> str:
    return data.decode("utf-8", "surrogateescape")


def to_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")
