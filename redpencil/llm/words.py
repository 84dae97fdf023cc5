"""Word splitting shared by several operators. Texts are lower-cased for A-Z only and handled as UTF-8 bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

# The bytes of words by characters. Digits, a-z and every byte of a non-ASCII character belong to a word.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def spaced_words(text: bytes) -> list[bytes]:
    """Words between white space (x20, x09 to x0D)."""
    return text.lower().split()


def plain_words(text: bytes) -> list[bytes]:
    """Words of digits, letters a-z and non-ASCII characters."""
    return _WORD.findall(text.lower())


def pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few rows, so that what is made of them stays small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a text column; a null text is empty."""
    for value in batch.column(column).cast(pa.large_binary()):
        yield value.as_py() or b""
