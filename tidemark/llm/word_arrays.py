"""Words and shingle sets of a whole column of texts at once, as arrays.

A text's words are runs without ASCII white space, with A-Z in lower case. A word's number is a sum over its bytes, each
weighted by its place, taken over the column's bytes without making a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of texts that are taken at once.
BYTES = 1 << 20
#: Odd multipliers of the hashes.
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * M2
    x = (x ^ (x >> np.uint64(29))) * M3
    return x ^ (x >> np.uint64(32))


#: A number for each byte in lower case.
LETTER = mix(np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64) + M1)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes, and where each row begins in them (with the end of the last); nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return text, at - at[0]


class Words(NamedTuple):
    """All words of a column: their numbers, where each row's begin among them (with the end of the last), the column's bytes, and where each word begins and ends in these."""

    number: np.ndarray
    rows: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def words(column: pa.Array, apart: np.ndarray = BLANK) -> Words:
    """The words of a text column; apart tells of each byte whether it stands between words."""
    text, rows = bytes_of(column)
    inside = ~apart[text]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = rows[:-1][rows[:-1] < len(text)]
    begins[heads] = inside[heads]  # a word doesn't run on into the next row
    start = np.flatnonzero(begins)
    at = np.flatnonzero(inside)
    if not len(start):
        return Words(np.empty(0, np.uint64), np.zeros(len(rows), np.int64), text, start, start)
    first = np.searchsorted(at, start)
    size = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, size)
    weight = np.cumprod(np.full(int(size.max()), M1, np.uint64))
    number = np.add.reduceat(LETTER[text[at]] * weight[place], first)
    return Words(mix(number + size.astype(np.uint64) * M3), np.searchsorted(start, rows), text, start, start + size)


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    out = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for k in range(size):
        out = out * M1 + h[k : k + len(out)]
        out ^= out >> np.uint64(31)
    return mix(out)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Each row's distinct runs of so many words as sorted 64-bit numbers; a row with fewer words, but not none, is one run."""
    h, first = words(column)[:2]
    runs = _runs(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(runs[a : b - size + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(_runs(h[a:b], b - a) if b > a else runs[:0])
    return out


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut where rows or bytes get too many, or to single rows."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            piece = batch.slice(k, step)
            if piece.nbytes <= 2 * size:
                yield piece
            else:  # long texts among short ones
                yield from (piece.slice(i, 1) for i in range(piece.num_rows))
