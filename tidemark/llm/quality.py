"""Quality rules by repetition: how much of a text lies in n-grams and lines that it repeats.

Word n-grams of several lengths are hashed by one rolling polynomial a text, in numpy; characters (code points) covered by any
occurrence of a repeated n-gram are counted once. A text fails if the covered share passes the limit of a length,
or if repeated lines hold too much of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_bytes, slices

#: Largest share of characters inside repeated n-grams, by length, and inside repeated lines.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
BASE_WORDS, BASE_REPEAT = 50, 50
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
#: Odd multiplier of the rolling hash, modulo 2 to the 64.
STEP = np.uint64(0x9E3779B97F4A7C15)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which positions hold a key found twice or more."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "surrogatepass"))


def _covered(hit: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside any window of n that starts at a hit."""
    edge = np.zeros(words + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: bytes | None, limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, shares of characters by length, line share, kept."""
    text = text or b""
    words = text.split()
    n = len(words)
    word_chars = _code_points(text) - (len(text) - len(text.translate(None, BLANKS)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    dup_lines, dup_line_chars, seen = 0, 0, set()
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line.strip(BLANKS):
                if line in seen:
                    dup_lines += 1
                    dup_line_chars += _code_points(line.translate(None, BLANKS))
                seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeat_words, shares = 0, [0.0] * len(limits)
    if n > 3:
        pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
        three = _repeated(pair[:-1] * len(number) + ids[2:])
        if three.any():
            repeat_words = int(_covered(three, 3, n).sum())
            sizes = np.fromiter(map(len if text.isascii() else _code_points, words), np.int64, n)
            rolled, grams, hit = (ids + 1).astype(np.uint64), 1, three
            for k, (length, _) in enumerate(sorted(limits.items())):
                while grams < length and len(rolled) > 1:
                    rolled = rolled[:-1] * STEP + (ids[grams:] + 1).astype(np.uint64)
                    grams += 1
                if grams < length:
                    break
                # a repeated n-gram begins with a repeated shorter one: only those positions are compared
                at = np.flatnonzero(hit[: len(rolled)])
                hit = np.zeros(len(rolled), bool)
                hit[at[_repeated(rolled[at])]] = True
                if not hit.any():
                    break
                shares[k] = float(sizes[_covered(hit, length, n)].sum()) / word_chars
    base_failed = n < BASE_WORDS or 100 * repeat_words > BASE_REPEAT * n
    line_share = dup_line_chars / max(1, word_chars)
    kept = not base_failed and line_share <= line_limit and all(s <= limit for s, (_, limit) in zip(shares, sorted(limits.items()), strict=True))
    return n, word_chars, symbols, dup_lines, repeat_words, base_failed, max(shares, default=0.0), line_share, kept


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ngram_share", "line_share", "kept")


def repetition(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """A row for each document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ngram_share, line_share, kept.

    A null or empty text has no words and fails the base rule. Repeated rows and ids give a row each; other columns are
    not read. Texts are measured whole, one at a time, so memory follows the longest text. No shuffle.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ngram_share double, line_share double, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [measure(x, limits, line_limit) for x in ascii_bytes(batch.column(1))]
            columns = list(zip(*got, strict=True)) if got else [()] * len(NAMES)
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [id_col, *NAMES])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
