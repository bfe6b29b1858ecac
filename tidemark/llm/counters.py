"""Large tables of counters, filled by tasks and added up in Spark chunk by chunk.

A task sends its counters as packed chunks, those without a count left out: what it sends grows with what it counted rather than with the table. The chunks of one number are added in two steps of
about as many rows each, so that neither their number nor the table's size meets in one task. What comes to the driver is one row a chunk.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of a chunk.
CHUNK = 1 << 14


def packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def chunks(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Numbers and packed bytes of the chunks that hold a count."""
    rows = counts.reshape(-1, min(CHUNK, len(counts)))
    used = np.flatnonzero(rows.any(axis=1))
    return used.tolist(), [packed(rows[k]) for k in used]


def added(rows: DataFrame, dtype: np.dtype, most: int | None = None, finish: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> DataFrame:
    """rows (chunk, packed counts) -> chunk, counts: their sums, no count above most, each chunk as finish gives it back."""

    def by(last: Callable[[np.ndarray], bytes]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            total = 0
            for x in pdf["counts"]:
                total = total + np.frombuffer(zlib.decompress(x), dtype).astype(np.int64)
            if most is not None:
                np.minimum(total, most, out=total)
            return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1].to_numpy(), "counts": [last(total.astype(dtype))]})

        return run

    most_rows = rows.groupBy("chunk").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    parts = rows.select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(math.isqrt(most_rows))).alias("part"))
    first = parts.groupBy("chunk", "part").applyInPandas(by(packed), "chunk int, counts binary")
    return first.groupBy("chunk").applyInPandas(by(finish), "chunk int, counts binary")


def gathered(rows: DataFrame, size: int, dtype: np.dtype, per_chunk: int) -> np.ndarray:
    """The whole table on the driver, of so many elements a chunk; chunks that no row has are zeros."""
    out = np.zeros(size, dtype)
    for r in rows.toLocalIterator():
        part = np.frombuffer(r["counts"], dtype)
        out[r["chunk"] * per_chunk : r["chunk"] * per_chunk + len(part)] = part
    return out
