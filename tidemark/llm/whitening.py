"""Whitening of embeddings by a tiled covariance.

The dimensions are cut into tiles, the distinct vectors into row blocks. The columns of a row block that belong to a tile
are sent to each pair of tiles that needs them; there the two column blocks of a row block are centred and multiplied,
and the products are added up by tile. What comes to the driver has a row for each pair of dimensions, whatever the
number of vectors: it assembles the covariance and finds its eigenvectors. All vectors are then projected where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, slices

#: Steps of a unit of an entry: entries become whole numbers of them.
STEPS = 256
#: Dimensions of a tile, vectors of a row block at most.
TILE, ROWS = 32, 8_192
#: First components that are given back.
COMPONENTS = 4
#: A component with no more than this share of the trace has no variance: it can't be brought to one.
NO_VARIANCE = 1e-12


def whole_vectors(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id, x: vectors without null and non-finite entries, each entry as floor(256 * entry)."""
    rows = embeddings.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_vector"))
    rows = rows.where(F.col("_vector").isNotNull() & F.forall("_vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return rows.select("_id", F.transform("_vector", lambda c: F.floor(c * STEPS)).alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of lists of dims numbers each as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def column_blocks(fit: DataFrame, dims: int, tile: int, rows: int) -> DataFrame:
    """fit (x) -> block, i, j, left, kind, cells: for each row block and pair of tiles i <= j the columns of i (left) and of j, as numbers of the smallest kind that holds them."""
    tiles = range(-(-dims // tile))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, rows):
            x = matrix(batch.column(0), dims)
            low, high = (int(f()) for f in (x.min, x.max))
            kind = next(k for k in ("int8", "int16", "int32", "int64") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
            cells = [x[:, k * tile : (k + 1) * tile].astype(kind).tobytes() for k in tiles]
            sent = [(i, j, left) for i in tiles for j in tiles[i:] for left in ((True, False) if i < j else (True,))]
            i, j, left = zip(*sent, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(sent), pa.int64()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(left), pa.array([kind] * len(sent)), pa.array([cells[a if first else b] for a, b, first in sent], pa.binary())],
                ["block", "i", "j", "left", "kind", "cells"],
            )
            block += 1

    return fit.mapInArrow(run, "block long, i int, j int, left boolean, kind string, cells binary")


def tile_products(blocks: DataFrame, mean: np.ndarray, dims: int, tile: int) -> DataFrame:
    """i, j, cells: the sums over all vectors of the products of centred entries, for each pair of tiles row by row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        sides = {}
        for left, kind, cells in zip(pdf["left"], pdf["kind"], pdf["cells"], strict=True):
            k = i if left else j
            wide = min(tile, dims - k * tile)
            sides[bool(left)] = np.frombuffer(cells, kind).reshape(-1, wide) - mean[k * tile : k * tile + wide]
        product = sides[True].T @ sides.get(False, sides[True])
        return pd.DataFrame({"i": [i], "j": [j], "products": [product.ravel()]})

    each = blocks.groupBy("block", "i", "j").applyInPandas(run, "i int, j int, products array<double>")
    total = each.select("i", "j", F.posexplode("products").alias("place", "product")).groupBy("i", "j", "place").agg(F.sum("product").alias("total"))
    cells = F.transform(F.sort_array(F.collect_list(F.struct("place", "total"))), lambda c: c["total"])  # tile * tile of them
    return total.groupBy("i", "j").agg(cells.alias("cells"))


def covariance(fit: DataFrame, n: int, mean: np.ndarray, tile: int = TILE, rows: int = ROWS) -> np.ndarray:
    """The covariance of the vectors in fit (x), divisor n; tile by tile in Spark, put together on the driver."""
    dims = len(mean)
    out = np.zeros((dims, dims))
    for r in tile_products(column_blocks(fit, dims, tile, rows), mean, dims, tile).collect():
        i, j = r["i"] * tile, r["j"] * tile
        cells = np.array(r["cells"]).reshape(min(tile, dims - i), min(tile, dims - j)) / n
        out[i : i + tile, j : j + tile] = cells
        out[j : j + tile, i : i + tile] = cells.T
    return out


def principal(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns, the largest entry of each positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(order))])
    return values, vectors * np.where(sign == 0, 1.0, sign)


def identity_error(fit: DataFrame, mean: np.ndarray, scaled: np.ndarray) -> float:
    """The largest entry of the projections' covariance minus the identity, measured over the vectors in fit (x)."""
    wide = scaled.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(wide), np.zeros((wide, wide))
        for batch in slices(batches, ROWS):
            w = (matrix(batch.column(0), len(mean)) - mean) @ scaled
            n, total, products = n + len(w), total + w.sum(axis=0), products + w.T @ w
        sums = [float(n), *total.tolist(), *products.ravel().tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.float64())], ["place", "value"])

    sums = fit.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    found = np.zeros(1 + wide + wide * wide)
    for r in sums.collect():
        found[r["place"]] = r["value"]
    own = found[1 : 1 + wide] / found[0]
    cov = found[1 + wide :].reshape(wide, wide) / found[0] - np.outer(own, own)
    return float(np.abs(cov - np.eye(wide)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n * x - sum)^2 for each row, exact: in 64 bits where all fit, else in Python's numbers."""
    most = n * max(1, int(np.abs(x).max(initial=1))) + max(map(abs, sums))
    if x.min(initial=0) > np.iinfo(np.int64).min and most * most * len(sums) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    return ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()


def whiten(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, tile: int = TILE, rows: int = ROWS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for each row and each of the first components.

    Rows whose vector is null or holds a null, NaN or infinite entry are left out. Entries beyond the 64-bit numbers after
    scaling become the nearest one. A vector shorter than the longest counts as followed by zeros. The
    covariance is that of the distinct vectors, so copies don't weigh. Each row gives its own rows: null and repeated ids
    and repeated rows stay. There are at most as many components as dimensions; one without variance has a null whitened
    and isn't part of identity_error (0 if none has any; explained is 0 then). Equal eigenvalues come in any order.
    deviation is a decimal, null beyond 38 digits. An empty table gives no rows; other columns are not read.
    """
    kind = dict(embeddings.dtypes)[id_col]
    vectors = whole_vectors(embeddings, id_col, vector_col)
    short, dims = vectors.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    schema = f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not dims:
        return embeddings.sparkSession.createDataFrame([], schema)
    if short < dims:
        vectors = vectors.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), (F.lit(dims) - F.size("x")).cast("int"))))
    fit = durable(vectors.select("x").distinct(), "fit")
    n = fit.count()
    by_dim = fit.select(F.posexplode("x").alias("dim", "entry")).groupBy("dim").agg(F.sum(F.col("entry").cast("decimal(38,0)")).alias("total")).collect()
    sums = [0] * dims
    for r in by_dim:
        sums[r["dim"]] = int(r["total"])
    mean = np.array([s / n for s in sums])
    cov = covariance(fit, n, mean, tile, rows)
    values, directions = principal(cov, components)
    trace = float(np.trace(cov))
    some = values > NO_VARIANCE * trace
    scaled = directions[:, some] / np.sqrt(values[some])
    error = identity_error(fit, mean, scaled) if some.any() else 0.0
    explained = [float(v) / trace if trace > 0 else 0.0 for v in values]
    count, places = len(values), np.flatnonzero(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            x = matrix(batch.column(1), dims)
            white = np.full((len(x), count), np.nan)
            white[:, places] = (x - mean) @ scaled
            deviation = [Decimal(d) if d < 10**38 else None for d in deviations(x, n, sums)]
            row = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(row), pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()), pa.array(np.full(len(row), n), pa.int64()), pa.array(deviation, pa.decimal128(38, 0)).take(row),
                    pa.array(white.ravel(), pa.float64(), from_pandas=True), pa.array(explained * len(x), pa.float64()), pa.array(np.full(len(row), error), pa.float64()),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, schema)
