"""What the operators of this subpackage share: tables, durable intermediate results, text as bytes."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Folders that new_path writes to, innermost last: those of the open scratch blocks.
_folders: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a folder of its own; on a cluster that would lose data, so it raises.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        at = context.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{_folders[-1] if _folders else shared_dir(spark) + '/tidemark'}/{uuid.uuid4().hex}/{name}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside the block go to a folder that is deleted at its end: write what is to stay outside of it first."""
    _folders.append(new_path(spark, "scratch"))
    try:
        yield
    finally:
        discard(spark, _folders.pop())


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage with a written table: later steps survive lost executors without a recompute."""
    spark = df.sparkSession
    df.write.parquet(path := path or new_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into smaller ones of so many rows and bytes (or one row), so that a worker holds few Python objects at a time."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            piece = batch.slice(k, step)
            if piece.nbytes <= 2 * size:
                yield piece
            else:  # long texts among short ones
                yield from (piece.slice(i, 1) for i in range(piece.num_rows))


def ascii_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column. bytes.lower() and bytes.split() then treat A-Z and the six ASCII white space characters only."""
    return column.cast(pa.binary()).to_pylist()


class WordHashes:
    """Words as 64-bit numbers. A word is hashed once a worker, as long as there is room."""

    def __init__(self, kept: int = 60_000) -> None:
        self.kept, self.known = kept, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.kept:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
