"""Differences of two large tables by a tree of digests: only rows of the ranges whose digests differ are joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.relations import drift
from tidemark.sources.durable import written

#: Bits of a leaf's number, and of a step from a node to its children.
LEAF_BITS, STEP_BITS = 16, 4


def leaf(key: str, bits: int = LEAF_BITS) -> Column:
    """The leaf of a key: the first bits of its hash."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("long")


def digests(rows: DataFrame, key: str, fields: Sequence[str], bits: int = LEAF_BITS) -> DataFrame:
    """node, rows, a, b: each leaf's number of rows and two sums of their hashes. The table can be kept as a baseline; it has at most 2^bits rows."""
    own = lambda seed: F.sum(F.xxhash64(F.lit(seed), key, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).cast("decimal(38,0)"))
    return rows.groupBy(leaf(key, bits).alias("node")).agg(F.count("*").alias("rows"), own(1).alias("a"), own(2).alias("b"))


def differing(old: DataFrame, new: DataFrame, bits: int = LEAF_BITS, step: int = STEP_BITS) -> DataFrame:
    """level, node of the nodes that differ, from the root (level 0) to the leaves (the last level). Below an equal node nothing is compared."""
    levels = list(range(0, bits, step)) + [bits]
    up = lambda d, b: d.groupBy(F.shiftright("node", bits - b).alias("node")).agg(F.sum("rows").alias("rows"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    found, out = None, None
    for k, b in enumerate(levels):
        left, right = (up(d, b) if b < bits else d for d in (old, new))
        if found is not None:
            parents = found.select(F.col("node").alias("_parent"))
            left, right = (d.join(F.broadcast(parents), F.shiftright("node", b - levels[k - 1]) == F.col("_parent"), "left_semi") for d in (left, right))  # noqa: B023
        both = left.select("node", F.struct("rows", "a", "b").alias("x")).join(right.select("node", F.struct("rows", "a", "b").alias("y")), "node", "full_outer")
        found = written(both.where(~F.col("x").eqNullSafe(F.col("y"))).select(F.lit(k).alias("level"), "node"), "nodes")
        out = found if out is None else out.unionByName(found)
    return out


def tree_drift(expected: DataFrame, actual: DataFrame, key: str, fields: Sequence[str], *, baseline: DataFrame | None = None, bits: int = LEAF_BITS, step: int = STEP_BITS) -> DataFrame:
    """key, state (changed, missing, extra), changed (names of fields): the rows that differ, as drift() gives them.

    expected's digests may be kept ones. Keys must be unique and not null. Rows are only joined where a leaf differs;
    two different leaves pass for equal if two 64-bit hash sums agree by chance.
    """
    old = written(digests(expected, key, fields, bits), "digests") if baseline is None else baseline
    nodes = differing(old, written(digests(actual, key, fields, bits), "digests"), bits, step)
    last = -(-bits // step)
    leaves = nodes.where(F.col("level") == last).select(F.col("node").alias("_leaf"))  # at most 2^bits rows
    left, right = (d.join(F.broadcast(leaves), leaf(key, bits) == F.col("_leaf"), "left_semi") for d in (expected, actual))
    return drift(left, right, key, fields).where("state != 'same'")
