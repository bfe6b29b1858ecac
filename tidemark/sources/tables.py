"""The driver's tables, and constant ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A constant table as VALUES, which needs no Python worker. schema: "name type, ..."."""
    literal = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"
    names, kinds = zip(*(c.split() for c in schema.split(",")), strict=True)
    table = spark.sql(f"values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)} as t({', '.join(names)})")
    return table.select(*(table[n].cast(k).alias(n) for n, k in zip(names, kinds, strict=True)))
