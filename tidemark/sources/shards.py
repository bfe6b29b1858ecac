"""Sharded corpora with a manifest, canonical snapshots, JSON and CSV documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BadShards(ValueError):
    """A corpus that isn't what its manifest says."""


def manifest_of(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """by, question_count, sha256 of each shard: of the digests of its rows in order. One digest a row is gathered, not the row."""
    whole = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    d = rows.select(*by, F.struct(*order, whole.alias("_row")).alias("_x"))
    return d.groupBy(*by).agg(F.count("*").alias("question_count"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("_x")), lambda x: x["_row"]), "\n"), 256).alias("sha256"))


def revision(manifest: DataFrame, by: Sequence[str]) -> str:
    """The corpus' name by content: the first 20 digits over "shard:sha256" lines in order. A manifest has a row a shard."""
    line = F.concat(F.concat_ws("/", *by), F.lit(":"), F.col("sha256"))
    return manifest.agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256), 1, 20).alias("r")).first()["r"]


def write_shards(rows: DataFrame, path: str, by: Sequence[str], order: Sequence[str]) -> str:
    """Write one folder a shard, rows in order, and the manifest beside it; returns the revision."""
    rows.repartition(*by).sortWithinPartitions(*by, *order).write.mode("overwrite").partitionBy(*by).parquet(f"{path}/shards")
    manifest = manifest_of(rows, by, order)
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return revision(manifest, by)


def read_shards(spark: SparkSession, path: str, schema: T.StructType, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows, after every shard's count and digest has been held against the manifest."""
    rows = spark.read.schema(schema).parquet(f"{path}/shards").select(*schema.names)
    kinds = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in by)
    want = spark.read.schema(f"{kinds}, question_count long, sha256 string").json(f"{path}/manifest")
    both = manifest_of(rows, by, order).withColumnsRenamed({"question_count": "n", "sha256": "s"}).join(want, list(by), "full_outer")
    bad = both.where(~(F.col("n").eqNullSafe(F.col("question_count")) & F.col("s").eqNullSafe(F.col("sha256")))).select(*by).limit(5).collect()
    if bad:
        raise BadShards(f"shards differ from the manifest: {[tuple(r) for r in bad]}")
    return rows


def content_digest(rows: DataFrame, ignore: Sequence[str] = ("generated_at",)) -> tuple[int, str]:
    """Number of rows and an order-free digest of all but the ignored columns."""
    kept = [c for c in sorted(rows.columns) if c not in ignore]
    h = F.xxhash64(F.to_json(F.struct(*kept)))
    r = rows.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("a"), F.bit_xor(h).alias("b")).first()
    return r["n"], f"{r['a']}:{r['b']}"


def must_write(new: DataFrame, old: DataFrame | None, now: str, *, stamp: str = "generated_at", max_hours: float = 18.0) -> bool:
    """Whether a snapshot has to be written: there is none, its content differs, or it is as old as max_hours."""
    if old is None or content_digest(new, (stamp,)) != content_digest(old, (stamp,)):
        return True
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.max(stamp))) / 3600
    hours = old.agg(age.alias("h")).first()["h"]
    return hours is None or hours >= max_hours


def json_items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Rows of JSON documents that are a list, or hold one under questions or items."""
    text = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", f"array<{item}>")
    under = lambda name: F.from_json("value", f"struct<{name}: array<{item}>>")[name]
    rows = F.when(F.ltrim("value").startswith("["), as_list).otherwise(F.coalesce(under("questions"), under("items")))
    return text.select(F.explode(rows).alias("x")).select("x.*")


def incoming(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Rows of the folder's files whose names are six digits, with the file's number; others, such as drafts, are not read."""
    text = spark.read.text(f"{path}/{'[0-9]' * 6}.json", wholetext=True).withColumn("_file", F.regexp_extract(F.col("_metadata.file_name"), "([0-9]{6})[.]json$", 1))
    as_list = F.from_json("value", f"array<{item}>")
    under = lambda name: F.from_json("value", f"struct<{name}: array<{item}>>")[name]
    rows = F.when(F.ltrim("value").startswith("["), as_list).otherwise(F.coalesce(under("questions"), under("items")))
    return text.select(F.col("_file").alias("file"), F.explode(rows).alias("x")).select("file", "x.*")


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; a byte order mark before it is no part of the first name."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(path)


def first_valid(readers: Sequence, valid) -> DataFrame:
    """The first source that can be read and passes: network copy, cached copy, database. The last error stands if none does."""
    error: Exception = BadShards("no source")
    for read in readers:
        try:
            rows = read()
            if valid(rows):
                return rows
            error = BadShards("a source was read but isn't valid")
        except Exception as e:  # a source that can't be read gives way to the next
            error = e
    raise error


def expect(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a check, with the names of the broken ones: CHECK constraints for tables that have none. Null counts as passed, as in SQL."""
    broken = F.array_compact(F.array(*(F.when(~c, F.lit(n)) for n, c in checks.items())))
    return rows.withColumn("broken", broken).where(F.size("broken") > 0)
