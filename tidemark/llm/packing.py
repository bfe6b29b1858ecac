"""Packing into length buckets of least padding, and batches of a token budget inside each bucket.

The lengths of all sequences are counted in Spark; the histogram has one row for each length up to the context, so a
bounded table comes to the driver. Dynamic programming over it chooses the bucket bounds with the least padding.
Sequences get their place in their bucket by counts of shards and a rank inside the shard, so no bucket
meets in one task; consecutive places form the batches.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import durable, slices

#: Tokens of a sequence at most, number of buckets, padded tokens of a batch.
CONTEXT, BUCKETS, BUDGET = 2048, 16, 65_536
#: The characters that splitting patterns take as white space; runs so long are split off before the pattern, which would try them from each place.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
#: Rows of a shard of a bucket to aim for, and shards at most.
SHARD_ROWS, SHARDS = 2_000, 20_000


class TokenCounter:
    """Counts tokens by a byte-level vocabulary of ranks (lines of base64 token and rank) and its splitting pattern.

    The file is read on the driver and sent to the tasks with the counter, at the vocabulary's size; each worker builds
    the tokenizer once. The pattern must, as usual, take a run of white space at the end as one part, and before other signs all
    of it but the last one, which may belong to the word behind it. Long runs are split off in that way beforehand.
    """

    def __init__(self, vocabulary: str, pattern: str) -> None:
        with open(vocabulary, "rb") as f:
            self.ranks, self.pattern, self.own, self.blank = f.read(), pattern, None, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"own": None, "blank": None}

    def __call__(self, text: str) -> int:
        if self.own is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            self.own, self.blank = (tiktoken.Encoding("packing", pat_str=x, mergeable_ranks=ranks, special_tokens={}) for x in (self.pattern, r"\s+"))
        n, at = 0, 0
        for run in LONG_BLANK.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            n += len(self.own.encode_ordinary(text[at : run.start()])) + len(self.blank.encode_ordinary(text[run.start() : end]))
            at = end
        return n + len(self.own.encode_ordinary(text[at:]))


def lengths(docs: DataFrame, count: Callable[[str], int], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens of each row: the text's tokens and one end token, so that null and empty texts have 1."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([1 + (count(x) if x else 0) for x in batch.column(1).to_pylist()], pa.int64())], [id_col, "n_tokens"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")


def best_bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most so many buckets, the last the longest length, that minimise padding: sum of count * (bound - length)."""
    if not histogram:
        return []
    size = np.array(sorted(histogram), np.int64)
    many = np.array([histogram[x] for x in size.tolist()], np.float64)
    n = len(size)
    count, total = np.concatenate(([0.0], np.cumsum(many))), np.concatenate(([0.0], np.cumsum(many * size)))
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    back: list[np.ndarray] = []
    for _ in range(min(buckets, n)):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0.0
        for j in range(1, n + 1):  # lengths i..j-1 go to the bucket bounded by size[j - 1]
            cost = best[:j] + size[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j])
            cut[j] = k = int(np.argmin(cost))
            now[j] = cost[k]
        best = now
        back.append(cut)
    bounds, j = [], n
    for cut in reversed(back):
        if j == 0:
            break
        bounds.append(int(size[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def padding(histogram: dict[int, int], bounds: list[int]) -> int:
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())


def pack(docs: DataFrame, count: Callable[[str], int], *, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """A row for each sequence: id, part, start, length, bucket, bound, batch, slot, batch_rows.

    count gives a text's number of tokens, such as TokenCounter does. A document longer than the context becomes consecutive parts of it; none of its
    tokens is dropped. A batch holds budget // bound sequences of one bucket, at least one; only a bucket's last batch
    may hold fewer. Null and empty texts are one end token. Repeated rows and ids are sequences of their own; an empty
    table gives none; other columns are not read.
    """
    counted = durable(lengths(docs, count, id_col=id_col, text_col=text_col).withColumnRenamed(id_col, "_id"), "lengths")
    parts = counted.select("_id", "n_tokens", F.posexplode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / context).cast("int"))).alias("part", "_p")).select(
        "_id", "part", (F.col("part").cast("long") * context).alias("start"), F.least(F.col("n_tokens") - F.col("part").cast("long") * context, F.lit(context)).alias("length")
    )
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length up to the context
    bounds = best_bounds(histogram, buckets)
    if not bounds:
        bounds = [1]
    shards = min(SHARDS, -(-sum(histogram.values()) // SHARD_ROWS) or 1)
    bucket = F.array_position(F.transform(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("length")), True).cast("int") - 1
    placed = parts.withColumns({"bucket": bucket, "shard": F.pmod(F.xxhash64("_id", "part"), F.lit(shards)).cast("int")}).withColumn("bound", F.get(F.array(*map(F.lit, bounds)), F.col("bucket")).cast("long"))
    before = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = before.select("bucket", "shard", (F.sum("n").over(W.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy("bucket")).alias("all"))
    before = durable(before, "shards")
    ranked = placed.withColumn("rank", F.row_number().over(W.partitionBy("bucket", "shard").orderBy("_id", "part", "length")) - 1)
    rows = F.greatest(F.floor(F.lit(budget) / F.col("bound")), F.lit(1)).cast("long")
    out = ranked.join(before, ["bucket", "shard"]).withColumn("place", F.col("before") + F.col("rank")).withColumn("rows", rows)
    return out.select(
        F.col("_id").alias(id_col), "part", "start", "length", "bucket", "bound", F.floor(F.col("place") / F.col("rows")).cast("long").alias("batch"), (F.col("place") % F.col("rows")).cast("long").alias("slot"),
        F.least(F.col("rows"), F.col("all") - F.floor(F.col("place") / F.col("rows")) * F.col("rows")).cast("long").alias("batch_rows"),
    )
