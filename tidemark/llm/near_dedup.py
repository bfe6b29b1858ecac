"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Two permutations make a signature: the first spreads the shingles over a ring, the second, shifted by one place
for each coordinate, ranks them; coordinate k is the least rank under shift k. Bands of a signature's rows are the
buckets. Texts of one shingle set are one class, and only a class's smallest document goes on.

Every pair that shares a bucket is compared on full shingle sets. Buckets of up to SMALL classes are
compared as a whole, each distinct one once. Larger ones are first joined to clusters, whose members are compared with
a few hubs: those that link through them need no more comparing (they are reachable). The rest of a bucket is compared
with all its members of a size that fits, block by block. Links stay inside the comparing task as sets of linked classes, so copies never
make all their pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WordHashes, ascii_bytes, durable, slices
from tidemark.llm.components import components

#: Rows of a band and bands: a pair of similarity 0.85 shares no bucket with a chance of 7e-9, one of 0.8 with 3e-6.
ROWS, BANDS = 5, 32
#: Classes of a bucket that is compared as a whole, members of a block, hubs of a cluster (about).
SMALL, BLOCK, HUBS = 48, 256, 64
#: Shingles of a bucket that is compared as a whole, and of a block (about), so that long texts don't fill a task.
BLOCK_SHINGLES = 1_000_000
#: Odd multipliers of the hashes.
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M2
    x = (x ^ (x >> np.uint64(29))) * M3
    return x ^ (x >> np.uint64(32))


def _mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


class Shingler:
    """Shingle sets as sorted 64-bit numbers. Words hash once a worker."""

    def __init__(self, size: int) -> None:
        self.size, self.hashes = size, WordHashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII white space characters
        if not words:
            return np.empty(0, np.uint64)
        h = self.hashes(words)
        n = min(self.size, len(h))  # a text of fewer words is one shingle
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = out * M1 + h[k : k + len(out)]
            out ^= out >> np.uint64(31)
        return np.unique(_mix64(out))


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: the least of pi(sigma(x) + k) for each shift k."""
    ring = (_mix64(shingles + M2) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(ring), 512):
        np.minimum(out, _mix32(ring[k : k + 512] + shift).min(axis=1), out=out)
    return out


def bands(sign: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit number for each band, other bands' numbers apart."""
    parts = sign.reshape(-1, rows).astype(np.uint64)
    out = np.arange(1, len(parts) + 1, dtype=np.uint64) * M2
    for k in range(rows):
        out = _mix64(out * M1 + parts[:, k])
    return out.astype(np.int64)


def signatures(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, rows: int, band_count: int) -> DataFrame:
    """doc_id, n_shingles, set_key (a 128-bit digest of the shingle set, null if empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(shingle)
        for batch in slices(batches):
            sizes, keys, found = [], [], []
            for text in ascii_bytes(batch.column(1)):
                s = of(text)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                found.append(bands(signature(s, rows * band_count), rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame, *, shingle: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, shingles (64-bit numbers, sorted, as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(shingle)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(x).tobytes() for x in ascii_bytes(batch.column(1))], pa.binary())], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections of one list's sets with another's (or its own), over the elements that two sets or more share."""
    sets = left if right is None else left + right
    if right is None and len(left) == 2:
        one = len(np.intersect1d(*left, assume_unique=True))
        return np.array([[len(left[0]), one], [one, len(left[1])]])
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, number, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = many[number] > 1
    owner, number = owner[shared], np.unique(number[shared], return_inverse=True)[1] if shared.any() else np.empty(0, np.int64)
    split = len(left) if right is not None else 0
    out = np.zeros((len(left), len(sets) - split), np.float32)
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        lo, hi = np.searchsorted(number, (a, a + 4096))
        x = np.zeros((len(sets), 4096), np.float32)
        x[owner[lo:hi], number[lo:hi] - a] = 1
        out += x[: len(left)] @ x[split:].T
    return out.round().astype(np.int64)


def linked(inter: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (left[:, None] + right[None, :] - inter)


def forest(pairs: Iterator[tuple[int, int]] | np.ndarray, n: int) -> list[tuple[int, int]]:
    """As few of the pairs of numbers under n as connect what all of them connect."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in pairs:
        if (x := top(a)) != (y := top(b)):
            up[x] = y
            out.append((a, b))
    return out


def _compare_groups(groups: DataFrame, percent: int) -> DataFrame:
    """groups (members array<struct<rep, shingles>>): edges u, v between linked members, as many as connect them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 50):
            us, vs = [], []
            for k in range(batch.num_rows):
                members = batch.column(0)[k].as_py()
                sets = [np.frombuffer(x["shingles"], np.uint64) for x in members]
                size = np.array([len(x) for x in sets])
                yes = np.triu(linked(overlaps(sets), size, size, percent), 1)
                for a, b in forest(np.argwhere(yes).tolist(), len(sets)):
                    us.append(members[a]["rep"])
                    vs.append(members[b]["rep"])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return groups.mapInArrow(run, "u long, v long")


def _compare_blocks(rows: DataFrame, by: list[str], percent: int, kind: str = "long") -> DataFrame:
    """rows (by, query boolean, rep, shingles): in each block, edges between query rows and the others, as many as connect them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["query"]], pdf[~pdf["query"]]
        ra, rb = a["rep"].to_numpy(), b["rep"].to_numpy()
        edges: list[tuple[int, int]] = []
        if len(a) and len(b):
            left, right = ([np.frombuffer(x, np.uint64) for x in d["shingles"]] for d in (a, b))
            yes = linked(overlaps(left, right), np.array([len(x) for x in left]), np.array([len(x) for x in right]), percent)
            found = np.argwhere(yes & (ra[:, None] != rb[None, :]))
            edges = forest(((x, y + len(ra)) for x, y in found.tolist()), len(ra) + len(rb))
        return pd.DataFrame({"u": ra[[x for x, _ in edges]], "v": rb[[y - len(ra) for _, y in edges]]})

    return rows.groupBy(*by).applyInPandas(run, f"u {kind}, v {kind}")


def _blocks(count: str, shingles: str) -> Column:
    """How many blocks so many members with so many shingles are cut into."""
    return F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _copies(df: DataFrame, n: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), n - 1)))


def _hot_edges(hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """hot (key, rep, hub, size): edges inside the large buckets.

    First, members of buckets that hang together (a cluster) are compared with a few hubs of the cluster. A bucket whose
    members are then all in one component needs nothing more; the others go to compare_rest.
    """
    clusters = components(hot.select(F.col("rep").alias("u"), F.col("hub").alias("v")))
    members = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(hot.groupBy("rep").agg(F.max("size").alias("size")), "rep")
    total = members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("size").alias("all"))
    held = durable(members.join(total, "cluster").join(sets, "rep").withColumn("blocks", _blocks("m", "all")).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")), "hot")
    # about HUBS hubs a cluster, chosen by a hash, are compared with every member
    hubs = _copies(held.where(F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(1 << 30)) * F.col("m") < HUBS * (1 << 30)), F.col("blocks"), "with")
    asked = hubs.select("cluster", F.col("with").alias("block"), F.lit(True).alias("query"), "rep", "shingles")
    first = durable(_compare_blocks(asked.unionByName(held.select("cluster", "block", F.lit(False).alias("query"), "rep", "shingles")), ["cluster", "block"], percent), "hubs")
    # the buckets that the hubs left in several components
    part = durable(hot.select("key", "rep", "size").join(components(first), F.col("rep") == F.col("node"), "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("component")), "parts")
    return first.unionByName(compare_rest(part, held.select("rep", "shingles"), percent))


def compare_rest(part: DataFrame, sets: DataFrame, percent: int, kind: str = "long") -> DataFrame:
    """part (key, rep, size, component), sets (rep, shingles): edges inside the keys that several components hold.

    A key's members outside its main component are compared with all its members of a size that fits, block by block.
    The key is cut into bands of sizes that grow by the factor that linked ones differ by at most, so these lie in one
    band or in neighbouring ones.
    """
    by_part = part.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = by_part.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    step = math.log(100 / percent) + 1e-9  # a bit wider, so that rounding can't put linked sizes two bands apart
    band = F.floor(F.log("size") / step).cast("int") if percent < 100 else F.col("size").cast("int")
    rows = durable(part.join(main, "key").select("key", "rep", "size", (F.col("component") != F.col("main")).alias("left"), band.alias("band")), "unsettled")
    blocks = durable(rows.groupBy("key", "band").agg(F.count("*").alias("m"), F.sum("size").alias("all")).select("key", "band", _blocks("m", "all").alias("blocks")), "blocks")
    asking = rows.where("left").withColumn("band", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1))))).join(blocks, ["key", "band"])
    rest = durable(asking.groupBy("key", "band").agg(F.count("*").alias("m"), F.sum("size").alias("all")).select("key", "band", _blocks("m", "all").alias("rest")), "rest")
    asking = asking.join(rest, ["key", "band"]).join(sets, "rep")
    query = _copies(asking.withColumn("row", F.pmod(F.xxhash64("rep", F.lit(3)), "rest").cast("int")), F.col("blocks"), "block")
    asked = rows.join(blocks, ["key", "band"]).join(rest, ["key", "band"]).join(sets, "rep")
    other = _copies(asked.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")), F.col("rest"), "row")
    columns = ["key", "band", "row", "block", "query", "rep", "shingles"]
    both = query.withColumn("query", F.lit(True)).select(columns).unionByName(other.withColumn("query", F.lit(False)).select(columns))
    return _compare_blocks(both, ["key", "band", "row", "block"], percent, kind)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, rows: int = ROWS, band_count: int = BANDS) -> DataFrame:
    """A row for each row of docs: id, n_shingles, component_id, kept.

    Documents link if 100 * shared shingles >= percent * all shingles of both. component_id is the smallest id reachable
    over links, kept whether it is the row's own. Null texts and texts without words have an empty set, link with
    nothing and are kept. Rows that repeat an id are one document with several texts. A row with a null id takes the
    component of its text's copies, and is kept only if they have no id either. An empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    sign = durable(signatures(docs, id_col=id_col, text_col=text_col, shingle=shingle, rows=rows, band_count=band_count), "signatures")
    classes = durable(sign.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")), "classes")
    entries = classes.where("rep is not null").select("rep", "size", F.explode("bands").alias("key"))
    buckets = durable(entries.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n"), F.sum("size").alias("all")).where("n > 1"), "buckets")
    members = durable(entries.join(buckets, "key"), "members")
    small = (F.col("n") <= SMALL) & (F.col("all") <= BLOCK_SHINGLES)
    groups = durable(members.where(small).groupBy("key").agg(F.array_distinct(F.sort_array(F.collect_list("rep"))).alias("reps")).select("reps").where("size(reps) > 1").distinct(), "groups")
    wanted = durable(members.select("rep").distinct(), "wanted")
    first_text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = durable(shingle_sets(first_text.join(wanted, F.col("doc_id") == F.col("rep"), "left_semi"), shingle=shingle).dropDuplicates(["doc_id", "shingles"]).withColumnRenamed("doc_id", "rep"), "sets")
    listed = groups.select(F.xxhash64("reps").alias("g"), F.explode("reps").alias("rep"))
    compared = _compare_groups(listed.join(sets, "rep").groupBy("g").agg(F.collect_list(F.struct("rep", "shingles")).alias("members")).select("members"), percent)
    edges = durable(compared, "links")
    hot = members.where(~small).select("key", "rep", "hub", "size")
    if not hot.isEmpty():
        edges = edges.unionByName(_hot_edges(hot, sets, percent))
    found = components(edges)
    label = classes.select("set_key", "rep", "copies").join(found, F.col("rep") == F.col("node"), "left").where("copies > 1 or component is not null").select("set_key", F.coalesce("component", "rep").alias("component"))
    own = sign.join(label, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return own.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
