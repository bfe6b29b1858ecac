"""Benchmark decontamination by a prefix-filtered set join.

An item's windows of consecutive words are the sets, their word shingles the tokens, and a document must contain a
window whole. For an overlap of all tokens, a prefix of one suffices: a document that contains a window contains its
rarest shingle. Shingles are ordered by their count in all documents; each window is filed under its rarest one. Where
a document holds that shingle, the window could only stand at one place: it has to begin and end inside the document
(position and length bounds), and its words are then compared one by one.

Windows, counts and the filing are tables, and the comparison is a join on the shingle. Documents are read where they
lie: each task sends on only the shingles that may be the benchmark's, by a bitmap of their hashes, with the few words
around them. The bitmap is all that is broadcast and has a fixed largest size, whatever the size of the benchmark; when
it fills up, more shingles reach the join, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WordHashes, ascii_bytes, durable, slices

WINDOW, SHINGLE = 10, 5
#: A bitmap of shingles marks each at so many places. It has so many bits for each shingle, and so many at most (64 MB).
PLACES, BITS_EACH, MAP_BITS = 4, 32, 1 << 29
#: Bits of a bitmap that one task puts together.
CHUNK_BITS = 1 << 16
#: A-Z to lower case; bytes outside words to a space. Bytes from 0x80 on, and so all non-ASCII letters, are parts of words.
WORD_BYTES = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else c if c >= 128 else 32 for c in range(256))
#: Odd multipliers of the hashes.
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def shingle_keys(hashes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit number for each run of so many words."""
    out = np.full(max(0, len(hashes) - length + 1), length, np.uint64)
    for k in range(length):
        out = out * M1 + hashes[k : k + len(out)]
        out ^= out >> np.uint64(31)
    out = (out ^ (out >> np.uint64(32))) * M2
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def item_windows(benchmark: DataFrame, *, item_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """item (as a string), words (of the window, with a space between), keys (of its shingles), for each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            for item, text in zip(batch.column(0).to_pylist(), ascii_bytes(batch.column(1)), strict=True):
                words = words_of(text)
                if not words:
                    continue
                n, m = min(window, len(words)), min(shingle, len(words))
                keys = shingle_keys(hashes(words), m)
                for first in range(0, len(words) - n + 1, 5_000):
                    at = range(first, min(first + 5_000, len(words) - n + 1))
                    texts = pa.array([b" ".join(words[k : k + n]).decode() for k in at], pa.string())
                    own = pa.array([keys[k : k + n - m + 1] for k in at], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(at), pa.string()), texts, own], ["item", "words", "keys"])

    return benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).mapInArrow(run, "item string, words string, keys array<long>")


def bitmap(keys: DataFrame, map_bits: int = MAP_BITS) -> np.ndarray:
    """Bits that mark the numbers in a column of distinct ones, put together in chunks by tasks; how many is a power of two.

    The driver gets map_bits / 8 bytes at most. As long as the bitmap isn't full, one in 4000 other numbers passes.
    """
    wanted = max(CHUNK_BITS, BITS_EACH * keys.count())
    bits = min(map_bits, 1 << (wanted - 1).bit_length())
    chunk = min(bits, CHUNK_BITS)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(chunk, bool)
        out[pdf["bit"].to_numpy() % chunk] = True
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "bits": [np.packbits(out).tobytes()]})

    key = F.col(keys.columns[0])
    low, high = key.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(key, 32)
    bit = F.explode(F.array(*((low + k * high).bitwiseAND(F.lit(bits - 1)) for k in range(PLACES))))
    placed = keys.select(bit.alias("bit")).distinct().withColumn("chunk", F.floor(F.col("bit") / chunk))
    out = np.zeros(bits // 8, np.uint8)
    for r in placed.groupBy("chunk").applyInPandas(fill, "chunk long, bits binary").toLocalIterator():
        out[r["chunk"] * chunk // 8 : (r["chunk"] + 1) * chunk // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the numbers may be in the bitmap, as places. Most are out after the first look."""
    low, high = keys & 0xFFFFFFFF, (keys.view(np.uint64) >> np.uint64(32)).astype(np.int64)
    left = np.arange(len(keys))
    for k in range(PLACES):
        at = (low[left] + k * high[left]) & (len(bits) * 8 - 1)
        left = left[(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
    return left


def shingle_counts(docs: DataFrame, shared, lengths: list[int], text_col: str) -> DataFrame:
    """key, n: how often each shingle that may be in the bitmap stands in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), np.asarray(shared.value)
        for batch in slices(batches):
            found = []
            for text in ascii_bytes(batch.column(0)):
                h = hashes(words_of(text))
                found += [k[marked(bits, k)] for k in (shingle_keys(h, n) for n in lengths)]
            keys, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    return docs.select(F.col(text_col)).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def filed_windows(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """windows (words, keys) -> key, place, words: each window under its rarest shingle, ties to the first.

    Windows with a shingle that no document holds are left out: no document can hold them.
    """
    each = windows.select("words", F.size("keys").alias("size"), F.posexplode("keys").alias("place", "key")).join(counts, "key")
    best = each.groupBy("words", "size").agg(F.min(F.struct("n", "place", "key")).alias("least"), F.count("*").alias("seen"))
    return best.where("seen = size").select(F.col("least.key").alias("key"), F.col("least.place").alias("place"), "words")


HIT = pa.struct([("key", pa.int64()), ("lead", pa.int64()), ("context", pa.string()), ("places", pa.list_(pa.int64()))])


def document_hits(base: DataFrame, shared, lengths: list[int], keep: tuple[str, ...], window: int) -> DataFrame:
    """base (_id, _text, keep) -> _id, keep, n_words, _hits: shingles that may be filed ones, each with the words around it (lead of them before it) and its places."""
    kinds = dict(base.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), np.asarray(shared.value)
        for batch in slices(batches):
            n_words, hits = [], []
            for text in ascii_bytes(batch.column(1)):
                words = words_of(text)
                h, own = hashes(words), {}
                for n in lengths:
                    keys = shingle_keys(h, n)
                    for at in marked(bits, keys).tolist():
                        begin = max(0, at + n - window)
                        context = b" ".join(words[begin : at + window]).decode()
                        own.setdefault((int(keys[at]), at - begin, context), []).append(at)
                n_words.append(len(words))
                hits.append([{"key": k, "lead": lead, "context": c, "places": p} for (k, lead, c), p in own.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(HIT))], ["_id", *keep, "n_words", "_hits"])

    kept = "".join(f", `{c}` {kinds[c]}" for c in keep)
    return base.mapInArrow(run, f"_id {kinds['_id']}{kept}, n_words long, _hits array<struct<key: long, lead: long, context: string, places: array<long>>>")


def contained(hits: DataFrame, filed: DataFrame) -> DataFrame:
    """hits (_row, key, lead, context, places) joined with the windows filed under key: _row, words, size, place, places, where all words agree."""
    wanted, around = F.split("words", " "), F.split("context", " ")
    begin = F.col("lead") - F.col("place")
    same = F.slice(around, (begin + 1).cast("int"), F.size(wanted)) == wanted
    inside = hits.join(filed, "key").where(F.when(begin >= 0, same).otherwise(False))
    return inside.select("_row", "words", F.size(wanted).alias("size"), "place", "places")


def merged(each: DataFrame) -> DataFrame:
    """_row, begin, end -> _row, spans: a row's spans in order, those that meet or overlap put together."""
    by = Window.partitionBy("_row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    before = each.withColumn("apart", F.coalesce(F.col("begin") > F.max("end").over(by), F.lit(True)).cast("long"))
    runs = before.withColumn("run", F.sum("apart").over(Window.partitionBy("_row").orderBy("begin", "end")))
    spans = runs.groupBy("_row", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return spans.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, shingle: int = SHINGLE, map_bits: int = MAP_BITS) -> DataFrame:
    """A row for each document row: id, n_words, n_hit, items (sorted array of item ids as strings), spans (merged word ranges), and the columns named in keep.

    Null texts have no words. Items with fewer words than a window are one window; items without words are left out;
    an item id that repeats counts once, a null one not at all. Each row of docs gives one row, null and repeated ids and
    repeated rows included. An empty benchmark hits nothing. Other columns are not read.
    """
    share = docs.sparkSession.sparkContext.broadcast
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *keep)
    listed = durable(item_windows(benchmark, item_col=item_col, text_col=item_text_col, window=window, shingle=shingle), "windows")
    lengths = sorted(r["n"] for r in listed.select(F.least(F.size(F.split("words", " ")), F.lit(shingle)).alias("n")).distinct().collect())
    keys = durable(listed.select(F.explode("keys").alias("key")).distinct(), "keys")
    counts = durable(shingle_counts(base, share(bitmap(keys, map_bits)), lengths, "_text"), "counts")
    filed = durable(filed_windows(listed.select("words", "keys").distinct(), counts), "filed")
    read = document_hits(base, share(bitmap(filed.select("key").distinct(), map_bits)), lengths, keep, window)
    rows = durable(read.withColumn("_row", F.monotonically_increasing_id()), "hits")
    found = durable(contained(rows.where(F.size("_hits") > 0).select("_row", F.inline("_hits")), filed), "contained")
    each = found.select("_row", "size", "place", F.explode("places").alias("at")).select("_row", (F.col("at") - F.col("place")).alias("begin"), (F.col("at") - F.col("place") + F.col("size")).alias("end"))
    spans = merged(each.distinct())
    owners = durable(listed.where("item is not null").select("words", "item").distinct(), "owners")
    items = found.select("_row", "words").distinct().join(owners, "words").groupBy("_row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hit = durable(spans.join(items, "_row", "left"), "hit")
    joined = rows.drop("_hits").join(hit, "_row", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<begin:bigint,end:bigint>>"))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return joined.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), spans.alias("spans"), *keep)
