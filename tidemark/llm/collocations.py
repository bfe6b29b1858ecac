"""Phrases that stand together more often than chance, found by passes with hashed buckets (PCY, DHP).

Everything is per language. A pass counts phrases of k words exactly, but only those that can be frequent: both phrases of
k - 1 words inside are frequent (Apriori), and so was the phrase's bucket. Buckets are counted one pass ahead, and only for
phrases whose parts pass; what the next pass gets is a bit for each bucket. A first pass counts the buckets of words and
of pairs, so that exact counting begins with pairs; words are counted exactly only where a frequent pair holds them.
The frequent phrases go to the tasks as a bitmap of their hashes, whose largest size is fixed. Both bitmaps can only let more
phrases through, never fewer, so the counts behind them are whole: a task adds up its own and sends them packed, by parts of the keys;
each part is then added up by the phrase itself, and only frequent phrases come out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, durable, new_path
from tidemark.llm.counters import CHUNK, added, chunks, gathered
from tidemark.llm.decontaminate import bitmap, marked
from tidemark.llm.word_arrays import M1, mix, pieces, words

#: Least occurrences of a phrase, words at most, phrases of a language in the result.
SUPPORT, LONGEST, TOP = 100, 5, 2_000
#: Phrases inside one that is longer by a word and holds this percentage of their occurrences are dropped.
INSIDE = 100
#: Buckets at least and at most (128 MB of counters in a worker, twice that in the first pass; 4 MB of bits).
LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 25
#: Buckets for as many words as may be the start of a frequent phrase.
BUCKETS_EACH = 2
#: Phrases of a task's own counts, and places in its buckets, at most before they are sent on or counted.
HELD, WAITING = 300_000, 1 << 22
#: Parts of a length's phrases in a language that are sent and added up together.
FILED = 128
#: Bytes between pieces, and between words.
BREAK = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
APART = BREAK | np.isin(np.arange(256), list(b" \t"))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Parts that a language's phrases are ranked in before the last ranking.
PARTS = 64


def seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


def gram_keys(hashes: np.ndarray, seeds: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit number for each run of so many words, by language."""
    out = seeds[: max(0, len(hashes) - length + 1)] + np.uint64(length)
    for k in range(length):
        out = out * M1 + hashes[k : k + len(out)]
        out ^= out >> np.uint64(31)
    return mix(out).view(np.int64)


def _every(flags: np.ndarray, length: int) -> np.ndarray:
    """Whether all of so many consecutive flags are set, by the first one's place."""
    out = flags[: max(0, len(flags) - length + 1)].copy()
    for k in range(1, length):
        out &= flags[k : k + len(out)]
    return out


def counting_pass(rows: DataFrame, length: int, buckets: int, most: int, *, singles: Broadcast | None = None, frequent: Broadcast | None = None, passed: Broadcast | None = None, wanted: Broadcast | None = None) -> DataFrame:
    """rows (lang, text) -> lang, k, part, phrases, counts: a task's packed counts of phrases of so many words that may be frequent, and of wanted words, by parts of their keys; and chunk, counts of its buckets of phrases one word longer, if buckets isn't 0.

    singles and passed have a bit for each bucket of words and of these phrases, frequent and wanted mark the keys of the
    phrases one word shorter and of words. With a length of 0, the only phrase of a
    language is the empty one, which stands at each word, and the buckets are those of words, then those of pairs.
    """

    kind = np.min_scalar_type(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets if length else 2 * buckets, np.uint32)
        seed_of: dict[str, int] = {}
        told: dict[int, tuple] = {}
        count: dict[int, int] = {}
        waiting: list[np.ndarray] = []

        def batch_of(chunk: list[int], sums: list[bytes]) -> pa.RecordBatch:
            filed: dict[tuple, list] = {}
            for key, n in count.items():
                lang, phrase, k = told[key]
                filed.setdefault((lang, k, key % FILED), []).append((phrase, n))
            told.clear()
            count.clear()
            rows = []
            for at, own in filed.items():
                phrases, n = zip(*sorted(own), strict=True)
                rows.append((*at, zlib.compress(b"\n".join(phrases), 1), None, zlib.compress(np.array(n, np.int64).tobytes(), 1)))  # no word holds a line feed
            rows += [(None, None, None, None, x, y) for x, y in zip(chunk, sums, strict=True)]
            types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["lang", "k", "part", "phrases", "chunk", "counts"])

        def fill(places: np.ndarray | None) -> None:
            """Count places, WAITING of them at once: over the whole table where that is no larger, else by sorting."""
            if places is not None:
                waiting.append(places.astype(np.int32))
            if waiting and (places is None or sum(map(len, waiting)) > min(len(own), WAITING)):
                every = np.concatenate(waiting)
                waiting.clear()
                if len(own) <= 2 * WAITING:
                    own[:] += np.bincount(every, minlength=len(own)).astype(np.uint32)
                else:
                    at, n = np.unique(every, return_counts=True)
                    own[at] += n.astype(np.uint32)

        def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
            place = keys & (8 * len(bits) - 1)
            return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1

        for batch in pieces(batches):
            langs, w = batch.column(0).to_pylist(), words(batch.column(1), APART)
            h = w.number
            for x in set(langs).difference(seed_of):
                seed_of[x] = seed(x)
            row = np.repeat(np.arange(len(langs)), np.diff(w.rows))
            seeds = np.array([seed_of[x] for x in langs], np.uint64)[row]
            piece = np.cumsum(BREAK[w.text])[w.start] + row if len(h) else row  # grows with each break and row
            keys_of = lambda n: gram_keys(h, seeds, n)[: len(h)]  # noqa: B023, E731
            whole = lambda n: piece[: max(0, len(h) - n + 1)] == piece[n - 1 :]  # noqa: B023, E731

            def add(keys: np.ndarray, at: np.ndarray, size: int) -> None:
                found, first, n = np.unique(keys[at], return_index=True, return_counts=True)
                for key, begin, many in zip(found.tolist(), at[first].tolist(), n.tolist(), strict=True):
                    if key in count:
                        count[key] += many
                    else:
                        count[key] = many
                        phrase = b" ".join(w.text[w.start[k] : w.end[k]].tobytes() for k in range(begin, begin + size)).translate(LOWER)  # noqa: B023
                        told[key] = langs[row[begin]], phrase, size  # noqa: B023

            ones = keys_of(1)
            if length == 0:
                add(keys_of(0), np.arange(len(h)), 0)
                fill(ones & (buckets - 1))
                fill(buckets + (keys_of(2)[whole(2)] & (buckets - 1)))
                continue
            keys, may = keys_of(length), whole(length)
            if singles is not None:
                may &= _every(among(singles.value, ones), length)
            if frequent is not None:
                known = np.zeros(max(0, len(h) - length + 2), bool)
                known[marked(frequent.value, keys_of(length - 1)[: len(known)])] = True
                may &= _every(known, 2)[: len(may)]
            if passed is not None:
                may &= among(passed.value, keys)
            if buckets:
                fill(keys_of(length + 1)[whole(length + 1) & _every(may, 2)] & (buckets - 1))
            add(keys, np.flatnonzero(may), length)
            if wanted is not None:
                add(ones, np.sort(marked(wanted.value, ones)), 1)
            if len(count) > HELD:
                yield batch_of([], [])
        fill(None)
        yield batch_of(*chunks(np.minimum(own, most).astype(kind)) if buckets else ([], []))

    return rows.mapInArrow(run, "lang string, k int, part int, phrases binary, chunk int, counts binary")


def summed(made: DataFrame, support: int) -> DataFrame:
    """What counting_pass made -> lang, phrase, k, key, words, f: the sums of all tasks that are frequent, and each language's number of words. words are the keys of a pair's words."""

    def run(sent: pa.Table) -> pa.Table:
        lang, k = sent["lang"][0].as_py(), sent["k"][0].as_py()
        total: dict[bytes, int] = {}
        for phrases, counts in zip(sent["phrases"].to_pylist(), sent["counts"].to_pylist(), strict=True):
            for phrase, n in zip(zlib.decompress(phrases).split(b"\n"), np.frombuffer(zlib.decompress(counts), np.int64).tolist(), strict=True):
                total[phrase] = total.get(phrase, 0) + n
        found = {phrase.decode(): n for phrase, n in total.items() if n >= support or k == 0}
        w = words(pa.array(list(found), pa.string()), APART)
        seeds = np.full(len(w.number), seed(lang), np.uint64)
        keys = gram_keys(w.number, seeds, k)[w.rows[:-1]].tolist() if k and found else [None] * len(found)
        ones = gram_keys(w.number, seeds, 1).reshape(-1, 2).tolist() if k == 2 else [None] * len(found)
        columns = (([lang] * len(found), pa.string()), (list(found), pa.string()), ([k] * len(found), pa.int32()), (keys, pa.int64()), (ones, pa.list_(pa.int64())), (list(found.values()), pa.int64()))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in columns], ["lang", "phrase", "k", "key", "words", "f"])

    rows = made.where("chunk is null").select("lang", "k", "part", "phrases", "counts")
    return rows.groupBy("lang", "k", "part").applyInArrow(run, "lang string, phrase string, k int, key long, words array<long>, f long")


def bucket_bits(rows: DataFrame, buckets: int, support: int) -> np.ndarray:
    """A bit for each bucket that was filled so often in all tasks."""
    kind = np.min_scalar_type(support)
    bits = added(rows.where("chunk is not null"), kind, support, lambda c: np.packbits(c >= support).tobytes())
    return gathered(bits, buckets // 8, np.uint8, min(CHUNK, buckets) // 8)


def frequent_phrases(rows: DataFrame, support: int, longest: int, least_buckets: int = LEAST_BUCKETS, most_buckets: int = MOST_BUCKETS) -> tuple[DataFrame, DataFrame]:
    """rows (lang, text) -> the frequent phrases of two words or more and the words in them (lang, phrase, k, f), and each language's number of words (lang, n)."""
    share = rows.sparkSession.sparkContext.broadcast
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    wanted = BUCKETS_EACH * size // 6 // support
    buckets = min(most_buckets, max(least_buckets, 1 << int(wanted).bit_length()))

    def counted(length: int, ahead: int, **bits: Broadcast | None) -> tuple[DataFrame, np.ndarray | None]:
        """The frequent phrases of a pass, and the bits of its buckets; what the tasks sent is deleted."""
        made = durable(counting_pass(rows, length, ahead, support, **bits), f"pass{length}", at := new_path(rows.sparkSession, f"pass{length}"))
        counts = durable(summed(made, support), f"counts{length}")
        filled = bucket_bits(made, ahead if length else 2 * ahead, support) if ahead else None
        discard(rows.sparkSession, at)
        return counts, filled

    counts, bits = counted(0, buckets)
    totals, none = counts.select("lang", F.col("f").alias("n")), counts.where("false").select("lang", "phrase", "k", "f")
    singles, passed, known, held, found = share(bits[: buckets // 8]), share(bits[buckets // 8 :]), None, None, none
    for k in range(2, longest + 1):
        ahead = buckets if k < longest else 0
        counts, bits = counted(k, ahead, singles=singles if k == 2 else None, frequent=known, passed=passed, wanted=held)
        here = counts.where((F.col("f") >= support) & (F.col("k") == k))
        found = found.unionByName(counts.where(F.col("f") >= support).select("lang", "phrase", "k", "f"))
        if k == 2:
            held = share(bitmap(here.select(F.explode("words").alias("key")).distinct()))
        elif held is not None:
            held = None  # counted once
        if here.isEmpty() and k > 2:
            break
        if here.isEmpty():
            return durable(none, "frequent"), totals
        if ahead:
            known, passed = share(bitmap(here.select("key").distinct())), share(bits)
    if longest == 2:
        found = found.unionByName(counted(1, 0, frequent=None, wanted=held, passed=share(np.zeros(1, np.uint8)))[0].where(F.col("f") >= support).select("lang", "phrase", "k", "f"))
    return durable(found, "frequent"), totals


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, k, a, n, l, r, score, cut: each phrase of two words or more with its lowest-scoring cut.

    The arithmetic is on decimals of up to 38 digits: counts up to 10^14, a language's words up to 10^18.
    """
    cuts = frequent.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": F.array_join(F.slice("w", 1, F.col("cut")), " "), "right": F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ")}).drop("w")
    part = lambda side, name: frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("(cast(a as decimal(14,0)) * cast(n as decimal(18,0)) * 1000) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    one = ["lang", "phrase", "k", "a", "n"]
    least = both.withColumn("score", score).groupBy(*one).agg(F.min(F.struct("score", "cut", "l", "r")).alias("least"))
    return least.select(*one, "least.l", "least.r", "least.score", "least.cut")


def contained(frequent: DataFrame, percent: int = INSIDE) -> DataFrame:
    """lang, phrase of those inside a longer frequent phrase that holds so large a part of their occurrences.

    One more word is enough to look at: a phrase between both occurs at least as often as the longest.
    """
    longer = frequent.where("k > 2").withColumn("w", F.split("phrase", " "))
    parts = F.explode(F.array(*(F.array_join(F.slice("w", first, F.col("k") - 1), " ") for first in (1, 2))))
    around = longer.select("lang", parts.alias("phrase"), F.col("f").alias("held")).groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    return frequent.join(around, ["lang", "phrase"]).where(100 * F.col("held") >= percent * F.col("f")).select("lang", "phrase")


def mine(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, percent: int = INSIDE, least_buckets: int = LEAST_BUCKETS, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut: the best phrases of each language by score, occurrences, and the phrase's bytes.

    A null text is empty, a null language is "und", and such rows count together with those of that name. Repeated rows
    and ids count each; texts are read whole, once a pass; a phrase ends with its row. Languages without a frequent phrase
    have no rows; neither has an empty table; other columns are not read. Phrases are kept apart by 64-bit hashes while
    they are candidates, and counted under their own words.
    """
    rows = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    frequent, totals = frequent_phrases(rows, support, longest, least_buckets, most_buckets)
    best = scored(frequent, totals).join(contained(frequent, percent), ["lang", "phrase"], "left_anti")
    order = (F.col("score").desc(), F.col("a").desc(), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = durable(best, "scored").withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("cut").cast("long").alias("cut"))
