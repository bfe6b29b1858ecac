"""Groups of similar documents by a grouped prefix join over word shingles.

Shingles are ordered by how rare they are; two sets that are similar enough share one of the rarest of each, their
prefixes. Documents with the same prefix and size are one group, and only groups are joined: by the shingles of their
prefixes, with bounds on their sizes and on the places of the shared one. What passes is expanded to members, and
those are verified on full sets.

The order comes from a small table of counters, one for all shingles whose hashes begin alike. Any order gives the same result, and
this one keeps the frequent shingles out of prefixes. Shingles of prefixes that stand in one document only are left out of
the join by a bitmap of fixed largest size: tasks send 32 bits of each shingle, packed by parts of the hashes, and a part's bits are set where
one comes twice.

Groups that share a shingle of a short list are all paired. The number of shingles that a pair shares in its prefixes
bounds what it can share at all, and drops most pairs. In long lists, groups are first paired with a few hubs, those that stand
in most lists, as an original does beside its edited copies. The result is what hangs together, so only long lists that
then still hold several parts are paired, dealt out by blocks. There, a shingle counts only where it may be the first that a pair
shares, which leaves out copies with too many shingles of their own before they meet.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, durable, new_path
from tidemark.llm.components import components
from tidemark.llm.counters import packed
from tidemark.llm.decontaminate import BITS_EACH, MAP_BITS, PLACES
from tidemark.llm.word_arrays import BYTES, M1, M2, pieces, shingle_sets

#: Counters of shingles, the bits of a hash that choose one, and counters that are added up at once.
COUNTERS, COUNTER_BITS, CHUNK = 1 << 16, np.uint64(48), 1 << 12
#: Groups of a short list; hubs of a long one; groups of a long list's block; pairs of a document that one task verifies.
SHORT, HUBS, BLOCK, PART = 32, 8, 1_000, 512
#: Parts that a list's groups are ranked in before the hubs are chosen.
RANKED = 64
#: Sets of a task whose prefixes it sends once.
SEEN = 200_000
#: Keys of a part of a bitmap, the most parts, and keys that a task holds before it sends them.
KEYS, PARTS, HELD = 1 << 18, 1 << 12, 1 << 20


def needed(x: int, y: int, percent: int) -> int:
    """The least intersection of linked sets of such sizes."""
    return -(-percent * (x + y) // (100 + percent))


def prefix_size(size: int, percent: int) -> int:
    """How many of a set's rarest elements hold at least one of any linked set's: a linked set shares ceil(percent * size / 100)."""
    return size - -(-percent * size // 100) + 1


def shingle_counts(docs: DataFrame, *, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """_id, n_shingles, set_key (128 bits, null if empty) of each row; and, with these null, chunk, counts of each task's shingles."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(COUNTERS, np.int64)
        names = ["_id", "n_shingles", "set_key", "chunk", "counts"]
        id_type = None
        for batch in pieces(batches):
            sets = shingle_sets(batch.column(1), shingle)
            own += np.bincount((np.concatenate(sets) >> COUNTER_BITS).astype(np.int64), minlength=COUNTERS)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            n, id_type = len(sets), batch.column(0).type
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if id_type is not None:
            counted = own.reshape(-1, CHUNK)
            used = np.flatnonzero(counted.any(axis=1))
            counts, n = [packed(counted[k]) for k in used], len(used)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(used, pa.int32()), pa.array(counts, pa.binary())], names)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, n_shingles long, set_key binary, chunk int, counts binary")


def _by_part(rows: DataFrame, fold: Callable[[int, list[bytes]], list], schema: str) -> DataFrame:
    """rows (part, packed) -> what fold gives for each part, in one shuffle. A task goes from part to part and holds one at a time."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, types = None, [], None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(fold(now, held), types, strict=True)], names)
        types = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
        for batch in batches:
            for part, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and held:
                    yield done()
                    held = []
                now = part
                held.append(row)
        if held:
            yield done()

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def summed(read: DataFrame) -> np.ndarray:
    """The tasks' counters (chunk, counts), added up chunk by chunk: a task sends one row for each, however much it has read."""

    def fold(chunk: int, rows: list[bytes]) -> list:
        total = np.zeros(CHUNK, np.int64)
        for x in rows:
            total += np.frombuffer(zlib.decompress(x), np.int64)
        return [chunk, total.tobytes()]

    out = np.zeros(COUNTERS, np.int64)
    for r in _by_part(read.select(F.col("chunk").alias("part"), "counts"), fold, "part int, counts binary").collect():
        out[r["part"] * CHUNK : (r["part"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    return out


def _split(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's part, by its first bits, and the 32 bits behind them."""
    bits = np.uint64(parts.bit_length() - 1)
    keys = keys.view(np.uint64)
    return (keys >> np.uint64(32) >> (np.uint64(32) - bits)).astype(np.int64), (keys >> (np.uint64(32) - bits)).astype(np.uint32)


def _places(low: np.ndarray, bits: int) -> np.ndarray:
    """The places of keys in a part of so many bits, by rows."""
    x = low.astype(np.uint64) * M1
    return np.stack([((x ^ (x >> np.uint64(32))) * (M2 + np.uint64(2 * k)) >> np.uint64(32)).astype(np.int64) & (bits - 1) for k in range(PLACES)])


def bit_table(keys: DataFrame, least: int) -> np.ndarray:
    """Bits that mark the 64-bit numbers which stand at least so often (1 or 2) in a column of arrays, a row for each part of the numbers.

    Tasks send 32 bits of each, packed by parts whose number grows with the keys, and each part is put together by itself: one
    shuffle of 4 bytes a key. The driver gets MAP_BITS / 8 bytes at most.
    """
    column = keys.columns[0]
    total = keys.agg(F.sum(F.size(column))).first()[0] or 0
    parts = min(PARTS, 1 << max(0, (total // KEYS).bit_length()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flushed() -> pa.RecordBatch:
            part, low = _split(np.concatenate(held), parts)
            order = np.lexsort((low, part))
            part, low = part[order], low[order]
            again = np.ones(len(low), bool)  # no number is sent more often than it has to stand
            again[least:] = (low[least:] != low[: len(low) - least]) | (part[least:] != part[: len(low) - least])
            part, low = part[again], low[again]
            used, first = np.unique(part, return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([x.tobytes() for x in np.split(low, first[1:])], pa.binary())], ["part", "packed"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            n += len(held[-1])
            if n >= HELD:
                yield flushed()
                held, n = [], 0
        if n:
            yield flushed()

    def often(part: int, rows: list[bytes]) -> list:
        low = np.sort(np.frombuffer(b"".join(rows), np.uint32))
        found = np.unique(low if least == 1 else low[1:][low[1:] == low[:-1]])
        return [part, len(found), found.tobytes()]

    sent = keys.where(F.col(column).isNotNull()).mapInArrow(send, "part int, packed binary")
    found = durable(_by_part(sent, often, "part int, n long, packed binary"), "keys")
    most = found.agg(F.max("n")).first()[0] or 1
    bits = min(MAP_BITS // parts, 1 << (max(1 << 10, BITS_EACH * most) - 1).bit_length())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.zeros(bits, bool)
                own[_places(np.frombuffer(low, np.uint32), bits)] = True
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["part", "bits"])

    out = np.zeros((parts, bits // 8), np.uint8)
    for r in found.select("part", "packed").mapInArrow(fill, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the numbers may be in the table, as places."""
    part, low = _split(keys, len(table))
    hit = np.ones(len(keys), bool)
    for at in _places(low, table.shape[1] * 8):
        hit &= (table[part, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return np.flatnonzero(hit)


def prefixes(docs: DataFrame, counters, *, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """_id, grp, size, prefix of each row with shingles: the group of its prefix and size, and the prefix, rarest first, unless the task has sent this group's."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = counters.value, set()
        for batch in pieces(batches):
            rows, groups, sizes, found = [], [], [], []
            for row, s in enumerate(shingle_sets(batch.column(1), shingle)):
                if not len(s):
                    continue
                order = np.argsort(counts[(s >> COUNTER_BITS).astype(np.int64)], kind="stable")  # s is sorted, so ties are in order
                prefix = s[order[: prefix_size(len(s), percent)]]
                key = prefix.tobytes() + len(s).to_bytes(8, "little")
                rows.append(row)
                groups.append(xxhash.xxh3_64_intdigest(key) - (1 << 63))
                sizes.append(len(s))
                mark = hashlib.blake2b(key, digest_size=16).digest()
                found.append(None if mark in seen else prefix.view(np.int64))
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(mark)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(groups, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["_id", "grp", "size", "prefix"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, grp long, size long, prefix array<long>")


def postings(rows: DataFrame, shared) -> DataFrame:
    """rows (grp, size, prefix) -> token, grp, size, place: the prefixes' shingles that may stand in several of them, each once a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            lists = batch.column(2)
            tokens = lists.flatten().to_numpy()
            many = np.diff(np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())))
            first = np.repeat(np.cumsum(many) - many, many)
            hit = marked(shared.value, tokens)
            at = pa.array(np.repeat(np.arange(len(many)), many)[hit], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(tokens[hit], pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array((np.arange(len(tokens)) - first)[hit], pa.int64())], ["token", "grp", "size", "place"])

    return rows.where("prefix is not null").select("grp", "size", "prefix").mapInArrow(run, "token long, grp long, size long, place long").repartition("grp").distinct()  # a group's rows lie together, and compress


def texts_of(docs: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """rep, packed text of the rows whose id is in wanted (rep), and perhaps of some others. Nothing is shuffled."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(wanted.select(F.array(F.xxhash64("rep")).alias("keys")), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 10_000):
            rows = pa.array(marked(shared.value, batch.column(2).to_numpy()), pa.int64())
            texts = [zlib.compress(x, 1) for x in batch.column(1).take(rows).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(texts, pa.binary())], ["rep", "text"])

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(id_col).alias("_key"))
    return rows.mapInArrow(run, f"rep {kind}, text binary")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """pairs (u, v) -> those whose full sets are similar enough.

    Texts are sent and not sets, since they compress to less, and packed one by one. The v of a u pass one by one, in parts of so many.
    """
    kind = dict(pairs.dtypes)["u"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in pieces(batches, 200, BYTES >> 2):  # unpacked, they are larger
            us, vs = [], []
            texts = pa.array([zlib.decompress(x) for x in batch.column(3).to_pylist()], pa.binary()).cast(pa.string())
            for u, part, v, s in zip(*(c.to_pylist() for c in batch.columns[:3]), shingle_sets(texts, shingle), strict=True):
                if (u, part) != now:
                    now, own = (u, part), []
                if v is None:
                    own.append(s)
                    continue
                for o in own:
                    if 100 * min(len(o), len(s)) < percent * max(len(o), len(s)) or not len(s):
                        continue
                    at = np.minimum(o.searchsorted(s), len(o) - 1)
                    both = int((o[at] == s).sum())
                    if 100 * both >= percent * (len(o) + len(s) - both):
                        us.append(u)
                        vs.append(v)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(us, batch.column(0).type), pa.array(vs, batch.column(2).type)], ["u", "v"])

    many = pairs.groupBy("u").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = pairs.join(many, "u").select("u", F.pmod(F.xxhash64("v"), "parts").alias("part"), "v")
    own = dealt.select(F.col("u").alias("rep"), "u", "part", F.lit(None).cast(kind).alias("v")).distinct()
    both = own.union(dealt.select(F.col("v").alias("rep"), "u", "part", "v")).join(texts, "rep").select("u", "part", "v", "text")
    dealt_out = both.repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    return dealt_out.mapInArrow(run, f"u {kind}, v {kind}")


def fitting(a: str, b: str, percent: int) -> Column:
    """Whether sets of such sizes may be linked."""
    return 100 * F.least(f"size_{a}", f"size_{b}") >= percent * F.greatest(f"size_{a}", f"size_{b}")


def enough(shared: Column, percent: int) -> Column:
    """Whether groups a and b, with so many shingles shared by their prefixes at most, may hold linked sets. Behind the prefix that ends first, all of that set may be shared."""
    behind = lambda side: F.ceil(percent * F.col(f"size_{side}") / 100) - 1
    return (100 + percent) * (shared + F.greatest(behind("a"), behind("b"))) >= percent * (F.col("size_a") + F.col("size_b"))


def _side(entries: DataFrame, name: str) -> DataFrame:
    return entries.select(*(F.col(c).alias(c if c in ("token", "row", "block", "blocks") else f"{c}_{name}") for c in entries.columns))


def leading(percent: int) -> Column:
    """Whether a shingle may be the first that linked sets of groups a and b share: from it on, all that they share has to fit in both."""
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    return (100 + percent) * left >= percent * (F.col("size_a") + F.col("size_b"))


def hub_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """entries (token, grp, size, place, degree) of long lists -> a, b: each group with the first hubs of its lists that it may be linked to."""
    order = (F.col("degree").desc(), "grp")
    part = F.pmod(F.xxhash64("grp"), F.lit(RANKED))
    some = entries.withColumn("rank", F.row_number().over(Window.partitionBy("token", part).orderBy(*order))).where(F.col("rank") <= HUBS)
    hubs = some.withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy(*order))).where(F.col("rank") <= HUBS).drop("rank")
    both = _side(entries, "a").join(_side(hubs, "b"), "token").where((F.col("grp_a") != F.col("grp_b")) & fitting("a", "b", percent))
    both = both.where(leading(percent))
    best = both.groupBy("grp_a").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("degree_b")).alias("d"), "grp_b"))), 1, 2).alias("best"))  # a group has few lists, and a list few hubs
    return best.select(F.col("grp_a"), F.explode("best.grp_b").alias("grp_b")).select(F.least("grp_a", "grp_b").alias("a"), F.greatest("grp_a", "grp_b").alias("b"))


def met(entries: DataFrame, percent: int) -> DataFrame:
    """entries (token, grp, size, n, ...) -> the pairs of groups a and b in a list whose sizes fit, with the other columns of both.

    A list of n groups is cut into blocks by a hash, and each pair of blocks is joined by itself.
    """
    own = entries.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n").withColumn("block", F.pmod(F.xxhash64("grp"), "blocks").cast("int"))
    a = _side(own, "a").withColumn("row", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    b = _side(own, "b").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return a.join(b, ["token", "row", "block"]).where((F.col("grp_a") < F.col("grp_b")) & fitting("a", "b", percent))


def group_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """entries (token, grp, size, n, other, ...) -> a, b: pairs of groups that share a shingle and pass the bounds. other is how many shingles a group has in lists that aren't here."""
    pairs = met(entries.drop("place", "degree"), percent)
    counted = pairs.groupBy(F.col("grp_a").alias("a"), F.col("grp_b").alias("b"), "size_a", "size_b", "other_a", "other_b").agg(F.count("*").alias("shared"))
    return counted.where(enough(F.col("shared") + F.least("other_a", "other_b"), percent)).select("a", "b")


def leads(entries: DataFrame, percent: int) -> DataFrame:
    """entries (token, grp, size, place, ...) -> those whose shingle may be the first that the group shares with another one of its list.

    An edited copy has its own shingles before those of the original. With many of them, what is left from a shingle of the list
    on is too little for any size of the list that may be linked to it. Sizes are looked up by bands: what may be linked lies in the same
    one or the next.
    """
    band = F.floor(F.log("size") / float(np.log(101 / percent)))  # a little wider than the ratio of linked sizes
    banded = entries.withColumn("band", band)
    least = banded.select("token", "size", F.explode(F.array("band", F.col("band") + 1)).alias("band")).groupBy("token", "band").agg(F.min("size").alias("least"))
    other = F.greatest("least", F.ceil(percent * F.col("size") / 100))
    return banded.join(least, ["token", "band"]).where((100 + percent) * (F.col("size") - F.col("place")) >= percent * (F.col("size") + other)).drop("band", "least")


def leading_pairs(entries: DataFrame, percent: int, condition: Column) -> DataFrame:
    """entries (token, grp, size, place, n, ...) -> a, b: pairs of groups with the condition that may share a shingle of these lists as their first one."""
    pairs = met(entries, percent).where(leading(percent) & condition)
    return pairs.select(F.col("grp_a").alias("a"), F.col("grp_b").alias("b")).distinct()


def similar_edges(docs: DataFrame, reps: DataFrame, counters: np.ndarray, *, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """Edges u, v between ids in reps (rep: one document of each distinct set) that connect all that is linked, by what is found first as stars."""
    spark = docs.sparkSession
    docs = docs.where(F.col(id_col).isNotNull())  # so each group has a member in reps
    share = spark.sparkContext.broadcast
    of = {"id_col": id_col, "text_col": text_col}
    rows = durable(prefixes(docs, share(counters), shingle=shingle, percent=percent, **of), "prefixes", at := new_path(spark, "prefixes"))
    posted = durable(postings(rows, share(bit_table(rows.select("prefix"), 2))), "postings", listed_at := new_path(spark, "postings"))
    members = durable(rows.join(reps, F.col("_id") == F.col("rep"), "left_semi").select(F.col("_id").alias("rep"), "grp").distinct(), "members")
    discard(spark, at)
    groups = durable(members.groupBy("grp").agg(F.min("rep").alias("leader"), F.count("*").alias("m")), "groups")
    lists = posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    listed = posted.join(lists, "token")
    is_long = F.col("n") > SHORT
    own = Window.partitionBy("grp")  # as many rows as a prefix holds
    entries = durable(listed.withColumns({"degree": F.count("*").over(own), "long": F.count_if(is_long).over(own)}), "entries")
    discard(spark, listed_at)
    short = entries.where(~is_long).withColumn("other", F.col("long")).drop("long")
    long = entries.where(is_long).withColumn("other", F.col("degree") - F.col("long")).drop("long")
    pairs = durable(group_pairs(short, percent).union(hub_pairs(long.drop("n", "other"), percent)).distinct(), "group_pairs")

    def texts(named: DataFrame, name: str) -> DataFrame:
        return durable(texts_of(docs, named, **of), name)

    def expanded(named: DataFrame, pairs: DataFrame) -> DataFrame:
        """The members' pairs of pairs of groups, in different components only."""
        member = lambda side, name: named.select(F.col("grp").alias(side), F.col("rep").alias(name), F.col("component").alias(f"of_{name}"))
        both = pairs.join(member("a", "u"), "a").join(member("b", "v"), "b").where("of_u != of_v and (a != b or u < v)")
        return durable(both.select("u", "v").distinct(), "pairs")

    # leaders of paired groups, and each member with its group's leader
    leader = lambda side, name: groups.select(F.col("grp").alias(side), F.col("leader").alias(name))
    within = members.join(groups.where("m > 1"), "grp").select(F.col("leader").alias("u"), F.col("rep").alias("v"))
    first = durable(pairs.join(leader("a", "u"), "a").join(leader("b", "v"), "b").select("u", "v").union(within).where("u != v").distinct(), "first_pairs")
    edges = durable(verified(first, texts(first.select(F.col("u").alias("rep")).union(first.select("v")), "texts"), shingle, percent), "links")
    found = durable(components(edges), "components")
    named = durable(members.join(found, F.col("rep") == F.col("node"), "left").select("rep", "grp", F.coalesce("component", "rep").alias("component")), "named")
    spread = durable(named.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")), "spread")
    apart = (F.col("low_a") != F.col("high_b")) | (F.col("low_b") != F.col("high_a"))
    # of groups with several members, only the leaders are compared yet
    side = lambda x: spread.select(F.col("grp").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("low", "high", "m")))
    again = pairs.join(side("a"), "a").join(side("b"), "b").where(apart & ((F.col("m_a") > 1) | (F.col("m_b") > 1))).select("a", "b")
    again = again.union(spread.where("low != high").select(F.col("grp").alias("a"), F.col("grp").alias("b")))
    # long lists that several components hold
    labelled = durable(leads(long.drop("n", "degree", "other"), percent).join(spread.drop("m"), "grp"), "leads")
    still = labelled.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count("*").alias("n")).where("least != most").select("token", "n")
    open_ = durable(labelled.join(still, "token"), "open")
    rest = expanded(named, durable(again.union(leading_pairs(open_, percent, apart)).distinct(), "open_pairs"))
    stars = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    if rest.isEmpty():
        return stars
    ids = rest.select(F.col("u").alias("rep")).union(rest.select("v"))
    return stars.unionByName(durable(verified(rest, texts(ids, "texts"), shingle, percent), "links"))


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs: id, n_shingles, component_id (the smallest id reachable over links, itself included).

    Documents link if 100 * shared shingles >= percent * all shingles of both. Null texts and texts without words have an
    empty set and link with nothing. ids may be of any kind that has an order. Rows that repeat an id are one document with several
    texts. A row with a null id takes the component of its text's copies that have one, else null. An empty table gives no
    rows; other columns are not read. Texts are read whole.
    """
    of = {"id_col": id_col, "text_col": text_col, "shingle": shingle}
    read = durable(shingle_counts(docs, **of), "read")
    sign = read.where("chunk is null").select("_id", "n_shingles", "set_key")
    counters = summed(read.where("chunk is not null"))
    classes = durable(sign.where("set_key is not null").groupBy("set_key").agg(F.min("_id").alias("rep"), F.count("*").alias("copies")), "classes")
    edges = similar_edges(docs, classes.where("rep is not null").select("rep").distinct(), counters, percent=percent, **of)
    # an id with several texts is one document, so it holds their classes together
    several = sign.where("set_key is not null").groupBy("_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low != high and _id is not null").select("_id")
    same = sign.join(several, "_id", "left_semi").join(classes, "set_key").select(F.col("_id").alias("u"), F.col("rep").alias("v"))
    found = components(edges.unionByName(same))
    label = classes.join(found, F.col("rep") == F.col("node"), "left").where("copies > 1 or component is not null").select("set_key", F.coalesce("component", "rep").alias("component"))
    return sign.join(label, "set_key", "left").select(F.col("_id").alias(id_col), "n_shingles", F.coalesce("component", "_id").alias("component_id"))
