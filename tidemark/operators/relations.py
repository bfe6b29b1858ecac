"""Joins and set operations: point-in-time versions, drift and parity, overlays, upserts, similarity joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.alike import _ragged
from tidemark.sources.durable import written


def asof(facts: DataFrame, versions: DataFrame, key: str, at: str, *, version_date: str, effective_date: str, carry: str, name: str = "version") -> DataFrame:
    """facts with the version that holds at their date: of those published and effective by then, the latest published; ties go to the smallest carry.

    A key's facts and versions are sorted together month by month, and the best version so far runs along; what was the
    best before a month is carried into it. So a key with very many facts is spread over its months, and no pairs are made.
    Versions without an effective date never hold. Facts without a date or version get null.
    """
    since = F.greatest(F.col(version_date), F.col(effective_date))
    month = lambda d: (F.year(d) * 12 + F.month(d)).alias("_month")
    best = _best_type(versions, version_date, carry)
    left = facts.select(F.col(key).alias("_key"), F.col(at).alias("_at"), month(F.col(at)), F.lit(1).alias("_kind"), F.struct(*facts.columns).alias("_fact"), F.lit(None).cast(best).alias("_best"))
    usable = versions.where(F.col(effective_date).isNotNull() & F.col(version_date).isNotNull())
    right = usable.select(F.col(key).alias("_key"), since.alias("_at"), month(since), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_fact"].dataType).alias("_fact"), F.struct(F.col(version_date).alias("d"), (-F.col(carry)).alias("c")).alias("_best"))
    both = left.unionByName(right)
    months = both.groupBy("_key", "_month").agg(F.max("_best").alias("_top"), F.max("_kind").alias("_facts"))  # combined before the shuffle
    before = F.max("_top").over(W.partitionBy("_key").orderBy("_month").rowsBetween(W.unboundedPreceding, -1))
    carried = months.withColumn("_best", before).where("_facts = 1 and _best is not null")
    first = carried.select("_key", F.lit(None).cast(left.schema["_at"].dataType).alias("_at"), "_month", F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_fact"].dataType).alias("_fact"), "_best")
    running = F.max("_best").over(W.partitionBy("_key", "_month").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0))
    found = both.unionByName(first).withColumn(name, running).where("_kind = 1")
    held = F.when(F.col("_at").isNotNull(), -F.col(name)["c"])
    return found.select("_fact.*", held.alias(name))


def _best_type(versions: DataFrame, version_date: str, carry: str) -> str:
    kinds = dict(versions.dtypes)
    return f"struct<d:{kinds[version_date]},c:{kinds[carry]}>"


def latest_range(facts: DataFrame, at: Column, ranges: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """facts with the name of the range that holds at; of several, that with the latest start, of equal ones the largest name. ranges is a fixed small table.

    The ranges come to each fact as one sorted array, so facts aren't shuffled and repeated ones stay.
    """
    listed = ranges.agg(F.sort_array(F.collect_list(F.struct(F.col(first).alias("a"), F.col(name).alias("v"), F.col(last).alias("b"))), asc=False).alias("_ranges"))
    held = facts.withColumn("_at", at).join(F.broadcast(listed))
    found = F.filter("_ranges", lambda r: (F.col("_at") >= r["a"]) & (F.col("_at") <= r["b"]))
    return held.withColumn(name, F.get(found, F.lit(0))["v"]).drop("_at", "_ranges")


def numbered(rows: DataFrame, order: str, ranges: int = 200) -> DataFrame:
    """rows with place: 1, 2, ... by a numeric column without repeats and nulls.

    The column's quantiles cut the rows into ranges; these are counted, and each range numbers its own rows from there.
    """
    share = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
    cuts = rows.agg(F.percentile_approx(order, share, F.lit(50 * ranges)).alias("_cuts"))
    at = rows.join(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    n = at.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    before = n.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(order))
    return at.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn("place", (F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_own", "_before")


def drift(expected: DataFrame, actual: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Full outer comparison by key, null-safe: key, state (same, changed, missing, extra), changed (names of fields)."""
    e = expected.select(key, F.struct(*fields).alias("e"))
    a = actual.select(key, F.struct(*fields).alias("a"))
    both = e.join(a, key, "full_outer")
    names = F.array_compact(F.array(*(F.when(~F.col("e")[f].eqNullSafe(F.col("a")[f]), F.lit(f)) for f in fields)))
    inner = F.col("e").isNotNull() & F.col("a").isNotNull()
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.size(names) > 0, "changed").otherwise("same")
    return both.select(key, state.alias("state"), F.when(inner, names).otherwise(F.array().cast("array<string>")).alias("changed"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one side only."""
    return a.subtract(b).unionAll(b.subtract(a))


def overlay(base: DataFrame, patch: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """base with the fields of patch where it has the key, nulls of patch included: a present key is not a non-null value."""
    p = patch.select(key, F.struct(*fields).alias("_patch"))
    out = base.join(p, key, "left")
    return out.withColumns({f: F.when(F.col("_patch").isNotNull(), F.col("_patch")[f]).otherwise(F.col(f)) for f in fields}).withColumn("patched", F.col("_patch").isNotNull()).drop("_patch")


def orphans(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    return patch.join(base, key, "left_anti")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], merge: dict[str, Column]) -> DataFrame:
    """Insert or update without MERGE: a full outer join. merge: field -> the merged value, as a column over the structs old and new."""
    fields = list(merge)
    old = target.select(*keys, F.struct(*fields).alias("old"))
    new = source.select(*keys, F.struct(*fields).alias("new"))
    both = old.join(new, list(keys), "full_outer")
    pick = lambda f: F.when(F.col("old").isNull(), F.col("new")[f]).when(F.col("new").isNull(), F.col("old")[f]).otherwise(merge[f])
    return both.select(*keys, *(pick(f).alias(f) for f in fields))


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target and the rows of source whose key it lacks, one a key."""
    return target.unionByName(source.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti"))


#: Sets and tokens of a slab at most (about), and at least that many slabs where there are so many sets; columns of a comparison's matrix, and those that suffice for small sets; rows of a step.
SLAB, TOKENS, SLABS, FEW, WIDTH, NARROW, STEP = 2_000, 250_000, 8, 500, 2_048, 128, 250
#: Slabs of a partition; partitions at least, where there are so many slabs; pairs sent at once.
HELD, PARTS, PAIRS = 8, 12, 65_536


def _packed(table: pa.Table) -> pa.Table:
    """A slab (rows block, slab, id, t) as one row: its ids, and sizes, different tokens and numbers of the sets' tokens among these as bytes."""
    lists, ids = table["t"].combine_chunks(), table["id"].combine_chunks()
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
    known, codes = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    sides = {"low": [n.min()], "high": [n.max()], "ids": pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), ids)}
    return pa.table({"block": table["block"][:1], "slab": table["slab"][:1]} | sides | {name: pa.array([x.tobytes()], pa.binary()) for name, x in (("sizes", n), ("known", known), ("codes", codes.astype(np.int32)))})


def _compared(kinds: tuple[str, str], jaccard: int, overlap: int | None) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]:
    """The comparison of two slabs (a row block, x, y, and both sides' ids, sizes, known and codes) or of one with itself, and its schema."""
    names = ["block", "a", "b", "n_shared", "n_all", "n_less"]

    def pairs(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], same: bool) -> Iterator[tuple[np.ndarray, ...]]:
        (x_ids, n, x_known, x_codes), (y_ids, m, y_known, y_codes) = x, y
        known = np.union1d(x_known, y_known)
        x_at, y_at = np.searchsorted(known, x_known)[x_codes], np.searchsorted(known, y_known)[y_codes]
        rank = np.empty(len(known), np.int64)
        rank[np.argsort(-np.bincount(x_at, minlength=len(known)) - np.bincount(y_at, minlength=len(known)), kind="stable")] = np.arange(len(known))
        x_token, y_token, begin, y_begin = rank[x_at], rank[y_at], np.append(0, np.cumsum(n)), np.append(0, np.cumsum(m))
        width = min(len(known), max(WIDTH, SLAB * WIDTH // max(len(n), len(m))))
        if overlap is None:  # pairs are few, and sets that differ stay far below what they need even if tokens share columns
            width = min(width, max(NARROW, 4 * int(max(n.max(), m.max()))))

        def marked(sizes: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            marks = np.zeros((len(sizes), width), np.float32)
            marks[np.repeat(np.arange(len(sizes)), sizes), token % width] = 1
            return marks, sizes - marks.sum(1).astype(np.int32)  # tokens that share a column with another one of their set

        marks, spare = marked(n, x_token)
        against, y_spare = (marks, spare) if same else marked(m, y_token)
        has = np.zeros(len(known), bool)
        for first in range(0, len(n), STEP):
            own = slice(first, first + STEP)
            most = marks[own] @ against.T  # shared tokens at most, exact if no column is shared
            if width < len(known):
                most += np.minimum(spare[own][:, None], y_spare)
            k = n[own][:, None]
            wanted = -(-jaccard * (k + m) // (100 + jaccard))
            if overlap is not None:
                wanted = np.minimum(wanted, -(-overlap * np.minimum(k, m) // 100))
            fits = most >= wanted
            if same:
                fits &= np.arange(len(m)) > np.arange(first, first + len(k))[:, None]
            i, j = np.divmod(np.flatnonzero(fits), len(m))
            shared = most[i, j].astype(np.int64)
            if width < len(known) and len(i):
                for u, start, many in zip(*np.unique(i, return_index=True, return_counts=True), strict=True):
                    tokens = x_token[begin[first + u] : begin[first + u + 1]]
                    has[tokens] = True
                    row, place = _ragged(y_begin, j[start : start + many])
                    shared[start : start + many] = np.bincount(row[has[y_token[place]]], minlength=many)
                    has[tokens] = False
                sure = shared >= wanted[i, j]
                i, j, shared = i[sure], j[sure], shared[sure]
            u, v = x_ids[first + i], y_ids[j]
            low, both = u < v, (n[first + i].astype(np.int64), m[j].astype(np.int64))
            yield np.where(low, u, v), np.where(low, v, u), shared, both[0] + both[1] - shared, np.minimum(*both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch["x_ids"].type.value_type
            for r in range(batch.num_rows):
                side = lambda name: (batch[f"{name}_ids"][r].values.to_numpy(zero_copy_only=False), *(np.frombuffer(batch[f"{name}_{c}"][r].as_buffer(), t) for c, t in (("sizes", np.int32), ("known", np.int64), ("codes", np.int32))))  # noqa: B023, E731
                for a, b, *counts in pairs(side("x"), side("y"), batch["x"][r] == batch["y"][r]):
                    columns = [pa.repeat(batch["block"][r], len(a)), pa.array(a, kind), pa.array(b, kind), *map(pa.array, counts)]
                    made = pa.RecordBatch.from_arrays(columns, names)
                    yield from (made.slice(at, PAIRS) for at in range(0, len(a), PAIRS))

    return run, f"block {kinds[0]}, a {kinds[1]}, b {kinds[1]}, n_shared long, n_all long, n_less long"


def _set_pairs(rows: DataFrame, id_col: str, block: str, tokens: str, jaccard: int, overlap: int | None) -> DataFrame:
    """block, a, b, n_shared, n_all, n_less of all pairs that are alike enough.

    With few different tokens nearly every pair shares a rare one, so there is no join on tokens: the sets of a block are
    dealt into slabs by size, and each two slabs whose sizes may fit are compared whole by products of matrices. A slab is a
    row, bounded in sets and tokens, and these rows meet as partitions of a Cartesian product, which copies none of them to
    disk: what is written grows with the sets, only the work with their square. Pairs leave a task as they are found.
    """
    t = rows.select(F.col(id_col).alias("id"), F.col(block).alias("block"), F.array_sort(F.transform(F.array_distinct(tokens), lambda w: F.xxhash64(w))).alias("t")).where((F.size("t") > 0) & F.col("block").isNotNull())
    t = written(t.groupBy("block", "t").agg(F.min("id").alias("id")).withColumn("n", F.size("t")), "sets")
    kinds = dict(t.dtypes)
    sizes = t.groupBy("block", "n").agg(F.count("*").alias("m"))  # a row for each size
    all_ = F.sum("m").over(W.partitionBy("block"))
    share = F.greatest(1 / F.greatest(F.lit(1), F.least(F.lit(SLAB), F.greatest(F.lit(FEW), F.ceil(all_ / SLABS)))), F.col("n") / TOKENS)  # of a slab, by a set
    sizes = sizes.withColumn("share", share).withColumn("before", F.sum(F.col("m") * F.col("share")).over(W.partitionBy("block").orderBy("n")) - F.col("m") * F.col("share"))
    dealt = t.join(F.broadcast(sizes), ["block", "n"]).select("block", F.floor(F.col("before") + F.pmod(F.xxhash64("id"), "m") * F.col("share")).cast("int").alias("slab"), "id", "t")
    schema = f"block {kinds['block']}, slab int, low int, high int, ids array<{kinds['id']}>, sizes binary, known binary, codes binary"
    slabs = written(dealt.groupBy("block", "slab").applyInArrow(_packed, schema), "slabs")
    many = slabs.count()
    slabs = slabs.repartition(max(1, min(many, PARTS), -(-many // HELD)))
    side = lambda name: slabs.select("block", F.col("slab").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("low", "high", "ids", "sizes", "known", "codes")))
    x, y = side("x").hint("shuffle_replicate_nl"), side("y").withColumnRenamed("block", "y_block")
    fits = F.lit(True) if overlap is not None else 100 * F.col("x_high") >= jaccard * F.col("y_low")
    both = x.join(y, (F.col("block") == F.col("y_block")) & (F.col("x") <= F.col("y")) & fits).drop("y_block", "x_low", "x_high", "y_low", "y_high")
    run, schema = _compared((kinds["block"], kinds["id"]), jaccard, overlap)
    return both.mapInArrow(run, schema)


def jaccard_pairs(rows: DataFrame, id_col: str, block: str, tokens: str, percent: int) -> DataFrame:
    """Pairs (a < b) inside a block with 100 * shared >= percent * all tokens, with n_shared and n_all.

    Rows with the same tokens are compared as one and listed under their smallest id, so copies make no pairs;
    membership gives the rest.
    """
    return _set_pairs(rows, id_col, block, tokens, percent, None).drop("n_less")


def containments(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """a, b: the distinct texts of left and right of which one contains the other (equal ones included), null ones left out.

    A text that another holds brings its first two characters along, so each is joined by its own with all runs of two
    characters of the other side; those of a single character by that, an empty one with all.
    """
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    head = lambda c: F.substring(c, 1, 2)
    every = lambda c: F.array_distinct(F.concat(F.array(F.lit("")), chars(F.col(c)), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.col(c).substr(i, F.lit(2)))))
    x, y = left.select(a).where(F.col(a).isNotNull()).distinct(), right.select(b).where(F.col(b).isNotNull()).distinct()
    inside = x.withColumn("k", head(F.col(a))).join(y.withColumn("k", F.explode(every(b))), "k").where(F.contains(b, a))
    around = x.withColumn("k", F.explode(every(a))).join(y.withColumn("k", head(F.col(b))), "k").where(F.contains(a, b))
    return inside.select(a, b).unionByName(around.select(a, b)).distinct()


def alike_pairs(rows: DataFrame, id_col: str, block: str, tokens: str, jaccard_percent: int, overlap_percent: int) -> DataFrame:
    """Pairs (a < b) inside a block with 100 * shared >= jaccard_percent * all tokens, or >= overlap_percent * tokens of the smaller set: n_shared, n_all, n_less.

    An overlap doesn't bound the larger set, so that all slabs of a block are compared. Rows with the same tokens are
    compared as one and listed under their smallest id.
    """
    return _set_pairs(rows, id_col, block, tokens, jaccard_percent, overlap_percent)
