"""Joins of points and ranges with ranges, by aligned blocks.

A range is cut into the few aligned blocks (of 1, 2, 4, ... places) that make it up, and a point lies in one block of each
size. So a pair meets under exactly one block, and only pairs of the result are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a block that meet in one task before its ranges are sent to several.
HOT = 50_000


def _blocks(low: Column, high: Column, bits: int) -> Column:
    """The aligned blocks of [low, high] as (level, block), each the largest that begins at its place and ends inside."""
    start = F.struct(low.cast("long").alias("at"), F.array().cast("array<struct<level:int,block:long>>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        # the lowest bit of the place, no larger than what is left of the range
        left = F.floor(F.log2(high - at + 1)).cast("int")
        level = F.least(F.when(at == 0, bits).otherwise(F.bit_count(at.bitwiseAND(-at) - 1)), left, F.lit(bits)).cast("int")
        width = F.pow(F.lit(2), level).cast("long")
        more = F.struct((at + width).alias("at"), F.array_append(acc["out"], F.named_struct(F.lit("level"), level.cast("int"), F.lit("block"), F.floor(at / width).cast("long"))).alias("out"))
        return F.when(at > high, acc).otherwise(more)

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * bits + 1)), start, step, lambda acc: acc["out"])


def containing(points: DataFrame, ranges: DataFrame, *, key: str, at: str, low: str, high: str, bits: int = 20, hot: int = HOT) -> DataFrame:
    """Each row of points with each row of ranges of the same key that holds its place: the columns of points, then those of ranges but the key.

    Places are whole numbers from 0 to 2^bits - 1. Ranges are closed; one with low above high, or a null, holds
    nothing, and neither does a null key or place match. Only distinct places meet distinct ranges under their blocks; what
    meets then takes the rows of ranges, and those of points. Blocks and places with very many are dealt out: theirs by a
    hash, the other side to each part.
    """
    own = [c for c in ranges.columns if c != key]
    p = points.where(F.col(at).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(at).cast("long").alias("_at"), F.struct(*points.columns).alias("_p"))
    r = ranges.where((F.col(low) <= F.col(high)) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(low).cast("long").alias("_low"), F.col(high).cast("long").alias("_high"), F.struct(*own).alias("_r"))
    shapes = r.groupBy("_key", "_low", "_high").agg(F.count("*").alias("_n"))
    cut = shapes.select("_key", "_low", "_high", F.explode(_blocks(F.col("_low"), F.col("_high"), bits)).alias("_b")).select("_key", "_low", "_high", "_b.level", "_b.block")
    used = cut.agg(F.collect_set("level").alias("_used"))  # a row, with each size at most
    places = p.groupBy("_key", "_at").agg(F.count("*").alias("_n"))
    within = places.crossJoin(F.broadcast(used)).select("_key", "_at", F.explode("_used").alias("level")).withColumn("block", F.expr("shiftright(_at, level)"))
    met = _dealt(within, cut, ["_key", "level", "block"], "_at", hot).select("_key", "_at", "_low", "_high")
    held = _dealt(r, met, ["_key", "_low", "_high"], "_r", hot).select("_key", "_at", "_r")
    return _dealt(p, held, ["_key", "_at"], "_p", hot).select("_p.*", *(F.col(f"_r.{c}").alias(c) for c in own))


def _dealt(rows: DataFrame, others: DataFrame, on: list[str], by: str, hot: int) -> DataFrame:
    """The join of rows with others, where more than hot rows of a key are cut into parts by a hash, and others sent to each. Such keys are few: at most one for each hot rows."""
    many = F.broadcast(rows.groupBy(*on).agg(F.count("*").alias("_m")).where(F.col("_m") > hot).select(*on, F.ceil(F.col("_m") / hot).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(many, on, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    sent = others.join(many, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(sent, [*on, "_part"])


def overlapping(left: DataFrame, right: DataFrame, *, key: str, left_low: str, left_high: str, right_low: str, right_high: str, bits: int = 20, hot: int = HOT) -> DataFrame:
    """Each row of left with each row of right of the same key whose closed range overlaps its own.

    Either the left one begins inside the right one, or the right one begins inside the left one behind its first place:
    two joins of places with ranges, and no pair in both.
    """
    sound = left.where(F.col(left_low) <= F.col(left_high))
    first = containing(sound, right, key=key, at=left_low, low=right_low, high=right_high, bits=bits, hot=hot)
    rest = sound.withColumn("_from", F.col(left_low) + 1)
    second = containing(right.where(F.col(right_low) <= F.col(right_high)), rest, key=key, at=right_low, low="_from", high=left_high, bits=bits, hot=hot)
    return first.unionByName(second.drop("_from").select(first.columns))
