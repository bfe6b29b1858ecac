"""Many aliases in many texts by an automaton that each worker builds once and runs over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Aliases of one automaton; a larger dictionary is matched in parts, each in a pass over the texts.
PART = 500_000
BLANKS = re.compile("[ \t\n\x0b\f\r]+")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


class Matcher:
    """Keys of the aliases that stand in a lower-case text.

    An ASCII alias needs borders (no a-z or 0-9 beside it) and takes any white space between its words; others match as
    they stand. Empty aliases match nothing.
    """

    def __init__(self, entries: Iterable[tuple[str, str]]) -> None:
        keys: tuple[dict, dict] = {}, {}
        for key, alias in entries:
            alias = " ".join(BLANKS.split(alias.lower().strip(" \t\n\x0b\f\r"))) if alias.isascii() else alias
            if alias:
                keys[alias.isascii()].setdefault(alias, set()).add(key)
        self.plain, self.bordered = (self._built(x) for x in keys)

    @staticmethod
    def _built(keys: dict) -> ahocorasick.Automaton | None:
        if not keys:
            return None
        made = ahocorasick.Automaton()
        for alias, own in keys.items():
            made.add_word(alias, (len(alias), tuple(own)))
        made.make_automaton()
        return made

    def __call__(self, text: str) -> list[str]:
        found: set[str] = set()
        if self.plain is not None:
            for _, (_, own) in self.plain.iter(text):
                found.update(own)
        if self.bordered is not None:
            text = BLANKS.sub(" ", text)
            for end, (size, own) in self.bordered.iter(text):
                if (end - size < 0 or text[end - size] not in LETTERS) and (end + 1 == len(text) or text[end + 1] not in LETTERS):
                    found.update(own)
        return sorted(found)


def tagged(docs: DataFrame, dictionary: DataFrame, *, id_col: str, text_col: str, part: int = PART) -> DataFrame:
    """id, keys: for each row of docs the sorted keys of dictionary (key, alias) whose aliases stand in its text.

    Null texts have none. The dictionary goes to the tasks as a list of bounded length, so the plan has one step whatever
    its size; beyond part aliases the texts are read once for each part. Rows with a null key or alias are left out.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("_text"))
    entries = dictionary.where("key is not null and alias is not null").select("key", "alias").distinct()
    parts = max(1, -(-entries.count() // part))
    found = None
    for k in range(parts):
        own = entries.where(F.pmod(F.xxhash64("alias"), F.lit(parts)) == k)
        shared = spark.sparkContext.broadcast([(r["key"], r["alias"]) for r in own.collect()])
        made = rows.mapInArrow(_run(shared), f"_id {kind}, keys array<string>")
        found = made if found is None else found.unionByName(made)
    out = found if parts == 1 else found.groupBy("_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"))
    return out.withColumnRenamed("_id", id_col)


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([matcher(x) for x in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["_id", "keys"])

    return run
