"""Sources that may fail: a second pass over the mandatory ones that did, outcomes in the registry's order, the availability gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.durable import written

#: attempt(sources) -> name, entries (array, null if the source failed), error.
Attempt = Callable[[DataFrame], DataFrame]


def two_passes(sources: DataFrame, first: Attempt, again: Attempt) -> DataFrame:
    """sources (name, place, optional) -> name, place, optional, entries, outcome (ok, recovered, optional_error, failed), error.

    All sources are read once; those mandatory ones that failed are read once more, and only these. What a
    second reading gives is the same source, never another in its place. A source that an attempt doesn't list has failed.
    """
    tried = written(sources.join(first(sources), "name", "left"), "first_pass")
    broken = F.col("entries").isNull() | F.col("error").isNotNull()
    pending = tried.where(broken & ~F.col("optional")).select("name", "place", "optional")
    second = again(pending).select("name", F.col("entries").alias("_entries"), F.col("error").alias("_error"), F.lit(True).alias("_again"))
    both = tried.join(second, "name", "left")
    saved = F.col("_entries").isNotNull() & F.col("_error").isNull()
    outcome = F.when(~broken, "ok").when(F.col("optional"), "optional_error").when(saved, "recovered").otherwise("failed")
    found = F.when(~broken, F.col("entries")).when(~F.col("optional") & saved, F.col("_entries"))
    said = F.when(F.col("optional") | F.col("_again").isNull(), F.col("error")).otherwise(F.col("_error"))
    return both.select("name", "place", "optional", found.alias("entries"), outcome.alias("outcome"), F.when(outcome.isin("failed", "optional_error"), F.coalesce(said, F.lit("no result"))).alias("error"))


def availability(outcomes: DataFrame) -> DataFrame:
    """One row: mandatory, failed, recovered, fetched (entries of all sources), state.

    state: invalid without a mandatory source, mandatory_failed if all of them did, empty without an entry, else
    available. A mandatory source without entries is no failure.
    """
    n = lambda c: F.count_if(c).alias
    c = F.col
    told = outcomes.agg(n(~c("optional"))("mandatory"), n(c("outcome") == "failed")("failed"), n(c("outcome") == "recovered")("recovered"), F.coalesce(F.sum(F.when(c("entries").isNotNull(), F.size("entries"))), F.lit(0)).cast("long").alias("fetched"))
    state = F.when(c("mandatory") < 1, "invalid").when(c("failed") == c("mandatory"), "mandatory_failed").when(c("fetched") <= 0, "empty").otherwise("available")
    return told.withColumn("state", state)
