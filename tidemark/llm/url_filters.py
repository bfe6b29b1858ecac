"""URL filtering: allow and block rules first, else an empirical-Bayes reputation of the host.

The reputation shrinks the labelled outcomes of a host towards those of its registered domain, these towards
those of its public suffix, and these towards the rate of all labelled pages. Each level is a beta-binomial:
its prior mean is the posterior mean of the level above, and its prior strength comes from the spread of the
level's groups around their priors, by the method of moments. A host is blocked if its good rate lies under the wanted
rate with a posterior chance of SURE, which is to say that the upper bound of that chance lies under it. Hosts with few
labels are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import durable

#: The rules of the URL list, longest match first decides.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Without a list of public suffixes: under a country's top-level domain, these second labels make a suffix of two.
SECOND_LABELS = ("ac", "co", "com", "edu", "gov", "net", "or", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A prior is worth this many labelled pages at least and at most.
STRENGTH = (1.0, 1000.0)
#: Posterior chance of a bad rate from which a host is blocked.
SURE = 0.95


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def clean_host(host: Column) -> Column:
    """The key of a host's reputation: without user part, port and dots at the end. An address in brackets stays whole."""
    named = F.regexp_replace(host, r"^.*@", "")
    return F.when(named.startswith("["), F.regexp_replace(named, r"\].*$", "]")).otherwise(F.regexp_replace(F.regexp_replace(named, r":[0-9]*$", ""), r"\.+$", ""))


def is_address(host: Column) -> Column:
    return host.startswith("[") | host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where they are a country's second level. An address is its own suffix."""
    country = F.substring_index(host, ".", -2).rlike(rf"^({'|'.join(SECOND_LABELS)})\.[a-z]{{2}}$")
    return F.when(is_address(host), host).otherwise(F.when(country, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1)))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label more; a suffix or an address is its own domain."""
    rest = F.left(host, F.greatest(F.length(host) - F.length(suffix) - 1, F.lit(0)))
    return F.when(rest == "", host).otherwise(F.concat(F.substring_index(rest, ".", -1), F.lit("."), suffix))


def read_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """rule: the rules of a public suffix list in its usual form (comments from //, *. for any label, ! for exceptions)."""
    rule = F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1))
    return spark.read.text(path).select(rule.alias("rule")).where("rule != '' and rule not like '//%'").distinct()


def with_suffixes(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """hosts (host, ...) with the column suffix by the rules of a public suffix list: an exception first, else the longest rule, else the last label.

    Each host is looked up by its tails, a few a host; the list is joined to them.
    """
    labels = F.split("host", r"\.")
    tail = F.array_join(F.slice("_labels", F.col("_k"), 1000), ".")
    parent = F.array_join(F.slice("_labels", F.col("_k") + 1, 1000), ".")
    tails = hosts.select("host").distinct().where(~is_address(F.col("host"))).withColumn("_labels", labels).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_labels"))))
    asked = tails.select("host", tail.alias("_tail"), parent.alias("_parent"), F.explode(F.array(tail, F.concat(F.lit("*."), parent), F.concat(F.lit("!"), tail))).alias("rule"))
    found = asked.join(suffixes, "rule").select("host", F.when(F.col("rule").startswith("!"), F.col("_parent")).otherwise(F.col("_tail")).alias("_suffix"), F.col("rule").startswith("!").alias("_sure"))
    best = found.groupBy("host").agg(F.max(F.struct("_sure", F.length("_suffix").alias("n"), "_suffix"))["_suffix"].alias("_suffix"))
    last = F.when(is_address(F.col("host")), F.col("host")).otherwise(F.substring_index("host", ".", -1))
    return hosts.join(best, "host", "left").withColumn("suffix", F.coalesce("_suffix", last)).drop("_suffix")


def chance_below(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The chance that a Beta(a, b) number lies below x: the regularized incomplete beta function by its continued fraction."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    turned = x > (a + 1) / (a + b + 2)  # there the fraction of the other side is the fast one
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    gamma = np.frompyfunc(math.lgamma, 1, 1)
    front = np.exp((gamma(p + q) - gamma(p) - gamma(q)).astype(float) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(p), 1 / np.where(np.abs(w := 1 - (p + q) * y / (p + 1)) < tiny, tiny, w)
    out = d.copy()
    for m in range(1, 300):  # Lentz's method
        step = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / (1 + step * d), 1 + step / c
        out *= d * c
        step = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / (1 + step * d), 1 + step / c
        out *= d * c
        if (np.abs(d * c - 1) < 1e-14).all():
            break
    return np.where(turned, 1 - front * out, front * out)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]], what: str) -> Column:
    """The longest rule that fits the host or a parent of it, with a path that starts with the rule's; what: "rule" or "verdict"."""
    out = None
    for verdict, rule in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        value = F.lit(rule if what == "rule" else verdict)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def _strength(level: DataFrame) -> float:
    """Prior strength of a level with columns n, k, prior: the spread of its rates beyond a binomial's, by moments."""
    p = F.col("prior")
    row = level.where("n > 0").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2) / (p * (1 - p))).alias("s")).first()
    if not row["c"] or row["n"] <= row["c"]:
        return STRENGTH[1]
    rho = (row["s"] - row["c"]) / (row["n"] - row["c"])
    return min(max(1 / rho - 1, STRENGTH[0]), STRENGTH[1]) if rho > 0 else STRENGTH[1]


def host_reputation(outcomes: DataFrame, *, want: float = 0.5, sure: float = SURE, suffixes: DataFrame | None = None) -> DataFrame:
    """outcomes (host, good): one row a page; good is 1, 0 or null if unlabelled. One row a host: host, n, k, rate, below, blocked.

    below is the posterior chance that the good rate lies under want. Hosts without labels get the prior of their domain.
    Without any label, every rate is 0.5. A hot host is summed up before the shuffle; only one row a host goes on from there.
    """
    host = F.coalesce(F.col("host"), F.lit(""))
    hosts = outcomes.select(host.alias("host"), F.col("good").cast("int").alias("good")).groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"))) if suffixes is None else with_suffixes(hosts, suffixes)
    hosts = durable(hosts.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = ((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)
    above, keys = None, ("suffix", "domain", "host")
    for depth, key in enumerate(keys):
        level = hosts.groupBy(*keys[: depth + 1]).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        level = level.withColumn("prior", F.lit(base)) if above is None else level.join(above, keys[depth - 1])
        level = durable(level, key)
        m = _strength(level)
        rate = (F.col("k") + m * F.col("prior")) / (F.col("n") + m)
        above = durable(level.select(key, rate.alias("prior")), f"{key}_rates")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = pdf["k"] + m * pdf["prior"]
            yield pdf[["host", "n", "k"]].assign(rate=good / (pdf["n"] + m), below=chance_below(want, good.to_numpy(), (pdf["n"] + m - good).to_numpy()))

    return level.select("host", "n", "k", "prior").mapInPandas(run, "host string, n long, k long, rate double, below double").withColumn("blocked", F.col("below") >= sure)


def filter_urls(pages: DataFrame, outcomes: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, want: float = 0.5, sure: float = SURE, suffixes: DataFrame | None = None) -> DataFrame:
    """Judge every row of pages: id, host, path, rule, verdict (allow or block), rate, below.

    outcomes (id, good): labelled outcomes of pages; ids without a page are ignored, repeated ids count by their worst outcome.
    A null url or one without :// has an empty host and path, fits no rule and is judged as the host "". Repeated
    pages give a row each, an empty table gives none, null ids stay. Other columns of pages are not read. suffixes: the
    rules of a public suffix list, as read_suffixes() gives them; without it the rule of suffix_of() stands in.
    """
    seen = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("_key", clean_host(F.col("host")))
    known = outcomes.groupBy(F.col(outcomes.columns[0]).alias("_id")).agg(F.min(F.col(outcomes.columns[1]).cast("int")).alias("good"))
    by_host = seen.join(durable(known, "outcomes"), "_id", "left").select(F.col("_key").alias("host"), "good")
    reputation = durable(host_reputation(by_host, want=want, sure=sure, suffixes=suffixes).select(F.col("host").alias("_key"), "rate", "below", "blocked"), "reputation")
    judged = seen.join(reputation, "_key", "left")
    host, path = F.col("host"), F.col("path")
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return judged.select(F.col("_id").alias(id_col), host, path, rule_of(host, path, rules, "rule").alias("rule"), F.coalesce(rule_of(host, path, rules, "verdict"), method).alias("verdict"), "rate", "below")
