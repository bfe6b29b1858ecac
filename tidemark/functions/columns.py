"""Column functions with the rounding, time and text rules of exam-operations data.

Rounding follows where a figure comes from: half_even for figures made by scripts, half_away for those of the database,
js_round for those of the browser. Local days are those of Asia/Taipei.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "Asia/Taipei"


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, here.

    Spark would put a column's expression wherever it is used, in filters too; used twice in each of several steps, it
    grows beyond measure. What comes out of a generator stays where it is.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def utc(ts: Column) -> Column:
    """A timestamp without a zone, read as UTC (the session's zone must be UTC)."""
    return ts.cast("timestamp")


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(utc(ts), zone))


def bucket(ts: Column, minutes: int = 5) -> Column:
    """The start of the tumbling window that holds ts."""
    size = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_seconds(utc(ts)) / size) * size)


def age_hours(now: str, ts: Column) -> Column:
    """Hours from ts to now, never negative, to two places."""
    return F.greatest(half_even((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(utc(ts))) / 3.6e9, 2), F.lit(0.0))


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def half_away(x: Column, places: int = 0) -> Column:
    return F.round(x.cast("decimal(38,10)"), places)


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def percent(part: Column, whole: Column) -> Column:
    """A whole percentage, 0 where there is nothing."""
    return F.when(whole > 0, js_round(100 * part / whole)).otherwise(F.lit(0)).cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()))


def nfkc(text: Column) -> Column:
    """NFKC with white space runs as one space; Spark SQL has no normalize(). Only texts with other than ASCII characters are normalised in Python."""
    plain = F.trim(F.regexp_replace(text, r"[\x09-\x0D\x1C-\x20]+", " "))
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, F.pandas_udf(_nfkc, "string")(F.when(other, text))).otherwise(plain)


def title_norm(text: Column) -> Column:
    """Lower case, without dates, numbers and punctuation, white space as one space; the order of steps matters."""
    x = F.lower(text)
    x = F.regexp_replace(x, r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}", " ")
    x = F.regexp_replace(x, r"[0-9]+(\.[0-9]+)?%?", " ")
    x = F.regexp_replace(x, r"[!-/:-@\[-`{-~]+", " ")
    return F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " "))


def char_ngrams(text: Column, n: int = 2) -> Column:
    """Distinct character n-grams in order; a shorter text is its own only one, an empty one has none."""
    gram = lambda c, i: F.concat(*(F.get(c, i + k) for k in range(n)))
    many = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: gram(c, i)))
    short = lambda c: F.when(F.size(c) == 0, c).when(F.size(c) < n, F.array(F.array_join(c, "")))
    # the characters are bound once, else the text's own expression would run for each n-gram
    bound = F.array(F.filter(F.split(text, ""), lambda x: x != ""))
    return F.element_at(F.transform(bound, lambda c: short(c).otherwise(many(c))), 1)


def jaccard(a: Column, b: Column) -> Column:
    """0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    small = F.least(F.size(a), F.size(b))
    return F.when(small == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / small)


def alias_pattern(aliases: Sequence[str]) -> str:
    """A pattern for lower-case texts: non-ASCII aliases as they stand; ASCII ones need borders and take any white space between their words."""
    quote = lambda w: "".join(rf"\{c}" if c.isascii() and not c.isalnum() else c for c in w)
    plain = [quote(a) for a in aliases if not a.isascii()]
    bordered = [r"\s+".join(map(quote, a.lower().split())) for a in aliases if a.isascii()]
    return "|".join(plain + ([f"(?<![a-z0-9])(?:{'|'.join(bordered)})(?![a-z0-9])"] if bordered else []))


def has_alias(text: Column, *aliases: str) -> Column:
    """Whether one of the aliases stands in the text."""
    return F.lower(text).rlike(alias_pattern(aliases))


def affirmed(text: Column, term: str, negations: Sequence[str], gap: int = 18) -> Column:
    """Whether some occurrence of the term has no negation that begins at most gap characters before it."""
    quote = lambda x: rf"\Q{x}\E"
    before = "|".join(f"{quote(n)}.{{0,{gap - len(n)}}}" for n in negations if len(n) <= gap)
    return text.rlike(f"(?s)(?<!(?:{before})){quote(term)}" if before else quote(term))


def count_present(text: Column, terms: Sequence[str]) -> Column:
    """How many different terms stand in the text."""
    out = F.lit(0)
    for t in terms:
        out = out + text.contains(t).cast("int")
    return out


def level(text: Column, high: Sequence[str], medium: Sequence[str], low: Sequence[str]) -> Column:
    """high, medium or low by the terms present: high terms count only fully without low ones."""
    h, m, n = (count_present(text, x) for x in (high, medium, low))
    return F.when((h >= 1) & (n == 0), "high").when(h >= 1, "medium").when(m >= 2, "medium").when((m >= 1) & (n == 0), "medium").otherwise("low")


def missing(x: Column) -> Column:
    """Null for what a script takes as missing: null, empty and blank strings."""
    return F.nullif(F.trim(x), F.lit(""))


def fingerprint(*parts: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def qno_number(qno: Column) -> Column:
    """Numbers in text sort by value, anything else last."""
    return F.when(qno.rlike("^[0-9]+$"), qno.try_cast("int")).otherwise(F.lit(999999))


def article_refs(text: Column) -> Column:
    """Article numbers named in a text: ranges spread out (at most 300), sub-articles with their parent."""
    plain = F.regexp_extract_all(text, F.lit(r"第\s*(\d{1,4})\s*條(?!之)"), F.lit(1))
    sub = F.transform(F.regexp_extract_all(text, F.lit(r"(第\s*\d{1,4}\s*條之\s*\d{1,3})"), F.lit(1)), lambda x: F.regexp_replace(x, r"第\s*(\d+)\s*條之\s*(\d+)", "$1-$2"))
    spans = F.regexp_extract_all(text, F.lit(r"第\s*(\d{1,4})\s*條?\s*[至~-]\s*第?\s*\d{1,4}\s*條"), F.lit(0))
    number = lambda x, g: F.regexp_extract(x, r"(\d{1,4})\D+(\d{1,4})", g).cast("int")
    spread = F.flatten(F.transform(spans, lambda x: F.when((number(x, 2) >= number(x, 1)) & (number(x, 2) - number(x, 1) <= 300), F.sequence(number(x, 1), number(x, 2))).otherwise(F.array().cast("array<int>"))))
    parents = F.transform(sub, lambda x: F.substring_index(x, "-", 1))
    return F.array_distinct(F.concat(plain, sub, parents, F.transform(spread, lambda x: x.cast("string"))))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]*)(?::[0-9]*)?(?:[/?#]|$)", 1))


def allowed_url(url: Column, hosts: Sequence[str]) -> Column:
    """https, an allowed host or a subdomain of one, no user part, no port but 443."""
    at = host(url)
    known = F.lit(False)
    for h in hosts:
        known = known | (at == h) | at.endswith(f".{h}")
    return F.coalesce(url.rlike(r"^https://[^/?#@]+(?:[/?#]|$)") & known & ~url.rlike(r"^https://[^/?#]*:(?!443(?:[/?#]|$))"), F.lit(False))
