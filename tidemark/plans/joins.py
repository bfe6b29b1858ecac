"""Joins that need a form of their own: aliases by an automaton, ranges by blocks, differences by digests; sources in two passes; keys of JSON texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.jsontext import repeated_keys
from tidemark.operators.hashtree import tree_drift
from tidemark.operators.matching import tagged
from tidemark.operators.ranges import containing, overlapping
from tidemark.operators.retrieval import ranked_articles
from tidemark.plans.derived import NEWS, news
from tidemark.sources.passes import availability, two_passes
from tidemark.sources.tables import read


def alias_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with a long word in a document, by the words of all items as aliases: how many, the first and last of them."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: w.rlike("^[a-z]{9,}$")))
    dictionary = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("key"), F.explode(words).alias("alias"))
    found = tagged(read(spark, sf_dir, "documents"), dictionary, id_col="doc_id", text_col="text")
    return found.select("doc_id", F.size("keys").cast("long").alias("n"), F.get("keys", F.lit(0)).alias("first"), F.try_element_at("keys", F.lit(-1)).alias("last"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed ranges of articles: change, law, low, high."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").where(k % 20 == 0).select(k.alias("change"), (F.col("o_custkey") % 50).alias("law"), (k % 1500).alias("low"), (k % 1500 + k % 37 - 2).alias("high"))


def range_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of single articles with the changed ranges that hold them. A range whose end lies before its start holds none."""
    cited = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question"), F.col("l_linenumber").cast("long").alias("citation"), (F.col("l_suppkey") % 50).alias("law"), F.col("l_partkey").alias("article"))
    return containing(cited, _changes(spark, sf_dir), key="law", at="article", low="low", high="high")


def range_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of article ranges with the changed ranges that they overlap."""
    k = F.col("o_orderkey")
    cited = read(spark, sf_dir, "orders").where(k % 20 != 0).select(k.alias("question"), (F.col("o_custkey") % 50).alias("law"), (k * 7 % 1500).alias("begin"), (k * 7 % 1500 + k % 11).alias("end"))
    return overlapping(cited, _changes(spark, sf_dir), key="law", left_low="begin", left_high="end", right_low="low", right_high="high")


def tree_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a changed state of them: rows with other values, missing and new ones."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    fields = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    price, status = F.when(k % 997 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), F.when(k % 1009 == 5, F.lit(None)).otherwise(F.col("o_orderstatus"))
    new = o.where(k % 1499 != 7).withColumns({"o_totalprice": price, "o_orderstatus": status})
    new = new.unionByName(o.where(k % 1511 == 3).withColumn("o_orderkey", k + 1_000_000_000))
    return tree_drift(o, new, "o_orderkey", fields).select("o_orderkey", "state", F.array_join("changed", ",").alias("changed"))


def repeated_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that an event's payload has twice in one object, at any depth."""
    c = F.col
    key = lambda n: F.concat(F.lit('"k'), (c(n) % 7).cast("string"), F.lit('"'))
    inner = F.when(c("event_id") % 3 == 0, F.lit('{"a": 1, "\\u0061": [{"a": "x,\\"a\\":"}]}')).otherwise(F.lit('{"a": {"a": "}"}, "b": "a"}'))
    text = F.concat(F.lit('{"user": '), c("user_id").cast("string"), F.lit(", "), key("user_id"), F.lit(": "), inner, F.lit(", "), key("event_id"), F.lit(": ["), inner, F.lit('], "'), c("event_type"), F.lit('": null}'))
    rows = read(spark, sf_dir, "events").select("event_id", repeated_keys(text).alias("keys"))
    return rows.select("event_id", F.array_join("keys", ",").alias("keys"), F.size("keys").cast("long").alias("n"))


def article_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three articles of a law nearest to each question. News titles and summaries are articles, forty a law; every seventh, with a number of its own, asks as well."""
    n, i = news(spark, sf_dir), F.col("id")
    law = F.floor(i / 40)
    articles = n.select(i.alias("d"), law.alias("law"), F.concat_ws(" ", "title", "summary", (i % 9).cast("string")).alias("text"))
    asked = n.where(i % 7 == 3).select(i.alias("q"), law.alias("law"), F.concat_ws(" ", "title", (i % 5).cast("string"), F.lit("1,200")).alias("text"))
    return ranked_articles(asked, articles, 3).select("q", "d", "score", "shared", "evidence", "place")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host of pages as a source that gives its pages' numbers: some fail at first, some both times, some are optional."""
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1).alias("name"))
    own = p.groupBy("name").agg(F.min("page_id").alias("place"), F.sum("page_id").alias("sum"), F.count("*").alias("n"))
    return own.withColumn("optional", F.col("sum") % 5 == 0)


def source_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources after the second pass: what each gave, and how it came to it."""
    pages = _sources(spark, sf_dir)
    numbers = F.sequence(F.lit(1).cast("long"), F.col("n"))

    def attempt(fails):
        def run(sources: DataFrame) -> DataFrame:
            told = sources.select("name").join(pages.select("name", "sum", "n"), "name")
            return told.select("name", F.when(~fails, numbers).alias("entries"), F.when(fails, F.concat(F.lit("no answer "), (F.col("sum") % 7).cast("string"))).alias("error"))

        return run

    out = two_passes(pages.select("name", "place", "optional"), attempt(F.col("sum") % 3 == 0), attempt(F.col("sum") % 2 == 0))
    return out.select("name", "place", "optional", F.when(F.col("entries").isNotNull(), F.size("entries")).cast("long").alias("n_entries"), "outcome", "error")


def source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sources of a scan are good enough to publish from."""
    o = source_outcomes(spark, sf_dir)
    return availability(o.withColumn("entries", F.when(F.col("n_entries").isNotNull(), F.sequence(F.lit(1).cast("long"), F.col("n_entries")))))


QUERIES = {f.__name__: f for f in (alias_tags, range_impact, range_overlaps, tree_differences, repeated_json_keys, article_retrieval, source_outcomes, source_gate)}

CHANGES = "c as (select o_orderkey change, o_custkey % 50 law, o_orderkey % 1500 low, o_orderkey % 1500 + o_orderkey % 37 - 2 high from orders where o_orderkey % 20 = 0)"
FIELDS = ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
SOURCES = """p as (select page_id, regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1) as name from pages), s as (select name, min(page_id) place, sum(page_id) t, count(*) n, sum(page_id) % 5 = 0 optional from p group by 1),
 o as (select name, place, optional, case when t % 3 <> 0 then n when not optional and t % 2 <> 0 then n end n_entries, case when t % 3 <> 0 then 'ok' when optional then 'optional_error' when t % 2 <> 0 then 'recovered' else 'failed' end outcome, t from s)"""
REPEATS = """case when event_id % 3 = 0 then ['a'] else [] end"""
GRAM = lambda n: f"list_transform(generate_series(1, length(p) - {n - 1}), lambda i: substr(p, cast(i as integer), {n}))"
GRAMS = f"list_distinct(list_concat(list_concat({GRAM(2)}, {GRAM(3)}), {GRAM(4)}))"
READ = r"regexp_replace(t, '[^\p{L}\p{N}]', '', 'g') p, list_distinct(regexp_extract_all(t, '([0-9]+(?:\.[0-9]+)?%?)', 1)) m"
ORACLE = {
    "article_retrieval": f"""with {NEWS}, d as (select id d, id // 40 law, concat_ws(' ', title, summary, (id % 9)::varchar) t from news), q as (select id q, id // 40 law, concat_ws(' ', title, (id % 5)::varchar, '1,200') t from news where id % 7 = 3),
 dg as (select d, law, m, {GRAMS} g from (select *, {READ} from d)), qg as (select q, law, m, {GRAMS} g from (select *, {READ} from q) where length(p) >= 4), dt as (select d, law, unnest(g) t from dg), qt as (select q, law, unnest(g) t from qg where len(g) >= 3),
 n as (select law, count(*) n from d group by 1), f as (select law, t, count(*) df from dt group by 1, 2), w as (select qt.*, cast(round((ln((n + 1)::double / (coalesce(df, 0) + 1)) + 1) * 1000000) as bigint) w from qt join n on n.law = qt.law left join f on f.law = qt.law and f.t = qt.t),
 a as (select q, sum(w)::double s from w group by 1), h as (select w.q, dt.d, sum(w)::double got, count(*) shared, array_to_string((list(w.t order by length(w.t) desc, w desc, w.t))[:8], '|') evidence from w join dt on dt.law = w.law and dt.t = w.t group by 1, 2),
 s as (select h.q, h.d, shared, evidence, round(least(1.0::double, 0.88::double * (got / s) + 0.12::double * (shared::double / (len(qg.g) + len(dg.g) - shared)) + case when len(qg.m) > 0 then 0.08::double * (len(list_intersect(qg.m, dg.m))::double / len(qg.m)) else 0 end), 6) score from h join a on a.q = h.q join qg on qg.q = h.q join dg on dg.d = h.d),
 r as (select *, row_number() over (partition by q order by score desc, shared desc, d) place from s) select q, d, score, shared, evidence, place from r where place <= 3""",
    "alias_tags": """with a as (select distinct item_id::varchar k, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1), lambda w: regexp_full_match(w, '[a-z]{9,}'))) w from benchmark),
 d as (select distinct doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1)) w from documents), h as (select doc_id, count(distinct k) n, min(k) f, max(k) l from d join a on a.w = d.w group by 1)
 select documents.doc_id, cast(coalesce(n, 0) as bigint) n, f as first, l as last from documents left join h on h.doc_id = documents.doc_id""",
    "range_impact": f"with {CHANGES} select l_orderkey question, cast(l_linenumber as bigint) citation, law, l_partkey article, change, low, high from lineitem join c on l_suppkey % 50 = law and l_partkey between low and high",
    "range_overlaps": f"with {CHANGES}, q as (select o_orderkey question, o_custkey % 50 law, o_orderkey * 7 % 1500 as begin, o_orderkey * 7 % 1500 + o_orderkey % 11 as end_ from orders where o_orderkey % 20 <> 0) select question, q.law, begin, end_ as end, change, low, high from q join c on q.law = c.law and begin <= high and low <= end_ and low <= high",
    "tree_differences": f"""with n as (select o_orderkey, o_custkey, case when o_orderkey % 1009 = 5 then null else o_orderstatus end o_orderstatus, case when o_orderkey % 997 = 0 then o_totalprice + 1 else o_totalprice end o_totalprice, o_orderpriority from orders where o_orderkey % 1499 <> 7
 union all select o_orderkey + 1000000000, {', '.join(FIELDS)} from orders where o_orderkey % 1511 = 3),
 j as (select coalesce(o.o_orderkey, n.o_orderkey) o_orderkey, case when n.o_orderkey is null then 'missing' when o.o_orderkey is null then 'extra' else 'changed' end state,
 case when n.o_orderkey is null or o.o_orderkey is null then '' else array_to_string(list_filter([{', '.join(f"case when o.{f} is distinct from n.{f} then '{f}' end" for f in FIELDS)}], lambda x: x is not null), ',') end changed from orders o full join n on o.o_orderkey = n.o_orderkey)
 select * from j where state <> 'changed' or changed <> ''""",
    "repeated_json_keys": f"""with k as (select event_id, list_concat(list_concat({REPEATS}, case when user_id % 7 = event_id % 7 then ['k' || (event_id % 7)::varchar] else [] end), list_concat({REPEATS}, case when event_type = 'user' then ['user'] else [] end)) k from events)
 select event_id, array_to_string(k, ',') keys, cast(len(k) as bigint) n from k""",
    "source_outcomes": f"with {SOURCES} select name, place, optional, n_entries, outcome, case when outcome in ('failed', 'optional_error') then 'no answer ' || (t % 7)::varchar end as error from o",
    "source_gate": f"""with {SOURCES}, g as (select count(*) filter (where not optional) mandatory, count(*) filter (where outcome = 'failed') failed, count(*) filter (where outcome = 'recovered') recovered, cast(coalesce(sum(n_entries), 0) as bigint) fetched from o)
 select *, case when mandatory < 1 then 'invalid' when failed = mandatory then 'mandatory_failed' when fetched <= 0 then 'empty' else 'available' end state from g""",
}
