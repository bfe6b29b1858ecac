"""Merged maps, article order, law rows of an API's JSON, and reports as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.lawtext import article_number
from tidemark.sources.tables import read

#: Fixed value: topics of a subject in a merged map at most.
TOPICS = 6


def merged_maps(rows: DataFrame, group: str, order: str, maps: str, cap: int = TOPICS) -> DataFrame:
    """group, key, values: maps of arrays merged over a group's rows in order: a key's distinct values by their first place, the first so many.

    Blank keys and values don't count. Values are cut down to their first place before they are ranked, and a rank is
    taken inside a key of a group.
    """
    each = rows.select(group, order, F.explode(maps).alias("key", "list")).select(group, order, F.trim("key").alias("key"), F.posexplode("list").alias("at", "v")).withColumn("v", F.trim("v"))
    first = each.where("key <> '' and v <> ''").groupBy(group, "key", "v").agg(F.min(F.struct(order, "at")).alias("first"))
    ranked = first.withColumn("place", F.row_number().over(W.partitionBy(group, "key").orderBy("first", "v"))).where(F.col("place") <= cap)
    return ranked.groupBy(group, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("values"))


def topic_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of each source by language: a document names its first and third word and one by its number, some of them blank."""
    k, words = F.col("doc_id"), F.split(F.coalesce("text", F.lit("")), " ")
    own = F.map_from_arrays(F.array(F.concat(F.lit(" "), F.coalesce("lang", F.lit("")), F.lit(" ")), F.lit("all")), F.array(F.array(F.get(words, F.lit(0)), F.concat(F.lit("t"), (k % 9).cast("string"))), F.array(F.get(words, F.lit(2)), F.lit(" "), F.concat(F.lit("n"), (k % 4).cast("string"), F.lit(" ")))))
    rows = read(spark, sf_dir, "documents").select("source", "doc_id", own.alias("topics"))
    return merged_maps(rows, "source", "doc_id", "topics").select("source", "key", F.array_join("values", "|").alias("topics"))


def article_key(article: Column) -> Column:
    """What articles are ordered by: the numbers between the strokes, 12-1 behind 12 and before 13; anything else last, by its text."""
    numbers = F.when(article.rlike("^[0-9]+(-[0-9]+)*$"), F.transform(F.split(article, "-"), lambda x: x.cast("int")))
    return F.struct(numbers.isNull().alias("odd"), numbers.alias("numbers"), article.alias("text"))


def article_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of each law (a size of parts) in the order of their numbers."""
    k = F.col("p_partkey")
    base = (k * 7 % 130).cast("string")
    article = F.when(k % 17 == 0, F.concat(F.lit("附"), base)).when(k % 3 == 0, F.concat(base, F.lit("-"), (k % 12 + 1).cast("string"))).otherwise(base)
    rows = read(spark, sf_dir, "part").select("p_size", article.alias("article")).distinct()
    return rows.withColumn("place", F.row_number().over(W.partitionBy("p_size").orderBy(article_key(F.col("article")))).cast("long"))


def api_articles(text: Column) -> Column:
    """Articles (no, text) of a law in an API's JSON: chapter rows (type C) and those without a number or text are left out."""
    rows = F.from_json(text, "struct<LawArticles: array<struct<ArticleType: string, ArticleNo: string, ArticleContent: string>>>")["LawArticles"]
    told = F.transform(rows, lambda r: F.struct(F.coalesce(r["ArticleType"], F.lit("")).alias("kind"), article_number(F.regexp_replace(r["ArticleNo"], r"[第條\s]", "")).alias("no"), F.trim(F.regexp_replace(F.coalesce(r["ArticleContent"], F.lit("")), r"\s+", " ")).alias("text")))
    kept = F.filter(told, lambda r: (r["kind"] != "C") & r["no"].isNotNull() & (r["no"] != "") & (r["text"] != ""))
    return F.transform(kept, lambda r: F.struct(r["no"].alias("no"), r["text"].alias("text")))


def api_law_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of laws as an API gives them, a law for each part: its name is the text of two, between a chapter and a blank one."""
    k = F.col("p_partkey")
    row = lambda kind, no, content: F.struct(F.lit(kind).alias("ArticleType"), no.alias("ArticleNo"), content.alias("ArticleContent"))
    n = k.cast("string")
    law = F.to_json(F.struct(F.array(
        row("C", F.lit(""), F.concat(F.lit("第 一 章 "), F.col("p_name"))), row("A", F.concat(F.lit("第 "), n, F.lit(" 條")), F.concat(F.lit("  "), F.col("p_name"), F.lit("\n  "), n)),
        row("A", F.concat(F.lit("第 "), n, F.lit(" 條")), F.lit(" \n ")), row("A", F.concat(F.lit("第 "), n, F.lit(" 之 2 條")), F.col("p_type")), row("A", F.lit("附則"), F.lit("x")),
    ).alias("LawArticles")))
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(api_articles(law)).alias("a")).select("p_partkey", F.col("a.no").alias("article"), F.col("a.text").alias("text"))


def markdown(rows: DataFrame, title: str, columns: list[str], order: list) -> DataFrame:
    """line, text: a table of few rows as a Markdown report, in order; a bar inside a value is escaped, a null is empty."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    body = rows.select(F.row_number().over(W.orderBy(*order)).cast("long").alias("line"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("text"))
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    top = rows.sparkSession.range(len(head)).select((F.col("id") - len(head) + 1).alias("line"), F.element_at(F.array(*map(F.lit, head)), (F.col("id") + 1).cast("int")).alias("text"))
    return top.unionByName(body)


def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, characters and the longest one by language and source, as lines of a report."""
    g = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"), F.max("n_chars").alias("longest"))
    return markdown(g, "Corpus", ["lang", "source", "documents", "characters", "longest"], [F.desc("documents"), "lang", "source"])


QUERIES = {f.__name__: f for f in (topic_maps, article_order, api_law_articles, corpus_report)}
ORACLE = {
    "topic_maps": """with d as (select source, doc_id, string_split(coalesce(text, ''), ' ') w, coalesce(lang, '') lang from documents),
 e as (select source, doc_id, trim(lang) k, 0 a, trim(w[1]) v from d union all select source, doc_id, trim(lang), 1, 't' || (doc_id % 9)::varchar from d union all select source, doc_id, 'all', 0, trim(w[3]) from d union all select source, doc_id, 'all', 2, 'n' || (doc_id % 4)::varchar from d),
 f as (select source, k, v, min((doc_id, a)) first from e where k <> '' and v <> '' group by 1, 2, 3), r as (select *, row_number() over (partition by source, k order by first, v) p from f) select source, k as key, string_agg(v, '|' order by p) topics from r where p <= 6 group by 1, 2""",
    "article_order": """with a as (select distinct p_size, case when p_partkey % 17 = 0 then '附' || (p_partkey * 7 % 130)::varchar when p_partkey % 3 = 0 then (p_partkey * 7 % 130)::varchar || '-' || (p_partkey % 12 + 1)::varchar else (p_partkey * 7 % 130)::varchar end article from part),
 s as (select *, starts_with(article, '附') odd, case when not starts_with(article, '附') then list_transform(string_split(article, '-'), lambda x: x::integer) end n from a) select p_size, article, row_number() over (partition by p_size order by odd, n, article) place from s""",
    "api_law_articles": "select p_partkey, p_partkey::varchar article, p_name || ' ' || p_partkey::varchar as text from part union all select p_partkey, p_partkey::varchar || '-2', p_type from part",
    "corpus_report": """with g as (select lang, source, count(*) documents, cast(sum(n_chars) as bigint) characters, max(n_chars) longest from documents group by 1, 2)
 select row_number() over (order by documents desc, lang nulls first, source nulls first) line, '| ' || concat_ws(' | ', coalesce(lang, ''), coalesce(source, ''), documents, characters, longest) || ' |' as text from g
 union all select * from (values (-3, '# Corpus'), (-2, ''), (-1, '| lang | source | documents | characters | longest |'), (0, '|---|---|---|---|---|')) t""",
}
