"""Events over documents as news items: clusters, predecessors in the generation before, topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.events import JOIN, TIERS, clusters, match_previous, merged_topics
from tidemark.plans.texts import GRAMS, TITLE, items

#: Items up to this day are the generation before.
GENERATION = "2024-01-25"
#: Marks in texts that stand for explicit topics, laws and facts of the topic merge.
MARKS = {"thandth": "t-and", "eauxeau": "t-water", "heitkeit": "t-state"}
STOP = ("tion",)


def event_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a category put to events one by one, each compared with the leads of the moment."""
    rows = items(spark, sf_dir)
    return rows.select("category", "doc_id").join(clusters(rows, "doc_id").select("doc_id", "event_id"), "doc_id")


def _generation(rows: DataFrame) -> DataFrame:
    """Events of some items: the id of the first item, its lead's columns, a key of category and title, and their order."""
    found = clusters(rows, "doc_id").where("is_lead").select("doc_id", "event_id")
    began = rows.select(F.col("doc_id").alias("event_id"), F.col("published_at").alias("began"))
    place = F.date_diff("began", F.lit("2000-01-01").cast("date")).cast("long") * 10_000_000_000 + F.col("event_id")
    return rows.join(found, "doc_id").drop("doc_id").join(began, "event_id").withColumns({"place": place, "key": F.sha2(F.concat_ws("|", "category", "title"), 256)}).drop("began")


def event_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event of the later items with the one of the earlier items that it goes on: by key, or the most alike that is left."""
    rows = items(spark, sf_dir)
    new = F.col("published_at") > F.lit(GENERATION).cast("date")
    return match_previous(_generation(rows.where(new)), _generation(rows.where(~new)), id_col="event_id", place="place").select("event_id", "previous", F.col("score").cast("long").alias("score"))


def topic_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with an explicit topic, laws, facts and tags found in their own text, in the order of score, date and id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = items(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.alias("text")), "doc_id")
    has = lambda t: F.col("text").contains(t)
    topic = F.coalesce(*(F.when(has(mark), F.lit(name)) for mark, name in MARKS.items()))
    laws = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]{12,})"), F.lit(1)))), 1, 1)
    facts = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]{4,})"), F.lit(1))), 1, 3)
    tags = F.array_compact(F.array(*(F.when(has(t), F.lit(t)) for t in ("thand", "eau", "heit", "con", "tion", "ing", "ment", "ung"))))
    place = -F.col("signal_score").cast("long") * 10_000_000_000_000 - F.date_diff("published_at", F.lit("2000-01-01").cast("date")).cast("long") * 1_000_000_000 + F.col("doc_id")
    return rows.select("doc_id", "category", "source_name", "published_at", topic.alias("topic"), laws.alias("laws"), facts.alias("facts"), tags.alias("tags"), place.cast("long").alias("place"))


def topic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items put to the first topic that they fit, whose laws and tags grow by each."""
    return merged_topics(topic_items(spark, sf_dir), "doc_id", stop=STOP)


QUERIES = {f.__name__: f for f in (event_clusters, event_predecessors, topic_merge)}

# The fold in SQL: a category's items by number, with the leads so far as a list that each step replaces.
TAGS = "list_filter(['thand', 'eau', 'heit', 'con', 'tion'], lambda t: contains(coalesce(text, ''), t))"
ITEMS = f"""i as (select doc_id, concat_ws('|', lang, source) category, date '2024-01-01' + cast(doc_id % 40 as integer) as day, doc_id % 10 = 0 official, n_chars % 10 signal, {GRAMS} g, tags, tags[1:1] laws from (select *, {TITLE} t, {TAGS} tags from documents)),
 n as (select *, row_number() over (partition by category order by day, doc_id) k from i),
 p as (select a.category, a.doc_id l, b.doc_id r, cast(len(list_intersect(a.g, b.g)) as bigint) nb, least(len(a.g), len(b.g)) less, len(a.g) + len(b.g) s, len(list_intersect(a.laws, b.laws)) > 0 law, len(list_intersect(a.tags, b.tags)) x, len(list_distinct(list_concat(a.tags, b.tags))) y
 from n a join n b on a.category = b.category and a.k < b.k and b.day - a.day <= 10),
 q as (select *, less > 0 and (100 * nb >= {TIERS[0][0]} * (s - nb) or 100 * nb >= {TIERS[0][1]} * less) t0, less > 0 and (100 * nb >= {TIERS[1][0]} * (s - nb) or 100 * nb >= {TIERS[1][1]} * less) t1,
 less > 0 and (100 * nb >= {TIERS[2][0]} * (s - nb) or 100 * nb >= {TIERS[2][1]} * less) t2, y > 0 and 100 * x >= 50 * y hf, y > 0 and 100 * x >= 25 * y qt from p),
 e as (select category, l, r, least(100, case when t0 then 72 when t1 then 50 else 30 end + case when law then 28 else 0 end + case when hf then 15 when qt then 8 else 0 end + 5) score from q where t0 or (t1 and (law or hf)) or (t2 and law and qt))"""

ORACLE = {
    "event_clusters": f"""with recursive {ITEMS}, m as (select r, map_from_entries(list((l, score))) near from e where score >= {JOIN} group by r), o as (select n.*, coalesce(near, map {{}}) near from n left join m on m.r = n.doc_id),
 f as (select category, k, doc_id, doc_id event_id, [{{'g': doc_id, 'lead': doc_id, 'rank': (official, signal, day)}}] leads from o where k = 1 union all
 select category, k, doc_id, coalesce(g, doc_id) event_id, case when g is null then list_append(leads, {{'g': doc_id, 'lead': doc_id, 'rank': rank}}) else list_transform(leads, lambda x: case when x.g = g and rank > x.rank then {{'g': g, 'lead': doc_id, 'rank': rank}} else x end) end leads
 from (select *, case when best.s > 0 then best.g end g from (select o.category, o.k, o.doc_id, (o.official, o.signal, o.day) as rank, leads, list_reduce(list_transform(leads, lambda x: {{'s': coalesce(near[x.lead], 0), 'g': x.g}}), lambda a, b: case when b.s > a.s then b else a end) as best
 from f join o on o.category = f.category and o.k = f.k + 1)))
 select category, doc_id, event_id from f""",
}
