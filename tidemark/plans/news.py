"""News: scan and score, features, exam signals, links to questions and their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vocabulary as V
from tidemark.functions.columns import allowed_url
from tidemark.operators import news as N
from tidemark.plans.derived import ALLOWED, NEWS, QUESTIONS, SUBJECTS, SUBJECTS_OF, TODAY, news, questions, quoted, sql_any, sql_hits, sql_keys, sql_list, sql_ordered_distinct


def joined(x: Column) -> Column:
    return F.array_join(x, "|")


def news_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of value for the exam: score, category, tags."""
    return N.scored(news(spark, sf_dir)).select("id", F.col("score").cast("long").alias("score"), "category", joined(F.col("tags")).alias("tags"))


def news_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radar's report: items of 21 days (or without a date) from allowed hosts, the best-scored of each address, the first 100."""
    c = F.col
    recent = c("published_at").isNull() | (c("published_at") >= F.date_sub(F.lit(TODAY).cast("date"), 21))
    seen = N.scored(news(spark, sf_dir).where((c("title") != "") & recent & allowed_url(c("url"), ALLOWED)))
    best = seen.groupBy("url").agg(F.max_by(F.struct("id", "score", "category", "published_at"), F.struct("score", (-c("id")).alias("first"))).alias("b"), F.min("id").alias("seq"))
    order = [F.desc("b.score"), F.desc_nulls_last("b.published_at"), F.asc("seq")]
    top = best.orderBy(*order).limit(100)
    return top.select(F.substring(F.sha2("url", 256), 1, 32).alias("item_id"), "b.id", c("b.score").cast("long").alias("score"), "b.category", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))


def news_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts, agencies, facts and names like laws of each item, and its language."""
    c = F.col
    d = news(spark, sf_dir).withColumn("text", F.concat(c("title"), F.lit(" "), c("summary")))
    return d.select(
        "id", joined(N.tagged(c("text"), V.CONCEPTS)).alias("concepts"), joined(N.tagged(c("text"), V.AGENCIES)).alias("agencies"), joined(N.fact_keys(c("text"))).alias("facts"),
        joined(N.law_phrases(c("text"))).alias("laws"), F.when(c("title").rlike(N.CJK), "cjk").otherwise("latin").alias("language"), N.english(c("text")).alias("english"),
    )


def news_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exam signals of each scored item: laws, levels, focus, and confidence without related questions."""
    s = N.signals(N.scored(news(spark, sf_dir)))
    sure = N.confidence(F.col("policy"), F.col("essay"), F.col("facts"), F.col("laws"), F.lit(0))
    return s.select("id", joined(F.col("laws")).alias("laws"), "policy", "essay", "facts", joined(F.col("focus")).alias("focus"), sure.alias("confidence"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored items of one text, category and tags as one event, under the smallest id."""
    text = F.concat(F.col("title"), F.lit(" "), F.col("summary"))
    e = N.scored(news(spark, sf_dir)).groupBy(text.alias("text"), "category", "tags").agg(F.min("id").alias("event"))
    return e.withColumn("laws", N.laws_in(F.col("text")))


def _question_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the key of their text."""
    c = F.col
    words = F.array_join(N.keywords(c("keywords")), " ")
    q = questions(spark, sf_dir).withColumns({"text": F.concat_ws(" ", "question", "topic", words), "structured": F.concat_ws(" ", "topic", words, F.coalesce("law", F.lit("")))})
    return q.withColumn("question_key", F.xxhash64("text", F.coalesce("law", F.lit(""))))


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events, classed = _events(spark, sf_dir), _question_classes(spark, sf_dir)
    texts = classed.groupBy("question_key").agg(*(F.first(x).alias(x) for x in ("text", "structured", "law")))
    return events, classed, N.linked_questions(events, texts)


def _subjects() -> DataFrame:
    names = F.create_map(*(x for k, v in SUBJECTS_OF.items() for x in (F.lit(k), F.array(*(F.lit(SUBJECTS[i]) for i in v)))))
    return names[F.col("category")]


def event_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five questions nearest to each event, by score, later year, number. Of questions with one text, only the first five go on."""
    events, q, links = _links(spark, sf_dir)
    later = F.when(F.col("year").rlike("^[0-9]+$"), F.col("year").cast("int")).otherwise(0)
    q = q.withColumn("y", later)
    first = q.withColumn("r", F.row_number().over(W.partitionBy("question_key", "subject").orderBy(F.desc("y"), "qno", "id"))).where("r <= 5")
    found = links.join(events.select("event", F.explode(_subjects()).alias("subject")), "event").join(first.select("question_key", "subject", "id", "y", "qno"), ["question_key", "subject"])
    place = F.row_number().over(W.partitionBy("event").orderBy(F.desc("score"), F.desc("y"), "qno", "id"))
    return found.withColumn("place", place.cast("long")).where("place <= 5").select("event", F.col("id").alias("question"), "score", "place")


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and when an event's matter was examined: strong, medium and weak matches, their capped weight, years, subjects."""
    events, q, links = _links(spark, sf_dir)
    by_class = q.groupBy("question_key", "subject").agg(F.count("*").alias("n"), F.collect_set(F.col("year").cast("int")).alias("years"))
    latest = q.agg(F.max(F.col("year").cast("int")).alias("corpus"))
    found = links.join(events.select("event", F.explode(_subjects()).alias("subject")), "event").join(by_class, ["question_key", "subject"])
    band = lambda low, high: F.sum(F.when((F.col("score") >= low) & (F.col("score") < high), F.col("n")).otherwise(0))
    g = found.groupBy("event").agg(
        F.sum("n").alias("matched"), band(5, 1e9).alias("strong"), band(3, 5).alias("medium"), band(2, 3).alias("concept"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("years")))).alias("years"), F.count_distinct("subject").alias("subjects"),
    )
    weight = F.least("strong", F.lit(8)) + F.least("medium", F.lit(6)) * 0.5 + F.least("concept", F.lit(4)) * 0.25
    since = F.greatest(F.lit(0), F.col("corpus") - F.array_max("years"))
    return g.join(F.broadcast(latest)).select("event", "matched", "strong", "medium", "concept", F.bround(weight, 2).alias("weight"), joined(F.col("years").cast("array<string>")).alias("years"), since.cast("long").alias("since"), "subjects")


QUERIES = {f.__name__: f for f in (news_scored, news_scan, news_features, news_signals, event_questions, event_history)}

LETTERS = "length(regexp_replace({t}, '[^A-Za-z]', '', 'g'))"
ENGLISH = f"({LETTERS.format(t='txt')} >= 20 and {LETTERS.format(t='txt')} >= greatest(1, 3 * length(regexp_replace(txt, '[^一-龥]', '', 'g'))))"
WORKER, HARMED, AROUND = sql_any("title", V.SOCIAL_WORK), sql_any("title", V.HARM), sql_any("txt", V.PROFESSIONAL)
PRESS = f"""(not ({WORKER} and {HARMED} and not {AROUND}) and (({sql_any('title', V.SCHOOL)} and {sql_any('title', V.SCHOOL_HARM)}) or ({HARMED} and ({sql_any('title', V.ROLES)} or ({WORKER} and {AROUND})))
 or ({HARMED} and {sql_any('title', V.VULNERABLE)} and {sql_any('txt', V.SYSTEM)} and not {WORKER})))"""
STRONG = sql_any("title", [*V.STRUCTURAL, *V.REPORTS, *V.JUDICIAL, *V.SERIOUS])
CATEGORY_ROWS = ", ".join(f"({quoted(n)}, {b}, {k}, {sql_list(w.split())})" for k, (n, b, w) in enumerate(V.CATEGORIES))
CONCEPT_ROWS = ", ".join(f"({quoted(k)}, {quoted(c)}, {quoted(t)})" for k, c, t, _ in V.CONCEPTS)
#: Items with score, category and tags, written as joins with the categories and concepts.
SCORED = f"""{NEWS}, cats(category, base, k, words) as (values {CATEGORY_ROWS}), concepts(key, category, tag) as (values {CONCEPT_ROWS}),
 n1 as (select *, title || ' ' || summary txt from news), n2 as (select *, {sql_hits('txt', V.POLICY)} pol, region = 'international' and {ENGLISH} abroad, {PRESS} press from n1),
 n3 as (select * from n2 where not (source_type = 'news' and {WORKER} and {HARMED} and not {AROUND}) and case when abroad then {sql_any('lower(title)', V.EN_STRUCTURAL + V.EN_REPORTS + V.EN_SERIOUS)}
  else {STRONG} or (source_type = 'news' and press) or (not {sql_any('title', V.PROCEDURAL)} and {sql_any('title', V.STRUCTURAL_WEAK)}) end),
 h as (select n3.*, category, base, k, list_filter(words, lambda w: contains(title, w)) ti, list_filter(words, lambda w: contains(txt, w)) al from n3 cross join cats),
 l as (select *, base + least(2, greatest(0, len(ti) - 1)) + (len(pol) > 0)::int + (category = '性別與家庭政策' and len(pol) > 0 and {sql_any('title', V.FAMILY_STRONG)})::int points from h
  where len(al) > 0 and (len(ti) > 0 or (len(al) >= 2 and len(pol) > 0)) and not (category = '兒少保護' and len(ti) > 0 and len(list_filter(ti, lambda w: not list_contains({sql_list(V.CHILD_WEAK)}, w))) = 0 and not {sql_any('txt', V.CHILD_STRONG)})
  and not (category = '災害與社區工作' and not {sql_any('txt', V.DISASTER_STRONG)})),
 l1 as (select * from (select *, row_number() over (partition by id order by points desc, len(ti) desc, k) r from l) where r = 1),
 here as (select id, points + case when source_type = 'official' or (source_type = 'news' and press) then 1 else 0 end - case when {sql_any('title', V.LOW_VALUE)} then 3 else 0 end - (region = 'international')::int score, category,
  {sql_ordered_distinct('al || pol[1:3]')}[1:10] tags from l1 where not abroad and (region <> 'international' or {sql_any('txt', V.INTERNATIONAL_CORE)})),
 a as (select *, unnest({sql_keys('txt', V.CONCEPTS)}) key, len({sql_keys('title', V.CONCEPTS)}) told, {' or '.join(f"regexp_matches(lower(txt), '(^|[^a-z0-9]){'[ ]+'.join(t.split())}([^a-z0-9]|$)')" for t in V.EN_POLICY)} pl from n3 where abroad),
 a1 as (select id, c.category, base, count(*) m from a join concepts c using (key) join cats on cats.category = c.category group by 1, 2, 3), a2 as (select * from (select *, row_number() over (partition by id order by m desc, base desc, category desc) r from a1) where r = 1),
 a3 as (select id, any_value(source_type) st, bool_or(pl) pl, max(told) told, count(*) c, list(tag order by key)[1:8] tags from a join concepts using (key) group by 1),
 there as (select a3.id, greatest(4, base) + least(2, greatest(0, m - 1)) + pl::int + (st in ('official', 'international'))::int - 1 score, category, tags from a3 join a2 on a2.id = a3.id where told > 0 or (c >= 2 and pl)),
 scored as (select x.id, cast(least(10, score) as bigint) score, category, tags, title, summary, txt, url, published_at from (select * from here union all select * from there) x join n1 on n1.id = x.id where score >= 5)"""


def _count(terms) -> str:
    return " + ".join(f"contains(txt, {quoted(t)})::int" for t in terms)


def _level(levels) -> str:
    h, m, n = (f"({_count(x)})" for x in levels)
    return f"case when {h} >= 1 and {n} = 0 then 'high' when {h} >= 1 then 'medium' when {m} >= 2 then 'medium' when {m} >= 1 and {n} = 0 then 'medium' else 'low' end"


LAWS_IN = sql_ordered_distinct(f"(regexp_extract_all(txt, '《([^》]{{2,40}})》', 1) || {sql_hits('txt', V.KNOWN_LAWS)})") + "[1:8]"
FOUND = "(regexp_extract_all(txt, '\\b[0-9]{1,3}(?:[,，][0-9]{3})+(?:\\.[0-9]+)?%?') || regexp_extract_all(txt, '\\b[0-9]{4}\\s*年(?:[0-9]{1,2}\\s*月)?') || regexp_extract_all(txt, '第\\s*[0-9]+\\s*條')"
FOCUS = sql_ordered_distinct(f"{FOUND} || {sql_hits('txt', V.FOCUS_AGENCIES)} || laws[1:3] || list_filter(tags, lambda g: not list_contains({sql_list(V.WEAK_TAGS)}, g)))") + "[1:8]"
NUMBERS = " union all ".join(
    f"select id, cast(unnest(regexp_extract_all(lower(txt), '([0-9]+(?:\\.[0-9]+)?)\\s*{unit}', 1)) as decimal(24, 6)) * {times} v from n1"
    for unit, times in (("million\\b", 10**6), ("billion\\b", 10**9), ("萬", 10**4), ("億", 10**8))
)
POINTS = " + ".join(f"case {x} when 'high' then 2 when 'medium' then 1 else 0 end" for x in ("policy", "essay", "facts"))
HISTORY_KEYS = "case when list_contains({k}, 'residential_support') then list_filter({k}, lambda h: h <> 'long_term_care') else {k} end"


def _history(text: str) -> str:
    return HISTORY_KEYS.format(k=sql_keys(text, V.HISTORY))


def _tag_said(keys: str, table) -> str:
    """Whether a tag t holds an alias of one of the keys."""
    return "(" + " or ".join(f"(list_contains({keys}, {quoted(k)}) and {sql_any('t', aliases)})" for k, *_, aliases in table) + ")"


ALONE = f"list_filter({{x}}, lambda h: list_contains({sql_list(V.STANDALONE)}, h))"
SHARED = "list_filter({a}, lambda h: list_contains({b}, h))"
NEEDS = sql_list([k for k, _, needed, _ in V.HISTORY if needed])
KEYWORDS = "case when starts_with(trim(keywords), '[') then json_extract_string(keywords, '$[*]') else list_filter(string_split_regex(keywords, '[,，;；|/\\s]+'), lambda x: x <> '') end"
#: Events, classes of questions, and the score of each pair with evidence, by comparing all pairs.
LINKS = f"""{SCORED}, {QUESTIONS}, ev as (select min(id) event, txt, category, tags, {LAWS_IN} laws, {sql_keys('txt', V.CONCEPTS)} con, {_history('txt')} his from scored group by txt, category, tags),
 ev1 as (select *, list_filter(tags, lambda g: length(g) >= 2 and not list_contains({sql_list(V.WEAK_TAGS)}, g) and contains(lower(txt), lower(g))) tg from ev),
 qc as (select *, concat_ws(' ', question, topic, array_to_string({KEYWORDS}, ' ')) qt, concat_ws(' ', topic, array_to_string({KEYWORDS}, ' '), coalesce(law, '')) qs, coalesce(law, '') ql from questions),
 qt as (select distinct qt, qs, ql from qc), qk as (select *, {sql_keys("(qt || ' ' || ql)", V.CONCEPTS)} qcon, {_history("(qt || ' ' || ql)")} qhis, {_history('qs')} qst from qt),
 pr as (select event, qt, ql, list_filter(tg, lambda g: contains(qt, g) or contains(ql, g)) hit, len(list_filter(laws, lambda x: contains(ql, x) or contains(qt, x))) > 0 lh, {SHARED.format(a='his', b='qhis')} sam0, {SHARED.format(a=ALONE.format(x='con'), b='qcon')} com, qst from ev1 cross join qk),
 pr1 as (select *, case when lh then sam0 else list_filter(sam0, lambda h: not list_contains({NEEDS}, h)) end sam from pr),
 pr2 as (select *, {SHARED.format(a='sam', b='qst')} firm, list_filter(hit, lambda t: not {_tag_said('sam', V.HISTORY)} and not {_tag_said('com', V.CONCEPTS)} and len(list_filter(hit, lambda o: o <> t and contains(o, t))) = 0) own from pr1 where len(hit) > 0 or len(sam) > 0 or len(com) > 0),
 lk as (select event, qt, ql, round(least(4.0::double, 2.0 * len(own)) + least(4.0::double, 3.0 * len(firm)) + least(1.0::double, 0.8 * (len(sam) - len(firm))) + least(3.0::double, 2.0 * len(com)) + case when lh then 3.0 else 0.0 end + 0.2, 2)::double score from pr2),
 su(category, subject) as (values {', '.join(f"({quoted(k)}, {quoted(SUBJECTS[i])})" for k, v in SUBJECTS_OF.items() for i in v)}),
 fo as (select lk.event, qc.id question, lk.score, cast(qc.year as integer) y, qno, qc.subject from lk join ev1 on ev1.event = lk.event join su on su.category = ev1.category join qc on qc.qt = lk.qt and qc.ql = lk.ql and qc.subject = su.subject)"""
ORACLE = {
    "news_scored": f"with {SCORED} select id, score, category, array_to_string(tags, '|') tags from scored",
    "news_scan": f"""with {SCORED}, u as (select *, min(id) over (partition by url) seq, row_number() over (partition by url order by score desc, id) r from scored where title <> '' and (published_at is null or published_at >= date '{TODAY}' - 21)
  and regexp_matches(url, '^https://([^/]*\\.)?(example\\.org|gov\\.example\\.net)/')) select substr(sha256(url), 1, 32) item_id, id, score, category, place from (select *, row_number() over (order by score desc, published_at desc nulls last, seq) place from u where r = 1) where place <= 100""",
    "news_features": f"""with {NEWS}, n1 as (select *, title || ' ' || summary txt from news), nu as ({NUMBERS} union all select id, cast(replace(unnest(regexp_extract_all(lower(txt), '\\b[0-9]{{1,3}}(?:,[0-9]{{3}})+\\b')), ',', '') as decimal(24, 6)) from n1),
 k as (select id, 'num:' || cast(cast(v as bigint) as varchar) f from nu where v = floor(v) and v >= 100 and v not between 1900 and 2100 union
  select id, 'pct:' || case when contains(p, '.') then regexp_replace(p, '\\.?0*$', '') else p end from (select id, unnest(regexp_extract_all(lower(txt), '([0-9]+(?:\\.[0-9]+)?)\\s*%', 1)) p from n1)), f as (select id, string_agg(f, '|' order by f) facts from k group by 1)
 select n1.id, array_to_string({sql_keys('txt', V.CONCEPTS)}, '|') concepts, array_to_string({sql_keys('txt', V.AGENCIES)}, '|') agencies, coalesce(facts, '') facts, array_to_string(list_sort(list_distinct(regexp_extract_all(txt, '[一-龥A-Za-z0-9]{{2,30}}(?:法|條例|辦法|施行細則|公約)'))), '|') laws,
 case when regexp_matches(title, '[一-龥]') then 'cjk' else 'latin' end as language, {ENGLISH} english from n1 left join f on f.id = n1.id""",
    "news_signals": f"""with {SCORED}, s as (select *, {LAWS_IN} laws, {_level(V.POLICY_LEVELS)} policy, {_level(V.ESSAY_LEVELS)} e0, case when {' + '.join(f"regexp_matches(txt, {quoted(p)})::int" for p in V.FACT_PATTERNS)} >= 2 then 'high'
  when {' + '.join(f"regexp_matches(txt, {quoted(p)})::int" for p in V.FACT_PATTERNS)} = 1 or {sql_any('txt', V.FACT_TERMS)} then 'medium' else 'low' end facts from scored),
 t as (select *, case when e0 = 'low' and category in ({', '.join(map(quoted, V.ESSAY_RAISED))}) then 'medium' else e0 end essay, {FOCUS} focus from s)
 select id, array_to_string(laws, '|') laws, policy, essay, facts, array_to_string(focus, '|') focus, case when {POINTS} + (len(laws) > 0)::int >= 5 then 'high' when {POINTS} + (len(laws) > 0)::int >= 3 then 'medium' else 'low' end confidence from t""",
    "event_questions": f"with {LINKS} select event, question, score, place from (select *, row_number() over (partition by event order by score desc, y desc, qno, question) place from fo) where place <= 5",
    "event_history": f"""with {LINKS}, g as (select event, count(*) matched, count(*) filter (where score >= 5) strong, count(*) filter (where score >= 3 and score < 5) med, count(*) filter (where score >= 2 and score < 3) concept, list_sort(list(distinct y)) as years, count(distinct subject) subjects from fo group by 1)
 select event, matched, strong, med as medium, concept, round_even((least(strong, 8) + least(med, 6) * 0.5 + least(concept, 4) * 0.25)::double, 2) weight, array_to_string(years, '|') as years, cast(greatest(0, (select max(cast(year as integer)) from questions) - list_max(years)) as bigint) since, subjects from g""",
}
