"""Texts and pages: rules over terms, titles, similarity, clusters, trends, retrieval, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import affirmed, allowed_url, char_ngrams, has_alias, level, title_norm
from tidemark.operators.events import trend_score, trend_state
from tidemark.operators.relations import alike_pairs, jaccard_pairs
from tidemark.operators.retrieval import ranked
from tidemark.sources.tables import read

#: Test dictionaries: a rule has terms of which any, all, or none must stand in the text, and terms that must be affirmed.
RULES = (
    {"id": "en_core", "any": ("thand", "ouin"), "all": ("the",), "none": ("pathetic",), "affirmed": "onre"},
    {"id": "fr_core", "any": ("eaux", "ment"), "all": ("le",), "none": ("zut",), "affirmed": "aile"},
    {"id": "de_core", "any": ("heit", "keit"), "all": ("der",), "none": ("idiot",), "affirmed": "ung"},
)
NEGATIONS = ("not ", "no ", "pas ", "nicht ")
CONCEPTS = {"movement": ("thand", "er on"), "water": ("eau",), "state": ("heit", "con"), "none": ("qqq",)}
HIGH, MEDIUM, LOW = ("thestion", "eauxment", "keitheit"), ("tion", "ment", "heit", "ción"), ("idiot", "pathetic", "!!")
HOSTS = ("example.org", "m.ththth.example.net")


def _first_line(df: DataFrame) -> DataFrame:
    return df.withColumn("title", title_norm(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)))


def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that fit a rule: any, all, none, and one term that stands somewhere without a negation just before it."""
    text = F.coalesce("text", F.lit(""))
    fits = []
    for r in RULES:
        any_, none = F.lit(False), F.lit(False)
        for t in r["any"]:
            any_ = any_ | text.contains(t)
        for t in r["none"]:
            none = none | text.contains(t)
        every = F.lit(True)
        for t in r["all"]:
            every = every & text.contains(t)
        fits.append(F.when(any_ & every & ~none & affirmed(text, r["affirmed"], NEGATIONS), F.lit(r["id"])))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_compact(F.array(*fits))).alias("rule_id"))


def title_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_line(read(spark, sf_dir, "documents")).select("doc_id", "title")


def char_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct bigrams of each title, and the first and last of them by code."""
    g = _first_line(read(spark, sf_dir, "documents")).select("doc_id", char_ngrams(F.col("title")).alias("g"))
    return g.select("doc_id", F.size("g").cast("long").alias("n"), F.array_min("g").alias("first"), F.array_max("g").alias("last"))


def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of one language alike by 0.62 over 4-grams, whose prefixes are rare enough to join on; equal titles count as one."""
    t = _first_line(read(spark, sf_dir, "documents")).select("doc_id", "lang", char_ngrams(F.col("title"), 4).alias("g"))
    return jaccard_pairs(t, "doc_id", "lang", "g", 62).select("block", "a", "b", "n_shared", "n_all")


def title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of one language alike over bigrams by a Jaccard of 0.62 or an overlap of 0.72, as events link titles; equal titles count as one."""
    t = _first_line(read(spark, sf_dir, "documents")).select("doc_id", "lang", char_ngrams(F.col("title")).alias("g"))
    return alike_pairs(t, "doc_id", "lang", "g", 62, 72)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news items of a category (language and source)."""
    d = _first_line(read(spark, sf_dir, "documents"))
    has = lambda t: F.coalesce(F.col("text"), F.lit("")).contains(t)
    tags = F.array_compact(F.array(*(F.when(has(t), F.lit(t)) for t in ("thand", "eau", "heit", "con", "tion"))))
    return d.select(
        "doc_id", F.concat_ws("|", "lang", "source").alias("category"), "title", F.col("lang").alias("language"), F.col("source").alias("source_name"), F.lit("news").alias("source_type"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 40).cast("int")).alias("published_at"), tags.alias("tags"), F.array("lang").alias("subjects"), F.slice(tags, 1, 1).alias("laws"), (F.col("doc_id") % 10 == 0).alias("official"), (F.col("n_chars") % 10).alias("signal_score"),
    )


def trend_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as events, labels as their evidence: score and state."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    day = (F.col("doc_id") % 40).cast("int")
    n = lambda x: F.count_if(x)
    g = d.groupBy("source").agg(
        F.count_distinct("lang").alias("langs"), n(F.col("quality") == 1).alias("good"), n(F.col("toxic") == 1).alias("toxic"), n(F.col("quality").isNotNull()).alias("labelled"),
        F.count_distinct(day).alias("observed"), F.max(day).alias("last"), F.min(day).alias("first"), F.count("*").alias("n"),
    )
    c = F.col
    span, age = c("last") - c("first"), F.lit(39) - c("last")
    grade = lambda x, mid, high: F.when(x >= high, 3).when(x >= mid, 2).otherwise(1)
    quality = F.when(c("good") >= 5, 1.0).when(c("good") >= 3, 0.65).when(c("good") >= 1, 0.35).otherwise(0.0)
    score = trend_score(c("langs"), c("toxic"), grade(c("n"), 5, 10), c("good") * 0.5, c("labelled"), quality, F.when(c("labelled") > 0, c("toxic")), c("langs"), c("toxic"), c("good"), c("observed"), span, grade(c("good"), 2, 4), grade(c("toxic"), 1, 2), age)
    return g.select("source", score.alias("score"), trend_state(age, c("observed"), span).alias("state"))


def concept_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of each document by aliases with borders; those without any are left out."""
    tag = []
    for name, aliases in CONCEPTS.items():
        hit = F.lit(False)
        for a in aliases:
            hit = hit | has_alias(F.coalesce("text", F.lit("")), a)
        tag.append(F.when(hit, F.lit(name)))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_compact(F.array(*tag))).alias("concept"))


def level_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("lang", level(F.lower(F.coalesce("text", F.lit(""))), HIGH, MEDIUM, LOW).alias("level")).agg(F.count("*").alias("n"))


def retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents nearest to each benchmark item by words."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-zà-ÿ]+")), lambda x: x != "")
    return ranked(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), words.alias("terms")), read(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), words.alias("terms")), 3)


def dup_conflict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with equal text: a conflict if their languages differ; the richer row is kept, the first of equals."""
    d = read(spark, sf_dir, "documents").withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    rich = F.col("lang").isNotNull().cast("int") + F.col("source").isNotNull().cast("int") + F.col("n_chars").isNotNull().cast("int")
    g = d.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct(F.struct("lang")).alias("langs"), F.max(F.struct(rich.alias("r"), (-F.col("doc_id")).alias("i"))).alias("best"))
    return g.where("n > 1").select("key", "n", (F.col("langs") > 1).alias("conflict"), (-F.col("best")["i"]).alias("kept"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page by number and target, the target's text as it stands."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'<a href="([^"]*)"'), F.lit(1))
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("n", "href")).select("page_id", F.col("n").cast("long").alias("n"), "href")


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain text of each page: no scripts, styles or comments, tags as line feeds, the common references decoded, white space as one space."""
    x = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", " "), r"<[^>]*>", "\n")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    x = F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " "))
    return read(spark, sf_dir, "pages").select("page_id", F.length(x).cast("long").alias("chars"), F.sha2(x, 256).alias("text_sha256"))


def url_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which page addresses are https on an allowed host or below it, without a user part or another port."""
    return read(spark, sf_dir, "pages").select("page_id", "url", allowed_url(F.col("url"), HOSTS).alias("allowed"))


QUERIES = {f.__name__: f for f in (rule_match, title_norms, char_ngram_counts, pair_similarity, title_links, trend_scores, concept_tags, level_classifier, retrieval_topk, dup_conflict_merge, html_links, html_text, url_gate)}

TITLE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(string_split(coalesce(text, ''), chr(10))[1]), '[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}', ' ', 'g'), '[0-9]+(\.[0-9]+)?%?', ' ', 'g'), '[!-/:-@\[-`{-~]+', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"""
GRAMS = "(case when length(t) = 0 then [] when length(t) < 2 then [t] else list_distinct(list_transform(generate_series(1, length(t) - 1), lambda i: substr(t, cast(i as integer), 2))) end)"
FOURS = GRAMS.replace("< 2", "< 4").replace("- 1)", "- 3)").replace(", 2)", ", 4)")
PLAIN = "coalesce(text, '')"


def _rule_sql(r: dict) -> str:
    any_ = " or ".join(f"contains(t, '{x}')" for x in r["any"])
    none = " or ".join(f"contains(t, '{x}')" for x in r["none"])
    every = " and ".join(f"contains(t, '{x}')" for x in r["all"])
    neg = " and ".join(f"not contains(c, '{n}')" for n in NEGATIONS)
    before = f"list_transform(generate_series(1, len(string_split(t, '{r['affirmed']}')) - 1), lambda k: right(array_to_string(string_split(t, '{r['affirmed']}')[1:k], '{r['affirmed']}'), 18))"
    return f"select doc_id, '{r['id']}' rule_id from d where ({any_}) and {every} and not ({none}) and len(list_filter({before}, lambda c: {neg})) > 0"


ORACLE = {
    "rule_match": f"with d as (select doc_id, {PLAIN} t from documents) " + " union all ".join(_rule_sql(r) for r in RULES),
    "title_norms": f"select doc_id, {TITLE} title from documents",
    "char_ngram_counts": f"with g as (select doc_id, {GRAMS} g from (select doc_id, {TITLE} t from documents)) select doc_id, cast(len(g) as bigint) n, list_min(g) as first, list_max(g) as last from g",
    "pair_similarity": f"""with g as (select lang block, list_sort({FOURS}) g, min(doc_id) i from (select doc_id, lang, {TITLE} t from documents) where length(t) > 0 group by 1, 2),
 p as (select x.block, x.i a, y.i b, cast(len(list_intersect(x.g, y.g)) as bigint) n_shared, len(x.g) + len(y.g) s from g x join g y on x.block = y.block and x.i < y.i)
 select block, a, b, n_shared, cast(s - n_shared as bigint) n_all from p where 100 * n_shared >= 62 * (s - n_shared)""",
    "title_links": f"""with g as (select lang block, list_sort({GRAMS}) g, min(doc_id) i from (select doc_id, lang, {TITLE} t from documents) where length(t) > 0 group by 1, 2),
 p as (select x.block, x.i a, y.i b, cast(len(list_intersect(x.g, y.g)) as bigint) n_shared, len(x.g) + len(y.g) s, cast(least(len(x.g), len(y.g)) as bigint) n_less from g x join g y on x.block = y.block and x.i < y.i)
 select block, a, b, n_shared, cast(s - n_shared as bigint) n_all, n_less from p where 100 * n_shared >= 62 * (s - n_shared) or 100 * n_shared >= 72 * n_less""",
    "trend_scores": """with d as (select d.*, quality, toxic, cast(d.doc_id % 40 as integer) as t from documents d left join labels l on l.doc_id = d.doc_id),
 g as (select source, count(distinct lang) l, count(*) filter (where quality = 1) good, count(*) filter (where toxic = 1) tox, count(*) filter (where quality is not null) lab, count(distinct t) obs, max(t) hi, min(t) lo, count(*) n from d group by 1),
 q as (select *, (case when good >= 5 then 1.0 when good >= 3 then 0.65 when good >= 1 then 0.35 else 0.0 end)::double q, hi - lo span, 39 - hi age from g),
 s as (select source, obs, span, age, (least(1.2::double, 0.55::double * greatest(l - 1, 0)) + least(1.4::double, 0.7::double * tox) + 0.9::double * ((case when n >= 10 then 3 when n >= 5 then 2 else 1 end) - 1) + case when good * 0.5::double <= 0 then 0.0::double else round_even(least(1.3::double, 0.28::double * (good * 0.5::double)), 3) end
 + least(0.8::double, 0.12::double * lab) * q + (case when lab = 0 then 0.0 when tox <= 1 then 0.8 when tox <= 3 then 0.6 when tox <= 5 then 0.35 else 0.15 end)::double * q + (case when l >= 3 then 0.45 when l >= 2 then 0.25 else 0.0 end)::double
 + least(1.1::double, 0.35::double * tox + 0.04::double * least(good, 10)) + least(1.4::double, 0.45::double * greatest(obs - 1, 0) + 0.05::double * least(span, 10)) + 0.55::double * ((case when good >= 4 then 3 when good >= 2 then 2 else 1 end) - 1)
 + 0.45::double * ((case when tox >= 2 then 3 when tox >= 1 then 2 else 1 end) - 1) + (case when age <= 3 then 1.0 when age <= 7 then 0.6 else 0.2 end)::double) total from q)
 select source, round_even(greatest(0.0::double, least(10.0::double, total / 13.25::double * 10)), 1) score, case when age > 10 then 'cooling' when obs >= 3 or span >= 4 then 'sustained' when obs >= 2 then 'rising' else 'one_off' end state from s""",
    "concept_tags": f"with d as (select doc_id, lower({PLAIN}) t from documents) " + " union all ".join(f"select doc_id, '{n}' concept from d where " + " or ".join("regexp_matches(t, '(^|[^a-z0-9])" + r"\s+".join(a.split()) + "([^a-z0-9]|$)')" for a in aliases) for n, aliases in CONCEPTS.items()),
    "level_classifier": f"""with c as (select lang, {' + '.join(f"contains(t, '{x}')::int" for x in HIGH)} h, {' + '.join(f"contains(t, '{x}')::int" for x in MEDIUM)} m, {' + '.join(f"contains(t, '{x}')::int" for x in LOW)} l from (select lang, lower({PLAIN}) t from documents))
 select lang, case when h >= 1 and l = 0 then 'high' when h >= 1 then 'medium' when m >= 2 then 'medium' when m >= 1 and l = 0 then 'medium' else 'low' end as level, count(*) n from c group by 1, 2""",
    "retrieval_topk": """with q as (select item_id q, unnest(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-zà-ÿ]+'), lambda x: x <> ''))) t from benchmark), d as (select doc_id d, unnest(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-zà-ÿ]+'), lambda x: x <> ''))) t from documents),
 n as (select d, count(*) n_d from d group by 1), f as (select t, count(*) df from d group by 1), w as (select q, q.t, cast(round((ln(((select count(*) from documents) + 1)::double / (coalesce(df, 0) + 1)) + 1) * 1000000) as bigint) w from q left join f on f.t = q.t),
 a as (select q, sum(w)::double s, count(*) n_q from w group by 1), h as (select w.q, d.d, sum(w)::double got, count(*) shared from w join d on d.t = w.t group by 1, 2),
 s as (select h.q, h.d, shared, round(least(1.0::double, 0.88::double * (got / s) + 0.12::double * (shared::double / (n_q + n_d - shared))), 6) score from h join a on a.q = h.q join n on n.d = h.d),
 r as (select *, row_number() over (partition by q order by score desc, shared desc, d) place from s) select q, d, shared, score, place from r where place <= 3""",
    "dup_conflict_merge": f"""select sha256({PLAIN}) as key, count(*) n, count(distinct coalesce(lang, '-')) > 1 conflict, min(doc_id) kept from documents group by 1 having count(*) > 1""",
    "html_links": """with l as (select page_id, regexp_extract_all(coalesce(html, ''), '<a href="([^"]*)"', 1) h from pages) select page_id, cast(i - 1 as bigint) n, h[i] href from (select page_id, h, unnest(generate_series(1, len(h))) i from l)""",
    "html_text": r"""with x as (select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', chr(10), 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) t from pages) select page_id, cast(length(t) as bigint) chars, sha256(t) text_sha256 from x""",
    "url_gate": r"""with h as (select page_id, url, lower(regexp_extract(url, '^https://([^/?#:@]*)', 1)) h from pages)
 select page_id, url, coalesce(regexp_matches(url, '^https://[^/?#@:]+(:443)?([/?#]|$)') and (h = 'example.org' or ends_with(h, '.example.org') or h = 'm.ththth.example.net' or ends_with(h, '.m.ththth.example.net')), false) allowed from h""",
}
