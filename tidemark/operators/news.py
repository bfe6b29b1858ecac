"""News items: whether they tell of an event, their category and score, concepts, facts, laws, signals, and links to exam questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocabulary as V
from tidemark.functions.columns import bound, has_alias, level
from tidemark.operators.rules import ladder

CJK = "[一-龥]"


def any_of(text: Column, terms: Sequence[str]) -> Column:
    """Whether a term stands in the text. Terms hold no signs of regular expressions."""
    return text.rlike("|".join(terms))


def hits(text: Column, terms: Sequence[str] | Column) -> Column:
    """The terms that stand in the text, in their order."""
    known = terms if isinstance(terms, Column) else F.array(*map(F.lit, terms))
    return F.filter(known, lambda t: F.contains(text, t))


def english(text: Column) -> Column:
    """At least 20 letters, and three for each Chinese character."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return (letters >= 20) & (letters >= F.greatest(F.lit(1), 3 * F.length(F.regexp_replace(text, f"(?!{CJK})[\\s\\S]", ""))))


def tagged(text: Column, entries: Sequence[tuple]) -> Column:
    """Keys of the entries (key, ..., aliases) of which an alias stands in the text, in the entries' order."""
    return F.array_compact(F.array(*(F.when(has_alias(text, *aliases), F.lit(key)) for key, *_, aliases in entries)))


def press_event(title: Column, text: Column) -> Column:
    """Two independent signs of an event in the press: harm, and a role, a person at risk within the system, or a school.

    A social worker's title is a sign only with the profession around it.
    """
    harm, worker, context = any_of(title, V.HARM), any_of(title, V.SOCIAL_WORK), any_of(text, V.PROFESSIONAL)
    school = any_of(title, V.SCHOOL) & any_of(title, V.SCHOOL_HARM)
    role = any_of(title, V.ROLES) | (worker & context)
    return ~(worker & harm & ~context) & (school | (harm & role) | (harm & any_of(title, V.VULNERABLE) & any_of(text, V.SYSTEM) & ~worker))


def tells_event(title: Column, text: Column, region: Column, source_type: Column) -> Column:
    """Whether something happened that is worth studying: strong signs pass, mere procedure doesn't, weak signs pass without it."""
    low_title, low_text = F.lower(title), F.lower(text)
    grave = any_of(low_title, V.EN_STRUCTURAL + V.EN_REPORTS + V.EN_SERIOUS)
    strong = any_of(title, [*V.STRUCTURAL, *V.REPORTS, *V.JUDICIAL, *V.SERIOUS]) | ((source_type == "news") & press_event(title, text))
    weak = ~any_of(title, V.PROCEDURAL) & any_of(title, V.STRUCTURAL_WEAK)
    return F.when((region == "international") & english(text), grave).otherwise(strong | weak)


def _local(title: Column, text: Column, policy: Column) -> Column:
    """The best category: score, title evidence, category, terms. Of equals, the first category."""
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(b).alias("base"), F.lit(-k).alias("place"), F.array(*map(F.lit, w.split())).alias("words")) for k, (n, b, w) in enumerate(V.CATEGORIES)))
    weak = F.array(*map(F.lit, V.CHILD_WEAK))

    def judged(c: Column) -> Column:
        inside, everywhere = hits(title, c["words"]), hits(text, c["words"])
        bare = (c["name"] == "兒少保護") & (F.size(inside) > 0) & (F.size(F.array_except(inside, weak)) == 0) & ~any_of(text, V.CHILD_STRONG)
        dry = (c["name"] == "災害與社區工作") & ~any_of(text, V.DISASTER_STRONG)
        fits = (F.size(everywhere) > 0) & ((F.size(inside) > 0) | ((F.size(everywhere) >= 2) & policy)) & ~bare & ~dry
        family = (c["name"] == "性別與家庭政策") & policy & any_of(title, V.FAMILY_STRONG)
        score = c["base"] + F.least(F.lit(2), F.greatest(F.lit(0), F.size(inside) - 1)) + policy.cast("int") + family.cast("int")
        return F.when(fits, F.struct(score.alias("score"), F.size(inside).alias("evidence"), c["place"].alias("place"), c["name"].alias("category"), everywhere.alias("terms")))

    return F.array_max(F.transform(rows, judged))


def scored(items: DataFrame) -> DataFrame:
    """items (title, summary, region, source_type, ...) with score, category and tags; those without value for the exam are left out."""
    c = F.col
    rows = items.withColumn("text", F.concat(c("title"), F.lit(" "), c("summary")))
    crime = (c("source_type") == "news") & any_of(c("title"), V.SOCIAL_WORK) & any_of(c("title"), V.HARM) & ~any_of(c("text"), V.PROFESSIONAL)
    rows = rows.where(~crime & tells_event(c("title"), c("text"), c("region"), c("source_type")))
    rows = bound(
        rows, _policy=hits(c("text"), V.POLICY), _foreign=(c("region") == "international") & english(c("text")), _press=press_event(c("title"), c("text")),
        _concepts=tagged(c("text"), V.CONCEPTS), _titled=tagged(c("title"), V.CONCEPTS), _english=has_alias(c("text"), *V.EN_POLICY),
    )
    # English items go by concepts: the category with most of them, then the higher base, then the later name
    base = {n: b for n, b, _ in V.CATEGORIES}
    count = {n: sum((F.array_contains("_concepts", k).cast("int") for k, cat, *_ in V.CONCEPTS if cat == n), F.lit(0)) for n in dict.fromkeys(cat for _, cat, *_ in V.CONCEPTS)}
    top = F.array_max(F.array(*(F.when(x > 0, F.struct(x.alias("n"), F.lit(base[n]).alias("base"), F.lit(n).alias("name"))) for n, x in count.items())))
    rows = bound(rows, _best=_local(c("title"), c("text"), F.size("_policy") > 0), _top=top)
    bonus = F.when(c("source_type") == "official", 1).when((c("source_type") == "news") & c("_press"), 1).otherwise(0)
    local = c("_best.score") + bonus - F.when(any_of(c("title"), V.LOW_VALUE), 3).otherwise(0) - F.when(c("region") == "international", 1).otherwise(0)
    local = F.when((c("region") != "international") | any_of(c("text"), V.INTERNATIONAL_CORE), local)
    told = (F.size("_titled") > 0) | ((F.size("_concepts") >= 2) & c("_english"))
    abroad = F.greatest(F.lit(4), c("_top.base")) + F.least(F.lit(2), F.greatest(F.lit(0), c("_top.n") - 1)) + c("_english").cast("int") + c("source_type").isin("official", "international").cast("int") - 1
    names = F.create_map(*(F.lit(x) for k, _, t, _ in V.CONCEPTS for x in (k, t)))
    tags = F.transform(F.array_sort("_concepts"), lambda k: names[k])
    rows = bound(
        rows, _score=F.when(c("_foreign"), F.when(told, abroad)).otherwise(local), category=F.when(c("_foreign"), c("_top.name")).otherwise(c("_best.category")),
        tags=F.when(c("_foreign"), F.slice(tags, 1, 8)).otherwise(F.slice(F.array_distinct(F.concat(c("_best.terms"), F.slice("_policy", 1, 3))), 1, 10)),
    )
    return rows.where(c("_score") >= 5).select(*items.columns, F.least(F.lit(10), c("_score")).alias("score"), "category", "tags")


def fact_keys(text: Column) -> Column:
    """Percentages and numbers that identify an event, sorted: pct:45, num:12345. Numbers under 100, years and fractions are none."""
    low = F.lower(text)
    number = lambda times: lambda found: F.transform(found, lambda x: x.cast("decimal(24,6)") * F.lit(times).cast("decimal(10,0)"))
    keep = lambda x: F.filter(x, lambda v: (v == F.floor(v)) & (v >= 100) & ~v.between(1900, 2100))
    found = []
    for pattern, times in ((r"([0-9]+(?:\.[0-9]+)?)\s*million\b", 10**6), (r"([0-9]+(?:\.[0-9]+)?)\s*billion\b", 10**9), (r"([0-9]+(?:\.[0-9]+)?)\s*萬", 10**4), (r"([0-9]+(?:\.[0-9]+)?)\s*億", 10**8)):
        found.append(keep(number(times)(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)))))
    grouped = F.regexp_extract_all(low, F.lit(r"\b[0-9]{1,3}(?:,[0-9]{3})+\b"), F.lit(0))
    found.append(keep(number(1)(F.transform(grouped, lambda x: F.replace(x, F.lit(","), F.lit(""))))))
    numbers = F.transform(F.concat(*found), lambda v: F.concat(F.lit("num:"), v.cast("decimal(38,0)").cast("string")))
    shares = F.transform(F.regexp_extract_all(low, F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*%"), F.lit(1)), lambda x: F.concat(F.lit("pct:"), F.when(x.contains("."), F.regexp_replace(x, r"\.?0*$", "")).otherwise(x)))
    return F.array_sort(F.array_distinct(F.concat(shares, numbers)))


def laws_in(text: Column, known: Sequence[str] = V.KNOWN_LAWS) -> Column:
    """Names in brackets, then known names that stand in the text; the first eight different ones."""
    return F.slice(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit("《([^》]{2,40})》"), F.lit(1)), hits(text, known))), 1, 8)


def law_phrases(text: Column) -> Column:
    """Runs of characters that end like the name of a law, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("[一-龥A-Za-z0-9]{2,30}(?:法|條例|辦法|施行細則|公約)"), F.lit(0))))


def keywords(raw: Column) -> Column:
    """A JSON array of strings, else a text cut at commas, semicolons, bars, slashes and white space; blanks left out."""
    listed = F.when(F.trim(raw).startswith("["), F.from_json(raw, "array<string>"))
    parts = F.transform(F.coalesce(listed, F.split(F.coalesce(raw, F.lit("")), r"[,，;；|/\s]+")), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def fact_density(text: Column) -> Column:
    """high from two kinds of hard facts, medium from one or from a term, else low."""
    hard = sum((text.rlike(p).cast("int") for p in V.FACT_PATTERNS), F.lit(0))
    return ladder([(hard >= 2, "high"), ((hard == 1) | any_of(text, V.FACT_TERMS), "medium")], "low")


def signals(items: DataFrame) -> DataFrame:
    """items (title, summary, category, tags, ...) with laws, policy, essay, facts (levels) and focus (what to learn by heart)."""
    c = F.col
    rows = items.withColumn("text", F.concat(c("title"), F.lit(" "), c("summary")))
    rows = bound(rows, laws=laws_in(c("text")), policy=level(c("text"), *V.POLICY_LEVELS), _essay=level(c("text"), *V.ESSAY_LEVELS), facts=fact_density(c("text")))
    rows = rows.withColumn("essay", F.when(c("category").isin(*V.ESSAY_RAISED) & (c("_essay") == "low"), "medium").otherwise(c("_essay")))
    found = [F.regexp_extract_all(c("text"), F.lit(p), F.lit(0)) for p in (r"\b[0-9]{1,3}(?:[,，][0-9]{3})+(?:\.[0-9]+)?%?", r"\b[0-9]{4}\s*年(?:[0-9]{1,2}\s*月)?", r"第\s*[0-9]+\s*條")]
    strong = F.array_except("tags", F.array(*map(F.lit, V.WEAK_TAGS)))
    focus = F.slice(F.array_distinct(F.concat(*found, hits(c("text"), V.FOCUS_AGENCIES), F.slice("laws", 1, 3), strong)), 1, 8)
    return bound(rows, focus=focus).drop("text", "_essay")


def confidence(policy: Column, essay: Column, facts: Column, laws: Column, related: Column) -> Column:
    """high from five points, medium from three: two for each high level, one for a medium one, one for a law, up to one for related questions."""
    points = sum((F.when(x == "high", 2.0).when(x == "medium", 1.0).otherwise(0.0) for x in (policy, essay, facts)), F.lit(0.0))
    points = points + F.when(F.size(laws) > 0, 1.0).otherwise(0.0) + F.when(related >= 2, 1.0).when(related == 1, 0.5).otherwise(0.0)
    return ladder([(points >= 5, "high"), (points >= 3, "medium")], "low")


def history_concepts(text: Column) -> Column:
    """Concepts of past exams; residential support stands for its parent, long-term care."""
    found = tagged(text, V.HISTORY)
    return F.when(F.array_contains(found, "residential_support"), F.array_remove(found, "long_term_care")).otherwise(found)


def strong_tags(tags: Column) -> Column:
    return F.filter(F.array_except(tags, F.array(*map(F.lit, V.WEAK_TAGS))), lambda t: F.length(t) >= 2)


def linked_questions(events: DataFrame, questions: DataFrame) -> DataFrame:
    """events (event, text, tags, laws), questions (question_key, text, structured, law): event, question_key, score of the pairs with evidence.

    Pairs need a strong tag of the event, a shared concept of past exams or a shared standalone concept; a shared law adds to
    the score but links nothing by itself. Candidates come from an equi-join on evidence, so only pairs that share some
    are made. Both sides hold a row for each different text, not for each item. Tags come from the fixed vocabulary.
    """
    c = F.col
    e = bound(events, concepts=tagged(c("text"), V.CONCEPTS), history=history_concepts(c("text")))
    e = e.withColumn("tags", F.filter(strong_tags(c("tags")), lambda t: F.contains(F.lower(c("text")), F.lower(t))))
    whole = F.concat_ws(" ", c("text"), c("law"))
    q = bound(questions, q_concepts=tagged(whole, V.CONCEPTS), q_history=history_concepts(whole), q_structured=history_concepts(c("structured"))).withColumnRenamed("text", "q_text")
    tags = e.select(F.explode("tags").alias("tag")).distinct()
    with_tags = q.join(F.broadcast(tags.groupBy().agg(F.collect_set("tag").alias("known")))).withColumn("q_tags", F.filter("known", lambda t: F.contains(c("q_text"), t) | F.contains(F.coalesce(c("law"), F.lit("")), t)))
    prefixed = lambda name, x: F.transform(x, lambda v: F.concat(F.lit(name), v))
    alone = lambda x: F.array_intersect(x, F.array(*map(F.lit, V.STANDALONE)))
    left = e.select("event", F.explode(F.concat(prefixed("t:", c("tags")), prefixed("h:", c("history")), prefixed("c:", alone(c("concepts"))))).alias("key"))
    right = with_tags.select("question_key", F.explode(F.concat(prefixed("t:", c("q_tags")), prefixed("h:", c("q_history")), prefixed("c:", alone(c("q_concepts"))))).alias("key"))
    pairs = left.join(right, "key").select("event", "question_key").distinct()
    both = pairs.join(e.select("event", "tags", "concepts", "history", "laws"), "event").join(with_tags.select("question_key", "q_text", "law", "q_tags", "q_concepts", "q_history", "q_structured"), "question_key")
    law_hit = F.exists("laws", lambda x: F.contains(F.coalesce(c("law"), F.lit("")), x) | F.contains(c("q_text"), x))
    needs = F.array(*(F.lit(k) for k, _, needed, _ in V.HISTORY if needed))
    both = bound(both, hit=F.array_intersect("tags", "q_tags"), law_hit=law_hit, shared=F.array_intersect("history", "q_history"), common=alone(F.array_intersect("concepts", "q_concepts")))
    both = bound(both, same=F.when(c("law_hit"), c("shared")).otherwise(F.array_except("shared", needs)))
    both = both.where((F.size("hit") > 0) | (F.size("same") > 0) | (F.size("common") > 0))
    firm = F.size(F.array_intersect("same", "q_structured"))
    loose = F.size("same") - firm
    # a tag that says what a shared concept says already, or that is part of a longer one, is no evidence of its own
    aliases_h = {k: a for k, _, _, a in V.HISTORY}
    aliases_c = {k: a for k, _, _, a in V.CONCEPTS}
    covers = lambda t, keys, table: F.exists(keys, lambda k: F.exists(F.create_map(*(x for key, names in table.items() for x in (F.lit(key), F.array(*map(F.lit, names)))))[k], lambda a: F.contains(t, a)))
    own = F.filter("hit", lambda t: ~covers(t, c("same"), aliases_h) & ~covers(t, c("common"), aliases_c) & ~F.exists("hit", lambda o: (o != t) & F.contains(o, t)))
    score = (
        F.least(F.lit(4.0), 2.0 * F.size(own)) + F.least(F.lit(4.0), 3.0 * firm) + F.least(F.lit(1.0), 0.8 * loose)
        + F.least(F.lit(3.0), 2.0 * F.size("common")) + F.when(c("law_hit"), 3.0).otherwise(0.0) + 0.2
    )
    return both.select("event", "question_key", F.round(score, 2).alias("score"), "law_hit")
