"""Orders, ranks and windows: version chains, margins, ranks of the expected, counters, top lists, sorted evidence; and figures of dashboards and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import half_even, percent, qno_number
from tidemark.operators.rules import ladder, names_where
from tidemark.plans.derived import pick, quoted, sql_pick
from tidemark.sources.tables import read


def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article's versions (orders of a customer) in order: the last one is current, the others old, and each ends where the next begins."""
    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    after = F.lead("o_orderdate").over(by)
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(after.isNull(), "current").otherwise("oldver").alias("kind"), F.to_date(after).alias("until"))


def top_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates (lines of an order) by score: the best two, the margin between them, the rank of the expected one, and what that decides."""
    c = F.col
    by = W.partitionBy("l_orderkey").orderBy(F.desc("score"), "l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(c("l_quantity") / 60, 6).alias("score"), (c("l_partkey") % 20).alias("shared")).withColumn("place", F.row_number().over(by))
    one, two = F.when(c("place") == 1, c("score")), F.when(c("place") == 2, c("score"))
    g = rows.groupBy("l_orderkey").agg(F.max(one).alias("top"), F.max(two).alias("second"), F.max(F.when(c("place") == 1, c("shared"))).alias("shared"), F.min(F.when(c("l_linenumber") == 1, c("place"))).alias("expected_rank"), F.max(F.when(c("place") == 1, c("l_linenumber"))).alias("best"))
    margin = F.round(c("top") - F.coalesce("second", F.lit(0.0)), 6)
    route = ladder([((c("top") >= 0.5) & (margin >= 0.15) & (c("shared") >= 12), "very_strong_semantic_separation"), ((c("top") >= 0.16) & (margin >= 0.035) & (c("shared") >= 5), "semantic_candidate_needs_second_signal")], "weak_or_ambiguous_semantics")
    status = ladder([((c("expected_rank") == 1) & (route == "very_strong_semantic_separation"), "historical_semantic_confirmed"), (c("expected_rank") == 1, "historical_semantic_support")], "historical_semantic_conflict")
    return g.select("l_orderkey", margin.alias("margin"), c("expected_rank").cast("long").alias("expected_rank"), route.alias("reason"), status.alias("status"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls (orders) by return flag of their first line: how many are right at the first and among the first three, how many a machine would take wrongly, and whether it may promote."""
    c = F.col
    by = W.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber")
    rows = read(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(by))
    first = c("l_linenumber") == 1
    g = rows.groupBy("l_orderkey").agg(F.max(F.when(first, c("l_returnflag"))).alias("flag"), F.min(F.when(first, c("place"))).alias("rank"), F.max("l_quantity").alias("top"))
    n = g.groupBy("flag").agg(F.count("*").alias("controls"), F.count_if(c("rank") == 1).alias("top1"), F.count_if(c("rank") <= 3).alias("top3"), F.count_if((c("rank") != 1) & (c("top") >= 49.5)).alias("false_machine"))
    return n.withColumn("safe", (c("controls") >= 10) & (10 * c("top1") >= 9 * c("controls")) & (10 * c("top3") >= 9 * c("controls")) & (c("false_machine") == 0))


def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment's review list (orders): by risk, blocked ones first, then subject and number as text; the first ten."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    risk = 5 - F.substring("o_orderpriority", 1, 1).cast("int")
    number = (F.col("o_orderkey") % 40).cast("string")
    by = W.partitionBy("c_mktsegment").orderBy(F.desc(risk), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), "o_orderpriority", number, "o_orderkey")
    return o.withColumn("place", F.row_number().over(by).cast("long")).where("place <= 10").select("c_mktsegment", "place", "o_orderkey")


SUBJECTS = ("MACHINERY", "BUILDING", "FURNITURE", "AUTOMOBILE", "HOUSEHOLD")


def subject_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exam in its subjects' order (segments), then by number; numbers in text count by value, others come last: the first 40 customers of each nation."""
    place = F.array_position(F.array(*map(F.lit, SUBJECTS)), F.col("c_mktsegment"))
    number = F.when(F.col("c_custkey") % 7 == 0, "x").otherwise((F.col("c_custkey") % 40).cast("string"))
    by = W.partitionBy("c_nationkey").orderBy(place, qno_number(number), "c_custkey")
    return read(spark, sf_dir, "customer").withColumn("place", F.row_number().over(by).cast("long")).where("place <= 40").select("c_nationkey", "place", "c_custkey")


def latest_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's last 20 events, newest first, and how many went: a local store that compacts itself."""
    by = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = read(spark, sf_dir, "events").withColumn("place", F.row_number().over(by)).where("place <= 20")
    n = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("all"))
    g = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "event_id"))), lambda x: x["event_id"]).cast("array<string>"), ",").alias("kept"), F.count("*").alias("n"))
    return g.join(n, "user_id").select("user_id", "kept", (F.col("all") - F.col("n")).alias("dropped"))


def gram_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that benchmark items show as evidence: the longest first, then the rarest, then by spelling, eight at most."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-zà-ÿ]+"), lambda x: x != ""))
    w = read(spark, sf_dir, "benchmark").select("item_id", F.explode(words).alias("w"))
    df = w.groupBy("w").agg(F.count("*").alias("df"))
    total = read(spark, sf_dir, "benchmark").agg(F.count("*").alias("n"))
    weighed = w.join(df, "w").join(F.broadcast(total)).select("item_id", "w", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 6).alias("weight"))
    g = weighed.groupBy("item_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.length("w")).alias("l"), (-F.col("weight")).alias("x"), "w"))), 1, 8).alias("g"))
    return g.select("item_id", F.array_join(F.transform("g", lambda x: x["w"]), ",").alias("grams"))


#: Feedback categories by priority.
HIGH, MEDIUM = ("answer_question", "law_outdated"), ("question_display", "explanation_error", "theory_question", "site_bug", "ai_feedback", "suggestion")
REPORTS = ("Answer_Question ", "law_outdated", " site_bug", "SUGGESTION", "other", None)


def feedback_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority of each report (event) by its category: trimmed, cut, in lower case."""
    raw = pick("event_id", REPORTS)
    kind = F.lower(F.substring(F.trim(F.coalesce(raw, F.lit(""))), 1, 60))
    high, medium = kind.isin(*HIGH), kind.isin(*MEDIUM)
    reason = ladder([(kind == "law_outdated", "legal_content_may_be_stale"), (high, "answer_or_grading_may_be_wrong"), (medium, "student_report_requires_product_or_content_review")], "insufficient_deterministic_signal")
    out = read(spark, sf_dir, "events").select("event_id", ladder([(high, "high"), (medium, "medium")], "untriaged").alias("risk"), F.when(high, 0.95).when(medium, 0.8).alias("confidence"), F.when(high | medium, "needs_review").otherwise("pending_triage").alias("action"), reason.alias("reason"))
    return out.groupBy("risk", "confidence", "action", "reason").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


SCORES = ("2", "1", "0", "1.5", "NaN", "true", "3", "-1", "Infinity", "x", None)


def score_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human scores of four dimensions (strings as they came, a set for each part): whole numbers from 0 to 2 only; the total, and whether the case passes."""
    total, errors = F.lit(0), []
    for k, name in enumerate(("fact", "law", "tone", "form")):
        raw = pick("p_partkey", SCORES, 11**k if k < 3 else 7)
        number = raw.try_cast("double")
        fine = F.coalesce(raw.rlike(r"^[0-9.]+$") & ~F.isnan(number) & (number == F.floor(number)) & number.between(0, 2), F.lit(False))
        errors.append(F.when(~fine, F.lit(name)))
        total = total + F.when(fine, number).otherwise(0)
    bad = F.array_compact(F.array(*errors))
    need = F.when(F.col("p_size") > 25, 7).otherwise(5)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(bad, ",").alias("errors"), F.when(F.size(bad) == 0, total.cast("long")).alias("total"), F.coalesce((F.size(bad) == 0) & (total >= need), F.lit(False)).alias("passes"))


def explanation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (conversations' turns) by state, those without explanation, and ready ones without content, which must not be."""
    c = F.col
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))
    return rows.groupBy(c("role").alias("status")).agg(F.count("*").alias("total"), F.count_if("blank").alias("no_explanation"), F.count_if(c("blank") & (c("role") == "assistant")).alias("ready_without_content"), F.min(F.when(c("blank"), c("conv_id"))).alias("first"))


def essay_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essays (documents) by cluster, those without one under a name of their own: how many, with the first one's name, and the share of the largest."""
    cluster = F.coalesce(F.nullif(F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("source")), F.lit("")), F.lit("其他"))
    g = read(spark, sf_dir, "documents").groupBy(cluster.alias("cluster")).agg(F.count("*").alias("n"), F.min_by("lang", "doc_id").alias("name"))
    top = g.agg(F.max("n").alias("most"))  # a row
    return g.join(F.broadcast(top)).select("cluster", "n", "name", percent(F.col("n"), F.col("most")).alias("pct"))


def law_essay_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essays (parts) for a law: 12 where they name it, 7 for its short name, and one for each of its keywords; those of two points and more."""
    named = pick("p_partkey", ("社會救助法", "社會救助施行要點", "老人福利法", "社會救助"))
    text = F.concat_ws(" ", "p_name", named, pick("p_partkey", ("最低生活費", "低收入戶", "長照", ""), 4))
    score = F.when(F.contains(named, F.lit("社會救助法")), 12).when(F.contains(named, F.lit("社會救助")), 7).otherwise(0)
    for k in ("最低生活費", "低收入戶", "救助"):  # "救助" is too short to count
        score = score + (F.lit(len(k) >= 3) & F.contains(text, F.lit(k))).cast("int")
    return read(spark, sf_dir, "part").select("p_partkey", score.cast("long").alias("score")).where("score >= 2")


def shadow_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correction tried on customers without writing: rows, touched ones, whether the old and new texts are as proposed, fields that must not change, and the verdict; one row."""
    c = F.col
    old = read(spark, sf_dir, "customer").select("c_custkey", F.create_map(F.lit("name"), c("c_name"), F.lit("segment"), c("c_mktsegment"), F.lit("balance"), c("c_acctbal").cast("string"), F.lit("status"), F.lit("ready")).alias("old"))
    patch = read(spark, sf_dir, "customer").where("c_acctbal < -500").select("c_custkey", c("c_mktsegment").alias("before"), F.lower("c_mktsegment").alias("after"))
    merged = F.map_zip_with("old", F.create_map(F.lit("segment"), c("after"), F.lit("status"), F.lit("review")), lambda _, a, b: F.coalesce(b, a))
    s = old.join(patch, "c_custkey", "left").withColumn("new", F.when(c("before").isNull(), c("old")).otherwise(merged))
    moved = F.filter(F.map_keys("old"), lambda k: ~F.try_element_at("old", k).eqNullSafe(F.try_element_at("new", k)) & ~k.isin("segment", "status"))
    g = s.agg(
        F.count("*").alias("rows"), F.count("before").alias("affected"), F.bool_and(c("before").isNull() | (c("old")["segment"] == c("before"))).alias("exact_before"), F.bool_and(c("before").isNull() | (c("new")["segment"] == c("after"))).alias("exact_after"),
        F.sum(F.size(moved)).alias("forbidden"), F.count_if(c("before").isNull() & (F.to_json("old") == F.to_json("new"))).alias("untouched"), F.count_if(c("new")["status"] == "review").alias("would_be_review"),
    )
    good = c("exact_before") & c("exact_after") & (c("forbidden") == 0) & (c("untouched") + c("affected") == c("rows")) & (c("would_be_review") == c("affected"))
    return g.withColumn("status", F.when(good, "PASS_READONLY_SHADOW_ONLY").otherwise("BLOCKED"))


def first_hit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets (nations' customers) in a first index (suppliers), else in a second one (parts): where they are found, and whether the record is who it says it is."""
    c = F.col
    t = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Supplier#"), c("c_custkey").cast("string")).alias("name"))
    a = read(spark, sf_dir, "supplier").select(c("s_suppkey").alias("c_custkey"), F.concat(F.lit("Supplier#"), F.when(c("s_suppkey") % 4 == 0, c("s_suppkey") + 1).otherwise(c("s_suppkey")).cast("string")).alias("law"), F.lit("law").alias("in_a"))
    b = read(spark, sf_dir, "part").select(c("p_partkey").alias("c_custkey"), F.concat(F.lit("Supplier#"), c("p_partkey").cast("string")).alias("order"), F.lit("order").alias("in_b"))
    j = t.join(a, "c_custkey", "left").join(b, "c_custkey", "left")
    where, name = F.coalesce("in_a", "in_b"), F.when(c("in_a").isNotNull(), c("law")).otherwise(c("order"))
    return j.select("c_custkey", where.alias("collection"), ladder([(where.isNull(), "not_found"), (name == c("name"), "ready")], "invalid_record").alias("status"))


def masked_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What students see of a question (part): explanation fields of official rows stay blank until they are ready; long texts are cut by code points."""
    c = F.col
    official = c("p_partkey") % 3 != 0
    ready = F.lower(F.trim(pick("p_partkey", ("ready", " Ready", "review", "")))) == "ready"
    mask = official & ~ready
    show = lambda x, n: F.when(mask, "").otherwise(F.substring(x, 1, n))
    return read(spark, sf_dir, "part").select("p_partkey", show(c("p_name"), 8).alias("topic"), show(F.concat("p_type", F.lit("…é")), 20).alias("law"), F.substring("p_name", 1, 12).alias("stem"), mask.alias("masked"))


def visible_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related rows of each order (its lines by score) that are strong enough to show, best first, eight at most; weak ones stay out of lists and counts."""
    c = F.col
    score = F.round(c("l_quantity") / 10, 2)
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct((-score).alias("s"), "l_linenumber"))).alias("m"))
    seen = F.filter("m", lambda x: x["s"] <= -2.0)
    return g.select("l_orderkey", F.size(seen).cast("long").alias("n"), F.array_join(F.transform(F.slice(seen, 1, 8), lambda x: x["l_linenumber"]).cast("array<string>"), ",").alias("lines"))


def publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that may be published: not those of a narrow source off its topic, nor those in a category by age words alone."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    scope = {"web": ("the", "der", "le", "que"), "books": ("and", "und", "et", "y")}
    on_topic = F.lit(True)
    for source, terms in scope.items():
        on_topic = on_topic & ((F.col("source") != source) | text.rlike(r"(^|[^\p{L}])(" + "|".join(terms) + r")([^\p{L}]|$)"))
    strong, harm, system = text.contains("thand"), text.contains("idiot"), text.contains("tion")
    fine = on_topic & ((F.col("lang") != "en") | strong | (harm & system))
    return read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.coalesce(fine, F.lit(False))).alias("publishable"))


def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows (events, in file order) by id: the last one wins; overlays (labels) apply, and those without a row are an error of their own."""
    c = F.col
    last = read(spark, sf_dir, "events").groupBy(c("user_id").alias("id")).agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("r"), F.count("*").alias("n"))
    over = read(spark, sf_dir, "labels").select(c("doc_id").alias("id"), "quality")
    j = last.join(over.withColumn("there", F.lit(True)), "id", "full_outer")
    return j.select("id", "r.event_type", half_even(F.coalesce(F.when(c("there"), c("quality").cast("double")), c("r.value")), 3).alias("value"), F.coalesce("n", F.lit(0)).cast("long").alias("seen"), c("n").isNull().alias("orphan"))


def health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local against remote counts by segment (customers, and their orders' customers) and against a profile: what differs."""
    c = F.col
    local = read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("local"))
    o = read(spark, sf_dir, "orders").select(c("o_custkey").alias("c_custkey")).distinct()
    remote = read(spark, sf_dir, "customer").join(o, "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("remote"))
    profile = spark.sql("values " + ", ".join(f"({quoted(s)})" for s in (*SUBJECTS[:4], "UNKNOWN")) + " as profile(c_mktsegment)").withColumn("expected", F.lit(True))
    j = local.join(remote, "c_mktsegment", "full_outer").join(profile, "c_mktsegment", "full_outer")
    wrong = {"not_in_profile": c("expected").isNull(), "not_in_data": c("local").isNull(), "counts_differ": ~c("local").eqNullSafe(c("remote"))}
    return j.select(c("c_mktsegment").alias("subject"), F.coalesce("local", F.lit(0)).cast("long").alias("local"), F.coalesce("remote", F.lit(0)).cast("long").alias("remote"), F.array_join(names_where(wrong), ",").alias("problems"))


HISTORY = ("", "3", "3,4", "all", "5")


def provenance_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exam questions (orders) against the history of their article (other orders of the customer): may the current text stand for the exam's? First by year, then by the exam's days.

    The order of the tests matters: no article, no history, none that touches it, special dates, later changes, changes in the exam's year.
    """
    c = F.col
    q = read(spark, sf_dir, "orders").select(c("o_orderkey").alias("q"), c("o_custkey").alias("k"), F.to_date("o_orderdate").alias("start"), F.when(c("o_orderkey") % 11 != 0, (c("o_orderkey") % 3 + 3).cast("string")).alias("article"), (c("o_orderkey") % 13 != 0).alias("dated"))
    h = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(c("o_custkey").alias("k"), F.to_date("o_orderdate").alias("at"), pick("o_orderkey", HISTORY, 2).alias("articles"), (c("o_orderkey") % 17 == 0).alias("special"))
    history = h.groupBy("k").agg(F.collect_list(F.struct("at", F.split("articles", ",").alias("articles"), "special")).alias("h"))  # a law's amendments are few
    j = q.join(history, "k", "left").withColumn("h", F.coalesce("h", F.array().cast("array<struct<at:date,articles:array<string>,special:boolean>>")))
    j = j.withColumn("r", F.filter("h", lambda x: F.array_contains(x["articles"], c("article")) | F.array_contains(x["articles"], "all")))
    year, end = F.year("start"), F.date_add("start", 1)
    same = F.filter("r", lambda x: F.year(x["at"]) == year)
    one = ladder(
        [
            (c("article").isNull(), "article_resolution_required"), (F.size("h") == 0, "official_history_unavailable"), (F.size("r") == 0, "article_origin_review"), (F.exists("r", lambda x: x["special"]), "effective_date_review"),
            (F.exists("r", lambda x: F.year(x["at"]) > year), "historical_text_required"), (F.size(same) > 0, "exam_date_required"),
        ],
        "current_text_equals_exam_year_candidate",
    )
    by_day = ladder([(F.exists(same, lambda x: (x["at"] >= c("start")) & (x["at"] <= end)), "exam_day_resolution_required"), (F.exists(same, lambda x: x["at"] > end), "historical_text_required")], "current_text_equals_exam_date_candidate")
    two = ladder([(~c("dated"), "exam_date_unresolved"), (one == "current_text_equals_exam_year_candidate", "current_text_equals_exam_date_candidate")], None)
    return j.select("q", one.alias("stage1"), F.coalesce(two, F.when(one == "exam_date_required", by_day), one).alias("stage2"))


QUERIES = {
    f.__name__: f
    for f in (
        version_chain, top_margin, calibration, review_order, subject_order, latest_kept, gram_evidence, feedback_priority, score_checks, explanation_guard, essay_clusters, law_essay_score, shadow_patch, first_hit_lookup,
        masked_analysis, visible_matches, publishable, payload_rows, health_counts, provenance_stages,
    )
}

KIND = f"lower(left(trim(coalesce({sql_pick('event_id', REPORTS)}, '')), 60))"


def _score(k: int) -> str:
    return sql_pick("p_partkey", SCORES, 11**k if k < 3 else 7)


FINE = "coalesce(regexp_matches({x}, '^[0-9.]+$') and try_cast({x} as double) = floor(try_cast({x} as double)) and try_cast({x} as double) between 0 and 2, false)"
STAGE = """case when article is null then 'article_resolution_required' when n = 0 then 'official_history_unavailable' when r = 0 then 'article_origin_review' when sp > 0 then 'effective_date_review' when later > 0 then 'historical_text_required' when same > 0 then 'exam_date_required' else 'current_text_equals_exam_year_candidate' end"""
ORACLE = {
    "version_chain": "select o_custkey, o_orderkey, case when lead(o_orderdate) over w is null then 'current' else 'oldver' end kind, cast(lead(o_orderdate) over w as date) until from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)",
    "top_margin": """with r as (select l_orderkey, l_linenumber, round(l_quantity::double / 60, 6) score, l_partkey % 20 shared from lineitem), p as (select *, row_number() over (partition by l_orderkey order by score desc, l_linenumber) place from r),
 g as (select l_orderkey, max(score) filter (where place = 1) top, max(score) filter (where place = 2) snd, max(shared) filter (where place = 1) shared, min(place) filter (where l_linenumber = 1) rank from p group by 1), m as (select *, round(top - coalesce(snd, 0), 6) margin from g),
 s as (select *, case when top >= 0.5 and margin >= 0.15 and shared >= 12 then 'very_strong_semantic_separation' when top >= 0.16 and margin >= 0.035 and shared >= 5 then 'semantic_candidate_needs_second_signal' else 'weak_or_ambiguous_semantics' end reason from m)
 select l_orderkey, margin, rank expected_rank, reason, case when rank = 1 and reason = 'very_strong_semantic_separation' then 'historical_semantic_confirmed' when rank = 1 then 'historical_semantic_support' else 'historical_semantic_conflict' end status from s""",
    "calibration": """with p as (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber) place from lineitem), g as (select l_orderkey, max(l_returnflag) filter (where l_linenumber = 1) flag, min(place) filter (where l_linenumber = 1) rank, max(l_quantity) top from p group by 1),
 n as (select flag, count(*) controls, count(*) filter (where rank = 1) top1, count(*) filter (where rank <= 3) top3, count(*) filter (where rank <> 1 and top >= 49.5) false_machine from g group by 1) select *, controls >= 10 and 10 * top1 >= 9 * controls and 10 * top3 >= 9 * controls and false_machine = 0 safe from n""",
    "review_order": """select c_mktsegment, place, o_orderkey from (select c_mktsegment, o_orderkey, row_number() over (partition by c_mktsegment order by 5 - cast(left(o_orderpriority, 1) as integer) desc, case when o_orderstatus = 'F' then 0 else 1 end, o_orderpriority, cast(o_orderkey % 40 as varchar), o_orderkey) place from orders join customer on c_custkey = o_custkey) where place <= 10""",
    "subject_order": f"""select c_nationkey, place, c_custkey from (select *, row_number() over (partition by c_nationkey order by list_position({list(SUBJECTS)}, c_mktsegment), case when c_custkey % 7 = 0 then 999999 else c_custkey % 40 end, c_custkey) place from customer) where place <= 40""",
    "latest_kept": "with p as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) place from events) select user_id, string_agg(cast(event_id as varchar), ',' order by place) filter (where place <= 20) kept, count(*) filter (where place > 20) dropped from p group by 1",
    "gram_evidence": """with w as (select item_id, unnest(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-zà-ÿ]+'), lambda x: x <> ''))) w from benchmark), d as (select w, count(*) df from w group by 1),
 r as (select item_id, w.w, row_number() over (partition by item_id order by length(w.w) desc, round(ln(((select count(*) from benchmark) + 1)::double / (df + 1)) + 1, 6) desc, w.w) place from w join d on d.w = w.w) select item_id, string_agg(w, ',' order by place) grams from r where place <= 8 group by 1""",
    "feedback_priority": f"""with k as (select event_id, {KIND} k from events), p as (select event_id, case when k in {HIGH} then 'high' when k in {MEDIUM} then 'medium' else 'untriaged' end risk, case when k in {HIGH} then 0.95::double when k in {MEDIUM} then 0.8::double end confidence, case when k in {HIGH} or k in {MEDIUM} then 'needs_review' else 'pending_triage' end as action,
 case when k = 'law_outdated' then 'legal_content_may_be_stale' when k in {HIGH} then 'answer_or_grading_may_be_wrong' when k in {MEDIUM} then 'student_report_requires_product_or_content_review' else 'insufficient_deterministic_signal' end reason from k) select risk, confidence, action, reason, count(*) n, min(event_id) as first from p group by 1, 2, 3, 4""",
    "score_checks": f"""with s as (select p_partkey, p_size, {', '.join(f'{FINE.format(x=_score(k))} f{k}' for k in range(4))}, {', '.join(f'try_cast({_score(k)} as double) v{k}' for k in range(4))} from part)
 select p_partkey, concat_ws(',', {', '.join(f"case when not f{k} then '{n}' end" for k, n in enumerate(('fact', 'law', 'tone', 'form')))}) errors, case when f0 and f1 and f2 and f3 then cast(v0 + v1 + v2 + v3 as bigint) end total,
 case when f0 and f1 and f2 and f3 then v0 + v1 + v2 + v3 >= case when p_size > 25 then 7 else 5 end else false end passes from s""",
    "explanation_guard": "select role status, count(*) total, count(*) filter (where trim(coalesce(text, '')) = '') no_explanation, count(*) filter (where trim(coalesce(text, '')) = '' and role = 'assistant') ready_without_content, min(conv_id) filter (where trim(coalesce(text, '')) = '') as first from conversations group by 1",
    "essay_clusters": "with g as (select coalesce(nullif(case when doc_id % 9 = 0 then '' else source end, ''), '其他') cluster, count(*) n, arg_min(lang, doc_id) as name from documents group by 1) select cluster, n, name, cast(floor(100.0::double * n / (select max(n) from g) + 0.5) as bigint) pct from g",
    "law_essay_score": f"""with s as (select p_partkey, p_name || ' ' || {sql_pick('p_partkey', ('社會救助法', '社會救助施行要點', '老人福利法', '社會救助'))} || ' ' || {sql_pick('p_partkey', ('最低生活費', '低收入戶', '長照', ''), 4)} t, {sql_pick('p_partkey', ('社會救助法', '社會救助施行要點', '老人福利法', '社會救助'))} n from part)
 select * from (select p_partkey, cast(case when contains(n, '社會救助法') then 12 when contains(n, '社會救助') then 7 else 0 end + contains(t, '最低生活費')::int + contains(t, '低收入戶')::int as bigint) score from s) where score >= 2""",
    "shadow_patch": "with a as (select count(*) n, count(*) filter (where c_acctbal < -500) k from customer) select n as rows, k affected, true exact_before, true exact_after, cast(0 as bigint) forbidden, n - k untouched, k would_be_review, 'PASS_READONLY_SHADOW_ONLY' status from a",
    "first_hit_lookup": """select c_custkey, case when s_suppkey is not null then 'law' when p_partkey is not null then 'order' end collection, case when s_suppkey is null and p_partkey is null then 'not_found' when s_suppkey is not null and s_suppkey % 4 = 0 then 'invalid_record' else 'ready' end status from customer left join supplier on s_suppkey = c_custkey left join part on p_partkey = c_custkey""",
    "masked_analysis": f"""with m as (select *, p_partkey % 3 <> 0 and lower(trim({sql_pick('p_partkey', ('ready', ' Ready', 'review', ''))})) <> 'ready' mask from part) select p_partkey, case when mask then '' else substr(p_name, 1, 8) end topic, case when mask then '' else substr(p_type || '…é', 1, 20) end law, substr(p_name, 1, 12) stem, mask masked from m""",
    "visible_matches": """with s as (select l_orderkey, l_linenumber, round(l_quantity::double / 10, 2) score from lineitem), r as (select *, row_number() over (partition by l_orderkey order by score desc, l_linenumber) place from s where score >= 2.0),
 g as (select l_orderkey, count(*) n, string_agg(cast(l_linenumber as varchar), ',' order by place) filter (where place <= 8) lines from r group by 1) select o.l_orderkey, coalesce(n, 0) n, coalesce(lines, '') lines from (select distinct l_orderkey from lineitem) o left join g on g.l_orderkey = o.l_orderkey""",
    "publishable": r"""with t as (select lang, source, lower(coalesce(text, '')) x from documents) select lang, source, count(*) n, count(*) filter (where (source <> 'web' or regexp_matches(x, '(^|[^\pL])(the|der|le|que)([^\pL]|$)')) and (source <> 'books' or regexp_matches(x, '(^|[^\pL])(and|und|et|y)([^\pL]|$)')) and (lang <> 'en' or contains(x, 'thand') or (contains(x, 'idiot') and contains(x, 'tion')))) publishable from t group by 1, 2""",
    "payload_rows": """with l as (select user_id id, event_type, value, count(*) over (partition by user_id) n, row_number() over (partition by user_id order by ts desc, event_id desc) k from events), r as (select * from l where k = 1)
 select coalesce(r.id, b.doc_id) id, event_type, round_even(coalesce(b.quality::double, value), 3) as value, coalesce(n, 0) seen, n is null orphan from r full join labels b on b.doc_id = r.id""",
    "health_counts": f"""with l as (select c_mktsegment s, count(*) n from customer group by 1), r as (select c_mktsegment s, count(*) n from customer where c_custkey in (select o_custkey from orders) group by 1), p(s) as (values {', '.join(f'({quoted(s)})' for s in (*SUBJECTS[:4], 'UNKNOWN'))}), a as (select s from l union select s from p)
 select a.s subject, coalesce(l.n, 0) as local, coalesce(r.n, 0) remote, concat_ws(',', case when p.s is null then 'not_in_profile' end, case when l.s is null then 'not_in_data' end, case when l.n is distinct from r.n then 'counts_differ' end) problems from a left join l on l.s = a.s left join r on r.s = a.s left join p on p.s = a.s""",
    "provenance_stages": f"""with q as (select o_orderkey q, o_custkey k, cast(o_orderdate as date) d, case when o_orderkey % 11 <> 0 then cast(o_orderkey % 3 + 3 as varchar) end article, o_orderkey % 13 <> 0 dated from orders),
 h as (select o_custkey k, cast(o_orderdate as date) at_day, string_split({sql_pick('o_orderkey', HISTORY, 2)}, ',') arts, o_orderkey % 17 = 0 special from orders where o_orderstatus <> 'P'),
 j as (select q, any_value(article) article, any_value(dated) dated, count(h.k) n, count(*) filter (where t) r, count(*) filter (where t and special) sp, count(*) filter (where t and year(at_day) > year(d)) later, count(*) filter (where t and year(at_day) = year(d)) same, count(*) filter (where t and year(at_day) = year(d) and at_day between d and d + 1) on_day, count(*) filter (where t and year(at_day) = year(d) and at_day > d + 1) after_day
  from (select q.*, h.k hk, at_day, special, coalesce(list_contains(arts, article) or list_contains(arts, 'all'), false) t from q left join h on h.k = q.k) x left join (select distinct k from h) h on h.k = x.hk group by 1)
 select q, {STAGE} stage1, case when not dated then 'exam_date_unresolved' when {STAGE} = 'current_text_equals_exam_year_candidate' then 'current_text_equals_exam_date_candidate' when {STAGE} = 'exam_date_required' then case when on_day > 0 then 'exam_day_resolution_required' when after_day > 0 then 'historical_text_required' else 'current_text_equals_exam_date_candidate' end else {STAGE} end stage2 from j""",
}
