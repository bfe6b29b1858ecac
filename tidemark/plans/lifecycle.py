"""Sinks and state: upserts that keep what people own, import guards, change rules, queue and quota, reviews, registries, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import bound, utc
from tidemark.operators.relations import drift, numbered
from tidemark.operators.rules import ladder, names_where
from tidemark.plans.derived import pick, quoted, sql_pick
from tidemark.plans.exams import MCQS, READY, _names_sql, law_names, mcqs
from tidemark.sources.tables import read

NOW = "2024-03-01"
#: Days after which a candidate is archived, rows of a write batch.
ARCHIVE_DAYS, BATCH = 548, 100


def upsert_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned items (documents) upserted onto the reviewed ones (labels): what people own stays, the rest is new; then candidates over 548 days old are archived."""
    new = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.date_sub(F.lit(NOW).cast("date"), (F.col("doc_id") % 900).cast("int")).alias("published_at"))
    label = read(spark, sf_dir, "labels")
    old = label.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "published").when(F.col("quality") == 0, "candidate").alias("old_status"), F.when(F.col("toxic") == 1, "toxic").alias("note"), F.lit("2023-12-31").cast("date").alias("seen"))
    both = new.join(old, "id", "left")
    status, at = F.coalesce(F.nullif("old_status", F.lit("")), F.lit("candidate")), F.col("published_at")
    archived = (status == "candidate") & (at < F.date_sub(F.lit(NOW).cast("date"), ARCHIVE_DAYS))
    return both.select("id", F.when(archived, "archived").otherwise(status).alias("status"), F.nullif("note", F.lit("")).alias("manual_note"), F.coalesce("seen", F.lit(NOW).cast("date")).alias("first_seen_at"), F.lit(NOW).cast("date").alias("last_seen_at"))


def upsert_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One heartbeat for each task: a message replaces the stored one only if it is newer, so messages may come in any order and twice."""
    e = read(spark, sf_dir, "events")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    row = F.struct("ts", (-F.col("event_id")).alias("first"), "event_type")  # of equal times the stored or earlier message stays
    g = e.groupBy("user_id").agg(F.max(F.when(F.col("ts") < half, row)).alias("old"), F.max(F.when(F.col("ts") >= half, row)).alias("new"))
    newer = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new.ts") > F.col("old.ts")))
    best = F.when(newer, F.col("new")).otherwise(F.col("old"))
    return g.select("user_id", best["ts"].alias("scheduled_at"), best["event_type"].alias("payload"), (newer & F.col("old").isNotNull()).alias("replaced"))


CORRECTIONS = (("1-URGENT", "O", "P"), ("2-HIGH", "O", "F"), ("5-LOW", "F", "P"))


def update_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections (a fixed list) applied to orders of that priority and state; the changed rows come back with both values."""
    fix = spark.sql("values " + ", ".join(f"({quoted(p)}, {quoted(a)}, {quoted(b)})" for p, a, b in CORRECTIONS) + " as fix(o_orderpriority, o_orderstatus, new_status)")
    return read(spark, sf_dir, "orders").join(F.broadcast(fix), ["o_orderpriority", "o_orderstatus"]).select("o_orderkey", F.col("o_orderstatus").alias("old_status"), "new_status")


def sync_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (days) with a marker before and after: complete if nothing failed. Readers see the rows of the last complete run only; each run leaves an audit row."""
    e = read(spark, sf_dir, "events").withColumn("run", F.to_date("ts"))
    g = e.groupBy("run").agg(F.count("*").alias("fetched"), F.count_if(F.col("event_type") != "view").alias("accepted"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 95)).alias("errors"))
    g = g.withColumns({"status": F.when(F.col("errors") == 0, "complete").otherwise("failed"), "note": F.format_string("feeds=%d errors", F.col("errors"))})
    last = g.where("status = 'complete'").agg(F.max("run").alias("visible"))
    return g.join(F.broadcast(last)).select("run", "fetched", "accepted", "status", "note", F.coalesce(F.col("run") == F.col("visible"), F.lit(False)).alias("visible"))


IDENTITY = ("code", "year", "round", "subject", "qno")
KEPT = ("topic", "why", "tags")


def _imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Incoming rows (customers) and the stored ones (those of older keys), with an identity that drifts here and there."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    identity = lambda shift: (F.concat(F.lit("code"), (k % 3).cast("string")).alias("code"), (F.lit(100) + (k + shift) % 5).cast("string").alias("year"), pick("c_custkey", ("第一次", "第二次")).alias("round"), F.col("c_mktsegment").alias("subject"), (k % 40 + 1).cast("string").alias("qno"))
    fields = lambda a, b, tags: (a.alias("topic"), b.alias("why"), tags.alias("tags"))
    new = c.select(k.alias("id"), *identity(0), *fields(F.lit("new topic"), F.lit("new why"), F.array(F.lit("n"))))
    tags = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("o"), F.lit("p")))
    old = c.where("c_acctbal > 0").select(k.alias("id"), *identity(F.when(k % 401 == 0, 1).otherwise(0)), *fields(pick("c_custkey", ("old", "", None)), pick("c_custkey", (None, "why", "")), tags))
    return new, old


IMPORTS = f"""incoming as (select c_custkey id, 'code' || cast(c_custkey % 3 as varchar) code, cast(100 + c_custkey % 5 as varchar) as year, {sql_pick('c_custkey', ('第一次', '第二次'))} as round, c_mktsegment subject, cast(c_custkey % 40 + 1 as varchar) qno, 'new topic' topic, 'new why' why, ['n'] tags from customer),
 stored as (select c_custkey id, 'code' || cast(c_custkey % 3 as varchar) code, cast(100 + (c_custkey + case when c_custkey % 401 = 0 then 1 else 0 end) % 5 as varchar) as year, {sql_pick('c_custkey', ('第一次', '第二次'))} as round, c_mktsegment subject, cast(c_custkey % 40 + 1 as varchar) qno,
 {sql_pick('c_custkey', ('old', '', None))} topic, {sql_pick('c_custkey', (None, 'why', ''))} why, case when c_custkey % 4 = 0 then [] when c_custkey % 4 = 1 then ['o', 'p'] end tags from customer where c_acctbal > 0)"""


def identity_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows of another identity under an incoming id, with the fields that differ. One such row stops the whole import before it writes."""
    new, old = _imports(spark, sf_dir)
    return drift(old, new, "id", IDENTITY).where("state = 'changed'").select("id", F.array_join("changed", ",").alias("changed"))


def merge_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows without collision, with what the stored row has already kept field by field (not null, not empty), in write batches of 100."""
    new, old = _imports(spark, sf_dir)
    o = old.select("id", F.struct(*IDENTITY).alias("who"), F.struct(*KEPT).alias("old"))
    both = new.join(o, "id", "left").where(F.col("who").isNull() | F.col("who").eqNullSafe(F.struct(*IDENTITY)))
    there = {"topic": F.col("old.topic") != "", "why": F.col("old.why") != "", "tags": F.size("old.tags") > 0}
    merged = both.select("id", *(F.when(F.coalesce(x, F.lit(False)), F.col("old")[n]).otherwise(F.col(n)).alias(n) for n, x in there.items()))
    placed = numbered(merged, "id")
    return placed.select("id", "topic", "why", F.array_join("tags", ",").alias("tags"), F.floor((F.col("place") - 1) / BATCH).cast("long").alias("batch"))


#: Comments on answers that must not be published.
FORBIDDEN = "(題庫答案|題庫正解|答案待查|答案有瑕疵|官方答案|本題官方|官方正確|官方全體給分|建議.{0,12}(查|複查).{0,12}答案|已核對答案|選項判定有爭議)"
CORE = ("question", "opt_a", "opt_b", "opt_c", "opt_d", "answer", "accepted", "grading_mode")
EDITS = ("", " 官方答案有誤", "", " 建議再複查一次本題答案", "")


def change_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of questions under the rules of a change: a changed core resets the analysis, comments on answers are refused, laws without support go, times follow the status.

    The new row is the old one with an edit to the question, the status and the explanation.
    """
    c, i = F.col, F.col("row")
    rows = mcqs(spark, sf_dir).withColumn("law", F.nullif("law", F.lit("")))
    edited = F.when(i % 7 == 0, F.concat(c("question"), F.lit("?"))).otherwise(c("question"))
    modes = F.when(i % 11 == 0, "any_answer").otherwise(c("grading_mode"))
    rows = bound(rows, new_question=edited, new_mode=modes, new_status=pick("row", ("ready", "ready", "pending", "review"), 3), new_why=F.concat(F.coalesce("exp_why", F.lit("")), pick("row", EDITS, 2)))
    core = (c("source_exam_code") != "") & (~c("new_question").eqNullSafe(c("question")) | ~c("new_mode").eqNullSafe(c("grading_mode")))
    rows = bound(rows, core=core, refused=(c("new_status") == "ready") & F.concat_ws(" ", "new_why", "exp_others", "law").rlike("(?i)" + FORBIDDEN))
    rows = bound(rows, status=F.when(c("core"), "pending").otherwise(c("new_status")), attempts=F.when(c("core"), 0).otherwise(i % 4).cast("long"))
    source = law_names(F.concat_ws(" ", "new_question", "opt_a", "opt_b", "opt_c", "opt_d"))
    kept = F.when(~c("core"), c("law"))
    rows = bound(rows, source=source, kept=kept, named=law_names(F.coalesce(kept, F.lit(""))))
    legal = F.lower(c("legal_status"))
    drop = (c("status") == "ready") & c("kept").isNotNull() & ~legal.isin("verified_current", "changed") & ((F.size("named") == 0) | (F.size(F.array_except("named", "source")) > 0))
    rows = bound(rows, final=F.when(~drop, c("kept")))
    names = F.array_distinct(F.concat(c("source"), F.when(c("final").isNotNull(), c("named")).otherwise(F.array().cast("array<string>"))))
    old_ready, now_ready = F.lower(c("analysis_status")).isin(*READY), c("status").isin(*READY)
    completed = ladder([(c("core"), "cleared"), (now_ready & ~old_ready, "set"), (~now_ready & old_ready, "cleared")], "kept")
    return rows.select("row", c("core").alias("reset"), "refused", "status", "attempts", c("final").alias("law"), F.array_join(F.array_sort(names), ",").alias("names"), completed.alias("completed"))


#: Failures that leave the attempts as they are, attempts until a review, rows a day after which nothing is claimed.
TRANSIENT, ATTEMPTS, DAILY, STALE = "(?i)HTTP 429|rate limit|fetch failed|network|timed? *out|temporar", 3, 25, "15 minutes"
ERRORS = ("HTTP 429 too many", "bad JSON", "Network down", "request timed out", "missing option", "temporary failure")


def attempt_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each failed row (order): a transient failure costs no attempt, the third other one goes to review."""
    message, used = pick("o_orderkey", ERRORS, 3), F.col("o_orderkey") % 4
    transient = message.rlike(TRANSIENT)
    attempts = F.when(transient, used).otherwise(used + 1)
    return read(spark, sf_dir, "orders").select("o_orderkey", transient.alias("transient"), attempts.cast("long").alias("attempts"), F.when(transient, "pending").when(attempts >= ATTEMPTS, "review").otherwise("pending").alias("status"))


def queue_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that the next claim gets in each queue (ship mode of lines), none where 25 were completed in a day; what is left, and whether the queue stops.

    Rows are open if pending, or under analysis for over 15 minutes, and tried less than three times.
    """
    c = F.col
    now, started = F.lit("1998-08-01 12:00:00").cast("timestamp_ntz"), F.col("l_shipdate")
    rows = read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 7).alias("queue"), "l_orderkey", "l_linenumber", F.element_at(F.array(*map(F.lit, ("pending", "analyzing", "ready", "review"))), (F.col("l_partkey") % 4 + 1).cast("int")).alias("status"),
        (F.col("l_orderkey") % 5).alias("attempts"), F.when(F.col("l_linenumber") % 2 == 0, started).alias("last"), started.alias("started"),
    )
    open_ = ((c("status") == "pending") | ((c("status") == "analyzing") & (c("started") < now - F.expr(f"interval {STALE}")))) & (c("attempts") < ATTEMPTS)
    key = F.struct(c("last").isNotNull().alias("tried"), "last", "l_linenumber", "l_orderkey")  # never tried first, then the oldest try
    g = rows.groupBy("queue").agg(
        F.count_if((c("status") == "ready") & (c("started") >= now - F.expr("interval 24 hours"))).alias("done"), F.min(F.when(open_, key)).alias("next"), F.count_if(open_).alias("remaining"), F.count_if(c("status") == "review").alias("review")
    )
    claim = F.when(c("done") < DAILY, c("next"))
    return g.select("queue", "done", claim["l_orderkey"].alias("order"), claim["l_linenumber"].alias("line"), "remaining", "review", (c("remaining") == 0).alias("stop"))


CLIENT, WHOLE = {"text": 3, "photo": 1}, {"text": 400, "photo": 90}


def quota_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against a client's and the whole day's quota: accepted, or refused by which. What the whole day refuses is given back to the client.

    Accepted are the first requests of each client, of these the first of the day. Only so many of a day leave each task.
    """
    c = F.col
    day, order = F.to_date(F.from_utc_timestamp(utc(c("ts")), "Asia/Taipei")), ["ts", "event_id"]
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", day.alias("day"), F.when(c("event_type") == "purchase", "photo").otherwise("text").alias("kind"))
    out = []
    for kind in ("text", "photo"):
        rows = e.where(c("kind") == kind)
        own = rows.withColumn("own", F.row_number().over(W.partitionBy("day", "user_id").orderBy(*order))).where(c("own") <= CLIENT[kind])
        first = own.withColumn("place", F.row_number().over(W.partitionBy("day").orderBy(*order))).where(c("place") <= WHOLE[kind])
        taken = first.groupBy("day", "user_id").agg(F.count("*").alias("taken"))
        judged = rows.join(first.select("event_id", F.lit(True).alias("ok")), "event_id", "left").join(taken, ["day", "user_id"], "left")
        out.append(judged.select("event_id", "kind", ladder([(c("ok").isNotNull(), "accepted"), (c("taken") >= CLIENT[kind], "client")], "global").alias("result")))
    return out[0].unionByName(out[1])


LANES = ("machine_verified", "ai_review", "history_unresolved", "human_review")
SKIPPED = ("machine_verified",)


def _item_id(ref: Column, lane: Column) -> Column:
    return F.concat(F.lit("historical-law:"), F.substring(F.sha2(F.concat_ws("|", ref, lane), 256), 1, 16))


def review_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with reviews (open ones of older orders) after a new routing of all orders: upsert, resolve, supersede, or leave alone what the routing no longer lists."""
    c = F.col
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("ref"), "o_orderkey", "o_orderstatus")
    current = o.where("o_orderstatus <> 'P'").select("ref", pick("o_orderkey", LANES).alias("lane")).withColumn("id", _item_id(c("ref"), c("lane")))
    open_ = o.where("o_orderstatus <> 'O'").select("ref", pick("o_orderkey", LANES[1:]).alias("was")).withColumn("open_id", _item_id(c("ref"), c("was")))
    upserts = current.where(~c("lane").isin(*SKIPPED)).select(c("id").alias("item_id"), "ref", F.lit("review_upsert").alias("action"), F.lit(None).cast("string").alias("final_state"))
    both = open_.join(current, "ref", "left")
    action = ladder([(c("lane").isNull(), "untouched"), (c("lane").isin(*SKIPPED), "review_resolve"), (c("id") != c("open_id"), "review_resolve")], None)
    state = ladder([(c("lane").isNull(), None), (c("lane").isin(*SKIPPED), "resolved"), (c("id") != c("open_id"), "superseded")], None)
    return upserts.unionByName(both.select(c("open_id").alias("item_id"), "ref", action.alias("action"), state.alias("final_state")).where("action is not null"))


def review_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review items (users) after their commands (events, in order): the first end state and resolution stand, the same again is no change, another is refused.

    Only an open item is touched, so its end is its first ending command, found without a loop over commands.
    """
    c = F.col
    final = F.create_map(*(F.lit(x) for kv in {"purchase": "resolved", "error": "superseded"}.items() for x in kv))[c("event_type")]
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", final.alias("final"), (F.floor(c("value") / 50)).cast("long").alias("resolution"))
    order = F.struct("ts", "event_id")
    end = e.where(c("final").isNotNull()).groupBy("user_id").agg(F.min(F.struct(order.alias("at"), "final", "resolution")).alias("end"))
    joined = e.join(end, "user_id", "left")
    before = c("end").isNull() | (order < c("end.at"))
    same = (c("final") == c("end.final")) & (c("resolution") == c("end.resolution"))
    return joined.groupBy("user_id").agg(
        F.first(F.coalesce("end.final", F.lit("open"))).alias("state"), F.first("end.at.ts").alias("resolved_at"), F.count_if(before & (c("event_type") == "click")).alias("attempts"),
        F.count_if(~before & (order != c("end.at")) & c("final").isNotNull() & same).alias("repeats"), F.count_if(~before & (order != c("end.at")) & c("final").isNotNull() & ~same).alias("refused"),
    )


def _registries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    row = lambda shift, version: (k.alias("key"), F.concat(F.lit("art"), ((k + shift) % 9).cast("string")).alias("article"), F.sha2(F.concat_ws("|", "p_name", version.cast("string")), 256).alias("sha"), (k % 6).cast("string").alias("version"))
    old = p.where("p_size > 10").select(*row(F.lit(0), F.lit(0)))
    fresh = p.where("p_size < 40").select(*row(F.when(k % 29 == 0, 1).otherwise(0), F.when(k % 23 == 0, 1).otherwise(0)))
    return old, fresh


REGISTRIES = """old_r as (select p_partkey as key, 'art' || cast(p_partkey % 9 as varchar) article, sha256(p_name || '|0') sha, cast(p_partkey % 6 as varchar) as version from part where p_size > 10),
 new_r as (select p_partkey as key, 'art' || cast((p_partkey + case when p_partkey % 29 = 0 then 1 else 0 end) % 9 as varchar) article, sha256(p_name || '|' || case when p_partkey % 23 = 0 then '1' else '0' end) sha, cast(p_partkey % 6 as varchar) as version from part where p_size < 40)"""


def registry_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry that only grows: stored records stay, new ones are added, drift is a conflict unless it is the digest alone and its migration is authorized."""
    c = F.col
    old, fresh = _registries(spark, sf_dir)
    d = drift(old, fresh, "key", ("article", "sha", "version"))
    allowed = (c("changed") == F.array(F.lit("sha"))) & (c("key") % 2 == 0)
    state = ladder([(c("state") == "missing", "kept"), (c("state") == "extra", "added"), (c("state") == "same", "same"), (allowed, "migrated")], "conflict")
    judged = d.withColumn("outcome", state)
    both = judged.join(old.select("key", c("sha").alias("old_sha")), "key", "left").join(fresh.select("key", c("sha").alias("new_sha")), "key", "left")
    kept = F.when(c("outcome").isin("kept", "conflict"), c("old_sha")).otherwise(c("new_sha"))
    return both.select("key", c("outcome").alias("state"), F.array_join("changed", ",").alias("changed"), F.substring(kept, 1, 12).alias("sha"))


def registry_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the reconciled registry lost a stored record or is smaller: one row, which must say no."""
    old, _ = _registries(spark, sf_dir)
    after = registry_reconcile(spark, sf_dir)
    gone = old.join(after, "key", "left_anti").agg(F.count("*").alias("gone"))
    sizes = old.agg(F.count("*").alias("before")).join(after.agg(F.count("*").alias("after"), F.count_if(F.col("state") == "conflict").alias("conflicts")))
    return sizes.join(gone).select("before", "after", "conflicts", "gone", ((F.col("gone") == 0) & (F.col("after") >= F.col("before"))).alias("monotone"))


def adjudicated_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence (parts) against its snapshot, link and question, in one inner join of four: confirmed, held, or what drifted. A missing side is an error of its own."""
    c, k = F.col, F.col("p_partkey")
    p = read(spark, sf_dir, "part")
    letter = lambda n: F.substr(F.lit("ABCD"), (n % 4 + 1).cast("int"), F.lit(1))
    evidence = p.select(k.alias("key"), F.concat(F.lit("art"), (k % 9).cast("string")).alias("article"), letter(k).alias("answer"), F.split("p_name", " ").alias("markers"), F.when(k % 10 == 0, "held").otherwise("confirmed").alias("decision"))
    snapshot = p.where(k % 31 != 0).select(k.alias("key"), F.concat(F.lit("art"), (F.when(k % 13 == 0, k + 1).otherwise(k) % 9).cast("string")).alias("s_article"), F.when(k % 17 == 0, F.substring("p_name", 1, 4)).otherwise(c("p_name")).alias("s_text"))
    link = p.where(k % 37 != 0).select(k.alias("key"), letter(F.when(k % 19 == 0, k + 1).otherwise(k)).alias("l_answer"))
    question = p.select(k.alias("key"), letter(F.when(k % 11 == 0, k + 2).otherwise(k)).alias("q_answer"))
    found = evidence.join(snapshot, "key", "left").join(link, "key", "left").join(question, "key", "left")
    problems = {
        "missing_evidence": c("s_text").isNull() | c("l_answer").isNull() | c("q_answer").isNull(), "article_drift": c("s_article") != c("article"), "marker_missing": ~F.forall("markers", lambda m: F.contains("s_text", m)),
        "link_answer_drift": c("l_answer") != c("answer"), "question_answer_drift": c("q_answer") != c("answer"),
    }
    wrong = names_where({n: F.coalesce(x, F.lit(False)) for n, x in problems.items()})
    return found.select("key", F.array_join(wrong, ",").alias("problems"), ladder([(F.size(wrong) > 0, "rejected"), (c("decision") == "held", "held")], "confirmed").alias("outcome"))


def disjoint_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine records and confirmed ones as one registry, by level; a key on both sides is a conflict and stops the union."""
    machine = read(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("key"), F.lit("machine").alias("level"))
    confirmed = adjudicated_evidence(spark, sf_dir).where("outcome = 'confirmed'").select("key", F.lit("adjudicated").alias("level"))
    g = machine.unionByName(confirmed).groupBy("key").agg(F.count("*").alias("n"), F.min("level").alias("level"))
    return g.groupBy(F.when(F.col("n") > 1, "conflict").otherwise(F.col("level")).alias("level")).agg(F.count("*").alias("n"))


#: Failure classes with whether they are tried again, how often, how they wait, and what comes when that is used up.
FAILURES = (
    ("transient_timeout", True, 3, "exponential_short", "preserve_last_known_good"), ("rate_limited_429", True, 2, "provider_retry_after_or_long", "preserve_last_known_good"), ("upstream_5xx", True, 3, "exponential_medium", "preserve_last_known_good"),
    ("source_unavailable", True, 2, "source_outage", "preserve_last_known_good"), ("stale_job", True, 1, "lease_recovery", "manual_required"), ("schema_drift", False, 0, "none", "quarantine"),
)
PATH = ("draft", "checked", "preview_verified", "publish_authorized", "published")
TERMINALS = ("quarantined", "rolled_back")


def failure_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on each failure (event) by the policy of its class; a class outside the policy is refused."""
    c = F.col
    policy = spark.sql("values " + ", ".join(f"({quoted(n)}, {quoted(r)}, {m}, {quoted(b)}, {quoted(x)})" for n, r, m, b, x in FAILURES) + " as policy(failure, retryable, most, backoff, exhausted)")
    e = read(spark, sf_dir, "events").select("event_id", pick("event_id", (*(f[0] for f in FAILURES), "unheard_of")).alias("failure"), (F.col("user_id") % 5).alias("used"))
    both = e.join(F.broadcast(policy), "failure", "left")
    again = F.coalesce(c("retryable") & (c("used") < c("most")), F.lit(False))
    action = ladder([(c("most").isNull(), "refused"), (again, "retry")], None)
    return both.select("event_id", F.coalesce(action, c("exhausted")).alias("action"), F.when(again, c("backoff")).otherwise("none").alias("backoff"), F.greatest(F.lit(0), c("most") - c("used")).alias("left"))


def release_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of releases (orders): one step along the path, publishing only with an authorization, a failure's end from anywhere."""
    c = F.col
    o = read(spark, sf_dir, "orders").select("o_orderkey", pick("o_orderkey", PATH).alias("at"), pick("o_orderkey", (*PATH, *TERMINALS), 3, 1).alias("to"), (F.col("o_orderstatus") == "F").alias("authorized"))
    place = lambda x: F.array_position(F.array(*map(F.lit, PATH)), x)
    forward = (place(c("to")) > 0) & (place(c("to")) == place(c("at")) + 1)
    gate = (c("at") == "preview_verified") & (c("to") == "publish_authorized")
    reason = ladder([(c("to").isin(*TERMINALS), "failure_terminal_transition"), (gate & c("authorized"), "external_authorization_present"), (gate, "external_authorization_required"), (forward, "normal_verified_transition")], "transition_not_allowed")
    allowed = c("to").isin(*TERMINALS) | (forward & (~gate | c("authorized")))
    return o.select("o_orderkey", "at", "to", reason.alias("reason"), allowed.alias("allowed"))


def unit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of work (months of orders) in order, with the keys of their parts, and which remain after the checkpoint."""
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month")
    units = read(spark, sf_dir, "orders").groupBy(month).agg(F.date_format(F.min("o_orderdate"), "yyyy-MM").alias("unit"), F.count("*").alias("rows"))
    placed = numbered(units, "month")
    key = F.sha2(F.concat_ws("|", F.lit("parent-1"), F.lit("session"), "unit"), 256)
    return placed.select("unit", "rows", (F.col("place") - 1).alias("index"), F.substring(key, 1, 32).alias("idempotency_key"), (F.col("unit") > "1995-06").alias("remaining"))


def law_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public report on watched laws (suppliers): which changed, and the eight most recently modified; counts that must agree stand on each row."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("s_suppkey") * 37 % 1500).cast("int")).alias("modified"), (F.col("s_acctbal") < 0).alias("changed"), (F.col("s_suppkey") % 9 != 0).alias("found"))
    n = s.agg(F.count("*").alias("watched"), F.count_if("found").alias("matched"), F.count_if(~F.col("found")).alias("missing"), F.count_if("changed").alias("n_changed"))
    top = s.orderBy(F.desc("modified"), "s_suppkey").limit(8).select("s_suppkey", F.lit("recent").alias("list"))
    rows = s.where("changed").select("s_suppkey", F.lit("changed").alias("list")).unionByName(top)
    return rows.join(F.broadcast(n)).select("s_suppkey", "list", "watched", "n_changed", (F.col("matched") + F.col("missing") == F.col("watched")).alias("adds_up"))


def url_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source addresses (of lines) against the registry (parts): proposals for those that differ, all or nothing by exam: one line without an entry leaves an exam out."""
    c = F.col
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c("l_partkey").alias("p"), F.concat(F.lit("/q?c="), (c("l_partkey") % 10 + F.when(c("l_suppkey") % 6 == 0, 1).otherwise(0)).cast("string")).alias("url"))
    registry = read(spark, sf_dir, "part").where("p_size < 49").select(c("p_partkey").alias("p"), F.concat(F.lit("/q?c="), (c("p_partkey") % 10).cast("string")).alias("wanted"))
    both = rows.join(registry, "p", "left")
    whole = both.groupBy("l_orderkey").agg(F.count_if(c("wanted").isNull()).alias("lacking")).where("lacking = 0").select("l_orderkey")
    return both.where(c("url") != c("wanted")).join(whole, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", c("url").alias("before"), c("wanted").alias("after"))


def field_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a correction (three of each customer) by whether they stand as before, as proposed, or neither; one of the last kind holds the row."""
    c, k = F.col, F.col("c_custkey")
    now = {"name": F.col("c_name"), "segment": F.when(k % 5 == 0, F.lower("c_mktsegment")).otherwise(c("c_mktsegment")), "balance": F.when(k % 7 == 0, "?").otherwise(F.when(k % 3 == 0, "0").otherwise(c("c_acctbal").cast("decimal(12,2)").cast("string")))}
    before = {"name": c("c_name"), "segment": c("c_mktsegment"), "balance": c("c_acctbal").cast("decimal(12,2)").cast("string")}
    after = {"name": c("c_name"), "segment": F.lower("c_mktsegment"), "balance": F.lit("0")}
    state = {f: ladder([(before[f] == after[f], ""), (now[f] == before[f], "before"), (now[f] == after[f], "after")], "unknown") for f in now}
    of = lambda s: F.array_join(names_where({f: x == s for f, x in state.items()}), ",")
    rows = read(spark, sf_dir, "customer").select("c_custkey", of("before").alias("precorrection"), of("after").alias("proposed"), of("unknown").alias("unknown"))
    return rows.withColumn("hold", F.col("unknown") != "")


def context_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that share a case (lines first to last of an order) must carry one preface: what is missing, incomplete or different."""
    c = F.col
    groups = read(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("first"), (F.col("o_orderkey") % 4 + 2).cast("int").alias("last"))
    each = groups.select("o_orderkey", "first", "last", F.explode(F.sequence("first", "last")).alias("number"))
    preface = F.when(c("l_partkey") % 7 == 0, "").otherwise(F.concat(F.lit("情況："), F.when(c("l_partkey") % 11 == 0, "乙").otherwise("甲"), F.when(c("l_partkey") % 13 == 0, "").otherwise("，第1題至最後")))
    lines = read(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("o_orderkey"), c("l_linenumber").cast("int").alias("number"), preface.alias("preface")).dropDuplicates(["o_orderkey", "number", "preface"])
    joined = each.join(lines, ["o_orderkey", "number"], "left")
    good = c("preface").startswith("情況：") & c("preface").contains("第1題至")
    canon = joined.where(good).groupBy("o_orderkey").agg(F.min_by("preface", F.struct("number", "preface")).alias("canon"))
    both = joined.join(canon, "o_orderkey", "left")
    reason = ladder([(c("preface").isNull(), "missing_or_wrong_dependent_question_identity"), (c("preface") == "", "shared_case_context_missing"), (~good, "shared_case_context_incomplete_or_wrong_range"), (c("preface") != c("canon"), "shared_case_context_mismatch")], None)
    return both.select("o_orderkey", "number", reason.alias("reason")).where("reason is not null").groupBy("o_orderkey").agg(F.count("*").alias("risks"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def degraded_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of scans (events by kind as sources): healthy, degraded with the age of the last good snapshot, or refused when all sources failed or it is over a day old."""
    c = F.col
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    by_source = e.groupBy("day", "event_type").agg(F.max("ts").alias("last"), (F.max("value") < 99).alias("ok"))
    g = by_source.groupBy("day").agg(F.count("*").alias("sources"), F.count_if(~c("ok")).alias("failed"), F.max(F.when(c("ok"), c("last"))).alias("good_at"))
    age = F.round((F.unix_seconds(utc(F.date_add("day", 1))) - F.unix_seconds(utc(c("good_at")))) / 3600, 2)
    mode = ladder([(c("failed") == 0, "healthy"), (c("failed") >= c("sources"), "refused"), (age > 24, "refused")], "degraded")
    return g.select("day", "sources", "failed", mode.alias("mode"), F.when((c("failed") > 0) & (c("failed") < c("sources")), age).alias("age_hours"))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of the backup's list; tables that aren't there count as null instead of failing."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf, out = spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in ("customer", "orders", "no_such_table", "labels"):
        path = there(f"{sf_dir}/{name}.parquet")
        found = path.getFileSystem(conf).exists(path)
        counted = read(spark, sf_dir, name).agg(F.count("*").alias("rows")) if found else spark.range(1).select(F.lit(None).cast("long").alias("rows"))
        out.append(counted.select(F.lit(name).alias("table"), "rows", F.lit(found).alias("present")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table read in key order by pages of 1000: each page's rows and bounds, and whether it is the last, short one."""
    placed = numbered(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").withColumn("page", F.floor((F.col("place") - 1) / 1000).cast("long"))
    g = placed.groupBy("page").agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    return g.withColumn("short", F.col("rows") < 1000)


QUERIES = {
    f.__name__: f
    for f in (
        upsert_owned, upsert_newer, update_returning, sync_runs, identity_collisions, merge_preserved, change_rules, attempt_accounting, queue_claims, quota_replay, review_reconcile, review_lifecycle, registry_reconcile,
        registry_monotone, adjudicated_evidence, disjoint_registry, failure_decisions, release_transitions, unit_plan, law_snapshot, url_repairs, field_states, context_groups, degraded_mode, table_counts, page_scan,
    )
}

REG = f"""{REGISTRIES}, j as (select coalesce(o.key, n.key) as key, o.key ok, n.key nk, o.sha osha, n.sha nsha, list_filter([case when o.article <> n.article then 'article' end, case when o.sha <> n.sha then 'sha' end, case when o.version <> n.version then 'version' end], lambda x: x is not null) ch from old_r o full join new_r n on o.key = n.key),
 reg as (select key, case when nk is null then 'kept' when ok is null then 'added' when len(ch) = 0 then 'same' when ch = ['sha'] and key % 2 = 0 then 'migrated' else 'conflict' end state, case when ok is null or nk is null then '' else array_to_string(ch, ',') end changed, osha, nsha from j)"""
LETTER = "substr('ABCD', cast(({n}) % 4 + 1 as integer), 1)"
ADJUDICATED = f"""ev as (select p_partkey as key, 'art' || cast(p_partkey % 9 as varchar) article, {LETTER.format(n='p_partkey')} answer, string_split(p_name, ' ') markers, p_partkey % 10 = 0 held from part),
 sn as (select p_partkey as key, 'art' || cast(case when p_partkey % 13 = 0 then p_partkey + 1 else p_partkey end % 9 as varchar) s_article, case when p_partkey % 17 = 0 then left(p_name, 4) else p_name end s_text from part where p_partkey % 31 <> 0),
 li as (select p_partkey as key, {LETTER.format(n='case when p_partkey % 19 = 0 then p_partkey + 1 else p_partkey end')} l_answer from part where p_partkey % 37 <> 0), qu as (select p_partkey as key, {LETTER.format(n='case when p_partkey % 11 = 0 then p_partkey + 2 else p_partkey end')} q_answer from part),
 ad as (select ev.key, held, concat_ws(',', case when s_text is null or l_answer is null then 'missing_evidence' end, case when s_article <> article then 'article_drift' end, case when len(list_filter(markers, lambda m: not contains(s_text, m))) > 0 then 'marker_missing' end,
 case when l_answer <> answer then 'link_answer_drift' end, case when q_answer <> answer then 'question_answer_drift' end) problems from ev left join sn on sn.key = ev.key left join li on li.key = ev.key left join qu on qu.key = ev.key),
 adjudicated as (select key, problems, case when problems <> '' then 'rejected' when held then 'held' else 'confirmed' end outcome from ad)"""
ORACLE = {
    "upsert_owned": f"""with b as (select d.doc_id id, case quality when 1 then 'published' else 'candidate' end status, case when toxic = 1 then 'toxic' end manual_note, case when l.doc_id is null then date '{NOW}' else date '2023-12-31' end first_seen_at, date '{NOW}' - cast(d.doc_id % 900 as integer) pub from documents d left join labels l on l.doc_id = d.doc_id)
 select id, case when status = 'candidate' and pub < date '{NOW}' - {ARCHIVE_DAYS} then 'archived' else status end status, manual_note, first_seen_at, date '{NOW}' last_seen_at from b""",
    "upsert_newer": """with r as (select *, row_number() over (partition by user_id order by ts desc, event_id) k from events) select r.user_id, ts scheduled_at, event_type payload, ts >= timestamp '2024-01-16' and o.user_id is not null replaced from r left join (select distinct user_id from events where ts < timestamp '2024-01-16') o on o.user_id = r.user_id where k = 1""",
    "update_returning": f"with f(p, a, b) as (values {', '.join(f'({quoted(p)}, {quoted(a)}, {quoted(b)})' for p, a, b in CORRECTIONS)}) select o_orderkey, o_orderstatus old_status, b new_status from orders join f on p = o_orderpriority and a = o_orderstatus",
    "sync_runs": """with g as (select cast(ts as date) run, count(*) fetched, count(*) filter (where event_type <> 'view') accepted, count(*) filter (where event_type = 'error' and value > 95) e from events group by 1), l as (select max(run) v from g where e = 0)
 select run, fetched, accepted, case when e = 0 then 'complete' else 'failed' end status, 'feeds=' || cast(e as varchar) || ' errors' note, coalesce(run = v, false) visible from g cross join l""",
    "identity_collisions": f"with {IMPORTS} select id, changed from (select i.id, concat_ws(',', case when i.code <> s.code then 'code' end, case when i.year <> s.year then 'year' end, case when i.round <> s.round then 'round' end, case when i.subject <> s.subject then 'subject' end, case when i.qno <> s.qno then 'qno' end) changed from incoming i join stored s on s.id = i.id) where changed <> ''",
    "merge_preserved": f"""with {IMPORTS}, m as (select i.id, case when s.topic <> '' then s.topic else i.topic end topic, case when s.why <> '' then s.why else i.why end why, array_to_string(case when len(s.tags) > 0 then s.tags else i.tags end, ',') tags from incoming i left join stored s on s.id = i.id
 where s.id is null or (i.code = s.code and i.year = s.year and i.round = s.round and i.subject = s.subject and i.qno = s.qno)) select *, (row_number() over (order by id) - 1) // {BATCH} batch from m""",
    "change_rules": f"""with {MCQS}, a as (select *, nullif(law, '') l0, case when row % 7 = 0 then question || '?' else question end q2, case when row % 11 = 0 then 'any_answer' else grading_mode end m2, {sql_pick('row', ('ready', 'ready', 'pending', 'review'), 3)} s2, coalesce(exp_why, '') || {sql_pick('row', EDITS, 2)} w2 from mcqs),
 b as (select *, source_exam_code <> '' and (q2 <> question or m2 <> grading_mode) core, s2 = 'ready' and regexp_matches(concat_ws(' ', w2, exp_others, l0), '(?i){FORBIDDEN}') refused from a),
 c as (select *, case when core then 'pending' else s2 end status, case when core then 0 else row % 4 end attempts, case when not core then l0 end kept, {_names_sql("concat_ws(' ', q2, opt_a, opt_b, opt_c, opt_d)")} src from b), d as (select *, {_names_sql("coalesce(kept, '')")} nam from c),
 e as (select *, case when status = 'ready' and kept is not null and legal_status not in ('verified_current', 'changed') and (len(nam) = 0 or len(list_filter(nam, lambda x: not list_contains(src, x))) > 0) then null else kept end final from d)
 select row, core reset, refused, status, cast(attempts as bigint) attempts, final law, array_to_string(list_sort(list_distinct(src || case when final is not null then nam else [] end)), ',') as names,
 case when core then 'cleared' when status in {READY} and analysis_status not in {READY} then 'set' when status not in {READY} and analysis_status in {READY} then 'cleared' else 'kept' end completed from e""",
    "attempt_accounting": f"""with a as (select o_orderkey, {sql_pick('o_orderkey', ERRORS, 3)} m, o_orderkey % 4 u from orders), b as (select *, regexp_matches(m, '{TRANSIENT}') t from a)
 select o_orderkey, t transient, cast(case when t then u else u + 1 end as bigint) attempts, case when not t and u + 1 >= {ATTEMPTS} then 'review' else 'pending' end status from b""",
    "queue_claims": f"""with r as (select l_suppkey % 7 queue, l_orderkey, l_linenumber, ['pending', 'analyzing', 'ready', 'review'][cast(l_partkey % 4 + 1 as integer)] status, l_orderkey % 5 attempts, case when l_linenumber % 2 = 0 then l_shipdate end as last_try, l_shipdate started from lineitem),
 o as (select *, (status = 'pending' or (status = 'analyzing' and started < timestamp '1998-08-01 12:00:00' - interval 15 minute)) and attempts < 3 op from r), n as (select *, row_number() over (partition by queue order by last_try nulls first, l_linenumber, l_orderkey) k from o where op),
 g as (select queue, count(*) filter (where status = 'ready' and started >= timestamp '1998-08-01 12:00:00' - interval 24 hour) done, count(*) filter (where op) remaining, count(*) filter (where status = 'review') review from o group by 1)
 select g.queue, done, case when done < {DAILY} then n.l_orderkey end as order, case when done < {DAILY} then n.l_linenumber end as line, remaining, review, remaining = 0 stop from g left join n on n.queue = g.queue and n.k = 1""",
    "quota_replay": f"""with e as (select event_id, ts, user_id, cast(ts + interval 8 hour as date) d, case when event_type = 'purchase' then 'photo' else 'text' end kind from events), o as (select *, row_number() over (partition by d, kind, user_id order by ts, event_id) r1 from e),
 c as (select *, case kind when 'text' then {CLIENT['text']} else {CLIENT['photo']} end cl, case kind when 'text' then {WHOLE['text']} else {WHOLE['photo']} end wh from o), p as (select *, row_number() over (partition by d, kind order by ts, event_id) r2 from c where r1 <= cl), a as (select * from p where r2 <= wh),
 t as (select d, kind, user_id, count(*) taken from a group by 1, 2, 3) select c.event_id, c.kind, case when a.event_id is not null then 'accepted' when taken >= c.cl then 'client' else 'global' end as result from c left join a on a.event_id = c.event_id left join t on t.d = c.d and t.kind = c.kind and t.user_id = c.user_id""",
    "review_reconcile": f"""with c as (select 'o:' || cast(o_orderkey as varchar) ref, {sql_pick('o_orderkey', LANES)} lane from orders where o_orderstatus <> 'P'), c1 as (select *, 'historical-law:' || left(sha256(ref || '|' || lane), 16) id from c),
 o as (select 'o:' || cast(o_orderkey as varchar) ref, {sql_pick('o_orderkey', LANES[1:])} was from orders where o_orderstatus <> 'O'), o1 as (select *, 'historical-law:' || left(sha256(ref || '|' || was), 16) oid from o)
 select id item_id, ref, 'review_upsert' as action, null::varchar final_state from c1 where lane <> 'machine_verified' union all
 select oid, o1.ref, case when lane is null then 'untouched' else 'review_resolve' end, case when lane is null then null when lane = 'machine_verified' then 'resolved' else 'superseded' end from o1 left join c1 on c1.ref = o1.ref where lane is null or lane = 'machine_verified' or id <> oid""",
    "review_lifecycle": """with e as (select *, case event_type when 'purchase' then 'resolved' when 'error' then 'superseded' end f, cast(floor(value / 50) as bigint) r, row_number() over (partition by user_id order by ts, event_id) k from events),
 x as (select user_id, min(k) k from e where f is not null group by 1), y as (select e.* from e join x on x.user_id = e.user_id and x.k = e.k)
 select e.user_id, coalesce(any_value(y.f), 'open') state, any_value(y.ts) resolved_at, count(*) filter (where (y.k is null or e.k < y.k) and e.event_type = 'click') attempts, count(*) filter (where e.k > y.k and e.f = y.f and e.r = y.r) repeats,
 count(*) filter (where e.k > y.k and e.f is not null and not (e.f = y.f and e.r = y.r)) refused from e left join y on y.user_id = e.user_id group by 1""",
    "registry_reconcile": f"with {REG} select key, state, changed, left(case when state in ('kept', 'conflict') then osha else nsha end, 12) sha from reg",
    "registry_monotone": f"with {REG} select (select count(*) from old_r) before, count(*) as after, count(*) filter (where state = 'conflict') conflicts, (select count(*) from old_r where key not in (select key from reg)) gone, true monotone from reg",
    "adjudicated_evidence": f"with {ADJUDICATED} select * from adjudicated",
    "disjoint_registry": f"with {ADJUDICATED}, u as (select key, min(level) as level, count(*) n from (select p_partkey as key, 'machine' as level from part where p_size > 45 union all select key, 'adjudicated' from adjudicated where outcome = 'confirmed') group by 1) select case when n > 1 then 'conflict' else level end as level, count(*) n from u group by 1",
    "failure_decisions": f"""with p(f, r, m, b, x) as (values {', '.join(f'({quoted(n)}, {quoted(r)}, {m}, {quoted(b)}, {quoted(x)})' for n, r, m, b, x in FAILURES)}), e as (select event_id, {sql_pick('event_id', (*(f[0] for f in FAILURES), 'unheard_of'))} f, user_id % 5 used from events)
 select event_id, case when m is null then 'refused' when r and used < m then 'retry' else x end as action, case when r and used < m then b else 'none' end backoff, case when m is null then 0 else greatest(0, m - used) end as left from e left join p on p.f = e.f""",
    "release_transitions": f"""with o as (select o_orderkey, {sql_pick('o_orderkey', PATH)} a, {sql_pick('o_orderkey', (*PATH, *TERMINALS), 3, 1)} t, o_orderstatus = 'F' z from orders), q as (select *, list_position({list(PATH)}, t) > 0 and list_position({list(PATH)}, t) = list_position({list(PATH)}, a) + 1 fw, a = 'preview_verified' and t = 'publish_authorized' gate from o)
 select o_orderkey, a as at, t as to, case when t in {TERMINALS} then 'failure_terminal_transition' when gate and z then 'external_authorization_present' when gate then 'external_authorization_required' when fw then 'normal_verified_transition' else 'transition_not_allowed' end reason, t in {TERMINALS} or (coalesce(fw, false) and (not gate or z)) allowed from q""",
    "unit_plan": """select unit, n as rows, row_number() over (order by unit) - 1 as index, left(sha256('parent-1|session|' || unit), 32) idempotency_key, unit > '1995-06' remaining from (select strftime(o_orderdate, '%Y-%m') unit, count(*) n from orders group by 1)""",
    "law_snapshot": """with s as (select s_suppkey, date '2020-01-01' + cast(s_suppkey * 37 % 1500 as integer) m, s_acctbal < 0 c, s_suppkey % 9 <> 0 f from supplier), n as (select count(*) watched, count(*) filter (where c) n_changed from s)
 select s_suppkey, 'changed' as list, watched, n_changed, true adds_up from s cross join n where c union all select s_suppkey, 'recent', watched, n_changed, true from (select * from s order by m desc, s_suppkey limit 8) cross join n""",
    "url_repairs": """with r as (select l_orderkey, l_linenumber, '/q?c=' || cast(l_partkey % 10 + case when l_suppkey % 6 = 0 then 1 else 0 end as varchar) u, case when p.p_partkey is not null then '/q?c=' || cast(l_partkey % 10 as varchar) end w from lineitem left join part p on p.p_partkey = l_partkey and p.p_size < 49)
 select l_orderkey, l_linenumber, u before, w as after from r where u <> w and l_orderkey not in (select l_orderkey from r where w is null)""",
    "field_states": """with b as (select c_custkey, c_custkey % 5 = 0 s_after, c_mktsegment = lower(c_mktsegment) s_same, cast(cast(c_acctbal as decimal(12, 2)) as varchar) v, case when c_custkey % 7 = 0 then '?' when c_custkey % 3 = 0 then '0' else cast(cast(c_acctbal as decimal(12, 2)) as varchar) end now from customer),
 s as (select c_custkey, case when s_same then '' when s_after then 'after' else 'before' end s, case when v = '0' then '' when now = v then 'before' when now = '0' then 'after' else 'unknown' end b from b)
 select c_custkey, concat_ws(',', case when s = 'before' then 'segment' end, case when b = 'before' then 'balance' end) precorrection, concat_ws(',', case when s = 'after' then 'segment' end, case when b = 'after' then 'balance' end) proposed, case when b = 'unknown' then 'balance' else '' end unknown, b = 'unknown' hold from s""",
    "context_groups": """with e as (select o_orderkey, unnest(generate_series(1, o_orderkey % 4 + 2)) k from orders), l as (select distinct l_orderkey, l_linenumber k, case when l_partkey % 7 = 0 then '' else '情況：' || case when l_partkey % 11 = 0 then '乙' else '甲' end || case when l_partkey % 13 = 0 then '' else '，第1題至最後' end end p from lineitem),
 j as (select e.o_orderkey, e.k, p, coalesce(contains(p, '第1題至'), false) good from e left join l on l.l_orderkey = e.o_orderkey and l.k = e.k), c as (select o_orderkey, arg_min(p, k * 2 + case when contains(p, '乙') then 0 else 1 end) canon from j where good group by 1),
 r as (select j.o_orderkey, case when p is null then 'missing_or_wrong_dependent_question_identity' when p = '' then 'shared_case_context_missing' when not good then 'shared_case_context_incomplete_or_wrong_range' when p <> canon then 'shared_case_context_mismatch' end reason from j left join c on c.o_orderkey = j.o_orderkey)
 select o_orderkey, count(*) risks, string_agg(distinct reason, ',' order by reason) reasons from r where reason is not null group by 1""",
    "degraded_mode": """with s as (select cast(ts as date) d, event_type, max(ts) t, max(value) < 99 ok from events group by 1, 2), g as (select d, count(*) n, count(*) filter (where not ok) f, max(t) filter (where ok) t from s group by 1),
 a as (select *, round((epoch(cast(d + 1 as timestamp)) - floor(epoch(t))) / 3600, 2) age from g) select d as day, n sources, f failed, case when f = 0 then 'healthy' when f >= n or age > 24 then 'refused' else 'degraded' end as mode, case when f > 0 and f < n then age end age_hours from a""",
    "table_counts": "select 'customer' as table, count(*) as rows, true present from customer union all select 'orders', count(*), true from orders union all select 'no_such_table', null, false union all select 'labels', count(*), true from labels",
    "page_scan": "select (k - 1) // 1000 page, count(*) as rows, min(o_orderkey) as first, max(o_orderkey) as last, count(*) < 1000 short from (select o_orderkey, row_number() over (order by o_orderkey) k from orders) group by 1",
}
