"""Task health, incidents, feedback, observations of sources, and command replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import age_hours, utc
from tidemark.operators.rules import ladder
from tidemark.operators.state import latest, replay_commands
from tidemark.sources.tables import read

NOW = "2024-01-31 00:00:00"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of a task (the user): signups are runs that only began, errors failed, the others succeeded."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("task"), "event_id", "ts", "value", ladder([(F.col("event_type") == "error", "failure"), (F.col("event_type") == "signup", "running")], "success").alias("conclusion"))


def task_watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest completed run of each task decides, whether it succeeded or not; critical tasks block. A task without a completed run is missing."""
    r = runs(spark, sf_dir)
    done = latest(r.where("conclusion != 'running'"), "task", [F.col("ts"), F.col("event_id")])
    tasks = r.select("task").distinct()
    age = age_hours(NOW, F.col("ts"))
    limit = F.when(F.col("task") % 2 == 0, 24.0).otherwise(8.0)
    status = ladder([(F.col("conclusion").isNull(), "missing"), (utc(F.col("ts")) > F.lit(NOW).cast("timestamp") + F.expr("interval 5 minutes"), "error"), (F.col("conclusion") != "success", "failed"), (age <= limit, "healthy")], "stale")
    out = tasks.join(done, "task", "left").select("task", "event_id", age.alias("age_hours"), status.alias("status"))
    return out.withColumn("blocking", (F.col("task") % 3 == 0) & F.col("status").isin("stale", "missing", "failed", "error"))


def ledger_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open runs by age band (24, 72, 168 hours) with the oldest, and the ledger's state."""
    r = runs(spark, sf_dir).where("conclusion = 'running'")
    age = age_hours(NOW, F.col("ts"))
    band = ladder([(age < 24, "under_24h"), (age < 72, "24h_72h"), (age < 168, "72h_168h")], "over_168h")
    g = r.select(age.alias("age"), band.alias("band"), "task").groupBy("band").agg(F.count("*").alias("n"), F.max("age").alias("oldest_hours"), F.count_distinct("task").alias("tasks"))
    return g.select("band", "n", "oldest_hours", "tasks", ladder([(F.col("band") == "over_168h", "blocked"), (F.col("band") == "72h_168h", "attention")], "ok").alias("state"))


def incident_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents (tasks with failures) of one day against the day before: new, ongoing, resolved, or unconfirmed. Absence is no recovery: that needs a success."""
    r = runs(spark, sf_dir).withColumn("d", F.to_date("ts")).where("d in (date '2024-01-29', date '2024-01-30')")
    day = F.col("d") == F.lit("2024-01-30").cast("date")
    failed, fine = F.col("conclusion") == "failure", F.col("conclusion") == "success"
    g = r.groupBy("task").agg(F.count_if(failed & ~day).alias("before"), F.count_if(failed & day).alias("now"), F.count_if(fine & day).alias("fine"))
    state = ladder([((F.col("before") == 0) & (F.col("now") > 0), "new"), (F.col("now") > 0, "ongoing"), (F.col("fine") > 0, "resolved")], "recovery_unconfirmed")
    return g.where("before > 0 or now > 0").select("task", F.col("before").alias("failures_before"), F.col("now").alias("failures_now"), state.alias("state"))


def feedback_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by cluster: count, the first 50 ids by time, latest, open ones, worst risk; in triage order."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("cluster"), "event_type")
    risk = ladder([(F.col("event_type") == "error", "high"), (F.col("event_type") == "purchase", "medium")], "low")
    rank = F.when(risk == "high", 3).when(risk == "medium", 2).otherwise(1)
    g = e.groupBy("cluster").agg(F.count("*").alias("n"), F.max("ts").alias("latest"), F.count_if(F.col("event_type") != "view").alias("pending"), F.max(rank).alias("r"))
    first = e.withColumn("p", F.row_number().over(W.partitionBy("cluster").orderBy("ts", "event_id"))).where("p <= 50").groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("first_ids"))
    return g.join(first, "cluster").select("cluster", "n", "latest", "pending", ladder([(F.col("r") == 3, "high"), (F.col("r") == 2, "medium")], "low").alias("risk"), "first_ids")


def source_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fetched page is, and whether it may replace the last trusted one."""
    p = read(spark, sf_dir, "pages")
    html = F.coalesce("html", F.lit(""))
    status = F.when(F.col("page_id") % 41 == 0, 404).when(F.col("page_id") % 37 == 0, 503).when(F.col("page_id") % 31 == 0, 302).otherwise(200)
    known = F.when(F.col("page_id") % 2 == 0, F.sha2(html, 256))
    items = F.size(F.split(html, "<p>")) - 1
    outcome = ladder([(status == 404, "not_found"), (status >= 500, "source_unavailable"), (status >= 300, "invalid_content"), (F.trim(html) == "", "empty_content"), (~html.contains("</html>"), "decode_error"), (items == 0, "empty_content"), (known == F.sha2(html, 256), "success_no_change")], "success_changed")
    return p.select("page_id", status.cast("long").alias("http_status"), items.cast("long").alias("items"), outcome.alias("outcome"), outcome.startswith("success").alias("replacement_allowed"), F.when(outcome.startswith("success"), F.sha2(html, 256)).alias("trusted"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commands on tasks that two workers share."""
    e = read(spark, sf_dir, "events")
    command = F.create_map(*map(F.lit, ("view", "claim", "click", "heartbeat", "purchase", "checkpoint", "error", "fail", "signup", "claim")))[F.col("event_type")]
    command = F.when((F.col("event_type") == "purchase") & (F.col("value") > 150), "complete").otherwise(command)
    return e.select(F.col("user_id").cast("string").alias("task"), F.col("event_id").alias("seq"), F.unix_seconds(utc(F.col("ts"))).alias("now"), command.alias("command"), F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("worker"), F.lit(43_200).cast("long").alias("lease_seconds"), F.lit(5).alias("max_attempts"), F.round("value").cast("long").alias("processed"))


def task_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the lease state machine over all commands."""
    return replay_commands(commands(spark, sf_dir))


QUERIES = {f.__name__: f for f in (task_watchdog, ledger_health, incident_transitions, feedback_clusters, source_observation, task_claims)}

RUNS = "(select user_id task, event_id, ts, case event_type when 'error' then 'failure' when 'signup' then 'running' else 'success' end conclusion from events)"
AGE = f"greatest(round_even((epoch_us(timestamp '{NOW}') - epoch_us(ts)) / 3.6e9::double, 2), 0)"
ORACLE = {
    "task_watchdog": f"""with r as {RUNS}, d as (select *, row_number() over (partition by task order by ts desc, event_id desc) p from r where conclusion <> 'running'), t as (select distinct task from r),
 a as (select t.task, d.event_id, case when ts is not null then {AGE} end age_hours, ts, conclusion from t left join d on d.task = t.task and d.p = 1),
 s as (select task, event_id, age_hours, case when conclusion is null then 'missing' when ts > timestamp '{NOW}' + interval 5 minute then 'error' when conclusion <> 'success' then 'failed' when age_hours <= case when task % 2 = 0 then 24 else 8 end then 'healthy' else 'stale' end status from a)
 select *, task % 3 = 0 and status <> 'healthy' blocking from s""",
    "ledger_health": f"""with a as (select task, {AGE} age from {RUNS} where conclusion = 'running'), b as (select *, case when age < 24 then 'under_24h' when age < 72 then '24h_72h' when age < 168 then '72h_168h' else 'over_168h' end band from a)
 select band, count(*) n, max(age) oldest_hours, count(distinct task) tasks, case band when 'over_168h' then 'blocked' when '72h_168h' then 'attention' else 'ok' end state from b group by 1""",
    "incident_transitions": f"""with g as (select task, count(*) filter (where conclusion = 'failure' and cast(ts as date) = date '2024-01-29') failures_before, count(*) filter (where conclusion = 'failure' and cast(ts as date) = date '2024-01-30') failures_now,
 count(*) filter (where conclusion = 'success' and cast(ts as date) = date '2024-01-30') fine from {RUNS} where cast(ts as date) in (date '2024-01-29', date '2024-01-30') group by 1)
 select task, failures_before, failures_now, case when failures_before = 0 then 'new' when failures_now > 0 then 'ongoing' when fine > 0 then 'resolved' else 'recovery_unconfirmed' end state from g where failures_before > 0 or failures_now > 0""",
    "feedback_clusters": """with e as (select event_id, ts, event_type, coalesce(json_extract_string(props, '$.k'), 'none') c from events), p as (select *, row_number() over (partition by c order by ts, event_id) r from e)
 select c as cluster, count(*) n, max(ts) latest, count(*) filter (where event_type <> 'view') pending, case when count(*) filter (where event_type = 'error') > 0 then 'high' when count(*) filter (where event_type = 'purchase') > 0 then 'medium' else 'low' end risk,
 string_agg(cast(event_id as varchar), ',' order by r) filter (where r <= 50) first_ids from p group by 1""",
    "source_observation": """with p as (select page_id, coalesce(html, '') h, case when page_id % 41 = 0 then 404 when page_id % 37 = 0 then 503 when page_id % 31 = 0 then 302 else 200 end s from pages),
 q as (select *, (length(h) - length(replace(h, '<p>', ''))) // 3 items from p),
 o as (select *, case when s = 404 then 'not_found' when s >= 500 then 'source_unavailable' when s >= 300 then 'invalid_content' when trim(h) = '' then 'empty_content' when not contains(h, '</html>') then 'decode_error' when items = 0 then 'empty_content' when page_id % 2 = 0 then 'success_no_change' else 'success_changed' end outcome from q)
 select page_id, cast(s as bigint) http_status, cast(items as bigint) items, outcome, starts_with(outcome, 'success') replacement_allowed, case when starts_with(outcome, 'success') then sha256(h) end trusted from o""",
}
