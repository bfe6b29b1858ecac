"""Usage and telemetry: daily counters, summaries on a zero-filled spine, admission, rate limits, status ladders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import bucket, clamp, half_away, local_day, utc
from tidemark.operators.relations import upsert
from tidemark.operators.rules import ladder
from tidemark.operators.state import spine, trailing_counts
from tidemark.sources.tables import read, values

#: "Now" of the summaries, as a day in Taipei and a moment in UTC; queries never ask the clock.
TODAY, NOW = "2024-01-31", "2024-01-15 12:00:00"
#: Counters stop at these.
VIEWS_CAP, BUCKET_CAP, LATENCY_CAP = 500, 10_000, 120_000
SITES = ("click", "error", "purchase", "signup", "view")
OUTCOMES = {"error": "service_error", "purchase": "success", "signup": "success", "click": "rate_limited", "view": "timeout"}


def daily_counters(events: DataFrame) -> DataFrame:
    """One row for each local day, site and client: saturating views, first and last seen."""
    return events.groupBy(local_day(F.col("ts")).alias("usage_date"), F.col("event_type").alias("site_origin"), F.sha2(F.col("user_id").cast("string"), 256).alias("client_hash")).agg(
        F.least(F.count("*"), F.lit(VIEWS_CAP)).cast("long").alias("page_views"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at")
    )


def usage_daily_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of the first half of the month, then the second half upserted onto them."""
    events = read(spark, sf_dir, "events")
    half = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    old, new = F.col("old"), F.col("new")
    return upsert(
        daily_counters(events.where(F.col("ts") < half)), daily_counters(events.where(F.col("ts") >= half)), ["usage_date", "site_origin", "client_hash"],
        {"page_views": F.least(old["page_views"] + new["page_views"], F.lit(VIEWS_CAP)), "first_seen_at": F.least(old["first_seen_at"], new["first_seen_at"]), "last_seen_at": F.greatest(old["last_seen_at"], new["last_seen_at"])},
    )


COUNTERS = """select cast(ts + interval 8 hour as date) usage_date, event_type site_origin, sha256(cast(user_id as varchar)) client_hash,
 cast(least(count(*), 500) as bigint) page_views, min(ts) first_seen_at, max(ts) last_seen_at from events group by 1, 2, 3"""


def usage_summary_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each known site, zeros included: views and browsers today and over seven days, and of all time."""
    u = daily_counters(read(spark, sf_dir, "events"))
    today = F.lit(TODAY).cast("date")
    week = F.col("usage_date") > F.date_sub(today, 7)
    sites = values(spark, "site_origin string", [(s,) for s in SITES])
    per_client = u.groupBy("site_origin", "client_hash").agg(
        F.sum("page_views").alias("views"), F.sum(F.when(F.col("usage_date") == today, F.col("page_views"))).alias("today"), F.count_if(F.col("usage_date") == today).alias("rows_today"),
        F.sum(F.when(week, F.col("page_views"))).alias("week"), F.count_if(week).alias("rows_week"),
    )
    # summed up by client first, so no distinct needs its rows expanded
    stats = per_client.groupBy("site_origin").agg(
        F.sum("views").alias("views_total"), F.sum("today").alias("views_today"), F.sum("rows_today").alias("browsers_today"), F.sum("week").alias("views_7d"), F.count_if(F.col("rows_week") > 0).alias("browsers_7d"), F.count("*").alias("browsers_total")
    )
    names = ["views_total", "views_today", "browsers_today", "views_7d", "browsers_7d", "browsers_total"]
    return F.broadcast(sites).join(stats, "site_origin", "left").select("site_origin", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names))


def usage_daily_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trailing seven days, each with its views and browser-days, zero where there is nothing. A browser on two sites counts twice."""
    u = daily_counters(read(spark, sf_dir, "events")).groupBy("usage_date").agg(F.sum("page_views").alias("v"), F.count("*").alias("b"))
    days = spark.range(1).select(F.explode(spine("2024-01-25", TODAY)).alias("usage_date"))
    return days.join(u, "usage_date", "left").select("usage_date", F.coalesce("v", F.lit(0)).cast("long").alias("page_views"), F.coalesce("b", F.lit(0)).cast("long").alias("browsers"))


def usage_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-time totals with distinct (site, client) pairs, which count where a part of the pair is null."""
    u = daily_counters(read(spark, sf_dir, "events")).select("usage_date", F.nullif("site_origin", F.lit("view")).alias("site_origin"), "client_hash", "page_views")
    return u.agg(F.sum("page_views").cast("long").alias("page_views"), F.count_distinct(F.struct("site_origin", "client_hash")).alias("site_clients"), F.count_distinct("client_hash").alias("clients"), F.min("usage_date").alias("since"))


def telemetry(events: DataFrame) -> DataFrame:
    """Events as requests: mode, outcome, latency within its bounds."""
    outcome = F.create_map(*(F.lit(x) for kv in OUTCOMES.items() for x in kv))[F.col("event_type")]
    return events.select("event_id", "ts", "user_id", F.when(F.col("user_id") % 3 == 0, "photo").otherwise("text").alias("mode"), outcome.alias("outcome"), clamp(F.round(F.col("value") * 1000), 0, LATENCY_CAP).cast("long").alias("latency_ms"))


REQUESTS = """select event_id, ts, user_id, case when user_id % 3 = 0 then 'photo' else 'text' end as mode,
 case event_type when 'error' then 'service_error' when 'purchase' then 'success' when 'signup' then 'success' when 'click' then 'rate_limited' when 'view' then 'timeout' end as outcome,
 cast(greatest(0, least(120000, round(value * 1000))) as bigint) as latency_ms from events"""


def telemetry_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(read(spark, sf_dir, "events"))
    return t.groupBy(bucket(F.col("ts")).cast("timestamp_ntz").alias("bucket_start"), "mode", "outcome").agg(
        F.least(F.count("*"), F.lit(BUCKET_CAP)).cast("long").alias("request_count"), F.sum("latency_ms").alias("latency_total_ms"), F.max("latency_ms").alias("latency_max_ms")
    )


def telemetry_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 60 minutes and 24 hours by mode, with the status ladder; a mode without requests is idle and has no rate."""
    now = F.lit(NOW).cast("timestamp")
    at = utc(F.col("ts"))
    t = telemetry(read(spark, sf_dir, "events")).where((at <= now) & (at > now - F.expr("interval 24 hours")))
    hour = at > now - F.expr("interval 60 minutes")
    hard = F.col("outcome").isin("service_error", "timeout", "network_error")
    n = t.groupBy("mode").agg(
        F.count_if(hour).alias("requests"), F.count_if(hour & (F.col("outcome") == "success")).alias("ok"), F.count_if(hour & hard).alias("hard"), F.count_if(hour & (F.col("outcome") == "rate_limited")).alias("limited"),
        F.count("*").alias("requests_24h"), F.count_if(F.col("outcome") == "success").alias("ok_24h"), F.max("latency_ms").alias("latency_max_24h"),
    )
    modes = values(spark, "mode string", [("text",), ("photo",), ("audio",)])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    q, ok, h, lim = (zero(c) for c in ("requests", "ok", "hard", "limited"))
    status = ladder([((q >= 3) & (ok == 0) & (h >= 3), "down"), ((q >= 4) & (2 * h >= q), "degraded"), ((q >= 4) & (2 * lim >= q), "busy"), (q == 0, "idle")], "ok")
    rate = F.when(zero("requests_24h") > 0, half_away(100 * zero("ok_24h").cast("decimal(20,0)") / zero("requests_24h"), 1).cast("double"))
    return F.broadcast(modes).join(n, "mode", "left").select("mode", *(zero(c).alias(c) for c in ("requests", "ok", "hard", "limited", "requests_24h", "ok_24h")), "latency_max_24h", rate.alias("success_pct_24h"), status.alias("status"))


def client_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and refused events of each local day and client under a cap of two a day. How many are enough: no order is needed."""
    n = read(spark, sf_dir, "events").groupBy(local_day(F.col("ts")).alias("day"), "user_id").agg(F.count("*").alias("n"))
    return n.select("day", "user_id", F.least("n", F.lit(2)).cast("long").alias("accepted"), F.greatest(F.col("n") - 2, F.lit(0)).cast("long").alias("refused"))


def rate_limited_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of clients with over three in a minute or thirty in a day, by trailing windows."""
    e = trailing_counts(read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", {"in_minute": 60, "in_day": 86_400})
    reason = ladder([(F.col("in_minute") > 3, "minute"), (F.col("in_day") > 3, "day")], None)
    return e.select("event_id", "user_id", "in_minute", "in_day", reason.alias("reason")).where("reason is not null")


def queue_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 25 rows of the work queue: never tried first, then the oldest retry; text numbers by value, others last."""
    o = read(spark, sf_dir, "orders").where("o_orderstatus in ('P', 'O')")
    qno = F.regexp_extract("o_orderpriority", "^([0-9]+)", 1)
    tried = F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate"))
    rows = o.select("o_orderkey", "o_orderstatus", tried.alias("last_attempt"), F.when(qno != "", qno.try_cast("int")).otherwise(F.lit(999999)).alias("qno"), "o_orderdate")
    return rows.orderBy(F.asc_nulls_first("last_attempt"), "qno", "o_orderdate", "o_orderkey").limit(25)


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Props read by path, merged with defaults (the last value wins), and counted."""
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).where("k is not null")
    g = e.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.sort_array(F.collect_set("event_type")).alias("types"))
    merged = F.to_json(F.map_zip_with(F.create_map(F.lit("k"), F.lit("0"), F.lit("origin"), F.lit("props")), F.create_map(F.lit("k"), F.col("k").cast("string")), lambda _, a, b: F.coalesce(b, a)))
    return g.select("k", "n", "kinds", F.array_join("types", ",").alias("types"), merged.alias("merged"))


def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table, one a table."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
    out = None
    for n in names:
        one = read(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


QUERIES = {f.__name__: f for f in (usage_daily_upsert, usage_summary_sites, usage_daily_spine, usage_clients, telemetry_5m, telemetry_status, client_admission, rate_limited_events, queue_claim_order, json_props, coverage_counts)}

ORACLE = {
    "usage_daily_upsert": """with c as (select cast(ts + interval 8 hour as date) usage_date, event_type site_origin, sha256(cast(user_id as varchar)) client_hash, (ts >= timestamp '2024-01-16 00:00:00') part,
 least(count(*), 500) v, min(ts) a, max(ts) b from events group by 1, 2, 3, 4)
 select usage_date, site_origin, client_hash, cast(least(sum(v), 500) as bigint) page_views, min(a) first_seen_at, max(b) last_seen_at from c group by 1, 2, 3""",
    "usage_summary_sites": f"""with u as ({COUNTERS}), s(site_origin) as (values ('click'), ('error'), ('purchase'), ('signup'), ('view')), p as (select date '{TODAY}' today)
 select s.site_origin, cast(coalesce(sum(page_views), 0) as bigint) views_total, cast(coalesce(sum(page_views) filter (where usage_date = today), 0) as bigint) views_today,
 cast(count(*) filter (where usage_date = today) as bigint) browsers_today, cast(coalesce(sum(page_views) filter (where usage_date > today - 7), 0) as bigint) views_7d,
 cast(count(distinct client_hash) filter (where usage_date > today - 7) as bigint) browsers_7d, cast(count(distinct client_hash) as bigint) browsers_total
 from s cross join p left join u on u.site_origin = s.site_origin group by 1""",
    "usage_daily_spine": f"""with u as ({COUNTERS}), d as (select cast(x as date) usage_date from generate_series(timestamp '2024-01-25', timestamp '{TODAY}', interval 1 day) t(x))
 select d.usage_date, cast(coalesce(sum(page_views), 0) as bigint) page_views, cast(count(u.client_hash) as bigint) browsers from d left join u on u.usage_date = d.usage_date group by 1""",
    "usage_clients": f"""with u as (select usage_date, nullif(site_origin, 'view') s, client_hash, page_views from ({COUNTERS}))
 select cast(sum(page_views) as bigint) page_views, count(distinct (coalesce(s, '-'), client_hash)) site_clients, count(distinct client_hash) clients, min(usage_date) since from u""",
    "telemetry_5m": f"""select time_bucket(interval 5 minute, ts) bucket_start, mode, outcome, cast(least(count(*), 10000) as bigint) request_count, cast(sum(latency_ms) as bigint) latency_total_ms, max(latency_ms) latency_max_ms
 from ({REQUESTS}) group by 1, 2, 3""",
    "telemetry_status": f"""with t as (select * from ({REQUESTS}) where ts <= timestamp '{NOW}' and ts > timestamp '{NOW}' - interval 24 hour), m(mode) as (values ('text'), ('photo'), ('audio')),
 n as (select m.mode, cast(count(*) filter (where ts > timestamp '{NOW}' - interval 60 minute) as bigint) requests,
 cast(count(*) filter (where ts > timestamp '{NOW}' - interval 60 minute and outcome = 'success') as bigint) ok,
 cast(count(*) filter (where ts > timestamp '{NOW}' - interval 60 minute and outcome in ('service_error', 'timeout', 'network_error')) as bigint) hard,
 cast(count(*) filter (where ts > timestamp '{NOW}' - interval 60 minute and outcome = 'rate_limited') as bigint) limited,
 cast(count(t.event_id) as bigint) requests_24h, cast(count(*) filter (where outcome = 'success') as bigint) ok_24h, max(latency_ms) latency_max_24h
 from m left join t on t.mode = m.mode group by 1)
 select *, case when requests_24h > 0 then cast(round(cast(100 * ok_24h as decimal(20,10)) / requests_24h, 1) as double) end success_pct_24h,
 case when requests >= 3 and ok = 0 and hard >= 3 then 'down' when requests >= 4 and 2 * hard >= requests then 'degraded' when requests >= 4 and 2 * limited >= requests then 'busy' when requests = 0 then 'idle' else 'ok' end status from n""",
    "client_admission": """with e as (select cast(ts + interval 8 hour as date) as day, user_id, row_number() over (partition by cast(ts + interval 8 hour as date), user_id order by ts, event_id) r from events)
 select day, user_id, count(*) filter (where r <= 2) accepted, count(*) filter (where r > 2) refused from e group by 1, 2""",
    "rate_limited_events": """with e as (select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 60 second preceding and current row) in_minute,
 count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) in_day from events)
 select *, case when in_minute > 3 then 'minute' else 'day' end reason from e where in_minute > 3 or in_day > 3""",
    "queue_claim_order": """select o_orderkey, o_orderstatus, case when o_orderstatus = 'P' then o_orderdate end last_attempt,
 case when regexp_matches(o_orderpriority, '^[0-9]') then cast(regexp_extract(o_orderpriority, '^([0-9]+)', 1) as integer) else 999999 end qno, o_orderdate
 from orders where o_orderstatus in ('P', 'O') order by last_attempt asc nulls first, qno, o_orderdate, o_orderkey limit 25""",
    "json_props": """with e as (select cast(json_extract_string(props, '$.k') as integer) k, event_type from events)
 select k, count(*) n, count(distinct event_type) kinds, string_agg(distinct event_type, ',' order by event_type) types, '{"k":"' || k || '","origin":"props"}' merged from e where k is not null group by k""",
    "coverage_counts": " union all ".join(f"select '{n}' as name, count(*) as n from {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")),
}
