"""Learner analytics: progress, weak subjects, spaced review, search and related items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import percent, utc
from tidemark.operators.rules import ladder
from tidemark.operators.state import review_state
from tidemark.sources.tables import read

NOW = "2024-01-31 00:00:00"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers of a learner: correct by value; views weren't answered, signups have no flag and count as answered."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("user_id", "event_id", "ts", k.alias("item"), (k % 5).cast("string").alias("subject"), (F.col("value") < 40).alias("right"), F.when(F.col("event_type") == "view", False).when(F.col("event_type") != "signup", True).alias("answered"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, accuracy of seven days and coverage of each learner; unanswered rows are left out, rows without the flag count."""
    a = answers(spark, sf_dir).where("answered is null or answered")
    week = utc(F.col("ts")) >= F.lit(NOW).cast("timestamp") - F.expr("interval 7 days")
    g = a.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("right").alias("ok"), F.count_if(week).alias("n7"), F.count_if(week & F.col("right")).alias("ok7"), F.count_distinct("item").alias("items"))
    return g.select("user_id", "n", percent(F.col("ok"), F.col("n")).alias("accuracy"), percent(F.col("ok7"), F.col("n7")).alias("accuracy_7d"), "items")


def weak_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each learner's next step: due reviews come elsewhere; a topic with two or more wrong answers, else the weakest subject with five tries, else practice."""
    a = answers(spark, sf_dir).where("answered is null or answered")
    by_item = a.groupBy("user_id", "item").agg(F.count_if(~F.col("right")).alias("wrong")).where("wrong >= 2")
    focus = by_item.groupBy("user_id").agg(F.max(F.struct("wrong", (-F.col("item")).alias("i"))).alias("f"))
    by_subject = a.groupBy("user_id", "subject").agg(F.count("*").alias("n"), F.count_if("right").alias("ok")).where("n >= 5")
    weakest = by_subject.groupBy("user_id").agg(F.min(F.struct((F.col("ok") / F.col("n")).alias("rate"), "subject")).alias("w"))
    both = a.select("user_id").distinct().join(focus, "user_id", "left").join(weakest, "user_id", "left")
    step = ladder([(F.col("f").isNotNull(), "focus_topic"), (F.col("w").isNotNull(), "weak_subject")], "practice")
    return both.select("user_id", step.alias("step"), F.when(F.col("f").isNotNull(), -F.col("f")["i"]).alias("item"), F.col("w")["subject"].alias("subject"))


def review_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaced review of each learner: active, due, mastered, maintenance due, next due time. The schedule of an item is replayed in order."""
    a = answers(spark, sf_dir).where("answered is null or answered").select("user_id", "event_id", F.unix_seconds(utc(F.col("ts"))).alias("ts"), "item", "right")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "right"))), lambda x: F.struct(x["right"].alias("right"), x["ts"].alias("ts")))
    s = a.groupBy("user_id", "item").agg(review_state(in_order).alias("s")).select("user_id", "item", "s.*")
    now = F.unix_seconds(F.lit(NOW).cast("timestamp"))
    due, open_ = F.coalesce("due_at", F.lit(0)) <= now, ~F.col("mastered")
    return s.groupBy("user_id").agg(F.count_if(open_).alias("active"), F.count_if(open_ & due).alias("due"), F.count_if("mastered").alias("mastered"), F.count_if(F.col("mastered") & ~F.col("maintenance_done") & due).alias("maintenance_due"), F.min(F.when(F.col("due_at") > now, F.col("due_at"))).alias("next_due"))


def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts for "small bolt" and its alias "tiny bolt": name 50, word 30, brand 20; the best variant of a part counts; the first 60."""
    p = read(spark, sf_dir, "part").withColumn("t", F.lower("p_name"))
    score = lambda q: F.when(F.col("t") == q, 50).otherwise(0) + F.when(F.col("t").contains(q.split()[1]), 30).otherwise(0) + F.when(F.col("t").startswith(q.split()[0]), 20).otherwise(0)
    s = p.select("p_partkey", "p_name", F.greatest(score("small bolt"), score("tiny bolt")).cast("long").alias("score")).where("score > 0")
    return s.orderBy(F.desc("score"), "p_partkey").limit(60)


def related_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers related to suppliers by nation (2) or by the same cents of balance (1), a pair once with its best reason; the first five of each supplier."""
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    cents = lambda x: F.round(F.col(x) * 100).cast("long") % 1000
    a = s.select("s_suppkey", "s_nationkey", cents("s_acctbal").alias("cents"))
    first = lambda key, n: c.select("c_custkey", key).withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("c_custkey"))).where(F.col("r") <= n).drop("r")
    # only the first five customers of a nation can be among the first five of its suppliers; of those with the same cents, at most five are among these, so the first ten do
    c = c.select("c_custkey", "c_nationkey", cents("c_acctbal").alias("cents"))
    by_nation = a.join(F.broadcast(first("c_nationkey", 5)), F.col("s_nationkey") == F.col("c_nationkey")).select("s_suppkey", "c_custkey", F.lit(2).alias("weight"))
    by_cents = a.join(F.broadcast(first("cents", 10)), "cents").select("s_suppkey", "c_custkey", F.lit(1).alias("weight"))
    best = by_nation.unionByName(by_cents).groupBy("s_suppkey", "c_custkey").agg(F.max("weight").alias("weight"))
    return best.withColumn("place", F.row_number().over(W.partitionBy("s_suppkey").orderBy(F.desc("weight"), "c_custkey")).cast("long")).where("place <= 5").select("s_suppkey", "c_custkey", F.col("weight").cast("long").alias("weight"), "place")


def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two part types are in one order, and the band of each pair against the most frequent one."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    kinds = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_type")).alias("t"))
    pairs = kinds.select(F.explode(F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    g = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    share = F.col("n") / F.max("n").over(W.partitionBy(F.lit(1)))  # a row a pair of types
    return g.select("a", "b", "n", ladder([(share >= 0.4, "often"), (share >= 0.15, "sometimes")], "rare").alias("band"))


QUERIES = {f.__name__: f for f in (progress, weak_subject, review_due, search_ranked, related_items, cooccurrence)}

ANSWERS = """(select user_id, event_id, ts, cast(json_extract_string(props, '$.k') as integer) item, cast(cast(json_extract_string(props, '$.k') as integer) % 5 as varchar) subject, value < 40 as ok from events where event_type <> 'view')"""
SCORE = "(case when lower(p_name) = '{q}' then 50 else 0 end + case when contains(lower(p_name), '{b}') then 30 else 0 end + case when starts_with(lower(p_name), '{a}') then 20 else 0 end)"
ORACLE = {
    "progress": f"""with g as (select user_id, count(*) n, count(*) filter (where ok) k, count(*) filter (where ts >= timestamp '{NOW}' - interval 7 day) n7, count(*) filter (where ok and ts >= timestamp '{NOW}' - interval 7 day) k7, count(distinct item) items from {ANSWERS} group by 1)
 select user_id, n, cast(case when n > 0 then floor(100.0::double * k / n + 0.5) else 0 end as bigint) accuracy, cast(case when n7 > 0 then floor(100.0::double * k7 / n7 + 0.5) else 0 end as bigint) accuracy_7d, items from g""",
    "weak_subject": f"""with a as {ANSWERS}, i as (select user_id, item, count(*) filter (where not ok) wrong from a group by 1, 2), f as (select user_id, item, row_number() over (partition by user_id order by wrong desc, item) r from i where wrong >= 2),
 s as (select user_id, subject, count(*) filter (where ok)::double / count(*) rate from a group by 1, 2 having count(*) >= 5), w as (select user_id, subject, row_number() over (partition by user_id order by rate, subject) r from s), u as (select distinct user_id from a)
 select u.user_id, case when f.item is not null then 'focus_topic' when w.subject is not null then 'weak_subject' else 'practice' end step, f.item, w.subject from u left join f on f.user_id = u.user_id and f.r = 1 left join w on w.user_id = u.user_id and w.r = 1""",
    "review_due": f"""with a as (select user_id, item, list({{streak: 0, step: 0, due: cast(floor(epoch(ts)) as bigint), ok: ok, done: false}} order by ts, event_id) l from {ANSWERS} group by 1, 2),
 f as (select user_id, item, list_reduce(l, lambda s, x: case when not x.ok then {{streak: 0, step: 0, due: x.due + 86400, ok: false, done: false}} when s.ok then {{streak: s.streak, step: s.step + 1, due: x.due + 30 * 86400, ok: true, done: s.step + 1 >= 2}}
  else {{streak: s.streak + 1, step: s.step, due: x.due + 86400 * case when s.streak + 1 >= 3 then 14 when s.streak + 1 = 2 then 7 else 3 end, ok: s.streak + 1 >= 3, done: s.done}} end, {{streak: 0, step: 0, due: cast(0 as bigint), ok: false, done: false}}) s from a),
 n as (select cast(epoch(timestamp '{NOW}') as bigint) now) select user_id, count(*) filter (where not s.ok) active, count(*) filter (where not s.ok and s.due <= now) due, count(*) filter (where s.ok) mastered, count(*) filter (where s.ok and not s.done and s.due <= now) maintenance_due, min(s.due) filter (where s.due > now) next_due from f cross join n group by 1""",
    "search_ranked": f"""with s as (select p_partkey, p_name, cast(greatest({SCORE.format(q='small bolt', a='small', b='bolt')}, {SCORE.format(q='tiny bolt', a='tiny', b='bolt')}) as bigint) score from part) select * from s where score > 0 order by score desc, p_partkey limit 60""",
    "related_items": """with p as (select s_suppkey, c_custkey, 2 w from supplier join customer on c_nationkey = s_nationkey union all select s_suppkey, c_custkey, 1 from supplier join customer on cast(round(c_acctbal * 100) as bigint) % 1000 = cast(round(s_acctbal * 100) as bigint) % 1000),
 b as (select s_suppkey, c_custkey, max(w) w from p group by 1, 2), r as (select *, row_number() over (partition by s_suppkey order by w desc, c_custkey) place from b) select s_suppkey, c_custkey, cast(w as bigint) weight, place from r where place <= 5""",
    "cooccurrence": """with k as (select distinct l_orderkey, p_type from lineitem join part on p_partkey = l_partkey), g as (select x.p_type a, y.p_type b, count(*) n from k x join k y on x.l_orderkey = y.l_orderkey and x.p_type < y.p_type group by 1, 2)
 select a, b, n, case when n >= 0.4 * max(n) over () then 'often' when n >= 0.15 * max(n) over () then 'sometimes' else 'rare' end band from g""",
}
