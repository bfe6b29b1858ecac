"""Point-in-time versions and what is routed by them; histories by year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.relations import asof, latest_range
from tidemark.operators.rules import ladder, names_where
from tidemark.sources.tables import read, values

#: Which profile holds for a range of days; where two hold, the later start wins.
PROFILES = (("old", "1995-01-01", "1998-12-31"), ("bridge", "1997-06-01", "1999-06-30"), ("new", "1999-01-01", "2001-12-31"))


def chains(orders: DataFrame) -> DataFrame:
    """A customer's orders as versions: published on the order date, effective up to 29 days later, some without an effective date."""
    effective = F.when(F.col("o_orderkey") % 17 != 0, F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 30).cast("int")))
    return orders.select(F.col("o_custkey").alias("law"), F.col("o_orderkey").alias("version_id"), F.to_date("o_orderdate").alias("version_date"), effective.alias("effective_date"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped lines as questions of a law (the customer), dated by the ship date."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("exam_date"))
    owner = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("law"))
    return lines.join(owner, "l_orderkey")


def _asof(facts: DataFrame, versions: DataFrame, at: str, name: str) -> DataFrame:
    return asof(facts, versions, "law", at, version_date="version_date", effective_date="effective_date", carry="version_id", name=name)


def asof_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version in force at each question's date."""
    held = _asof(questions(spark, sf_dir), chains(read(spark, sf_dir, "orders")), "exam_date", "version_id")
    return held.select("l_orderkey", "l_linenumber", "l_partkey", "law", "exam_date", "version_id")


def asof_window_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions in force at the first and last day of a 30-day window, counted by outcome: an open effective date vetoes, then a difference is a conflict."""
    versions = chains(read(spark, sf_dir, "orders"))
    facts = questions(spark, sf_dir).withColumn("end_date", F.date_add("exam_date", 30))
    opened = versions.where("effective_date is null").groupBy("law").agg(F.min("version_date").alias("open_since"))
    both = _asof(_asof(facts, versions, "exam_date", "first"), versions, "end_date", "last").join(opened, "law", "left")
    state = ladder([(F.col("open_since") <= F.col("end_date"), "effective_date_review"), (F.col("last").isNull(), "no_version"), (~F.col("first").eqNullSafe(F.col("last")), "window_conflict")], "selected")
    return both.groupBy(F.year("exam_date").alias("exam_year"), state.alias("state")).agg(F.count("*").alias("n"), F.count_distinct("law").alias("laws"))


def effective_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = values(spark, "profile string, first string, last string", list(PROFILES)).select("profile", F.col("first").cast("date").alias("first"), F.col("last").cast("date").alias("last"))
    return latest_range(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.to_date("o_orderdate"), ranges, "first", "last", "profile").select("o_orderkey", "profile")


def stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with what three stages say of them; a stage that has no row for an order says nothing."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.max("l_shipdate").alias("last_ship"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    owner = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return o.join(lines, "o_orderkey", "left").join(owner, "o_custkey", "left")


def stage_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lane of each order, counted by lane and status."""
    lane = ladder(
        [(F.col("n_lines").isNull(), "waiting_for_lines"), (F.col("c_mktsegment").isNull(), "owner_review"), (F.col("returned") * 2 > F.col("n_lines"), "manual_review"), (F.col("o_orderstatus") == "F", "done"), (F.col("n_lines") >= 6, "priority")], "standard",
    )
    return stage_rows(spark, sf_dir).groupBy(lane.alias("lane"), "o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


def promotion_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps each order from promotion; none means it is promoted."""
    blockers = names_where({"no_lines": F.col("n_lines").isNull(), "no_owner": F.col("c_mktsegment").isNull(), "open": F.col("o_orderstatus") != "F", "low_value": F.col("o_totalprice") < 100_000, "returns": F.coalesce("returned", F.lit(0)) > 1})
    return stage_rows(spark, sf_dir).select("o_orderkey", F.array_join(blockers, ",").alias("blockers"), F.size(blockers).cast("long").alias("n_blockers"), (F.size(blockers) == 0).alias("promoted"))


def history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand: years with sales, first and last, gap to the corpus' last year, strength buckets and the capped weighted count."""
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"), "l_quantity")
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    # by part and year before the join: at most a few rows a part are shuffled
    by_part = lines.groupBy("l_partkey", "y").agg(F.count_if(F.col("l_quantity") >= 40).alias("s"), F.count_if((F.col("l_quantity") >= 20) & (F.col("l_quantity") < 40)).alias("m"), F.count_if(F.col("l_quantity") < 20).alias("c"))
    g = by_part.join(part, "l_partkey").groupBy("p_brand").agg(F.sum("s").alias("s"), F.sum("m").alias("m"), F.sum("c").alias("c"), F.sort_array(F.collect_set("y")).alias("years"))
    top = by_part.agg(F.max("y").alias("corpus_last"))
    weight = F.least("s", F.lit(8)) + F.least("m", F.lit(6)) * 0.5 + F.least("c", F.lit(4)) * 0.25
    return g.join(F.broadcast(top)).select("p_brand", (F.col("s") + F.col("m") + F.col("c")).alias("matched"), weight.cast("double").alias("weighted"), F.array_join("years", ",").alias("years"), F.size("years").cast("long").alias("n_years"), F.array_min("years").alias("first_year"), F.array_max("years").alias("last_year"), (F.col("corpus_last") - F.array_max("years")).alias("years_since"))


def priority_recent5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part type: different orders of all time and of the five last years of the whole table, with the rank of the latter."""
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", F.year("l_shipdate").alias("y"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    top = lines.agg(F.max("y").alias("top"))
    per_order = lines.join(part, "l_partkey").groupBy("p_type", "l_orderkey").agg(F.max("y").alias("y"))
    g = per_order.join(F.broadcast(top)).groupBy("p_type").agg(F.count("*").alias("orders_all"), F.count_if(F.col("y") >= F.col("top") - 4).alias("orders_recent"), (F.first("top") - 4).alias("recent_start"))
    return g.withColumn("place", F.rank().over(W.orderBy(F.desc("orders_recent"), "p_type")).cast("long"))  # a row a type: the window is small by nature


QUERIES = {f.__name__: f for f in (asof_version, asof_window_conflict, effective_profile, stage_router, promotion_blockers, history_stats, priority_recent5)}

CHAIN = "(select o_custkey law, o_orderkey version_id, cast(o_orderdate as date) version_date, case when o_orderkey % 17 <> 0 then cast(o_orderdate as date) + cast(o_orderkey % 30 as integer) end effective_date from orders)"
FACT = "(select l_orderkey, l_linenumber, l_partkey, o_custkey law, cast(l_shipdate as date) exam_date, row_number() over () as k from lineitem join orders on o_orderkey = l_orderkey)"
STAGES = """(select o.o_orderkey, o.o_orderstatus, o.o_totalprice, n_lines, returned, c_mktsegment from orders o left join (select l_orderkey, count(*) n_lines, count(*) filter (where l_returnflag = 'R') returned from lineitem group by 1) l on l.l_orderkey = o.o_orderkey
 left join (select * from customer where c_acctbal > 0) c on c.c_custkey = o.o_custkey)"""
ORACLE = {
    "asof_version": f"""with f as {FACT}, v as {CHAIN}, j as (select f.k, v.version_id, row_number() over (partition by f.k order by v.version_date desc, v.version_id) r from f join v on v.law = f.law and v.effective_date <= f.exam_date and v.version_date <= f.exam_date)
 select f.l_orderkey, f.l_linenumber, f.l_partkey, f.law, f.exam_date, j.version_id from f left join j on j.k = f.k and j.r = 1""",
    "asof_window_conflict": f"""with f as materialized (select * from {FACT} x), v as {CHAIN},
 a as (select f.k, v.version_id, row_number() over (partition by f.k order by v.version_date desc, v.version_id) r from f join v on v.law = f.law and v.effective_date <= f.exam_date and v.version_date <= f.exam_date),
 b as (select f.k, v.version_id, row_number() over (partition by f.k order by v.version_date desc, v.version_id) r from f join v on v.law = f.law and v.effective_date <= f.exam_date + 30 and v.version_date <= f.exam_date + 30),
 o as (select law, min(version_date) s from v where effective_date is null group by 1)
 select cast(year(exam_date) as integer) exam_year, case when s <= exam_date + 30 then 'effective_date_review' when b.version_id is null then 'no_version' when a.version_id is distinct from b.version_id then 'window_conflict' else 'selected' end state,
 count(*) n, count(distinct f.law) laws from f left join a on a.k = f.k and a.r = 1 left join b on b.k = f.k and b.r = 1 left join o on o.law = f.law group by 1, 2""",
    "effective_profile": """with p(profile, f, l) as (values ('old', date '1995-01-01', date '1998-12-31'), ('bridge', date '1997-06-01', date '1999-06-30'), ('new', date '1999-01-01', date '2001-12-31')),
 j as (select o_orderkey, profile, row_number() over (partition by o_orderkey order by f desc) r from orders left join p on cast(o_orderdate as date) between f and l) select o_orderkey, profile from j where r = 1""",
    "stage_router": f"""select case when n_lines is null then 'waiting_for_lines' when c_mktsegment is null then 'owner_review' when returned * 2 > n_lines then 'manual_review' when o_orderstatus = 'F' then 'done' when n_lines >= 6 then 'priority' else 'standard' end lane,
 o_orderstatus, count(*) n, min(o_orderkey) first_order from {STAGES} group by 1, 2""",
    "promotion_blockers": f"""with b as (select o_orderkey, concat_ws(',', case when n_lines is null then 'no_lines' end, case when c_mktsegment is null then 'no_owner' end, case when o_orderstatus <> 'F' then 'open' end, case when o_totalprice < 100000 then 'low_value' end, case when coalesce(returned, 0) > 1 then 'returns' end) blockers,
 cast((n_lines is null)::int + (c_mktsegment is null)::int + (o_orderstatus <> 'F')::int + (o_totalprice < 100000)::int + (coalesce(returned, 0) > 1)::int as bigint) n_blockers from {STAGES}) select *, n_blockers = 0 promoted from b""",
    "history_stats": """with j as (select p_brand, cast(year(l_shipdate) as integer) y, l_quantity q from lineitem join part on p_partkey = l_partkey),
 g as (select p_brand, count(*) filter (where q >= 40) s, count(*) filter (where q >= 20 and q < 40) m, count(*) filter (where q < 20) c, string_agg(distinct cast(y as varchar), ',' order by cast(y as varchar)) as years, count(distinct y) n_years, min(y) first_year, max(y) last_year from j group by 1)
 select p_brand, s + m + c matched, cast(least(s, 8) + least(m, 6) * 0.5 + least(c, 4) * 0.25 as double) weighted, years, n_years, first_year, last_year, (select max(cast(year(l_shipdate) as integer)) from lineitem) - last_year years_since from g""",
    "priority_recent5": """with t as (select max(year(l_shipdate)) top from lineitem), g as (select p_type, count(distinct l_orderkey) orders_all, count(distinct l_orderkey) filter (where year(l_shipdate) >= (select top from t) - 4) orders_recent from lineitem join part on p_partkey = l_partkey group by 1)
 select *, cast((select top from t) - 4 as integer) recent_start, rank() over (order by orders_recent desc, p_type) place from g""",
}
