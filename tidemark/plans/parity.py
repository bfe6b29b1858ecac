"""Parity, drift, overlays, and what a change reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.relations import drift, insert_missing, orphans, overlay, symmetric_difference
from tidemark.operators.rules import ladder
from tidemark.sources.tables import read, values

FIELDS = ("c_acctbal", "c_mktsegment", "c_nationkey")


def perturbed(customer: DataFrame) -> DataFrame:
    """A second state of the customers: some gone, some changed, some new."""
    k = F.col("c_custkey")
    kept = customer.where(k % 10 != 3).withColumns({"c_acctbal": F.when(k % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")), "c_mktsegment": F.when(k % 11 != 0, F.col("c_mktsegment"))})
    return kept.unionByName(customer.where(k % 97 == 5).withColumn("c_custkey", k + 1_000_000_000))


B = """(select c_custkey, c_name, c_nationkey, case when c_custkey % 7 = 0 then c_acctbal + 1 else c_acctbal end c_acctbal, case when c_custkey % 11 <> 0 then c_mktsegment end c_mktsegment from customer where c_custkey % 10 <> 3
 union all select c_custkey + 1000000000, c_name, c_nationkey, c_acctbal, c_mktsegment from customer where c_custkey % 97 = 5)"""


def full_outer_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each state of a full comparison, and how many of the changed ones differ in each field."""
    a = read(spark, sf_dir, "customer")
    d = drift(a, perturbed(a), "c_custkey", FIELDS)
    return d.groupBy("state").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"), *(F.count_if(F.array_contains("changed", f)).alias(f"{f}_changed") for f in FIELDS))


def parity_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key that isn't the same on both sides, with the names of its differing fields."""
    a = read(spark, sf_dir, "customer")
    return drift(a, perturbed(a), "c_custkey", FIELDS).where("state != 'same'").select("c_custkey", "state", F.array_join("changed", ",").alias("changed"))


def except_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer")
    return symmetric_difference(a.select("c_custkey", *FIELDS), perturbed(a).select("c_custkey", *FIELDS))


def _patch(part: DataFrame) -> DataFrame:
    """New prices and brands for every fifth part, some null, and some for parts that don't exist."""
    k = F.col("p_partkey")
    p = part.where(k % 5 == 0).select("p_partkey", (F.col("p_retailprice") * 2).alias("p_retailprice"), F.when(k % 3 != 0, F.lit("Brand#new")).alias("p_brand"))
    return p.unionByName(part.where(k % 97 == 0).select((k + 10_000_000_000).alias("p_partkey"), "p_retailprice", "p_brand"))


def overlay_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return overlay(part, _patch(part), "p_partkey", ["p_retailprice", "p_brand"]).select("p_partkey", "p_name", "p_brand", "p_retailprice", "patched")


def overlay_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return orphans(part, _patch(part), "p_partkey").select("p_partkey", "p_brand")


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was there stays, and new keys are added once: counts by origin."""
    a = read(spark, sf_dir, "customer")
    both = insert_missing(a.select("c_custkey", F.lit("kept").alias("origin")), perturbed(a).select("c_custkey", F.lit("added").alias("origin")), ["c_custkey"])
    return both.groupBy("origin").agg(F.count("*").alias("n"), F.max("c_custkey").alias("last_key"))


def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders of 2000 against 1999 by fingerprint: changed, unchanged, vanished; without a base year no verdict."""
    o = read(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")).where("y in (1999, 2000)")
    side = lambda y: F.count_if(F.col("y") == y).alias(f"n{y}")
    prints = lambda y: F.sort_array(F.collect_set(F.when(F.col("y") == y, F.concat_ws(":", F.month("o_orderdate"), "o_orderstatus"))))
    g = o.groupBy("o_custkey").agg(side(1999), side(2000), F.sha2(F.array_join(prints(1999), ","), 256).alias("old"), F.sha2(F.array_join(prints(2000), ","), 256).alias("new"))
    state = ladder([(F.col("n1999") == 0, "baseline"), (F.col("n2000") == 0, "vanished"), (F.col("old") != F.col("new"), "changed")], "unchanged")
    return g.select("o_custkey", "n1999", "n2000", F.substring("new", 1, 24).alias("fingerprint"), state.alias("state"))


def impact_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed names to the documents whose text has them as a word: reached documents by name; names that reach none stay with 0."""
    rows = [("thand", True), ("leaux", True), ("heitge", True), ("con", True), ("thes", False), ("zzz", True)]
    changed, names = values(spark, "name string, changed boolean", rows), [n for n, moved in rows if moved]
    found = F.array_intersect(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z]+"), F.array(*map(F.lit, names)))
    hit = read(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(found).alias("name"))
    g = hit.groupBy("name").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.count_distinct("lang").alias("langs"))
    out = F.broadcast(changed).join(g, "name", "left")
    return out.select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n_docs"), "first_doc", F.coalesce("langs", F.lit(0)).cast("long").alias("langs"), ladder([(~F.col("changed"), "unchanged"), (F.col("n").isNull(), "no_document")], "review").alias("action"))


def trust_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers trusted only if all their names are registered, unchanged, of the current batch and not too old."""
    nation = read(spark, sf_dir, "nation")
    registry = nation.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 6 == 0, "changed").otherwise("unchanged").alias("state"), F.when(F.col("n_nationkey") % 5 == 0, 1).otherwise(2).alias("batch"), ((F.col("n_nationkey") * 3) % 20).alias("age_days")).where("age_days != 9")
    s = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    named = s.select("s_suppkey", F.explode(F.array("n_name", F.concat(F.lit("NATION_"), ((F.col("n_nationkey") + 1) % 25).cast("string")))).alias("name"))
    j = named.join(F.broadcast(registry), "name", "left")
    g = j.groupBy("s_suppkey").agg(F.count("*").alias("names"), F.count_if(F.col("state").isNull()).alias("unknown"), F.count_if(F.col("state") == "changed").alias("changed"), F.count_if(F.col("batch") != 2).alias("other_batch"), F.max("age_days").alias("age"))
    reason = ladder([(F.col("unknown") > 0, "not_registered"), (F.col("changed") > 0, "changed"), (F.col("other_batch") > 0, "other_batch"), (F.col("age") > 14, "too_old")], "trusted")
    return g.select("s_suppkey", "names", reason.alias("reason"), (reason == "trusted").alias("trusted"))


QUERIES = {f.__name__: f for f in (full_outer_drift, parity_fields, except_symmetric, overlay_apply, overlay_orphans, carry_forward, change_detect, impact_fanout, trust_join)}

DRIFT = f"""(select coalesce(a.c_custkey, b.c_custkey) c_custkey, case when b.c_custkey is null then 'missing' when a.c_custkey is null then 'extra'
 when a.c_acctbal is distinct from b.c_acctbal or a.c_mktsegment is distinct from b.c_mktsegment or a.c_nationkey is distinct from b.c_nationkey then 'changed' else 'same' end state,
 a.c_custkey is not null and b.c_custkey is not null and a.c_acctbal is distinct from b.c_acctbal d1, a.c_custkey is not null and b.c_custkey is not null and a.c_mktsegment is distinct from b.c_mktsegment d2,
 a.c_custkey is not null and b.c_custkey is not null and a.c_nationkey is distinct from b.c_nationkey d3 from customer a full outer join {B} b on a.c_custkey = b.c_custkey)"""
PATCH = """(select p_partkey, p_retailprice * 2 p_retailprice, case when p_partkey % 3 <> 0 then 'Brand#new' end p_brand from part where p_partkey % 5 = 0 union all select p_partkey + 10000000000, p_retailprice, p_brand from part where p_partkey % 97 = 0)"""
ORACLE = {
    "full_outer_drift": f"select state, count(*) n, min(c_custkey) first_key, count(*) filter (where d1) c_acctbal_changed, count(*) filter (where d2) c_mktsegment_changed, count(*) filter (where d3) c_nationkey_changed from {DRIFT} group by 1",
    "parity_fields": f"select c_custkey, state, concat_ws(',', case when d1 then 'c_acctbal' end, case when d2 then 'c_mktsegment' end, case when d3 then 'c_nationkey' end) changed from {DRIFT} where state <> 'same'",
    "except_symmetric": f"""with a as (select c_custkey, c_acctbal, c_mktsegment, c_nationkey from customer), b as (select c_custkey, c_acctbal, c_mktsegment, c_nationkey from {B})
 select * from ((select * from a except select * from b) union all (select * from b except select * from a))""",
    "overlay_apply": f"""select p.p_partkey, p.p_name, case when x.p_partkey is not null then x.p_brand else p.p_brand end p_brand, case when x.p_partkey is not null then x.p_retailprice else p.p_retailprice end p_retailprice, x.p_partkey is not null patched
 from part p left join {PATCH} x on x.p_partkey = p.p_partkey""",
    "overlay_orphans": f"select x.p_partkey, x.p_brand from {PATCH} x left join part p on p.p_partkey = x.p_partkey where p.p_partkey is null",
    "carry_forward": f"""select origin, count(*) n, max(c_custkey) last_key from (select c_custkey, 'kept' origin from customer union all select c_custkey, 'added' from {B} where c_custkey not in (select c_custkey from customer)) group by 1""",
    "change_detect": """with o as (select o_custkey, year(o_orderdate) y, cast(month(o_orderdate) as varchar) || ':' || o_orderstatus f from orders where year(o_orderdate) in (1999, 2000)),
 g as (select o_custkey, count(*) filter (where y = 1999) n1999, count(*) filter (where y = 2000) n2000, coalesce(string_agg(distinct f, ',' order by f) filter (where y = 1999), '') a, coalesce(string_agg(distinct f, ',' order by f) filter (where y = 2000), '') b from o group by 1)
 select o_custkey, n1999, n2000, substr(sha256(b), 1, 24) fingerprint, case when n1999 = 0 then 'baseline' when n2000 = 0 then 'vanished' when a <> b then 'changed' else 'unchanged' end state from g""",
    "impact_fanout": """with c(name, changed) as (values ('thand', true), ('leaux', true), ('heitge', true), ('con', true), ('thes', false), ('zzz', true)),
 w as (select doc_id, lang, unnest(list_distinct(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'))) as name from documents),
 g as (select w.name, count(*) n, min(doc_id) first_doc, count(distinct lang) langs from w join c on c.name = w.name where c.changed group by 1)
 select c.name, cast(coalesce(n, 0) as bigint) n_docs, first_doc, cast(coalesce(langs, 0) as bigint) langs, case when not changed then 'unchanged' when n is null then 'no_document' else 'review' end as action from c left join g on g.name = c.name""",
    "trust_join": """with r as (select n_name as name, case when n_nationkey % 6 = 0 then 'changed' else 'unchanged' end state, case when n_nationkey % 5 = 0 then 1 else 2 end batch, (n_nationkey * 3) % 20 age from nation where (n_nationkey * 3) % 20 <> 9),
 s as (select s_suppkey, n_name as name from supplier join nation on n_nationkey = s_nationkey union all select s_suppkey, 'NATION_' || cast((n_nationkey + 1) % 25 as varchar) from supplier join nation on n_nationkey = s_nationkey),
 g as (select s_suppkey, count(*) names, count(*) filter (where state is null) u, count(*) filter (where state = 'changed') c, count(*) filter (where batch <> 2) o, max(age) age from s left join r on r.name = s.name group by 1),
 t as (select s_suppkey, names, case when u > 0 then 'not_registered' when c > 0 then 'changed' when o > 0 then 'other_batch' when age > 14 then 'too_old' else 'trusted' end reason from g) select *, reason = 'trusted' trusted from t""",
}
