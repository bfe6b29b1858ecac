"""Row checks as data, their roll-ups, group completeness, grading, sampling and answer evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import half_even
from tidemark.operators.rules import RISKS, STATUSES, Rule, check, ladder, rank_of
from tidemark.sources.tables import read, values


def line_rules() -> list[Rule]:
    c = F.col
    return [
        Rule("quantity_range", "official", "blocked", "critical", "quantity must be 1 to 49", ~c("l_quantity").between(1, 49)),
        Rule("flag_known", "official", "blocked", "high", "unknown return flag", ~c("l_returnflag").isin("A", "N", "R")),
        Rule("ship_before_open", "official", "review", "medium", "shipped before the window", c("l_shipdate") < F.lit("1995-03-01").cast("timestamp_ntz")),
        Rule("discount_high", "enrichment", "review", "medium", "discount over 9 %", c("l_discount") > 0.09),
        Rule("tax_high", "enrichment", "warning", "low", "tax over 7 %", c("l_tax") > 0.07),
        Rule("flag_state", "enrichment", "warning", "low", "returned but open", (c("l_returnflag") == "R") & (c("l_linestatus") == "O")),
    ]


RULES_SQL = """(select l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_shipdate, l_discount, l_tax, l_partkey, l_suppkey,
 not (l_quantity between 1 and 49) r1, l_returnflag not in ('A', 'N', 'R') r2, l_shipdate < timestamp '1995-03-01' r3, l_discount > 0.09 r4, l_tax > 0.07 r5, (l_returnflag = 'R' and l_linestatus = 'O') r6 from lineitem)"""
GRADE_SQL = "(case when r1 or r2 then 4 when r3 or r4 then 3 when r5 or r6 then 2 else 1 end)"
STATUS_SQL = f"(case {GRADE_SQL} when 4 then 'blocked' when 3 then 'review' when 2 then 'warning' else 'passed' end)"


def qa_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken rule of every row."""
    found = check(read(spark, sf_dir, "lineitem"), line_rules())
    return found.select("l_orderkey", "l_linenumber", F.explode("issues").alias("i")).select("l_orderkey", "l_linenumber", "i.rule_id", "i.layer", "i.status", "i.risk")


def qa_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By return flag: rows, rows of each worst status, issues by layer, whether it can be released."""
    found = check(read(spark, sf_dir, "lineitem"), line_rules())
    layer = lambda name: F.sum(F.size(F.filter("issues", lambda i: i["layer"] == name))).cast("long")
    return found.groupBy("l_returnflag").agg(
        F.count("*").alias("n_rows"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), layer("official").alias("official_issues"), layer("enrichment").alias("enrichment_issues"),
        ((F.count_if(F.col("status") == "blocked") == 0) & (F.count_if(F.col("status") == "review") == 0)).alias("release_ready"),
    )


def qa_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By line status: health ladder, share of passed rows to two places, the two rules that break most."""
    found = check(read(spark, sf_dir, "lineitem"), line_rules())
    n = found.groupBy("l_linestatus").agg(F.count("*").alias("n_rows"), F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "blocked").alias("blocked"), F.count_if(F.col("status") == "review").alias("review"))
    by_rule = found.select("l_linestatus", F.explode("issues.rule_id").alias("rule")).groupBy("l_linestatus", "rule").agg(F.count("*").alias("n"))
    top = by_rule.groupBy("l_linestatus").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "rule"))), 1, 2).alias("t"))
    health = ladder([(F.col("blocked") > 0, "blocked"), (20 * F.col("review") > F.col("n_rows"), "attention"), (F.col("review") > 0, "watch")], "healthy")
    return n.join(top, "l_linestatus").select("l_linestatus", "n_rows", "passed", "blocked", "review", half_even(100.0 * F.col("passed") / F.col("n_rows"), 2).alias("passed_pct"), health.alias("health"), F.array_join(F.transform("t", lambda x: x["rule"]), ",").alias("top_rules"))


def worst_of_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's worst status and risk, by ordinal rank; unknown grades count as worst."""
    found = check(read(spark, sf_dir, "lineitem"), line_rules())
    name = lambda c, order: F.element_at(F.array(*map(F.lit, order)), F.max(rank_of(F.col(c), order)))
    return found.groupBy("l_orderkey").agg(name("status", STATUSES).alias("status"), name("risk", RISKS).alias("risk"), F.sum(F.size("issues")).cast("long").alias("issues"))


def group_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order's line numbers are 1 to N without gap or repeat, and what is missing or repeated."""
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    g = g.groupBy("l_orderkey").agg(F.sum("n").alias("n_rows"), F.max("l_linenumber").alias("top"), F.sort_array(F.collect_list("l_linenumber")).alias("seen"), F.count_if(F.col("n") > 1).alias("repeated"))
    lacking = F.array_except(F.sequence(F.lit(1), "top"), "seen")
    return g.select("l_orderkey", "n_rows", F.col("top").cast("long").alias("expected"), F.size(lacking).cast("long").alias("n_missing"), F.array_join(lacking, ",").alias("missing"), "repeated", ((F.size(lacking) == 0) & (F.col("repeated") == 0)).alias("complete"))


def group_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders a priority against the expected priorities: unexpected, missing and off-count groups."""
    seen = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("ids"))
    expected = values(spark, "o_orderpriority string", [(x,) for x in ("0-NONE", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")]).withColumn("wanted", F.lit(1))
    both = seen.join(expected, "o_orderpriority", "full_outer")
    state = ladder([(F.col("wanted").isNull(), "unexpected"), (F.col("n").isNull(), "missing"), (F.col("n") != F.col("ids"), "repeated ids")], "ok")
    return both.select("o_orderpriority", F.coalesce("n", F.lit(0)).cast("long").alias("n"), state.alias("state"))


def graded(rows: DataFrame, mode: Column, accepted: Column, picked: Column) -> DataFrame:
    """rows with mode and correct. All-credit rows are correct even blank, any-answer rows if a letter is picked; an unknown mode is invalid and never correct."""
    known = F.when(mode.isin("standard", "all_credit", "any_answer"), mode).otherwise("invalid")
    right = F.when(known == "all_credit", True).when(known == "any_answer", picked.rlike("^[ABCD]$")).when(known == "standard", F.array_contains(accepted, picked)).otherwise(False)
    return rows.withColumns({"mode": known, "correct": F.coalesce(right, F.lit(False)), "answered": F.coalesce(picked != "", F.lit(False))})


def grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exams (orders) graded by line: totals and score; one invalid row blocks its exam."""
    letter = lambda n: F.substr(F.lit("ABCD"), (n % 5 + 1).cast("int"), F.lit(1))
    odd = F.col("l_partkey") % 50
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", odd.alias("odd"), letter(F.col("l_suppkey") + F.col("l_linenumber")).alias("picked"), letter(F.col("l_partkey") % 4).alias("answer"), letter((F.col("l_partkey") + 1) % 4).alias("also"))
    mode = F.when(F.col("odd") == 0, "all_credit").when(F.col("odd") == 1, "any_answer").when(F.col("odd") == 2, "?").otherwise("standard")
    accepted = F.when(F.col("odd") == 3, F.array("answer", "also")).otherwise(F.array("answer"))
    g = graded(rows, mode, accepted, F.col("picked")).groupBy("l_orderkey").agg(F.count("*").alias("total"), F.count_if("correct").alias("right"), F.count_if("answered").alias("answered"), F.count_if(F.col("mode") == "invalid").alias("invalid"))
    return g.select("l_orderkey", "total", "answered", "invalid", (F.col("invalid") > 0).alias("blocked"), F.when(F.col("invalid") == 0, F.col("right")).alias("correct"), F.when(F.col("invalid") == 0, half_even(100.0 * F.col("right") / F.col("total"), 1)).alias("score"))


def mock_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty parts of each type by weighted sampling without replacement: the largest U^(1/weight), U from a keyed hash."""
    p = read(spark, sf_dir, "part")
    u = (F.conv(F.substring(F.sha2(F.concat(F.lit("seed-1:"), F.col("p_partkey").cast("string")), 256), 1, 12), 16, 10).cast("double") + 1) / 281474976710657.0
    keyed = p.select("p_type", "p_partkey", (F.log(u) / F.col("p_size")).alias("key"))
    place = F.row_number().over(W.partitionBy("p_type").orderBy(F.desc("key"), F.desc("p_partkey")))  # each task keeps its first forty before the shuffle
    return keyed.withColumn("r", place).where("r <= 40").select("p_type", (F.col("r") - 1).cast("long").alias("place"), "p_partkey")


def golden_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers (last assistant turn of a conversation) against a contract: findings, score out of 100, verdict."""
    c = read(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "text")).alias("text"))
    size = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\r\n\u000b\f]", ""))
    low = F.lower(F.coalesce("text", F.lit("")))
    broken = {"too_short": size < 300, "too_long": size > 3000, "no_list": ~low.contains(","), "forbidden": low.contains("idiot") | low.contains("worthless"), "no_close": ~low.endswith(".")}
    cost = {"too_short": 30, "too_long": 10, "no_list": 15, "forbidden": 60, "no_close": 5}
    total = F.lit(100)
    for name, x in broken.items():
        total = total - F.when(x, cost[name]).otherwise(0)
    found = F.array_compact(F.array(*(F.when(x, F.lit(name)) for name, x in broken.items())))
    out = c.select("conv_id", size.cast("long").alias("chars"), F.array_join(found, ",").alias("findings"), F.greatest(total, F.lit(0)).cast("long").alias("score"), broken["forbidden"].alias("critical"))
    return out.select("conv_id", "chars", "findings", "score", ladder([(F.col("critical"), "fail"), (F.col("score") >= 85, "pass")], "review").alias("verdict"))


def review_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backlog by category with a check that the categories add up to the rows to review."""
    found = check(read(spark, sf_dir, "lineitem"), line_rules()).where("status in ('review', 'blocked')")
    category = ladder([(F.exists("issues", lambda i: i["rule_id"] == r), r) for r in ("quantity_range", "ship_before_open", "discount_high")], "other")
    g = found.groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))
    total = found.agg(F.count("*").alias("total"))
    return g.join(F.broadcast(total)).select("category", "n", "first_order", "total")


QUERIES = {f.__name__: f for f in (qa_issues, qa_summary, qa_dashboard, worst_of_rank, group_completeness, group_distribution, grading, mock_sample, golden_eval, review_backlog)}

GRADING_SQL = """select l_orderkey, l_partkey % 50 odd, substr('ABCD', cast((l_suppkey + l_linenumber) % 5 + 1 as integer), 1) picked,
 substr('ABCD', cast(l_partkey % 4 + 1 as integer), 1) answer, substr('ABCD', cast((l_partkey + 1) % 4 + 1 as integer), 1) also from lineitem"""

ORACLE = {
    "qa_issues": f"""with c as {RULES_SQL} {' union all '.join(f"select l_orderkey, l_linenumber, '{n}' rule_id, '{layer}' layer, '{s}' status, '{r}' risk from c where {x}" for x, n, layer, s, r in (('r1', 'quantity_range', 'official', 'blocked', 'critical'), ('r2', 'flag_known', 'official', 'blocked', 'high'), ('r3', 'ship_before_open', 'official', 'review', 'medium'), ('r4', 'discount_high', 'enrichment', 'review', 'medium'), ('r5', 'tax_high', 'enrichment', 'warning', 'low'), ('r6', 'flag_state', 'enrichment', 'warning', 'low')))}""",
    "qa_summary": f"""select l_returnflag, count(*) n_rows, count(*) filter (where {STATUS_SQL} = 'passed') passed, count(*) filter (where {STATUS_SQL} = 'warning') warning, count(*) filter (where {STATUS_SQL} = 'review') review,
 count(*) filter (where {STATUS_SQL} = 'blocked') blocked, cast(sum(r1::int + r2::int + r3::int) as bigint) official_issues, cast(sum(r4::int + r5::int + r6::int) as bigint) enrichment_issues,
 count(*) filter (where {GRADE_SQL} >= 3) = 0 release_ready from {RULES_SQL} group by 1""",
    "qa_dashboard": f"""with c as {RULES_SQL}, n as (select l_linestatus, count(*) n_rows, count(*) filter (where {GRADE_SQL} = 1) passed, count(*) filter (where {GRADE_SQL} = 4) blocked, count(*) filter (where {GRADE_SQL} = 3) review from c group by 1),
 b as (select l_linestatus, rule, count(*) k from (select l_linestatus, unnest([case when r1 then 'quantity_range' end, case when r2 then 'flag_known' end, case when r3 then 'ship_before_open' end, case when r4 then 'discount_high' end, case when r5 then 'tax_high' end, case when r6 then 'flag_state' end]) rule from c) where rule is not null group by 1, 2),
 t as (select l_linestatus, string_agg(rule, ',' order by k desc, rule) top_rules from (select *, row_number() over (partition by l_linestatus order by k desc, rule) p from b) where p <= 2 group by 1)
 select n.*, round_even(100.0::double * passed / n_rows, 2) passed_pct, case when blocked > 0 then 'blocked' when 20 * review > n_rows then 'attention' when review > 0 then 'watch' else 'healthy' end health, top_rules from n join t using (l_linestatus)""",
    "worst_of_rank": f"""with c as {RULES_SQL} select l_orderkey, case max({GRADE_SQL}) when 4 then 'blocked' when 3 then 'review' when 2 then 'warning' else 'passed' end status,
 case max(case when r1 then 4 when r2 then 3 when r3 or r4 then 2 else 1 end) when 4 then 'critical' when 3 then 'high' when 2 then 'medium' else 'low' end risk,
 cast(sum(r1::int + r2::int + r3::int + r4::int + r5::int + r6::int) as bigint) issues from c group by 1""",
    "group_completeness": """with g as (select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2), t as (select l_orderkey, cast(sum(n) as bigint) n_rows, max(l_linenumber) top, count(*) filter (where n > 1) repeated from g group by 1),
 m as (select t.l_orderkey, string_agg(cast(s.i as varchar), ',' order by s.i) missing, count(*) n_missing from t cross join (select unnest(generate_series(1, 7)) i) s left join g on g.l_orderkey = t.l_orderkey and g.l_linenumber = s.i where s.i <= t.top and g.n is null group by 1)
 select t.l_orderkey, n_rows, cast(top as bigint) expected, cast(coalesce(n_missing, 0) as bigint) n_missing, coalesce(missing, '') missing, repeated, (coalesce(n_missing, 0) = 0 and repeated = 0) complete from t left join m on m.l_orderkey = t.l_orderkey""",
    "group_distribution": """with s as (select o_orderpriority p, count(*) n, count(distinct o_orderkey) ids from orders group by 1), e(p) as (values ('0-NONE'), ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'))
 select coalesce(s.p, e.p) o_orderpriority, cast(coalesce(n, 0) as bigint) n, case when e.p is null then 'unexpected' when n is null then 'missing' when n <> ids then 'repeated ids' else 'ok' end state from s full outer join e on s.p = e.p""",
    "grading": f"""with r as ({GRADING_SQL}), g as (select l_orderkey, odd, picked, case when odd = 0 then true when odd = 1 then picked in ('A', 'B', 'C', 'D') when odd = 2 then false when odd = 3 then picked in (answer, also) else picked = answer end correct from r),
 t as (select l_orderkey, count(*) total, count(*) filter (where picked <> '') answered, count(*) filter (where odd = 2) invalid, count(*) filter (where correct) k from g group by 1)
 select l_orderkey, total, answered, invalid, invalid > 0 blocked, case when invalid = 0 then k end correct, case when invalid = 0 then round_even(100.0::double * k / total, 1) end score from t""",
    "mock_sample": """with k as (select p_type, p_partkey, ln((cast('0x' || substr(sha256('seed-1:' || cast(p_partkey as varchar)), 1, 12) as bigint) + 1)::double / 281474976710657.0::double) / p_size as key from part)
 select p_type, r - 1 place, p_partkey from (select *, row_number() over (partition by p_type order by key desc, p_partkey desc) r from k) where r <= 40""",
    "golden_eval": """with a as (select conv_id, text, row_number() over (partition by conv_id order by turn desc, text desc) r from conversations where role = 'assistant'),
 t as (select conv_id, coalesce(lower(text), '') x, length(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n\\x0b\\f]', '', 'g')) n from a where r = 1),
 b as (select conv_id, n, n < 300 b1, n > 3000 b2, not contains(x, ',') b3, contains(x, 'idiot') or contains(x, 'worthless') b4, not ends_with(x, '.') b5 from t),
 s as (select conv_id, cast(n as bigint) chars, concat_ws(',', case when b1 then 'too_short' end, case when b2 then 'too_long' end, case when b3 then 'no_list' end, case when b4 then 'forbidden' end, case when b5 then 'no_close' end) findings,
 cast(greatest(0, 100 - 30 * b1::int - 10 * b2::int - 15 * b3::int - 60 * b4::int - 5 * b5::int) as bigint) score, b4 from b)
 select conv_id, chars, findings, score, case when b4 then 'fail' when score >= 85 then 'pass' else 'review' end verdict from s""",
    "review_backlog": f"""with c as (select l_orderkey, case when r1 then 'quantity_range' when r3 then 'ship_before_open' when r4 then 'discount_high' else 'other' end category from {RULES_SQL} where {GRADE_SQL} >= 3)
 select category, count(*) n, min(l_orderkey) first_order, (select count(*) from c) total from c group by 1""",
}
