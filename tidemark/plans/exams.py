"""Exam sessions: the question and essay checks, their sessions, enrichment decisions and routes, answer keys, structure, option triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import host
from tidemark.operators.rules import ladder, names_where
from tidemark.plans.derived import pick, quoted, sql_list, sql_pick
from tidemark.sources.tables import read

#: The exam's shape, its states and modes, and the patterns of law and of tasks with several parts.
SUBJECTS = ("社會工作", "社會工作直接服務", "社會政策與社會立法", "人類行為與社會環境", "社會工作研究方法")
ROUNDS = {"1": "第一次", "第1次": "第一次", "第一次": "第一次", "第一試": "第一次", "2": "第二次", "第2次": "第二次", "第二次": "第二次", "第二試": "第二次"}
TOTAL, EACH, LAST = {"mcq": 200, "essay": 10}, {"mcq": 40, "essay": 2}, {"mcq": 40, "essay": 2}
MODES, SPECIAL, MARKER = ("standard", "all_credit", "any_answer"), ("all_credit", "any_answer"), "一律給分"
READY, PENDING, MANUAL = ("ready", "done", "reviewed", "verified", "complete"), ("pending", "analyzing", ""), ("review",)
CHECKED, CHECKED_LAW, CHANGED_LAW = ("current", "checked", "verified", "historical_checked"), ("current", "checked", "verified", "verified_current", "historical_checked"), ("changed",)
LEGAL = (
    "家庭暴力防治法", "老人福利法", "社會救助法", "社會工作師法", "性別平等工作法", "兒童及少年福利與權益保障法", "兒童及少年性剝削防制條例", "長期照顧服務法", "性侵害犯罪防治法",
    r"第\s*[0-9一二三四五六七八九十百]+\s*條(?:之\s*[0-9一二三四五六七八九十百]+)?(?:$|[\s，、。；：規定第項款])", "修正", "公布", "施行", "政策綱領", "計畫第?[一二三四五六七八九十0-9]+期",
)
PARTS = ("（一）", "（二）", "並說明", "並比較", "並舉例", "並提出", "分別說明")
ALIASES = {"性別工作平等法": "性別平等工作法", "兩公約施行法": "公民與政治權利國際公約及經濟社會文化權利國際公約施行法"}
NAMES = ("家庭暴力防治法", "老人福利法", "社會救助法", "性別平等工作法", "公民與政治權利國際公約及經濟社會文化權利國際公約施行法")
REQUIRED = ("major", "topic", "keywords", "exp_why", "exp_others", "exp_trap", "mnemonic", "extension", "mistake")
BOUND = ("topic", "keywords", "exp_why", "exp_others", "exp_trap", "mnemonic", "extension", "law")
ARTIFACTS = ("na", "nb", "nc", "nd")
DECISIONS = {"passed": ("high", "publish"), "passed_sanitized": ("medium", "publish_sanitized"), "needs_review": ("low", "hold_for_review"), "blocked": ("blocked", "block_enrichment"), "pending_generation": ("not_applicable", "hold_generation")}
STATUSES, RISKS = ("passed", "passed_sanitized", "needs_review", "blocked"), ("low", "medium", "high", "critical")
#: Laws of the current watch: found, and changed since.
WATCH = {"家庭暴力防治法": (True, False), "老人福利法": (True, True), "社會救助法": (True, False), "社會工作師法": (False, False)}

STEMS = ("下列有關個案工作之敘述何者正確？", "依《社會救助法》第3條規定，何者正確？", "關於家庭暴力防治法修正，何者錯誤？", "研究法之信度與效度", "老人福利法與社會救助法之比較 CRPD 2023", "", "政策綱領第二期")
WHYS = ("因為 A 選項正確", "依社會救助法第3條", "DSM-5 指出 40% 的個案", "正確說明", "", "OECD 報告 nb")
OTHERS = ("B：錯誤。C 選項：不當", "A：與題意不符", "選項 D：錯", "", "其餘均非")
LAW_FIELDS = ("社會救助法", "性別工作平等法", "不存在之法", "", None)
ESSAY_STEMS = ("請說明社會工作之倫理，並舉例", "依老人福利法，（一）說明（二）比較", "請論述個案管理", "", "家庭暴力防治法施行後之變化，並提出建議", "第5條之2規定為何？")


def mcqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each order, 200 a session, with a fault here and there."""
    i = F.col("o_orderkey")
    j, s = i % 200, F.floor(i / 200)
    every = lambda n, bad, good: F.when(i % n == 0, bad).otherwise(good)
    mode = every(331, "", every(337, "bonus", every(89, "all_credit", every(83, "any_answer", F.lit("standard")))))
    answer = F.when(mode.isin(*SPECIAL), every(5, "A", F.lit(MARKER))).otherwise(every(347, MARKER, every(349, "e", pick("o_orderkey", ("A", "b", "C ", "D")))))
    accepted = F.when(i % 61 == 0, F.array(F.lit("A"), F.lit("B"))).when(i % 359 == 0, F.array().cast("array<string>")).when(i % 367 == 0, F.array(F.lit("A"), F.lit("A"))).when(i % 373 == 0, F.array(F.lit("X")))
    return read(spark, sf_dir, "orders").select(
        every(307, "", every(311, "dup", F.concat(F.lit("q"), i.cast("string")))).alias("id"), every(313, "外科", F.element_at(F.array(*map(F.lit, SUBJECTS)), (F.floor(j / 40) + 1).cast("int"))).alias("subject"),
        every(317, "99", (100 + F.floor(s / 2)).cast("string")).alias("year"), F.when(s % 2 == 0, pick("o_orderkey", ("1", "第1次", "第一次", "第一試"))).otherwise(pick("o_orderkey", ("2", "第二次"))).alias("round"),
        every(319, "x", (j % 40 + 1).cast("string")).alias("qno"), pick("o_orderkey", STEMS, 3).alias("question"), every(323, "", F.lit("甲")).alias("opt_a"), F.lit("乙").alias("opt_b"), every(329, F.lit(None).cast("string"), F.lit("丙 3")).alias("opt_c"), F.lit("丁").alias("opt_d"),
        every(101, "", F.lit("code")).alias("source_exam_code"), mode.alias("grading_mode"), answer.alias("answer"), accepted.alias("accepted"), pick("o_orderkey", ("", "current", "changed", "verified_current"), 7).alias("legal_status"),
        pick("o_orderkey", ("ready", "pending", "done", "review", "?"), 11).alias("analysis_status"), pick("o_orderkey", WHYS, 2).alias("exp_why"), pick("o_orderkey", OTHERS, 5).alias("exp_others"), pick("o_orderkey", LAW_FIELDS, 3, 1).alias("law"),
        every(13, "", F.lit("概念")).alias("topic"), (100 + F.floor(s / 2)).cast("string").alias("in_year"), F.when(s % 2 == 0, "第一次").otherwise("第二次").alias("in_round"), i.alias("row"),
    )


def _every(n: int, bad: str, good: str) -> str:
    return f"case when o_orderkey % {n} = 0 then {bad} else {good} end"


K = "o_orderkey"
MODE_SQL = _every(331, "''", _every(337, "'bonus'", _every(89, "'all_credit'", _every(83, "'any_answer'", "'standard'"))))
MCQS = f"""m0 as (select *, {MODE_SQL} grading_mode, o_orderkey % 200 j, o_orderkey // 200 s from orders),
 mcqs as (select {_every(307, "''", _every(311, "'dup'", "'q' || cast(o_orderkey as varchar)"))} id, {_every(313, "'外科'", f"{sql_list(SUBJECTS)}[cast(j // 40 + 1 as integer)]")} subject, {_every(317, "'99'", "cast(100 + s // 2 as varchar)")} as year,
 case when s % 2 = 0 then {sql_pick(K, ('1', '第1次', '第一次', '第一試'))} else {sql_pick(K, ('2', '第二次'))} end as round, {_every(319, "'x'", "cast(j % 40 + 1 as varchar)")} qno, {sql_pick(K, STEMS, 3)} question, {_every(323, "''", "'甲'")} opt_a, '乙' opt_b, {_every(329, 'null', "'丙 3'")} opt_c, '丁' opt_d,
 {_every(101, "''", "'code'")} source_exam_code, grading_mode, case when grading_mode in ('all_credit', 'any_answer') then {_every(5, "'A'", quoted(MARKER))} else {_every(347, quoted(MARKER), _every(349, "'e'", sql_pick(K, ('A', 'b', 'C ', 'D'))))} end answer,
 case when o_orderkey % 61 = 0 then ['A', 'B'] when o_orderkey % 359 = 0 then [] when o_orderkey % 367 = 0 then ['A', 'A'] when o_orderkey % 373 = 0 then ['X'] end accepted, {sql_pick(K, ('', 'current', 'changed', 'verified_current'), 7)} legal_status,
 {sql_pick(K, ('ready', 'pending', 'done', 'review', '?'), 11)} analysis_status, {sql_pick(K, WHYS, 2)} exp_why, {sql_pick(K, OTHERS, 5)} exp_others, {sql_pick(K, LAW_FIELDS, 3, 1)} law, {_every(13, "''", "'概念'")} topic,
 cast(100 + s // 2 as varchar) in_year, case when s % 2 = 0 then '第一次' else '第二次' end in_round, o_orderkey as row from m0)"""


def essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An essay for each part, ten a session."""
    i = F.col("p_partkey")
    j, s = i % 10, F.floor(i / 10)
    every = lambda n, bad, good: F.when(i % n == 0, bad).otherwise(good)
    return read(spark, sf_dir, "part").select(
        every(107, "", every(109, "dup", F.concat(F.lit("e"), i.cast("string")))).alias("id"), every(113, "外科", F.element_at(F.array(*map(F.lit, SUBJECTS)), (F.floor(j / 2) + 1).cast("int"))).alias("subject"),
        every(127, "99", (100 + F.floor(s / 2)).cast("string")).alias("year"), F.when(s % 2 == 0, pick("p_partkey", ("1", "第一試"))).otherwise(pick("p_partkey", ("第2次", "第二次"))).alias("round"), every(131, "3", (j % 2 + 1).cast("string")).alias("qno"),
        pick("p_partkey", ESSAY_STEMS, 3).alias("question"), every(31, "", F.lit("code")).alias("source_exam_code"), every(37, F.lit(None).cast("string"), F.lit("https://x")).alias("source_url"), pick("p_partkey", ("ready", "pending"), 5).alias("analysis_status"),
        (100 + F.floor(s / 2)).cast("string").alias("in_year"), F.when(s % 2 == 0, "第一次").otherwise("第二次").alias("in_round"), i.alias("row"),
    )


ESSAYS = f"""e0 as (select *, p_partkey % 10 j, p_partkey // 10 s from part),
 essays as (select case when p_partkey % 107 = 0 then '' when p_partkey % 109 = 0 then 'dup' else 'e' || cast(p_partkey as varchar) end id, case when p_partkey % 113 = 0 then '外科' else {sql_list(SUBJECTS)}[cast(j // 2 + 1 as integer)] end subject,
 case when p_partkey % 127 = 0 then '99' else cast(100 + s // 2 as varchar) end as year, case when s % 2 = 0 then {sql_pick('p_partkey', ('1', '第一試'))} else {sql_pick('p_partkey', ('第2次', '第二次'))} end as round, case when p_partkey % 131 = 0 then '3' else cast(j % 2 + 1 as varchar) end qno,
 {sql_pick('p_partkey', ESSAY_STEMS, 3)} question, case when p_partkey % 31 = 0 then '' else 'code' end source_exam_code, case when p_partkey % 37 <> 0 then 'https://x' end source_url, {sql_pick('p_partkey', ('ready', 'pending'), 5)} analysis_status,
 cast(100 + s // 2 as varchar) in_year, case when s % 2 = 0 then '第一次' else '第二次' end in_round, p_partkey as row from e0)"""


def canonical_round(x: Column) -> Column:
    """The name of a session's round; one without an alias stays."""
    return F.coalesce(F.create_map(*(F.lit(v) for kv in ROUNDS.items() for v in kv))[F.trim(x)], F.trim(x))


ROUND_SQL = "case {x} " + " ".join(f"when {quoted(a)} then {quoted(b)}" for a, b in ROUNDS.items()) + " else {x} end"


def pattern_hits(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike("(?i)" + p), F.lit(p)) for p in patterns)))


def _sql_patterns(text: str, patterns: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"regexp_matches({text}, {quoted('(?i)' + p)})" for p in patterns) + ")"


def watch_clears(text: Column) -> Column:
    """Whether the text names watched laws, all of them found and none changed."""
    found = F.filter(F.array(*map(F.lit, WATCH)), lambda n: F.contains(text, n))
    fresh = F.array(*(F.lit(n) for n, (seen, changed) in WATCH.items() if seen and not changed))
    return (F.size(found) > 0) & (F.size(F.array_except(found, fresh)) == 0)


WATCH_SQL = "(({any}) and not ({bad}))".format(any=" or ".join(f"contains({{t}}, {quoted(n)})" for n in WATCH), bad=" or ".join(f"contains({{t}}, {quoted(n)})" for n, (seen, changed) in WATCH.items() if changed or not seen))


def issues(rows: DataFrame, rules: list[tuple[str, str, str, str, Column]]) -> DataFrame:
    """rows with issues (rule, layer, status, risk): the broken rules. A condition that is null is broken: checks fail closed."""
    one = lambda r: F.struct(*(F.lit(x).alias(n) for x, n in zip(r[:4], ("rule", "layer", "status", "risk"), strict=True)))
    return rows.withColumn("issues", F.array_compact(F.array(*(F.when(F.coalesce(r[4], F.lit(True)), one(r)) for r in rules))))


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def _number(name: str, most: int) -> Column:
    """Not a whole number from 1 to most."""
    value = F.trim(F.col(name))
    return ~(value.rlike("^[0-9]+$") & value.try_cast("int").between(1, most))


def _core(kind: str) -> list[tuple[str, str, str, str, Column]]:
    """What questions and essays have in common."""
    c, p = F.col, kind.upper()
    bad = lambda rule, condition: (f"{p}_{rule}", "official_core", "blocked", "critical", condition)
    moved = (F.trim(c("year")) != c("in_year")) | (canonical_round(c("round")) != c("in_round"))
    return [bad("ID_REQUIRED", c("id") == ""), bad("SUBJECT_VALID", ~F.trim(c("subject")).isin(*SUBJECTS)), bad("SESSION_MATCH", moved), bad("QNO_VALID", _number("qno", LAST[kind])), bad("QUESTION_REQUIRED", _blank("question"))]


def mcq_rules() -> list[tuple[str, str, str, str, Column]]:
    c = F.col
    mode, answer, accepted = F.trim(c("grading_mode")), F.upper(F.trim(c("answer"))), c("accepted")
    given = F.transform(accepted, lambda x: F.upper(F.trim(x)))
    letters = F.array(*map(F.lit, "ABCD"))
    standard, special, listed = mode == "standard", mode.isin(*SPECIAL), accepted.isNotNull() & (F.size(accepted) > 0)
    text = F.concat_ws("\n", "question", "law", "exp_why")
    bad = lambda rule, condition: (f"MCQ_{rule}", "official_core", "blocked", "critical", condition)
    return _core("mcq") + [
        *(bad("OPTION_REQUIRED", _blank(f"opt_{x}")) for x in "abcd"),
        ("MCQ_SOURCE_REQUIRED", "official_core", "needs_review", "high", _blank("source_exam_code")),
        bad("GRADING_MODE_EXPLICIT", mode == ""),
        bad("GRADING_MODE_VALID", (mode != "") & ~mode.isin(*MODES)),
        bad("SPECIAL_GRADING_EXPLICIT", c("answer").contains(MARKER) & ~special),
        bad("STANDARD_ANSWER_VALID", standard & ~answer.isin(*"ABCD")),
        bad("ACCEPTED_ANSWERS_SHAPE", standard & accepted.isNotNull() & (F.size(accepted) == 0)),
        bad("ACCEPTED_ANSWERS_VALID", standard & listed & ((F.size(F.array_distinct(given)) != F.size(given)) | (F.size(F.array_except(given, letters)) > 0))),
        bad("PRIMARY_IN_ACCEPTED", standard & listed & answer.isin(*"ABCD") & ~F.array_contains(given, answer)),
        bad("SPECIAL_MARKER_MATCH", special & (F.trim(c("answer")) != MARKER)),
        bad("SPECIAL_ACCEPTED_EMPTY", special & accepted.isNotNull()),
        ("ENRICHMENT_LEGAL_REVIEW", "enrichment", "needs_review", "high", (F.size(pattern_hits(text, LEGAL)) > 0) & ~F.lower(F.trim(c("legal_status"))).isin(*CHECKED) & ~watch_clears(text)),
    ]


def essay_rules() -> list[tuple[str, str, str, str, Column]]:
    review = lambda rule, condition, layer="official_core": (f"ESSAY_{rule}", layer, "needs_review", "high", condition)
    legal = (F.size(pattern_hits(F.col("question"), LEGAL)) > 0) & ~watch_clears(F.col("question"))
    return _core("essay") + [review("SOURCE_CODE_REQUIRED", _blank("source_exam_code")), review("SOURCE_URL_REQUIRED", _blank("source_url")), review("HISTORICAL_LAW_REVIEW", legal, "enrichment")]


def mcq_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken rule of every question."""
    return issues(mcqs(spark, sf_dir), mcq_rules()).select("row", F.explode("issues").alias("i")).select("row", "i.rule", "i.layer", "i.status", "i.risk")


def essay_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken rule of every essay, and how demanding the essay is."""
    q = F.col("question")
    demand = ladder([(F.size(pattern_hits(q, LEGAL)) > 0, "high"), (F.size(pattern_hits(q, PARTS)) > 0, "medium")], "low")
    found = issues(essays(spark, sf_dir).withColumn("demand", demand), essay_rules())
    return found.select("row", "demand", F.explode_outer("issues").alias("i")).select("row", "demand", "i.rule", "i.layer", "i.status", "i.risk")


def session_faults(rows: DataFrame, kind: str) -> DataFrame:
    """in_year, in_round, faults: what is wrong with a session as a whole. Numbers and ids are counted before sessions are put together."""
    c, keys = F.col, ["in_year", "in_round"]
    number = F.when(F.trim(c("qno")).rlike("^[0-9]+$"), F.trim(c("qno")).try_cast("int"))
    ids = rows.groupBy(*keys, "id").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum("n").alias("n"), F.max(((c("n") > 1) | (c("id") == "")).cast("int")).alias("twice"))
    subject = rows.groupBy(*keys, "subject").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(number)).alias("numbers"))
    whole = subject.groupBy(*keys).agg(
        F.count_if(c("subject").isin(*SUBJECTS)).alias("known"), F.count("*").alias("subjects"), F.count_if(c("subject").isin(*SUBJECTS) & (c("n") == EACH[kind])).alias("even"),
        F.count_if(c("subject").isin(*SUBJECTS) & (c("numbers") == F.sequence(F.lit(1), F.lit(LAST[kind])))).alias("covered"),
    )
    p, all_ = kind.upper(), len(SUBJECTS)
    faults = {f"{p}_SESSION_COUNT": c("n") != TOTAL[kind], f"{p}_ID_UNIQUE": c("twice") == 1, f"{p}_SUBJECT_DISTRIBUTION": (c("subjects") != all_) | (c("even") != all_), f"{p}_QNO_COVERAGE": c("covered") != all_}
    return ids.join(whole, keys).select(*keys, "n", names_where(faults).alias("faults"))


def exam_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of questions and essays: size and faults."""
    both = session_faults(mcqs(spark, sf_dir), "mcq").withColumn("kind", F.lit("mcq")).unionByName(session_faults(essays(spark, sf_dir), "essay").withColumn("kind", F.lit("essay")))
    return both.select("kind", F.col("in_year").alias("year"), F.col("in_round").alias("round"), "n", F.array_join("faults", ",").alias("faults"))


def _graded(rows: DataFrame) -> DataFrame:
    """rows with official and enrichment status, and the generation state."""
    of = lambda layer: ladder([(F.exists("issues", lambda i: (i["layer"] == layer) & (i["status"] == s)), s) for s in ("blocked", "needs_review")], "passed")
    state = F.when(F.lower(F.trim("analysis_status")).isin(*READY), "ready").otherwise("pending_generation")
    return rows.select("in_year", "in_round", of("official_core").alias("official"), of("enrichment").alias("enrichment"), state.alias("state"))


def exam_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's report: rows by status and layer, rows for the manual queue, whether its core can be released."""
    mcq, essay = issues(mcqs(spark, sf_dir), mcq_rules()), issues(essays(spark, sf_dir), essay_rules())
    rows = _graded(mcq).withColumn("kind", F.lit("mcq")).unionByName(_graded(essay).withColumn("kind", F.lit("essay")))
    n = lambda name, value: F.count_if(F.col(name) == value)
    g = rows.groupBy("kind", "in_year", "in_round").agg(
        F.count("*").alias("items"), *(n("official", s).alias(f"core_{s}") for s in ("passed", "needs_review", "blocked")), *(n("enrichment", s).alias(f"enrichment_{s}") for s in ("passed", "needs_review")),
        n("state", "pending_generation").alias("pending"), F.count_if((F.col("official") != "passed") | (F.col("enrichment") != "passed")).alias("manual"),
    )
    s = exam_sessions(spark, sf_dir).select("kind", F.col("year").alias("in_year"), F.col("round").alias("in_round"), "faults")
    ready = (F.col("faults") == "") & (F.col("core_blocked") == 0) & (F.col("core_needs_review") == 0)
    return g.join(s, ["kind", "in_year", "in_round"]).withColumn("ready", ready).drop("faults").withColumnsRenamed({"in_year": "year", "in_round": "round"})


def exam_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus from its sessions' reports, with a check that the statuses add up to the items."""
    g = exam_reports(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("sessions"), F.count_if("ready").alias("ready"), *(F.sum(x).alias(x) for x in ("items", "core_passed", "core_needs_review", "core_blocked", "manual")))
    return g.withColumn("adds_up", F.col("core_passed") + F.col("core_needs_review") + F.col("core_blocked") == F.col("items"))


def law_names(text: Column) -> Column:
    """Canonical laws in a text: by aliases, then by name, the longest first."""
    by_alias = [F.when(F.contains(text, F.lit(a)), F.lit(n)) for a, n in ALIASES.items()]
    by_name = [F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in sorted(NAMES, key=len, reverse=True)]
    return F.array_distinct(F.array_compact(F.array(*by_alias, *by_name)))


def findings() -> dict[str, tuple[str, str, Column]]:
    """What can be wrong with a ready question's explanations: rule -> status, risk, condition."""
    c = F.col
    text = lambda *names: F.concat_ws(" ", *(F.when(F.trim(n) != "", F.trim(n)) for n in names))
    official = text("question", "opt_a", "opt_b", "opt_c", "opt_d")
    given = F.array_distinct(F.filter(F.transform(F.coalesce("accepted", F.array().cast("array<string>")), lambda x: F.upper(F.trim(x))), lambda x: x.rlike("^[ABCD]$")))
    own = F.upper(F.trim("answer"))
    answers = F.when(F.size(given) > 0, given).when(own.rlike("^[ABCD]$"), F.array(own)).otherwise(F.array().cast("array<string>"))
    source = F.concat_ws(" ", F.lit("A B C D"), official, F.array_join(answers, " "))
    made = text("topic", "exp_why", "exp_others", "law")
    words = lambda x: F.transform(F.regexp_extract_all(x, F.lit("[A-Za-z][A-Za-z0-9'’\\-]*"), F.lit(0)), F.lower)
    numbers = lambda x: F.regexp_extract_all(x, F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0))
    labels = F.transform(F.regexp_extract_all(F.trim("exp_others"), F.lit(r"(?:^|[\n。；;])\s*(?:選項\s*)?([ABCDabcd])(?:\s*選項)?\s*[：:]|(?:^|[\n。；;])\s*[ABCDabcd]\s*選項"), F.lit(0)), lambda x: F.upper(F.regexp_extract(x, "([ABCDabcd])", 1)))
    mode, legal = F.trim("grading_mode"), F.lower(F.trim("legal_status"))
    law, source_laws = F.coalesce(F.trim("law"), F.lit("")), law_names(official)
    unsupported = (law != "") & ~legal.isin("verified_current", "changed") & ((F.size(law_names(law)) == 0) | (F.size(F.array_except(law_names(law), source_laws)) > 0))
    about_law = (F.size(pattern_hits(official, LEGAL)) > 0) | (F.size(source_laws) > 0)
    known, standard = mode.isin(*MODES), mode == "standard"
    blank = F.lit(False)
    for name in ("topic", "exp_why", "exp_others"):
        blank = blank | _blank(name)
    return {
        "ENRICHMENT_REQUIRED_FIELDS": ("blocked", "critical", blank),
        "ENRICHMENT_UNKNOWN_GRADING_MODE": ("blocked", "critical", ~known),
        "ENRICHMENT_SPECIAL_GRADING": ("blocked", "critical", mode.isin(*SPECIAL)),
        "ENRICHMENT_MULTI_ANSWER_REVIEW": ("needs_review", "medium", standard & (F.size(answers) > 1)),
        "ENRICHMENT_OFFICIAL_ANSWER_MISSING": ("blocked", "critical", standard & (F.size(answers) == 0)),
        "ENRICHMENT_UNGROUNDED_ASCII": ("blocked", "critical", F.size(F.array_except(words(made), F.concat(words(source), F.array(*map(F.lit, ARTIFACTS))))) > 0),
        "ENRICHMENT_UNGROUNDED_NUMBER": ("blocked", "critical", F.size(F.array_except(numbers(made), numbers(source))) > 0),
        "ENRICHMENT_ACCEPTED_ANSWER_IN_OTHERS": ("needs_review", "high", F.arrays_overlap(labels, answers)),
        "ENRICHMENT_LAW_AUTO_DROP": ("passed_sanitized", "medium", unsupported),
        "ENRICHMENT_LAW_CHANGED_REVIEW": ("needs_review", "high", about_law & legal.isin(*CHANGED_LAW)),
        "ENRICHMENT_LEGAL_EVIDENCE_REQUIRED": ("needs_review", "high", about_law & ~legal.isin(*CHANGED_LAW, *CHECKED_LAW)),
    }


def enrichment_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for each question: what was found, status, risk, confidence and action, the route, and whether the law is dropped.

    Pending rows wait, rows that were put up for review stay there, unknown states fail closed. The legal finding goes where
    the current watch clears all laws of the question.
    """
    rules = findings()
    text = F.concat_ws(" ", *(F.when(F.trim(n) != "", F.trim(n)) for n in ("question", "opt_a", "opt_b", "opt_c", "opt_d")))
    rows = mcqs(spark, sf_dir).where("id <> ''").withColumns({"state": F.lower(F.trim("analysis_status")), "cleared": watch_clears(text)})
    hit = {n: F.coalesce(x, F.lit(True)) if n != "ENRICHMENT_LEGAL_EVIDENCE_REQUIRED" else x & ~F.col("cleared") for n, (_, _, x) in rules.items()}
    found = F.when(F.col("state").isin(*PENDING), F.array().cast("array<string>")).when(F.col("state").isin(*MANUAL), F.array(F.lit("UPSTREAM_ANALYSIS_REVIEW")))
    found = found.when(~F.col("state").isin(*READY), F.array(F.lit("UNKNOWN_ANALYSIS_STATE"))).otherwise(names_where(hit))
    rows = rows.withColumn("found", found)
    graded = {n: (s, r) for n, (s, r, _) in rules.items()} | {"UPSTREAM_ANALYSIS_REVIEW": ("needs_review", "high"), "UNKNOWN_ANALYSIS_STATE": ("needs_review", "high")}
    worst = lambda which, order: ladder([(F.arrays_overlap("found", F.array(*(F.lit(n) for n, g in graded.items() if g[which] == v))), v) for v in reversed(order[1:]) if any(g[which] == v for g in graded.values())], order[0])
    status = F.when(F.col("state").isin(*PENDING), "pending_generation").otherwise(worst(0, STATUSES))
    rows = rows.withColumns({"status": status, "risk": worst(1, RISKS)})
    of = lambda k: F.create_map(*(F.lit(v) for s, d in DECISIONS.items() for v in (s, d[k])))[F.col("status")]
    route = ladder([(F.col("status") == "passed", "ready"), (F.col("status") == "passed_sanitized", "sanitized_ready"), (F.col("status").isin("needs_review", "blocked"), "review")], None)
    return rows.select("row", F.array_join("found", ",").alias("findings"), "status", "risk", of(0).alias("confidence"), of(1).alias("action"), route.alias("route"), F.array_contains("found", "ENRICHMENT_LAW_AUTO_DROP").alias("drops_law"))


def enrichment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by status and action."""
    return enrichment_decisions(spark, sf_dir).groupBy("status", "action").agg(F.count("*").alias("n"), F.count_if("drops_law").alias("sanitized"))


#: Corrections as a key's note has them: 一律給分, blank gets nothing, several letters.
NOTES = ("第3題一律給分，第5題答A或B或AB者均給分。", "第1題未作答者不給分，其餘均給分", "", "第40題答Ｃ、Ｄ給分 第2題除未作答者不給分外，其餘均給分。第99題一律給分", "第7題更正")


def answer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key for each supplier: exam, note, and a row of 40 answers, # where the note decides."""
    i = F.col("s_suppkey")
    letters = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda n: F.when(((i + n) % 23 == 0) | (n == 3), "#").otherwise(F.substr(F.lit("ABCD"), ((i * 7 + n * n) % 4 + 1).cast("int"), F.lit(1))))
    return read(spark, sf_dir, "supplier").select(i.alias("exam"), pick("s_suppkey", NOTES).alias("note"), F.array_join(letters, "").alias("answers"))


KEYS = f"""keys as (select s_suppkey exam, {sql_pick('s_suppkey', NOTES)} note, array_to_string(list_transform(generate_series(1, 40), lambda n: case when (s_suppkey + n) % 23 = 0 or n = 3 then '#' else substr('ABCD', cast((s_suppkey * 7 + n * n) % 4 + 1 as integer), 1) end), '') answers from supplier)"""


def parsed_key(keys: DataFrame) -> DataFrame:
    """exam, qno, accepted (letters in order), mode (null where the note doesn't settle a #): a key's 40 questions.

    The last correction of a number counts; numbers outside 1 to 40 are none.
    """
    c = F.col
    note = F.translate(F.upper(F.regexp_replace("note", r"\s+", "")), "ＡＢＣＤ", "ABCD")
    parts = F.regexp_extract_all(note, F.lit("(第[0-9]{1,2}題[^第]*)"), F.lit(1))
    number, body = F.regexp_extract(c("part"), "^第([0-9]{1,2})題", 1).cast("int"), F.regexp_replace(c("part"), "^第[0-9]{1,2}題", "")
    between = F.substring_index(F.regexp_extract(body, "^[^答]*答(.*)$", 1), "給分", 1)
    letters = F.array_sort(F.array_distinct(F.regexp_extract_all(between, F.lit("[ABCD]"), F.lit(0))))
    everything = body.contains(MARKER)
    blank = body.contains("未作答者不給分") & body.contains("其餘均給分")
    mode = ladder([(everything, "all_credit"), (blank, "any_answer"), (body.contains("給分") & body.contains("答") & (F.size(letters) > 0), "standard")], None)
    given = F.when(mode == "standard", F.array_join(letters, "")).otherwise("ABCD")
    fixed = keys.select("exam", F.posexplode(parts).alias("place", "part")).select("exam", number.alias("qno"), "place", mode.alias("mode"), given.alias("given")).where("qno between 1 and 40 and mode is not null")
    fixed = fixed.groupBy("exam", "qno").agg(F.max_by(F.struct("mode", "given"), "place").alias("fix"))
    rows = keys.select("exam", F.posexplode(F.filter(F.split("answers", ""), lambda x: x != "")).alias("at", "letter")).select("exam", (c("at") + 1).alias("qno"), "letter")
    joined = rows.join(fixed, ["exam", "qno"], "left")
    plain = F.when(c("letter") != "#", c("letter"))
    return joined.select("exam", "qno", F.coalesce("fix.given", plain).alias("accepted"), F.coalesce("fix.mode", F.when(plain.isNotNull(), "standard")).alias("mode"))


def answer_keys_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By key: questions settled, special modes, unsettled numbers, and a digest of all accepted letters."""
    k = parsed_key(answer_keys(spark, sf_dir))
    line = F.sort_array(F.collect_list(F.struct("qno", F.coalesce("accepted", F.lit("?")).alias("a"))))
    g = k.groupBy("exam").agg(F.count("mode").alias("settled"), F.count_if(F.col("mode").isin(*SPECIAL)).alias("special"), F.array_sort(F.collect_list(F.when(F.col("mode").isNull(), F.col("qno")))).alias("open"), line.alias("line"))
    return g.select("exam", "settled", "special", F.array_join(F.col("open").cast("array<string>"), ",").alias("open"), F.sha2(F.array_join(F.transform("line", lambda x: x["a"]), " "), 256).alias("digest"))


def answer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official answers against stored ones by exam and number: missing, extra, other letters, another mode."""
    official = parsed_key(answer_keys(spark, sf_dir)).where("mode is not null")
    i = F.col("exam") * 40 + F.col("qno")
    stored = parsed_key(answer_keys(spark, sf_dir)).where("mode is not null").where(i % 53 != 0)
    stored = stored.withColumns({"accepted": F.when(i % 59 == 0, F.lit("A")).otherwise(F.reverse("accepted")), "mode": F.when(i % 61 == 0, "standard").otherwise(F.col("mode")), "qno": F.when(i % 67 == 0, F.col("qno") + 40).otherwise(F.col("qno"))})
    left, right = official.select("exam", "qno", F.struct("accepted", "mode").alias("o")), stored.select("exam", "qno", F.struct("accepted", "mode").alias("s"))
    both = left.join(right, ["exam", "qno"], "full_outer")
    letters = lambda x: F.array_sort(F.split(x, ""))
    state = ladder([(F.col("s").isNull(), "missing"), (F.col("o").isNull(), "extra"), (letters(F.col("o.accepted")) != letters(F.col("s.accepted")), "answer_mismatch"), (F.col("o.mode") != F.col("s.mode"), "mode_mismatch")], "match")
    return both.groupBy("exam", state.alias("state")).agg(F.count("*").alias("n"), F.min("qno").alias("first"))


#: What in an option hints at text of the next question.
CASE, FOLLOW, RANGE, LONG = r"案例|個案[：:]", r"請回答下列|回答第", r"第?[0-9]{1,2}\s*[至到~-]\s*第?[0-9]{1,2}\s*題", 260


def triage_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options (documents' first lines, put together with phrases) that look like more than an option, the blocking ones first by a flag."""
    tail = pick("doc_id", ("", " 案例：某甲", " 請回答下列問題", " 第3至5題", " 個案： 回答第 7-9題", ""), 2)
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.concat(F.substring(F.coalesce("text", F.lit("")), 1, n), t).alias("v")) for f, n, t in (("opt_a", 30, tail), ("opt_b", 270, F.lit("")), ("opt_c", 9, F.lit("")), ("opt_d", 100, tail))))).alias("o"))
    v = F.col("o.v")
    flags = {"case_label_inside_option": v.rlike(CASE), "next_question_directive_inside_option": v.rlike(FOLLOW), "question_range_inside_option": v.rlike(RANGE), "long_option_review": F.length(v) > LONG}
    found = names_where(flags)
    blocking = flags["case_label_inside_option"] & (flags["next_question_directive_inside_option"] | flags["question_range_inside_option"])
    return rows.select("doc_id", "o.field", F.array_join(found, ",").alias("flags"), blocking.alias("blocking")).where("flags <> ''")


def exam_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against observed subjects of each exam (order, by its lines' modes): status, what is missing and unexpected, next action."""
    expected = ("AIR", "MAIL", "RAIL", "SHIP", "TRUCK")
    seen = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.element_at(F.array(*map(F.lit, (*expected, "FOB"))), (F.col("l_partkey") % 6 + 1).cast("int")))).alias("seen"), F.min("l_suppkey").alias("s"))
    want = F.array(*map(F.lit, expected))
    missing, more = F.array_except(want, F.col("seen")), F.array_except(F.col("seen"), want)
    status = ladder([(F.col("s") % 7 == 0, "source_error"), (F.col("s") % 11 == 0, "target_class_missing"), (F.col("s") % 13 == 0, "unapproved_scheme"), (F.col("s") % 17 == 0, "new_status"), ((F.size(missing) == 0) & (F.size(more) == 0), "match")], "possible_scheme_change")
    out = seen.select("l_orderkey", status.alias("status"), F.array_join(missing, ",").alias("missing"), F.array_join(more, ",").alias("unexpected"), (F.col("s") % 2 == 0).alias("spent"))
    return out.withColumns(probe_action(F.col("status"), F.col("spent"))).drop("spent")


def probe_action(status: Column, spent: Column) -> dict[str, Column]:
    """What to do after a probe, its outcome in the ledger, and the reason of a review. Unknown states are quarantined, never guessed."""
    reasons = {"possible_scheme_change": "possible_exam_scheme_change", "target_class_missing": "target_class_missing", "unapproved_scheme": "unapproved_exam_scheme"}
    reason = ladder([(status == "match", None), ((status == "source_error") & spent, "source_unavailable_after_retries"), (status == "source_error", None), *((status == k, v) for k, v in reasons.items())], "unknown_probe_status")
    action = ladder([(status == "match", "continue"), ((status == "source_error") & spent, "manual_review"), (status == "source_error", "retry")], "quarantine")
    outcome = ladder([(status == "match", None), ((status == "source_error") & spent, "failed_terminal"), (status == "source_error", "failed_retryable")], "quarantined")
    return {"action": action, "outcome": outcome, "reason": reason}


def payload_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import payloads (sessions) before any write: what keeps a session out, and the first row that does."""
    c = F.col
    rows = mcqs(spark, sf_dir).withColumn("url", F.concat(F.lit("https://"), pick("row", ("exams.example.org", "exams.example.org", "exams.example.org", "exams.example.org.evil.net"), 501), F.lit("/x")))
    bad = {
        "subject": ~c("subject").isin(*SUBJECTS), "session": (c("year") != c("in_year")) | (canonical_round(c("round")) != c("in_round")), "source": ~(host(c("url")) == "exams.example.org"), "id": c("id") == "",
        "text": _blank("question") | _blank("opt_a") | _blank("opt_b") | _blank("opt_c") | _blank("opt_d"), "grading": ~c("grading_mode").isin(*MODES),
    }
    rows = rows.withColumn("bad", names_where({k: F.coalesce(x, F.lit(True)) for k, x in bad.items()}))
    faults = session_faults(rows, "mcq")
    g = rows.groupBy("in_year", "in_round").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("bad")))).alias("bad"), F.min(F.when(F.size("bad") > 0, c("row"))).alias("first"))
    both = g.join(faults, ["in_year", "in_round"])
    return both.select(c("in_year").alias("year"), c("in_round").alias("round"), F.array_join("bad", ",").alias("bad"), "first", ((F.size("bad") == 0) & (F.size("faults") == 0)).alias("accepted"))


QUERIES = {f.__name__: f for f in (mcq_issues, essay_issues, exam_sessions, exam_reports, exam_corpus, enrichment_decisions, enrichment_summary, answer_keys_parsed, answer_audit, triage_options, exam_structure, payload_check)}

BLANK = "trim(coalesce({x}, '')) = ''"
IN_SUBJECTS = f"in ({', '.join(map(quoted, SUBJECTS))})"
LETTERS = "('A', 'B', 'C', 'D')"
UP = "list_transform(accepted, lambda x: upper(trim(x)))"
LEGAL_TEXT = "concat_ws(chr(10), question, law, exp_why)"

def _sql_core(p: str, n: int) -> list[tuple[str, str, str, str, str]]:
    conditions = {
        "ID_REQUIRED": "id = ''", "SUBJECT_VALID": f"subject not {IN_SUBJECTS}", "SESSION_MATCH": f"year <> in_year or {ROUND_SQL.format(x='round')} <> in_round",
        "QNO_VALID": f"coalesce(try_cast(qno as integer), 0) not between 1 and {n}", "QUESTION_REQUIRED": BLANK.format(x="question"),
    }
    return [(f"{p}_{k}", "official_core", "blocked", "critical", x) for k, x in conditions.items()]


MCQ_CONDITIONS = {
    "GRADING_MODE_EXPLICIT": "grading_mode = ''",
    "GRADING_MODE_VALID": f"grading_mode not in {('', *MODES)}",
    "SPECIAL_GRADING_EXPLICIT": f"contains(answer, '{MARKER}') and grading_mode not in {SPECIAL}",
    "STANDARD_ANSWER_VALID": f"grading_mode = 'standard' and upper(trim(answer)) not in {LETTERS}",
    "ACCEPTED_ANSWERS_SHAPE": "grading_mode = 'standard' and coalesce(len(accepted), 1) = 0",
    "ACCEPTED_ANSWERS_VALID": f"grading_mode = 'standard' and coalesce(len(accepted), 0) > 0 and (len(list_distinct({UP})) <> len(accepted) or len(list_filter({UP}, lambda x: x not in {LETTERS})) > 0)",
    "PRIMARY_IN_ACCEPTED": f"grading_mode = 'standard' and coalesce(len(accepted), 0) > 0 and upper(trim(answer)) in {LETTERS} and not list_contains({UP}, upper(trim(answer)))",
    "SPECIAL_MARKER_MATCH": f"grading_mode in {SPECIAL} and trim(answer) <> '{MARKER}'",
    "SPECIAL_ACCEPTED_EMPTY": f"grading_mode in {SPECIAL} and accepted is not null",
}
MCQ_RULES = [
    *_sql_core("MCQ", 40), *(("MCQ_OPTION_REQUIRED", "official_core", "blocked", "critical", BLANK.format(x=f"opt_{x}")) for x in "abcd"), ("MCQ_SOURCE_REQUIRED", "official_core", "needs_review", "high", BLANK.format(x="source_exam_code")),
    *((f"MCQ_{k}", "official_core", "blocked", "critical", x) for k, x in MCQ_CONDITIONS.items()),
    ("ENRICHMENT_LEGAL_REVIEW", "enrichment", "needs_review", "high", f"{_sql_patterns(LEGAL_TEXT, LEGAL)} and legal_status not in {CHECKED} and not {WATCH_SQL.format(t=LEGAL_TEXT)}"),
]
ESSAY_RULES = [
    *_sql_core("ESSAY", 2), ("ESSAY_SOURCE_CODE_REQUIRED", "official_core", "needs_review", "high", BLANK.format(x="source_exam_code")), ("ESSAY_SOURCE_URL_REQUIRED", "official_core", "needs_review", "high", BLANK.format(x="source_url")),
    ("ESSAY_HISTORICAL_LAW_REVIEW", "enrichment", "needs_review", "high", f"{_sql_patterns('question', LEGAL)} and not {WATCH_SQL.format(t='question')}"),
]


def _issues_sql(rules: list[tuple[str, str, str, str, str]], table: str) -> str:
    return " union all ".join(f"select row, '{r}' rule, '{layer}' layer, '{s}' status, '{k}' risk from {table} where {x}" for r, layer, s, k, x in rules)


def _faults_sql(table: str, kind: str) -> str:
    p = kind.upper()
    return f"""(with i as (select in_year, in_round, id, count(*) n from {table} group by 1, 2, 3), a as (select in_year, in_round, cast(sum(n) as bigint) n, bool_or(n > 1 or id = '') twice from i group by 1, 2),
 s as (select in_year, in_round, subject, count(*) n, list_sort(list(distinct try_cast(qno as integer)) filter (where regexp_matches(qno, '^[0-9]+$'))) q from {table} group by 1, 2, 3),
 w as (select in_year, in_round, count(*) subjects, count(*) filter (where subject {IN_SUBJECTS} and n = {EACH[kind]}) even, count(*) filter (where subject {IN_SUBJECTS} and q = cast(generate_series(1, {LAST[kind]}) as integer[])) covered from s group by 1, 2)
 select '{kind}' kind, a.in_year, a.in_round, n, concat_ws(',', case when n <> {TOTAL[kind]} then '{p}_SESSION_COUNT' end, case when twice then '{p}_ID_UNIQUE' end, case when subjects <> 5 or even <> 5 then '{p}_SUBJECT_DISTRIBUTION' end, case when covered <> 5 then '{p}_QNO_COVERAGE' end) faults
 from a join w using (in_year, in_round))"""


def _graded_sql(rules: list, table: str, kind: str) -> str:
    return f"""select '{kind}' kind, t.in_year, t.in_round, t.analysis_status, coalesce(max(case when layer = 'official_core' then case status when 'blocked' then 2 else 1 end end), 0) core, coalesce(max(case when layer = 'enrichment' then 1 end), 0) enr
 from {table} t left join ({_issues_sql(rules, table)}) i on i.row = t.row group by t.row, t.in_year, t.in_round, t.analysis_status"""


SESSIONS = f"sessions as (select * from {_faults_sql('mcqs', 'mcq')} union all select * from {_faults_sql('essays', 'essay')})"
REPORTS = f"""{MCQS}, {ESSAYS}, {SESSIONS}, g as ({_graded_sql(MCQ_RULES, 'mcqs', 'mcq')} union all {_graded_sql(ESSAY_RULES, 'essays', 'essay')}),
 reports as (select g.kind, g.in_year as year, g.in_round as round, count(*) items, count(*) filter (where core = 0) core_passed, count(*) filter (where core = 1) core_needs_review, count(*) filter (where core = 2) core_blocked, count(*) filter (where enr = 0) enrichment_passed,
 count(*) filter (where enr = 1) enrichment_needs_review, count(*) filter (where analysis_status not in {READY}) pending, count(*) filter (where core > 0 or enr > 0) manual, any_value(faults) = '' and count(*) filter (where core > 0) = 0 ready
 from g join sessions s on s.kind = g.kind and s.in_year = g.in_year and s.in_round = g.in_round group by 1, 2, 3)"""
OFFICIAL = "concat_ws(' ', nullif(trim(question), ''), nullif(trim(opt_a), ''), nullif(trim(opt_b), ''), nullif(trim(opt_c), ''), nullif(trim(opt_d), ''))"


def _names_sql(text: str) -> str:
    cases = [f"case when contains({text}, {quoted(a)}) then {quoted(n)} end" for a, n in ALIASES.items()] + [f"case when contains({text}, {quoted(n)}) then {quoted(n)} end" for n in sorted(NAMES, key=len, reverse=True)]
    return f"list_filter([{', '.join(cases)}], lambda x: x is not null)"


TOKENS = "list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9''’\\-]*'), lambda x: lower(x))"
DIGITS = "regexp_extract_all({x}, '[0-9]+(?:[.,][0-9]+)?')"
FOUND = [
    ("ENRICHMENT_REQUIRED_FIELDS", "blocked", "critical", " or ".join(BLANK.format(x=x) for x in ("topic", "exp_why", "exp_others"))),
    ("ENRICHMENT_UNKNOWN_GRADING_MODE", "blocked", "critical", f"grading_mode not in {MODES}"),
    ("ENRICHMENT_SPECIAL_GRADING", "blocked", "critical", f"grading_mode in {SPECIAL}"),
    ("ENRICHMENT_MULTI_ANSWER_REVIEW", "needs_review", "medium", "grading_mode = 'standard' and len(ans) > 1"),
    ("ENRICHMENT_OFFICIAL_ANSWER_MISSING", "blocked", "critical", "grading_mode = 'standard' and len(ans) = 0"),
    ("ENRICHMENT_UNGROUNDED_ASCII", "blocked", "critical", f"len(list_filter({TOKENS.format(x='made')}, lambda w: not list_contains({TOKENS.format(x='src')} || {sql_list(ARTIFACTS)}, w))) > 0"),
    ("ENRICHMENT_UNGROUNDED_NUMBER", "blocked", "critical", f"len(list_filter({DIGITS.format(x='made')}, lambda w: not list_contains({DIGITS.format(x='src')}, w))) > 0"),
    ("ENRICHMENT_ACCEPTED_ANSWER_IN_OTHERS", "needs_review", "high", "len(list_filter(ans, lambda a: regexp_matches(trim(exp_others), '(^|[\\n。；;])\\s*(選項\\s*)?' || a || '(\\s*選項)?\\s*[：:]') or regexp_matches(trim(exp_others), '(^|[\\n。；;])\\s*' || a || '\\s*選項'))) > 0"),
    ("ENRICHMENT_LAW_AUTO_DROP", "passed_sanitized", "medium", f"coalesce(trim(law), '') <> '' and legal_status not in ('verified_current', 'changed') and (len({_names_sql('law')}) = 0 or len(list_filter({_names_sql('law')}, lambda x: not list_contains(laws, x))) > 0)"),
    ("ENRICHMENT_LAW_CHANGED_REVIEW", "needs_review", "high", "about and legal_status = 'changed'"),
    ("ENRICHMENT_LEGAL_EVIDENCE_REQUIRED", "needs_review", "high", f"about and legal_status not in ('changed', 'current', 'checked', 'verified', 'verified_current', 'historical_checked') and not {WATCH_SQL.format(t='off')}"),
]
DECIDED = f"""{MCQS}, d0 as (select *, {OFFICIAL} off, list_filter(list_distinct({UP}), lambda x: x in {LETTERS}) given, upper(trim(answer)) own from mcqs where id <> ''),
 d1 as (select *, case when len(coalesce(given, [])) > 0 then given when own in {LETTERS} then [own] else [] end ans, {_names_sql('off')} laws, concat_ws(' ', nullif(trim(topic), ''), nullif(trim(exp_why), ''), nullif(trim(exp_others), ''), nullif(trim(law), '')) made from d0),
 d2 as (select *, 'A B C D ' || off || ' ' || array_to_string(ans, ' ') src, {_sql_patterns('off', LEGAL)} or len(laws) > 0 about from d1),
 d3 as (select row, analysis_status st, case when analysis_status in {PENDING} then [] when analysis_status = 'review' then ['UPSTREAM_ANALYSIS_REVIEW'] when analysis_status not in {READY} then ['UNKNOWN_ANALYSIS_STATE']
  else list_filter([{', '.join(f"case when {x} then '{n}' end" for n, _, _, x in FOUND)}], lambda x: x is not null) end f from d2),
 graded(n, s, r) as (values {', '.join(f"('{n}', '{s}', '{r}')" for n, s, r, _ in FOUND)}, ('UPSTREAM_ANALYSIS_REVIEW', 'needs_review', 'high'), ('UNKNOWN_ANALYSIS_STATE', 'needs_review', 'high')),
 d4 as (select d3.row, any_value(st) st, any_value(f) f, max(case s when 'blocked' then 3 when 'needs_review' then 2 when 'passed_sanitized' then 1 end) sr, max(case r when 'critical' then 3 when 'high' then 2 when 'medium' then 1 end) rr from d3 left join graded on list_contains(f, n) group by d3.row),
 d5 as (select row, array_to_string(f, ',') findings, case when st in {PENDING} then 'pending_generation' when sr = 3 then 'blocked' when sr = 2 then 'needs_review' when sr = 1 then 'passed_sanitized' else 'passed' end status, case rr when 3 then 'critical' when 2 then 'high' when 1 then 'medium' else 'low' end risk, list_contains(f, 'ENRICHMENT_LAW_AUTO_DROP') drops_law from d4),
 decided as (select row, findings, status, risk, case status {' '.join(f"when '{s}' then '{d[0]}'" for s, d in DECISIONS.items())} end confidence, case status {' '.join(f"when '{s}' then '{d[1]}'" for s, d in DECISIONS.items())} end action,
  case status when 'passed' then 'ready' when 'passed_sanitized' then 'sanitized_ready' when 'pending_generation' then null else 'review' end route, drops_law from d5)"""
PARSED = f"""{KEYS}, n0 as (select exam, translate(upper(regexp_replace(note, '\\s+', '', 'g')), 'ＡＢＣＤ', 'ABCD') note from keys), n1 as (select exam, unnest(regexp_extract_all(note, '第[0-9]{{1,2}}題[^第]*')) part, generate_subscripts(regexp_extract_all(note, '第[0-9]{{1,2}}題[^第]*'), 1) k from n0),
 n2 as (select exam, k, cast(regexp_extract(part, '^第([0-9]{{1,2}})題', 1) as integer) qno, regexp_replace(part, '^第[0-9]{{1,2}}題', '') body from n1), n3 as (select *, list_sort(list_distinct(regexp_extract_all(string_split(array_to_string(string_split(body, '答')[2:], '答'), '給分')[1], '[ABCD]'))) l from n2 where qno between 1 and 40),
 n4 as (select exam, qno, k, case when contains(body, '一律給分') or (contains(body, '未作答者不給分') and contains(body, '其餘均給分')) then 'ABCD' else array_to_string(l, '') end given, case when contains(body, '一律給分') then 'all_credit' when contains(body, '未作答者不給分') and contains(body, '其餘均給分') then 'any_answer' when contains(body, '給分') and contains(body, '答') and len(l) > 0 then 'standard' end mode from n3),
 n5 as (select * from (select *, row_number() over (partition by exam, qno order by k desc) r from n4 where mode is not null) where r = 1), al as (select exam, unnest(generate_series(1, 40)) qno, answers from keys),
 parsed as (select al.exam, al.qno, coalesce(given, nullif(substr(answers, cast(al.qno as integer), 1), '#')) accepted, coalesce(mode, case when substr(answers, cast(al.qno as integer), 1) <> '#' then 'standard' end) mode from al left join n5 on n5.exam = al.exam and n5.qno = al.qno)"""
TAIL = sql_pick("doc_id", ("", " 案例：某甲", " 請回答下列問題", " 第3至5題", " 個案： 回答第 7-9題", ""), 2)
ORACLE = {
    "mcq_issues": f"with {MCQS} select row, rule, layer, status, risk from ({_issues_sql(MCQ_RULES, 'mcqs')})",
    "essay_issues": f"""with {ESSAYS}, i as ({_issues_sql(ESSAY_RULES, 'essays')}) select e.row, case when {_sql_patterns('e.question', LEGAL)} then 'high' when {_sql_patterns('e.question', PARTS)} then 'medium' else 'low' end demand, rule, layer, status, risk from essays e left join i on i.row = e.row""",
    "exam_sessions": f"with {MCQS}, {ESSAYS}, {SESSIONS} select kind, in_year as year, in_round as round, n, faults from sessions",
    "exam_reports": f"with {REPORTS} select * from reports",
    "exam_corpus": f"""with {REPORTS} select kind, count(*) sessions, count(*) filter (where ready) ready, cast(sum(items) as bigint) items, cast(sum(core_passed) as bigint) core_passed, cast(sum(core_needs_review) as bigint) core_needs_review, cast(sum(core_blocked) as bigint) core_blocked, cast(sum(manual) as bigint) manual,
 sum(core_passed) + sum(core_needs_review) + sum(core_blocked) = sum(items) adds_up from reports group by 1""",
    "enrichment_decisions": f"with {DECIDED} select * from decided",
    "enrichment_summary": f"with {DECIDED} select status, action, count(*) n, count(*) filter (where drops_law) sanitized from decided group by 1, 2",
    "answer_keys_parsed": f"""with {PARSED} select exam, count(mode) settled, count(*) filter (where mode in ('all_credit', 'any_answer')) special, coalesce(string_agg(case when mode is null then cast(qno as varchar) end, ',' order by qno), '') as open, sha256(string_agg(coalesce(accepted, '?'), ' ' order by qno)) digest from parsed group by 1""",
    "answer_audit": f"""with {PARSED}, o as (select * from parsed where mode is not null), s as (select exam, case when (exam * 40 + qno) % 67 = 0 then qno + 40 else qno end qno, case when (exam * 40 + qno) % 59 = 0 then 'A' else accepted end accepted, case when (exam * 40 + qno) % 61 = 0 then 'standard' else mode end mode from o where (exam * 40 + qno) % 53 <> 0),
 b as (select coalesce(o.exam, s.exam) exam, coalesce(o.qno, s.qno) qno, case when s.exam is null then 'missing' when o.exam is null then 'extra' when o.accepted <> s.accepted then 'answer_mismatch' when o.mode <> s.mode then 'mode_mismatch' else 'match' end state from o full join s on o.exam = s.exam and o.qno = s.qno)
 select exam, state, count(*) n, cast(min(qno) as integer) as first from b group by 1, 2""",
    "triage_options": f"""with o as (select doc_id, unnest([{{f: 'opt_a', v: left(coalesce(text, ''), 30) || {TAIL}}}, {{f: 'opt_b', v: left(coalesce(text, ''), 270)}}, {{f: 'opt_c', v: left(coalesce(text, ''), 9)}}, {{f: 'opt_d', v: left(coalesce(text, ''), 100) || {TAIL}}}]) x from documents),
 g as (select doc_id, x.f field, regexp_matches(x.v, '{CASE}') a, regexp_matches(x.v, '{FOLLOW}') b, regexp_matches(x.v, '{RANGE}') c, length(x.v) > {LONG} d from o)
 select doc_id, field, concat_ws(',', case when a then 'case_label_inside_option' end, case when b then 'next_question_directive_inside_option' end, case when c then 'question_range_inside_option' end, case when d then 'long_option_review' end) flags, a and (b or c) blocking from g where a or b or c or d""",
    "exam_structure": f"""with l as (select l_orderkey, list_sort(list(distinct ['AIR', 'MAIL', 'RAIL', 'SHIP', 'TRUCK', 'FOB'][cast(l_partkey % 6 + 1 as integer)])) seen, min(l_suppkey) s from lineitem group by 1),
 m as (select *, list_filter(['AIR', 'MAIL', 'RAIL', 'SHIP', 'TRUCK'], lambda x: not list_contains(seen, x)) miss, list_filter(seen, lambda x: x = 'FOB') more from l),
 t as (select *, case when s % 7 = 0 then 'source_error' when s % 11 = 0 then 'target_class_missing' when s % 13 = 0 then 'unapproved_scheme' when s % 17 = 0 then 'new_status' when len(miss) = 0 and len(more) = 0 then 'match' else 'possible_scheme_change' end status from m)
 select l_orderkey, status, array_to_string(miss, ',') missing, array_to_string(more, ',') unexpected, case when status = 'match' then 'continue' when status = 'source_error' then case when s % 2 = 0 then 'manual_review' else 'retry' end else 'quarantine' end action,
 case when status = 'match' then null when status = 'source_error' then case when s % 2 = 0 then 'failed_terminal' else 'failed_retryable' end else 'quarantined' end outcome,
 case when status = 'match' then null when status = 'source_error' then case when s % 2 = 0 then 'source_unavailable_after_retries' end when status = 'possible_scheme_change' then 'possible_exam_scheme_change' when status = 'target_class_missing' then status when status = 'unapproved_scheme' then 'unapproved_exam_scheme' else 'unknown_probe_status' end reason from t""",
    "payload_check": f"""with {MCQS}, r as (select *, {sql_pick('row', ('exams.example.org', 'exams.example.org', 'exams.example.org', 'exams.example.org.evil.net'), 501)} h from mcqs),
 b as (select row, in_year, in_round, unnest(list_filter([case when subject not {IN_SUBJECTS} then 'subject' end, case when year <> in_year or {ROUND_SQL.format(x='round')} <> in_round then 'session' end, case when h <> 'exams.example.org' then 'source' end, case when id = '' then 'id' end,
  case when {' or '.join(BLANK.format(x=x) for x in ('question', 'opt_a', 'opt_b', 'opt_c', 'opt_d'))} then 'text' end, case when grading_mode not in {MODES} then 'grading' end], lambda x: x is not null)) bad from r),
 g as (select in_year, in_round, string_agg(distinct bad, ',' order by bad) bad, min(row) as first from b group by 1, 2)
 select f.in_year as year, f.in_round as round, coalesce(bad, '') bad, g.first, bad is null and faults = '' accepted from {_faults_sql('mcqs', 'mcq')} f left join g on g.in_year = f.in_year and g.in_round = f.in_round""",
}
