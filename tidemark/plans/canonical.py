"""Canonical events: members merged under one key, matched with the previous generation, admitted as major, placed in the knowledge tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vocabulary as V
from tidemark.functions.columns import bound, host, title_norm
from tidemark.operators import news as N
from tidemark.operators.rules import ladder
from tidemark.plans.derived import SUBJECTS, SUBJECTS_OF, news, quoted, sql_any
from tidemark.plans.news import LAWS_IN, SCORED, _level
from tidemark.sources.durable import written
from tidemark.sources.tables import read

#: Items up to this day are the previous generation.
GENERATION = "2024-02-10"
#: Signs of official sources, and the gates of major events.
OFFICIAL = "衛生福利部 衛福部 內政部 勞動部 教育部 法務部 行政院 考試院 署".split()
DOMAIN = (
    "社工 社會安全網 社福 社會福利 老人福利 兒少保護 兒童保護 兒虐 虐童 安置 寄養 收出養 長照 長期照顧 家庭照顧 照顧者 精神衛生 精神健康 身心障礙 身障 家庭暴力 家暴 性騷擾 性侵害 社會救助 "
    "校園霸凌 學生輔導 弱勢 保護令 住宅政策 兒童及少年 少年事件處理 精神衛生法 家庭暴力防治法 災害社工 災害防救 社區重建 災民 福利服務 居住權 社會住宅"
).split()
CHANGE = "正式施行 正式上路 施行 三讀 公布 修正 修法 核定 啟動 擴大 增訂 改革 新制 重大 安置 重建 制度 審議通過 全面 通過 死亡 致死 虐死 受虐 崩塌 洪災 地震 堰塞湖".split()
ROUTINE = "工作坊 記者會 說明會 研討會 研習 徵稿 徵件 展覽 開幕 得獎 頒獎 參訪 交流活動 宣導活動 推廣活動 講座 論壇 節慶 疫情報告".split()
DRAFT, ENACTED = "修正草案 修法草案 研議 擬修 修法討論 修法建議".split(), "三讀通過 正式施行 正式上路 生效 已公布 行政院核定 已核定".split()
CASE = "致死 虐死 重傷 失職 重大災害 洪災 堰塞湖 地震 一家五口".split()
RESPONSE = "監察院 社會安全網 跨網絡 保護服務 社工 社會局 衛福部 政府 體系 制度漏洞 改革 家庭照顧者 資源分配 照顧負荷 社區重建".split()
DISASTER, DISASTER_LINK = "洪災 地震 堰塞湖 重大災害".split(), "災害社工 社區重建 社會局 安置".split()
COUNTRY_SECOND = "com net org gov edu ac co or ne mil idv".split()


def official(name: Column, kind: Column) -> Column:
    return (kind == "official") | N.any_of(name, OFFICIAL)


def publisher_site(url: Column) -> Column:
    """The registered-looking domain of an address: two labels, three under a country's second level."""
    h = host(url)
    deep = h.rlike(rf"\.({'|'.join(COUNTRY_SECOND)})\.[a-z]{{2}}$")
    return F.when(deep, F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))


def union_by_first(rows: DataFrame, key: str, array: str, order: Column) -> DataFrame:
    """key, values: the distinct values of an array over a group's rows, by their first row and place in it. Values are counted down before they are gathered."""
    each = rows.select(key, order.alias("_o"), F.posexplode(array).alias("_p", "_v"))
    first = each.groupBy(key, "_v").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_l")).select(key, F.transform("_l", lambda x: x["_v"]).alias("values"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored items with the key of their event: category and normalised title. Evidence is the first item of each address."""
    scored = N.scored(news(spark, sf_dir)).withColumns({"norm": title_norm(F.col("title")), "seq": F.struct(F.col("published_at").isNotNull().alias("d"), "published_at", "id"), "laws": N.laws_in(F.concat("title", F.lit(" "), "summary"))}).withColumn("group", F.concat_ws("|", "category", "norm"))
    # written, since each part of an event reads it
    return written(scored.select("group", "id", "title", "summary", "category", "norm", "score", "tags", "laws", "source_name", "source_type", "published_at", "url", "seq"), "members")


def _built(members: DataFrame) -> DataFrame:
    """group -> the event: id, lead, sources, days, tags in both orders, laws."""
    c = F.col
    rank = F.struct(official(c("source_name"), c("source_type")).alias("o"), "score", F.coalesce(c("published_at").cast("string"), F.lit("")).alias("p"), (-c("id")).alias("i"))
    rows = members
    lead = rows.groupBy("group").agg(F.max_by(F.struct("id", "title", "summary", "category", "norm", "score", "tags", "source_type"), rank).alias("lead"), F.count("*").alias("members"))
    evidence = rows.groupBy("group", "url").agg(F.min_by(F.struct("source_name", "source_type", "published_at"), "seq").alias("e")).select("group", "url", "e.*")
    by_source = evidence.groupBy("group", "source_name").agg(F.max(official(c("source_name"), c("source_type")).cast("int")).alias("official"), F.count("*").alias("n"))
    sources = by_source.groupBy("group").agg(F.count("*").alias("sources"), F.sum("official").alias("official_sources"), F.sum("n").alias("evidence"), F.array_join(F.array_sort(F.collect_list("source_name")), ",").alias("names"))
    days = evidence.where("published_at is not null").groupBy("group", "published_at").agg(F.count("*").alias("n")).groupBy("group").agg(F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"), F.count("*").alias("days"))
    sites = evidence.select("group", publisher_site(c("url")).alias("site")).distinct().groupBy("group").agg(F.count("*").alias("sites"))
    tags = union_by_first(rows, "group", "tags", c("seq")).withColumnRenamed("values", "tags_in_order")
    laws = union_by_first(rows, "group", "laws", c("seq")).withColumnRenamed("values", "laws")
    e = lead
    for part in (sources, days, sites, tags, laws):
        e = e.join(part, "group", "left")
    none = F.array().cast("array<string>")
    sorted_tags, sorted_laws = F.array_sort(F.coalesce("tags_in_order", none)), F.array_sort(F.coalesce("laws", none))
    basis = F.concat_ws("|", "lead.category", F.array_join(F.slice(sorted_laws, 1, 3), ","), F.array_join(F.slice(sorted_tags, 1, 5), ","), "lead.norm")
    return bound(e, event_id=F.substring(F.sha2(basis, 256), 1, 24), all_tags=sorted_tags, all_laws=sorted_laws)


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of this generation: lead, sources and their days, unions of tags and laws, and what their like of the previous generation adds to first and last seen."""
    c = F.col
    m = _members(spark, sf_dir)
    now, before = _built(m), _built(m.where(c("published_at") <= F.lit(GENERATION).cast("date"))).select("event_id", c("first_seen").alias("old_first"), c("last_seen").alias("old_last"))
    before = before.groupBy("event_id").agg(F.min("old_first").alias("old_first"), F.max("old_last").alias("old_last"))
    j = now.join(before, "event_id", "left")
    return j.select(
        "event_id", "lead.id", c("lead.category").alias("category"), "members", "evidence", "sources", "official_sources", "names", F.least("first_seen", "old_first").alias("first_seen"), F.greatest("last_seen", "old_last").alias("last_seen"),
        F.greatest(F.coalesce("days", F.lit(0)), F.lit(1)).cast("long").alias("observations"), F.array_join("tags_in_order", ",").alias("tags_in_order"), F.array_join("all_tags", ",").alias("tags"), F.array_join("all_laws", ",").alias("laws"), c("old_first").isNotNull().alias("matched"),
    )


def major_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event is admitted as major, with the first gate that it fails. No score can make up for a gate."""
    c = F.col
    e = _built(_members(spark, sf_dir)).select("event_id", "lead.id", "lead.title", "lead.summary", "lead.category", "sources", "official_sources", "sites", "days", c("lead.tags").alias("tags"))
    s = N.signals(e)
    sure = N.confidence(c("policy"), c("essay"), c("facts"), c("laws"), F.lit(0))
    title, summary, any_ = c("title"), c("summary"), N.any_of
    system = any_(title, CASE) & any_(summary, RESPONSE)
    anchor = any_(title, DOMAIN) | (any_(title, DISASTER) & any_(summary, DISASTER_LINK))
    n = lambda x: F.coalesce(x, F.lit(0))
    reason = ladder(
        [
            (~F.length(title).between(12, 230) | (summary == ""), "missing_event_details"), (any_(title, ROUTINE), "routine_activity"), (~anchor, "no_explicit_social_work_anchor"), (~any_(title, CHANGE), "no_concrete_major_impact"),
            (any_(title, DRAFT) & ~any_(title, ENACTED), "proposal_not_enacted_or_confidently_major"), (c("essay") != "high", "essay_value_not_high"), (~sure.isin("high", "medium"), "exam_context_unreliable"), (n("sources") < 2, "inconsistent_or_single_source"),
            (c("sites") < c("sources"), "repackaged_same_publisher"), ((c("official_sources") >= 1) & (n("days") < 2) & ~any_(title, ENACTED), "insufficient_time_or_formal_outcome"),
            ((c("official_sources") < 1) & ((c("sources") < 3) | (n("days") < 2)), "missing_official_or_cross_day_confirmation"), (any_(title, CASE) & ((c("sources") < 3) | ~any_(summary, RESPONSE)), "isolated_tragedy_without_systemic_evidence"),
            ((c("policy") != "high") & ~system, "insufficient_systemic_policy_or_practice_effect"),
        ],
        "confirmed_cross_source_systemic_impact",
    )
    return s.select("event_id", "id", reason.alias("reason"), (reason == "confirmed_cross_source_systemic_impact").alias("admitted"))


#: The management domains in order, those of each category, and which subjects explain a domain.
DOMAINS = ("規劃與政策執行", "組織治理與責信", "人力與督導", "服務輸送與跨網絡", "方案與資源管理", "品質與風險管理", "成效評估與證據", "倫理與權利保障")
DOMAINS_OF = {
    "兒少保護": (5, 3, 7), "家暴與性暴力": (5, 3, 7), "心理健康與成癮": (3, 7, 5), "長照與高齡": (3, 4, 0), "社會救助與居住": (0, 4, 7), "身障與人權": (7, 3, 0), "移工與新住民": (7, 3, 0), "勞動與社會保障": (0, 7), "教育與學生輔導": (3, 5, 7),
    "司法保護與修復式司法": (3, 7, 0), "少年司法與犯罪防治": (3, 7, 5), "性別與家庭政策": (0, 7, 4), "災害與社區工作": (5, 3, 4), "社工專業與社福制度": (1, 7),
}
LINKS = {0: (4, 0), 1: (0, 4, 3), 2: (0, 2), 3: (2, 0, 4), 4: (0, 4, 3), 5: (2, 0, 3), 6: (3, 0, 4), 7: (0, 2, 4, 1)}
#: Test dictionary: terms that add a domain, by its place.
DOMAIN_TERMS = {0: ("政策", "修法"), 2: ("人力", "督導"), 5: ("疏失", "風險"), 6: ("調查結果", "報告指出")}


def knowledge_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scored item in the knowledge tree: its domains (the category's, then those of its terms, five at most), subjects, and the paths from domain to subject, thirty at most."""
    c = F.col
    s = N.scored(news(spark, sf_dir)).withColumn("text", F.concat(c("title"), F.lit(" "), c("summary")))
    table = lambda of, names: F.create_map(*(x for k, v in of.items() for x in (F.lit(k), F.array(*(F.lit(names[i]) for i in v)))))[c("category")]
    extra = F.array_compact(F.array(*(F.when(N.any_of(c("text"), t), F.lit(DOMAINS[k])) for k, t in DOMAIN_TERMS.items())))
    rows = bound(s, _domains=F.slice(F.array_distinct(F.concat(table(DOMAINS_OF, DOMAINS), extra)), 1, 5), _subjects=table(SUBJECTS_OF, SUBJECTS))
    linked = F.create_map(*(x for k, v in LINKS.items() for x in (F.lit(DOMAINS[k]), F.array(*(F.lit(SUBJECTS[i]) for i in v)))))
    deep = F.flatten(F.transform("_domains", lambda d: F.transform(F.filter(linked[d], lambda x: F.array_contains("_subjects", x)), lambda x: F.concat_ws(" > ", d, x))))
    paths = F.slice(F.array_distinct(F.concat("_domains", deep)), 1, 30)
    return rows.select("id", F.array_join("_domains", ",").alias("domains"), F.array_join("_subjects", ",").alias("subjects"), F.size(paths).cast("long").alias("n_paths"), F.array_join(paths, "|").alias("paths"))


def richest_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History figures of an event's members (documents by language and source): those of the richest member, with the years of all."""
    c, i = F.col, F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(F.concat_ws("|", "lang", "source").alias("group"), i, (i % 7 / 2).alias("weighted"), (i % 11).alias("matched"), (i % 3).alias("strong"), F.array(100 + i % 9, 101 + i % 5).alias("years"))
    best = rows.groupBy("group").agg(F.max(F.struct("weighted", "matched", "strong", (-i).alias("first"))).alias("b"), F.max("strong").alias("laws"))
    years = rows.select("group", F.explode("years").alias("y")).distinct().groupBy("group").agg(F.array_sort(F.collect_list("y")).alias("y"))
    j = best.join(years, "group")
    return j.select("group", c("b.weighted").alias("weighted"), c("b.matched").alias("matched"), c("b.strong").alias("strong"), "laws", F.array_join(c("y").cast("array<string>"), ",").alias("years"), F.array_min("y").alias("earliest"), F.array_max("y").alias("latest"))


QUERIES = {f.__name__: f for f in (canonical_events, major_events, knowledge_paths, richest_member)}

NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}', ' ', 'g'), '[0-9]+(\.[0-9]+)?%?', ' ', 'g'), '[!-/:-@\[-`{-~]+', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"
OFF = f"(source_type = 'official' or {sql_any('source_name', OFFICIAL)})"
SITE = rf"case when regexp_matches(h, '\.({'|'.join(COUNTRY_SECOND)})\.[a-z]{{2}}$') then array_to_string(string_split(h, '.')[-3:], '.') else array_to_string(string_split(h, '.')[-2:], '.') end"


def _built_sql(name: str, members: str) -> str:
    ordered = lambda x: f"(select g, string_agg(v, ',' order by fa) o, string_agg(v, ',' order by v) s, list(v order by v) l from (select g, v, min(row(sq, p)) fa from (select g, sq, unnest({x}) v, generate_subscripts({x}, 1) p from {members}) group by 1, 2) group by 1)"
    return f"""{name}_e as (select * from (select *, row_number() over (partition by g, url order by sq) r from {members}) where r = 1),
 {name}_l as (select * from (select *, row_number() over (partition by g order by {OFF} desc, score desc, coalesce(cast(published_at as varchar), '') desc, id) r, count(*) over (partition by g) members from {members}) where r = 1),
 {name} as (select l.*, s.evidence, s.sources, s.official_sources, s.names, d.first_seen, d.last_seen, d.days, s.sites, t.o tags_o, t.s tags_s, w.s laws_s, left(sha256(concat_ws('|', l.category, array_to_string(coalesce(w.l, [])[1:3], ','), array_to_string(coalesce(t.l, [])[1:5], ','), l.norm)), 24) event_id
 from {name}_l l join (select g, count(*) evidence, count(distinct source_name) sources, count(distinct source_name) filter (where {OFF}) official_sources, string_agg(distinct source_name, ',' order by source_name) as names, count(distinct {SITE}) sites from {name}_e group by 1) s on s.g = l.g
 left join (select g, min(published_at) first_seen, max(published_at) last_seen, count(distinct published_at) as days from {name}_e where published_at is not null group by 1) d on d.g = l.g left join {ordered('tags')} t on t.g = l.g left join {ordered('laws')} w on w.g = l.g)"""


MEMBERS = f"""{SCORED}, mem as (select s.*, n.source_name, n.source_type, {LAWS_IN} laws, {NORM.replace('title', 's.title')} norm, lower(regexp_extract(s.url, '^https://([^/?#:@]*)', 1)) h, row_number() over (order by s.published_at is not null, s.published_at, s.id) sq from scored s join news n on n.id = s.id),
 memg as (select *, category || '|' || norm g from mem)"""
NOW_SQL = f"{MEMBERS}, {_built_sql('now', 'memg')}"
ANCHOR = f"({sql_any('title', DOMAIN)} or ({sql_any('title', DISASTER)} and {sql_any('summary', DISASTER_LINK)}))"
FACTS = f"case when {' + '.join(f'regexp_matches(txt, {quoted(p)})::int' for p in V.FACT_PATTERNS)} >= 2 then 'high' when {' + '.join(f'regexp_matches(txt, {quoted(p)})::int' for p in V.FACT_PATTERNS)} = 1 or {sql_any('txt', V.FACT_TERMS)} then 'medium' else 'low' end"
POINTS = " + ".join(f"case {x} when 'high' then 2 when 'medium' then 1 else 0 end" for x in ("policy", "essay", "facts"))
ORACLE = {
    "canonical_events": f"""with {NOW_SQL}, oldg as (select * from memg where published_at <= date '{GENERATION}'), {_built_sql('old', 'oldg')}, o as (select event_id, min(first_seen) a, max(last_seen) b from old group by 1)
 select now.event_id, id, category, members, evidence, sources, official_sources, now.names, least(first_seen, a) first_seen, greatest(last_seen, b) last_seen, greatest(coalesce(days, 0), 1) observations, coalesce(tags_o, '') tags_in_order, coalesce(tags_s, '') tags, coalesce(laws_s, '') laws, a is not null matched from now left join o on o.event_id = now.event_id""",
    "major_events": f"""with {NOW_SQL}, s0 as (select *, {_level(V.POLICY_LEVELS)} policy, {_level(V.ESSAY_LEVELS)} e0, {FACTS} facts from now), s1 as (select *, case when e0 = 'low' and category in ({', '.join(map(quoted, V.ESSAY_RAISED))}) then 'medium' else e0 end essay from s0), s2 as (select *, {POINTS} + (len(laws) > 0)::int points from s1),
 r as (select event_id, id, case when length(title) not between 12 and 230 or summary = '' then 'missing_event_details' when {sql_any('title', ROUTINE)} then 'routine_activity' when not {ANCHOR} then 'no_explicit_social_work_anchor' when not {sql_any('title', CHANGE)} then 'no_concrete_major_impact'
 when {sql_any('title', DRAFT)} and not {sql_any('title', ENACTED)} then 'proposal_not_enacted_or_confidently_major' when essay <> 'high' then 'essay_value_not_high' when points < 3 then 'exam_context_unreliable' when sources < 2 then 'inconsistent_or_single_source' when sites < sources then 'repackaged_same_publisher'
 when official_sources >= 1 and coalesce(days, 0) < 2 and not {sql_any('title', ENACTED)} then 'insufficient_time_or_formal_outcome' when official_sources < 1 and (sources < 3 or coalesce(days, 0) < 2) then 'missing_official_or_cross_day_confirmation'
 when {sql_any('title', CASE)} and (sources < 3 or not {sql_any('summary', RESPONSE)}) then 'isolated_tragedy_without_systemic_evidence' when policy <> 'high' and not ({sql_any('title', CASE)} and {sql_any('summary', RESPONSE)}) then 'insufficient_systemic_policy_or_practice_effect' else 'confirmed_cross_source_systemic_impact' end reason from s2)
 select *, reason = 'confirmed_cross_source_systemic_impact' admitted from r""",
    "knowledge_paths": f"""with {SCORED}, dom(category, k, d) as (values {', '.join(f'({quoted(c)}, {k}, {quoted(DOMAINS[i])})' for c, v in DOMAINS_OF.items() for k, i in enumerate(v))}), sub(category, k, s) as (values {', '.join(f'({quoted(c)}, {k}, {quoted(SUBJECTS[i])})' for c, v in SUBJECTS_OF.items() for k, i in enumerate(v))}),
 lnk(d, k, s) as (values {', '.join(f'({quoted(DOMAINS[d])}, {k}, {quoted(SUBJECTS[i])})' for d, v in LINKS.items() for k, i in enumerate(v))}),
 ka as (select id, d, k from scored join dom on dom.category = scored.category union all {' union all '.join(f"select id, {quoted(DOMAINS[k])}, {10 + k} from scored where {sql_any('txt', t)}" for k, t in DOMAIN_TERMS.items())}),
 kb as (select id, d, min(k) k from ka group by 1, 2), b5 as (select * from (select *, row_number() over (partition by id order by k) r from kb) where r <= 5), dd as (select id, string_agg(d, ',' order by r) domains, string_agg(d, '|' order by r) p1, count(*) n1 from b5 group by 1),
 ss as (select id, string_agg(s, ',' order by k) subjects from scored join sub on sub.category = scored.category group by 1), pp as (select b5.id, string_agg(b5.d || ' > ' || lnk.s, '|' order by r, lnk.k) p2, count(*) n2 from b5 join lnk on lnk.d = b5.d join scored on scored.id = b5.id join sub on sub.category = scored.category and sub.s = lnk.s group by 1)
 select dd.id, domains, subjects, n1 + coalesce(n2, 0) n_paths, p1 || coalesce('|' || p2, '') paths from dd join ss on ss.id = dd.id left join pp on pp.id = dd.id""",
    "richest_member": """with r as (select lang || '|' || source g, doc_id, (doc_id % 7)::double / 2 w, doc_id % 11 m, doc_id % 3 s, [100 + doc_id % 9, 101 + doc_id % 5] y from documents), b as (select *, row_number() over (partition by g order by w desc, m desc, s desc, doc_id) k, max(s) over (partition by g) laws from r),
 u as (select g, list_sort(list(distinct v)) y from (select g, unnest(y) v from r) group by 1) select b.g as group, w weighted, m matched, s strong, laws, array_to_string(u.y, ',') as years, list_min(u.y) earliest, list_max(u.y) latest from b join u on u.g = b.g where k = 1""",
}
