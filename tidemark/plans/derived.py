"""Relations of the exam domain built from the driver's tables: news, questions, answer keys, laws. Each has a Spark form and SQL.

Rows are those of the whole table; texts are put together from phrases by the row's key, so that every rule meets rows
that keep and rows that break it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import read


def pick(key: Column | str, options: Sequence, step: int = 1, shift: int = 0) -> Column:
    """One of the options by the key: the next one at each step."""
    key = F.col(key) if isinstance(key, str) else key
    at = F.pmod(F.floor(key / step) + shift, F.lit(len(options)))
    return F.element_at(F.array(*map(F.lit, options)), (at + 1).cast("int"))


def quoted(x) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def sql_list(options: Sequence) -> str:
    return "[" + ", ".join(map(quoted, options)) + "]"


def sql_pick(key: str, options: Sequence, step: int = 1, shift: int = 0) -> str:
    return f"{sql_list(options)}[cast((cast({key} as bigint) // {step} + {shift}) % {len(options)} + 1 as integer)]"


def sql_any(text: str, terms: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({text}, {quoted(t)})" for t in terms) + ")"


def sql_hits(text: str, terms: Sequence[str]) -> str:
    return f"list_filter({sql_list(terms)}, lambda h: contains({text}, h))"


def sql_alias(text: str, alias: str) -> str:
    if not alias.isascii():
        return f"contains({text}, {quoted(alias)})"
    return f"regexp_matches(lower({text}), {quoted('(^|[^a-z0-9])' + r'[ ]+'.join(alias.split()) + '([^a-z0-9]|$)')})"


def sql_keys(text: str, entries: Sequence[tuple]) -> str:
    """Keys of the entries with an alias in the text, in order."""
    cases = ", ".join(f"case when {' or '.join(sql_alias(text, a) for a in aliases)} then {quoted(key)} end" for key, *_, aliases in entries)
    return f"list_filter([{cases}], lambda h: h is not null)"


def sql_ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


TITLES = (
    "衛福部預告長照給付修正草案", "社工訪視疏失兒虐致死 檢討責任通報", "歡迎踴躍參加社工研習課程", "勞保老年給付調升 12,345 元", "行政院通過家庭暴力防治法修法", "學生輔導法上路 校園霸凌通報",
    "WHO report finds child protection and mental health gaps for refugees", "UNICEF workshop on child rights for project staff", "Domestic violence guidance adopted by the United Nations and social protection reform", "身心障礙者合理調整指引施行 增加 3.50% 補助",
    "颱風撤離 安置中心啟動", "愛心捐贈公益活動 好禮選購", "移工權益保障法規擴大", "老人福利機構裁罰 長者死亡通報", "少年事件處理法判決", "兒童書展熱鬧登場 新增場次", "社工涉詐遭起訴", "性別平等工作法 育嬰留職停薪新制",
    "社會救助法修正 貧窮家庭 2萬人受惠", "犯罪被害人權益保障 修復式司法報告指出", "最低工資調升 影響 1.5億元", "災害救助 災民避難", "", "難民 兒童權利 人權 白皮書",
)
SUMMARIES = (
    "本案涉及社會安全網與保護服務制度，每月補助 1,200 元。", "依《社會救助法》第3條與兒童及少年福利與權益保障法修正。", "New policy framework with 2.5 million persons with disabilities, guidance and services.", "活動宣導記者會。", "跨網絡合作 人力不足 倫理困境 檢討方案。", "",
    "自113年施行，主管機關衛福部公告 45% 覆蓋率，托育與長照機構。", "The workshop and training course concludes; mental health and suicide prevention policy.", "家暴 性侵 兒少保護 通報 老人福利法 精神衛生法", "social protection and older persons, 12,000 refugees and migrants",
)
HOSTS = ("news.example.org", "www.gov.example.net", "evil.example.com", "example.org")
PAPERS = ("甲報", "衛生福利部", "乙報", "UN News", "社會及家庭署")
ALLOWED = ("example.org", "gov.example.net")
TODAY = "2024-03-01"


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A news item for each document: id, title, summary, url (shared by some), source_name, source_type, region, published_at (null if missing or unreadable)."""
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-20").cast("date"), (i % 45).cast("int")).cast("string")
    raw = F.when(i % 17 == 0, F.lit(None)).when(i % 19 == 0, "soon").otherwise(day)
    return d.select(
        i.alias("id"), F.trim(F.concat_ws(" ", pick("doc_id", TITLES), pick("doc_id", TITLES, 24, 5))).alias("title"), pick("doc_id", SUMMARIES, 7, 2).alias("summary"),
        F.concat(F.lit("https://"), pick("doc_id", HOSTS, 3), F.lit("/a/"), F.floor(i / 2).cast("string")).alias("url"), pick("doc_id", PAPERS, 2).alias("source_name"), pick("doc_id", ("news", "official", "news", "international"), 5).alias("source_type"),
        F.when(i % 4 == 0, "international").otherwise("taiwan").alias("region"), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")).cast("date").alias("published_at"),
    )


NEWS = f"""news as (select doc_id id, trim(concat_ws(' ', {sql_pick('doc_id', TITLES)}, {sql_pick('doc_id', TITLES, 24, 5)})) title, {sql_pick('doc_id', SUMMARIES, 7, 2)} summary,
 'https://' || {sql_pick('doc_id', HOSTS, 3)} || '/a/' || cast(doc_id // 2 as varchar) url, {sql_pick('doc_id', PAPERS, 2)} source_name, {sql_pick('doc_id', ('news', 'official', 'news', 'international'), 5)} source_type,
 case when doc_id % 4 = 0 then 'international' else 'taiwan' end region, case when doc_id % 17 <> 0 and doc_id % 19 <> 0 then date '2024-01-20' + cast(doc_id % 45 as integer) end published_at from documents)"""

SUBJECTS = ("社會工作", "人類行為與社會環境", "社會工作直接服務", "社會工作研究方法", "社會政策與社會立法", "社會工作管理")
#: Exam subjects of each news category.
SUBJECTS_OF = {
    "兒少保護": (2, 4, 0), "家暴與性暴力": (2, 4), "心理健康與成癮": (1, 2), "長照與高齡": (4, 2), "社會救助與居住": (4, 0), "身障與人權": (4, 0), "移工與新住民": (0, 4),
    "勞動與社會保障": (4, 0), "教育與學生輔導": (2, 4, 0), "司法保護與修復式司法": (2, 4, 0), "少年司法與犯罪防治": (2, 4), "性別與家庭政策": (4, 0), "災害與社區工作": (0, 2), "社工專業與社福制度": (0, 2, 4),
}
STEMS = ("下列何者符合長照與失智照顧者之權益？", "關於家庭暴力與兒少保護通報，何者正確？", "社會救助與貧窮家庭之給付", "某獨居老人申請住宿補助之情境", "托育與育兒津貼", "勞保年金與延後退休", "修復式司法之原則", "社會工作研究之信度", "難民與移工之社會保障")
TOPICS = ("長照", "兒少保護", "社會救助", "居家托育", "勞工保險", "犯罪被害人", "研究法", "移民")
LAWS = ("社會救助法", "老人福利法", "", "兒童及少年福利與權益保障法", "家庭暴力防治法", None)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exam question for each order: id, subject, year (of the era), qno, question, topic, keywords (one text), law."""
    i = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        i.alias("id"), pick("o_orderkey", SUBJECTS).alias("subject"), (F.year("o_orderdate") - 1911).cast("string").alias("year"), ((i % 45).cast("string")).alias("qno"), pick("o_orderkey", STEMS, 5).alias("question"),
        pick("o_orderkey", TOPICS, 45).alias("topic"), pick("o_orderkey", ("長照,失智", "[\"兒虐\", \"通報\"]", "托育；津貼 補助", ""), 360).alias("keywords"), pick("o_orderkey", LAWS, 1440).alias("law"),
    )


QUESTIONS = f"""questions as (select o_orderkey id, {sql_pick('o_orderkey', SUBJECTS)} subject, cast(year(o_orderdate) - 1911 as varchar) as year, cast(o_orderkey % 45 as varchar) qno, {sql_pick('o_orderkey', STEMS, 5)} question,
 {sql_pick('o_orderkey', TOPICS, 45)} topic, {sql_pick('o_orderkey', ('長照,失智', '["兒虐", "通報"]', '托育；津貼 補助', ''), 360)} keywords, {sql_pick('o_orderkey', LAWS, 1440)} law from orders)"""
