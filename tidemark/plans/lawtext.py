"""Law and exam texts: articles of law pages, article references, dates of the era, effective dates, normalised and semantic text, exam text to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import bound, nfkc, utc
from tidemark.operators.relations import containments
from tidemark.operators.rules import ladder
from tidemark.plans.derived import pick, quoted, sql_pick
from tidemark.sources.tables import read

#: Numerals.
DIGITS = {"零": 0, "〇": 0, "○": 0, "一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
NUMBER = "[0-9零〇○一二兩三四五六七八九十百千]+"
ERA = 1911


def numeral(text: Column) -> Column:
    """A number in digits or Chinese numerals, null for anything else."""
    value = F.create_map(*(F.lit(x) for kv in (DIGITS | UNITS).items() for x in kv))
    chars = F.filter(F.split(text, ""), lambda x: x != "")
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("current"))

    def add(acc: Column, ch: Column) -> Column:
        unit = F.array_contains(F.array(*map(F.lit, UNITS)), ch)
        times = F.when(acc["current"] == 0, 1).otherwise(acc["current"])
        return F.struct(F.when(unit, acc["total"] + times * value[ch]).otherwise(acc["total"]).alias("total"), F.when(unit, 0).otherwise(value[ch]).alias("current"))

    read_ = F.aggregate(chars, start, add, lambda acc: acc["total"] + acc["current"])
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int")).when(text.rlike(f"^{NUMBER}$") & ~text.rlike("[0-9]"), read_)


def day(year: Column, month: Column, date: Column) -> Column:
    """A date of the era, null where there is no such day. The numbers are read once."""
    text = lambda n: F.format_string("%04d-%02d-%02d", n[0] + ERA, n[1], n[2])
    numbers = F.array(F.transform(F.array(year, month, date), numeral))
    return F.element_at(F.transform(numbers, lambda n: F.when(~F.exists(n, lambda x: x.isNull()), F.try_to_date(text(n), "yyyy-MM-dd"))), 1)


def part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def spelt(n: Column) -> Column:
    """A number under 1000 in Chinese numerals, as laws write it: 一百零二, 十二, 一百一十三."""
    digit = lambda x: F.substring(F.lit("零一二三四五六七八九"), x + 1, F.lit(1))
    hundreds, tens, ones = (F.floor(n / k).cast("int") % 10 for k in (100, 10, 1))
    ten = F.when((tens == 0) & ((hundreds == 0) | (ones == 0)), "").when(tens == 0, "零").when((tens == 1) & (hundreds == 0), "十").otherwise(F.concat(digit(tens), F.lit("十")))
    return F.concat(F.when(hundreds > 0, F.concat(digit(hundreds), F.lit("百"))).otherwise(""), ten, F.when((ones > 0) | (n == 0), digit(ones)).otherwise(""))


def era_text(date: Column, chinese: Column) -> Column:
    """A date as 年月日 of the era, in digits or Chinese numerals."""
    form = lambda x: F.when(chinese, spelt(x)).otherwise(x.cast("string"))
    return F.concat(form(F.year(date) - ERA), F.lit("年"), form(F.month(date)), F.lit("月"), form(F.day(date)), F.lit("日"))


def era_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and spans of the era in texts made of each order's date; some name a day that there isn't."""
    c, k = F.col, F.col("o_orderkey")
    date = c("o_orderdate").cast("date")
    d = F.concat(F.lit("中華民國"), F.when(k % 11 == 0, F.concat((F.year(date) - ERA).cast("string"), F.lit("年 2 月 30 日"))).otherwise(era_text(date, k % 2 == 0)), F.lit("公布"))
    short = lambda x: F.concat_ws("/", F.month(x), F.day(x))
    full = lambda x: F.concat_ws("/", F.year(x) - ERA, short(x))
    end = F.date_add(date, (k % 40).cast("int"))
    s = F.concat(F.lit("考試日期："), full(date), F.when(k % 3 == 0, "").otherwise(F.concat(pick("o_orderkey", ("~", "～", "至")), F.when((k % 3 == 1) & (F.year(end) == F.year(date)), short(end)).otherwise(full(end)))))
    pattern = rf"中華民國\s*({NUMBER})\s*年\s*({NUMBER})\s*月\s*({NUMBER})\s*日"
    span = r"([0-9]{2,3})/([0-9]{1,2})/([0-9]{1,2})(?:[~～至\-]\s*(?:([0-9]{2,3})/)?([0-9]{1,2})/([0-9]{1,2}))?"
    rows = bound(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), d=d, s=s)
    first = day(part(c("s"), span, 1), part(c("s"), span, 2), part(c("s"), span, 3))
    last = day(F.coalesce(part(c("s"), span, 4), part(c("s"), span, 1)), part(c("s"), span, 5), part(c("s"), span, 6))
    return rows.select("o_orderkey", day(part(c("d"), pattern, 1), part(c("d"), pattern, 2), part(c("d"), pattern, 3)).alias("day"), first.alias("first"), F.coalesce(last, first).alias("last"))


def article_number(text: Column) -> Column:
    """12, 12-1 and 十二之一 as digits joined by -; null for anything else."""
    parts = F.split(F.regexp_replace(F.replace(text, F.lit("之"), F.lit("-")), r"\s+", ""), "-")
    numbers = F.transform(parts, numeral)
    return F.when(~F.exists(numbers, lambda x: x.isNull()), F.array_join(numbers.cast("array<string>"), "-"))


def article_scope(text: Column) -> Column:
    """Articles named in a text, spans spread out (at most 300), in number order."""
    groups = F.regexp_extract_all(text, F.lit(r"第\s*([0-9\-、,，～~至\s之]+?)\s*條"), F.lit(1))
    tokens = F.flatten(F.transform(groups, lambda g: F.split(F.replace(g, F.lit("之"), F.lit("-")), "[、,，]")))
    low, high = (lambda t: F.regexp_extract(t, r"^\s*([0-9]+)\s*[～~至]\s*([0-9]+)\s*$", 1).try_cast("int")), (lambda t: F.regexp_extract(t, r"^\s*([0-9]+)\s*[～~至]\s*([0-9]+)\s*$", 2).try_cast("int"))
    spread = lambda t: F.when((low(t) <= high(t)) & (high(t) - low(t) <= 300), F.transform(F.sequence(low(t), high(t)), lambda n: n.cast("string")))
    one = lambda t: F.when(F.regexp_replace(t, r"\s+", "").rlike("^[0-9]+(-[0-9]+)*$"), F.array(F.regexp_replace(t, r"\s+", "")))
    found = F.array_distinct(F.flatten(F.filter(F.transform(tokens, lambda t: F.coalesce(spread(t), one(t))), lambda x: x.isNotNull())))
    return F.transform(F.array_sort(F.transform(found, lambda a: F.struct(F.transform(F.split(a, "-"), lambda n: n.cast("int")).alias("k"), a.alias("a")))), lambda s: s["a"])


def explicit_articles(text: Column) -> Column:
    """Articles written out in a text, 第 2 條之 1 as 2-1, in number order."""
    return article_scope(F.regexp_replace(text, r"第\s*([0-9]+)\s*條\s*之\s*([0-9]+)", "第$1-$2條"))


def article_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that texts made of each order's numbers refer to, in the order of their numbers: single ones, spans (one of them reversed on some) and one with a branch."""
    k, n = F.col("o_orderkey"), lambda x: x.cast("string")
    low = k % 97 + 1
    high = F.when(k % 13 == 0, low - 1).otherwise(low + k % 6)
    text = F.concat(F.lit("依第"), n(k % 89 + 1), F.lit("條、第"), n(low), pick("o_orderkey", ("～", "至", "~")), n(high), F.lit("條及第"), n(k % 31 + 1), F.lit("條之"), n(k % 4 + 1), F.lit("規定，第 "), n(k % 7 + 1), F.lit(" 條第 2 項"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(explicit_articles(text), ",").alias("articles"))


def effective_date(summary: Column, promulgated: Column, article: Column, all_articles: Column, special: Column) -> Column:
    """From when an article holds after an amendment, by the first rule that fits.

    A clause that names the article; for all articles a clause by the statute; a single clause without articles; for all
    articles the last clause without articles; the day of publication where the text says so; the first of the next year
    where it says so; the day of publication if nothing special is said; else unknown.
    """
    text = F.regexp_replace(summary, r"\s+", "")
    clause = rf"自(?:中華民國)?({NUMBER})年({NUMBER})月({NUMBER})日(?:起)?施行"
    found = F.regexp_extract_all(text, F.lit(f"({clause})"), F.lit(1))
    before = F.slice(F.split(text, clause), 1, F.size(found))
    scope_text = F.transform(before, lambda p: F.regexp_extract(p, "([^;；。]*)$", 1))
    clauses = F.filter(
        F.zip_with(found, scope_text, lambda f, s: F.struct(day(part(f, clause, 1), part(f, clause, 2), part(f, clause, 3)).alias("day"), article_scope(s).alias("scope"), s.rlike("依第[^條]+條規定[:：]?").alias("statute"))),
        lambda x: x["day"].isNotNull(),
    )
    published = F.try_to_date(promulgated, "yyyy-MM-dd")

    def first_fit(clauses: Column) -> Column:
        named = F.filter(clauses, lambda x: F.array_contains(x["scope"], article))
        statute, open_ = F.filter(clauses, lambda x: x["statute"]), F.filter(clauses, lambda x: F.size(x["scope"]) == 0)
        steps = (
            (F.size(named) > 0, F.get(named, F.lit(0))["day"]), (all_articles & (F.size(statute) > 0), F.get(statute, F.lit(0))["day"]), ((F.size(clauses) == 1) & (F.size(open_) == 1), F.get(open_, F.lit(0))["day"]),
            (all_articles & (F.size(open_) > 0), F.get(open_, F.size(open_) - 1)["day"]), (text.rlike("自公布日起?施行"), published), (text.rlike("自公布後次年(?:之)?一月一日施行"), F.make_date(F.year(published) + 1, F.lit(1), F.lit(1))), (~special, published),
        )
        out = F.when(~promulgated.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(None).cast("date"))
        for condition, value in steps:
            out = out.when(condition, value)
        return out

    # the clauses are bound once, else each step would read the text again
    return F.element_at(F.transform(F.array(clauses), first_fit), 1)


def effective_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From when articles hold after amendments, whose texts are made of each order's date and numbers: each step of the ladder in turn."""
    k, date = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    one, other = (F.concat(F.lit("第"), (k % 90 + n).cast("string"), F.lit("條")) for n in (1, 2))
    since, later = F.date_add(date, (k % 200 + 10).cast("int")), F.date_add(date, (k % 200 + 300).cast("int"))
    at = lambda x: F.concat(F.lit("自"), F.when(k % 4 == 0, F.lit("中華民國")).otherwise(""), era_text(x, k % 3 == 0), F.lit("施行"))
    texts = (
        F.concat(F.lit("修正"), one, F.lit("；"), one, at(since)), F.concat(F.lit("修正全文，依"), other, F.lit("規定："), at(since)), F.concat(F.lit("修正公布；"), at(since)), F.concat(one, at(since), F.lit("；"), other, at(later)), F.concat(F.lit("修正"), one, F.lit("，並自公布日施行")),
        F.concat(F.lit("修正"), one, F.lit("，自公布後次年一月一日施行")), F.concat(F.lit("修正"), one), F.lit("施行日期由行政院定之"), F.concat(one, at(since), F.lit("；其餘"), at(later)), F.concat(F.lit("修正"), one),
    )
    summary = F.when(k % len(texts) == 0, texts[0])
    for n, text in enumerate(texts[1:], 1):
        summary = summary.when(k % len(texts) == n, text)
    article = F.when((k % 10).isin(3, 8), k % 90 + 2).otherwise(k % 90 + 1).cast("string")
    promulgated = F.when(k % 10 == 9, F.date_format(date, "MM/dd")).otherwise(date.cast("string"))
    rows = bound(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), _summary=F.regexp_replace(summary, r"\s+", ""), _promulgated=promulgated, _article=article)  # only a row's own text is made, once
    found = effective_date(F.col("_summary"), F.col("_promulgated"), F.col("_article"), (k % 10).isin(1, 8), k % 10 != 6)
    return rows.select("o_orderkey", found.alias("since"))


HEADINGS = ("第 1 條", "第 2-1 條", "第 2 之 1 條", "第十條", "第 1 條")


def law_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A law page for each document: five headings, each with words of the document; the old layout on some."""
    plain = F.translate(F.coalesce("text", F.lit("")), "<>&\n", "    ")
    old = F.col("doc_id") % 3 == 0
    rows = [F.concat(F.when(old, '<div class="col-no">').otherwise("<p>"), F.lit(h), F.when(old, '</div><div class="law-article x">').otherwise("</p><p>"), F.substring(plain, 1 + 40 * k, 40 + k), F.when(old, "</div>").otherwise("</p>")) for k, h in enumerate(HEADINGS)]
    page = F.concat(F.lit("<title>全國法規資料庫</title><script>第 9 條</script>"), *rows)
    return read(spark, sf_dir, "documents").select("doc_id", page.alias("html"))


def articles_by_headings(html: Column) -> Column:
    """Articles of a page as (article, text): a line that is a heading opens one."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|title)[^>]*>.*?</\1>", "\n"), "<[^>]*>", "\n")
    heading = rf"(?m)^[ \t]*第\s*{NUMBER}(?:(?:\s*之\s*|\s*-\s*){NUMBER})?\s*條[ \t]*$"
    number = F.transform(F.regexp_extract_all(text, F.lit(heading), F.lit(0)), lambda h: article_number(F.regexp_replace(h, r"[第條\s]", "")))
    body = F.transform(F.slice(F.split(text, heading), 2, F.size(number)), lambda b: F.substring(F.trim(F.regexp_replace(b, r"\s+", " ")), 1, 12_000))
    return F.zip_with(number, body, lambda a, t: F.struct(a.alias("article"), t.alias("text")))


def articles_by_boxes(html: Column) -> Column:
    """Articles of a page in the old layout: pairs of number and text boxes."""
    box = r'(?is)<div\b[^>]*class="[^"]*\bcol-no\b[^"]*"[^>]*>\s*第\s*([^<]+?)\s*條\s*</div>'
    number = F.transform(F.regexp_extract_all(html, F.lit(box), F.lit(1)), article_number)
    body = F.transform(F.slice(F.split(html, box), 2, F.size(number)), lambda b: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(b, r'(?is)<div\b[^>]*class="[^"]*\blaw-article\b[^"]*"[^>]*>(.*)', 1), "<[^>]*>", " "), r"\s+", " ")))
    return F.zip_with(number, body, lambda a, t: F.struct(a.alias("article"), t.alias("text")))


def law_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of law pages by both layouts: the first of a number in each, of both the longer text."""
    p = law_pages(spark, sf_dir)
    both = [p.select("doc_id", F.posexplode(f("html")).alias("place", "a")).select("doc_id", "place", F.lit(k).alias("way"), "a.article", "a.text") for k, f in enumerate((lambda x: articles_by_headings(F.col(x)), lambda x: articles_by_boxes(F.col(x))))]
    first = both[0].unionByName(both[1]).where("article is not null and text <> ''").groupBy("doc_id", "article", "way").agg(F.min(F.struct("place", "text"))["text"].alias("text"))
    best = first.groupBy("doc_id", "article").agg(F.max_by("text", F.struct(F.length("text"), -F.col("way"))).alias("text"))
    return best.select("doc_id", "article", F.length("text").cast("long").alias("chars"), F.substring(F.sha2("text", 256), 1, 16).alias("sha"))


def normalised(text: Column) -> Column:
    """NFKC, white space as one space, 臺 as 台."""
    return F.replace(nfkc(text), F.lit("臺"), F.lit("台"))


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of full-width digits, ligatures, circled numbers and white space around each customer's number and name."""
    k, c = F.col("c_custkey"), F.col
    wide = F.translate(k.cast("string"), "0123456789", "０１２３４５６７８９")
    text = F.concat(F.lit("  "), wide, F.lit("　臺灣ﬁ\t"), pick("c_custkey", ("①", "Ａ", "é", "㎏")), F.lit(" \n "), c("c_name"), F.lit(" "))
    return read(spark, sf_dir, "customer").select("c_custkey", normalised(text).alias("text"))


#: Ends of names of laws, and phrases without meaning of their own, in the order in which they go.
SUFFIXES = ("施行法", "特別條例", "條例", "自治條例", "法")
PHRASES = "依據 依照 根據 依 我國 規定 所定 有關 關於 下列何者 下列敘述 何者正確 何者錯誤 何者不正確 何者不適用 何者符合 請問 的敘述 之敘述 下列 敘述 正確 錯誤".split()


def semantic_text(text: Column, law: str) -> Column:
    """What a text says beside the law's name, article numbers and set phrases: letters, digits and Chinese characters only."""
    core = next((law[: -len(s)] for s in SUFFIXES if law.endswith(s) and len(law) - len(s) >= 4), law)
    out = F.replace(F.replace(text, F.lit(law), F.lit("")), F.lit(core), F.lit("")) if core != law else F.replace(text, F.lit(law), F.lit(""))
    out = F.regexp_replace(out, rf"第\s*{NUMBER}(?:(?:\s*之\s*|\s*-\s*){NUMBER})?\s*條(?:\s*之\s*{NUMBER})?", "")
    for phrase in PHRASES:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    return F.regexp_replace(out, "[^0-9A-Za-z一-鿿]", "")


def semantic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What questions made of each part's name and number say beside the law, its articles and set phrases."""
    n = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("依據社會救助法第"), n, F.lit("條之 1 規定，關於 "), F.col("p_name"), F.lit(" 之給付("), n, F.lit(")，社會救助之敘述，下列何者正確？"))
    return read(spark, sf_dir, "part").select("p_partkey", semantic_text(text, "社會救助法").alias("text"))


def search_key(text: Column) -> Column:
    """A name as the search compares it."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s　（）()《》〈〉「」『』【】·・,，.。:：;；/\\_-]+", "")


def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names (brands of parts, as written in texts) and the first entry (distinct types) that contains them or that they contain, five at most for each size of parts."""
    p = read(spark, sf_dir, "part")
    entries = p.select(search_key(F.col("p_type")).alias("e")).distinct()
    names = p.select("p_size", search_key(F.substring("p_type", 3, 6)).alias("n")).distinct()
    hit = names.join(containments(names, entries, "n", "e"), "n").groupBy("p_size", "n").agg(F.min("e").alias("hit"))
    g = hit.groupBy("p_size").agg(F.slice(F.array_sort(F.collect_set("hit")), 1, 5).alias("hits"))
    return g.select("p_size", F.array_join("hits", ",").alias("hits"))


MARKS = {"Ⓐ": "A", "Ⓑ": "B", "Ⓒ": "C", "Ⓓ": "D"}


def exam_blocks(text: Column) -> Column:
    """(number, text) of the questions of an exam's text. A number opens a question only if it is the next one."""
    starts = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*([0-9]{1,2})[ \t]+"), F.lit(1))
    bodies = F.slice(F.split(text, r"(?m)^[ \t]*[0-9]{1,2}[ \t]+"), 2, F.size(starts))
    pairs = F.zip_with(starts, bodies, lambda n, b: F.struct(n.cast("int").alias("n"), b.alias("b"), n.alias("raw")))
    empty = F.array().cast("array<struct<n:int,b:string>>")

    def take(done: Column, x: Column) -> Column:
        opened = F.concat(done, F.array(F.struct(x["n"].alias("n"), x["b"].alias("b"))))
        last = F.try_element_at(done, F.lit(-1))
        more = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["n"].alias("n"), F.concat(last["b"], x["raw"], F.lit(" "), x["b"]).alias("b"))))
        return F.when(x["n"] == F.size(done) + 1, opened).when(F.size(done) == 0, done).otherwise(more)

    return F.aggregate(pairs, empty, take)


def exam_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in exam texts made of each order's number: up to five, on some with a line behind the first that begins with a number out of turn; how many are accepted, and their text."""
    k = F.col("o_orderkey")
    stem = lambda i: F.concat(i.cast("string"), F.lit("  stem"), k.cast("string"), F.lit("-"), i.cast("string"), F.lit("\n"), F.when((i == 1) & (k % 3 == 0), F.lit("7 note\n")).otherwise(""))
    text = F.concat(F.lit("3 cover\n"), F.array_join(F.transform(F.sequence(F.lit(1), (k % 5 + 1).cast("int")), stem), ""))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", exam_blocks(text).alias("q"))
    return rows.select("o_orderkey", F.size("q").cast("long").alias("accepted"), F.trim(F.regexp_replace(F.array_join(F.transform("q", lambda x: x["b"]), " "), r"\s+", " ")).alias("text"))


def option_rows(raw: Column) -> Column:
    """Stem and options of a raw question; null if one of A to D is missing or blank, or the stem is."""
    text = raw
    for mark, letter in MARKS.items():
        text = F.replace(text, F.lit(mark), F.lit(f"\n@@{letter}@@ "))
    text = F.regexp_replace(text, r"(?m)^[ \t]*([ＡA])[.、．][ \t]*", "\n@@A@@ ")
    for wide, letter in zip("ＢＣＤ", "BCD", strict=True):
        text = F.regexp_replace(text, rf"(?m)^[ \t]*([{wide}{letter}])[.、．][ \t]*", f"\n@@{letter}@@ ")
    marks = F.regexp_extract_all(text, F.lit("@@([ABCD])@@"), F.lit(1))
    parts = F.transform(F.split(text, "@@[ABCD]@@"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"\s*代號[:：]\s*[0-9]+\s*$", "")))
    return F.when((F.array_join(marks, "") == "ABCD") & ~F.exists(parts, lambda x: x == ""), parts)


def exam_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stem and options of questions made of each order's numbers in three layouts; on some an option is blank."""
    k = F.col("o_orderkey")
    style = (("Ⓐ", " Ⓑ", "\nⒸ", " Ⓓ "), ("\nA. ", "\nＢ．", "\nC、", "\nD."), ("Ⓐ ", "\nⒷ ", "\nC. ", " Ⓓ"))
    value = [F.when((k % 7 == 0) & (i == 2), "").otherwise(F.concat(F.lit(f"opt{'abcd'[i]}"), (k * (i + 3) % 101).cast("string"))) for i in range(4)]
    mark = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in style)), (k % 3 + 1).cast("int"))
    raw = F.concat(F.lit("題幹 "), F.col("o_orderpriority"), F.lit(" "), *(x for i in range(4) for x in (mark(i), value[i])), F.lit(" 代號：1101"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(option_rows(raw), "|").alias("row"))


def essay_points(text: Column) -> Column:
    """Points of an essay: the only mark, or the sum of several up to 40; null without a mark, with a zero, or if they add up to more."""
    marks = F.transform(F.regexp_extract_all(text, F.lit(r"[（(]\s*([0-9]+)\s*分\s*[）)]"), F.lit(1)), lambda x: x.cast("int"))
    total = F.aggregate(marks, F.lit(0), lambda a, x: a + x)
    return F.when((F.size(marks) > 0) & ~F.exists(marks, lambda x: x <= 0) & ((F.size(marks) == 1) | (total <= 40)), total)


def essay_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of essays whose marks are made of each order's numbers: one, two, none, or a zero beside another."""
    k = F.col("o_orderkey")
    p, q = ((k % 25 + 1).cast("string"), (k % 30 + 1).cast("string"))
    texts = (F.concat(F.lit("請說明。（"), p, F.lit("分）")), F.concat(F.lit("比較（"), p, F.lit(" 分）並舉例( "), q, F.lit("分 )")), F.concat(F.lit("沒有配分 "), p), F.concat(F.lit("零（0分）"), F.lit("其一（"), p, F.lit("分）")))
    return read(spark, sf_dir, "orders").select("o_orderkey", essay_points(F.element_at(F.array(*texts), (k % 4 + 1).cast("int"))).cast("long").alias("points"))


def embedded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a JSON array in a page's script: how many, and their ids."""
    page = F.concat(F.lit("<script>window.ESSAYS = ["), F.array_join(F.transform(F.sequence(F.lit(1), (F.col("s_suppkey") % 3 + 1).cast("int")), lambda k: F.concat(F.lit('{"id": "E-'), F.col("s_suppkey").cast("string"), F.lit("-"), k.cast("string"), F.lit('", "q": "x]"}'))), ", "), F.lit("];\nwindow.CLUSTER_ANCHORS = 1</script>"))
    found = F.from_json(F.regexp_extract(page, r"(?s)window\.ESSAYS\s*=\s*(\[.*?\]);\s*\n\s*window\.CLUSTER_ANCHORS", 1), "array<struct<id:string,q:string>>")
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.size(found).cast("long").alias("n"), F.array_join(F.transform(found, lambda x: x["id"]), ",").alias("ids"))


def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When news of "N minutes, hours or days ago" appeared, and the seconds from an event to the local midnight, one at least."""
    e = read(spark, sf_dir, "events")
    said = F.concat((F.col("event_id") % 50 + 1).cast("string"), F.lit(" "), pick("event_id", ("分鐘前", "小時前", "天前", "剛剛")))
    n = F.regexp_extract(said, r"^([0-9]+)\s*(?:分鐘|小時|天)前", 1).try_cast("long")
    unit = ladder([(said.contains("分鐘前"), "60"), (said.contains("小時前"), "3600"), (said.contains("天前"), "86400")], None).cast("long")
    at = F.unix_seconds(utc(F.col("ts")))
    left = F.greatest(F.lit(1), F.ceil(86_400 - F.pmod((F.unix_micros(utc(F.col("ts"))) + F.lit(8 * 3600 * 1_000_000)) / 1e6, F.lit(86_400.0)))).cast("long")
    return e.select("event_id", (at - n * unit).alias("published"), left.alias("to_midnight"))


#: Patterns of a policy, one of them no regular expression: that one counts as plain text.
POLICY_PATTERNS = (r"th[aeiou]+n", "(er", "eau|heit", "[0-9]{3}")


def pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which patterns a text matches; one that does not compile is looked for as it stands. Each is compiled once, when the plan is made."""
    import re

    text = F.coalesce(F.col("text"), F.lit(""))
    found = []
    for p in POLICY_PATTERNS:
        try:
            re.compile(p)
            hit = text.rlike("(?i)" + p)
        except re.error:
            hit = F.contains(text, F.lit(p))
        found.append(F.when(hit, F.lit(p)))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_compact(F.array(*found)), " ").alias("hits"))


QUERIES = {
    f.__name__: f
    for f in (era_dates, article_references, effective_dates, law_articles, normal_forms, semantic_texts, name_matches, exam_questions, exam_options, essay_scores, embedded_rows, relative_times, pattern_hits)
}


PAGE = "translate(coalesce(text, ''), '<>&' || chr(10), '    ')"
NUMBERS_ = ("1", "2-1", "2-1", "10", "1")
ORACLE = {
    "era_dates": """with o as (select o_orderkey k, cast(o_orderdate as date) d from orders) select k o_orderkey, case when k % 11 <> 0 then d end as day, d as first, case when k % 3 = 0 then d else cast(d + cast(k % 40 as integer) as date) end as last from o""",
    "article_references": """with o as (select o_orderkey k, o_orderkey % 97 + 1 low, case when o_orderkey % 13 = 0 then o_orderkey % 97 else o_orderkey % 97 + 1 + o_orderkey % 6 end high from orders),
 a as (select k, list_sort(list_distinct(list_concat(list_concat([[k % 89 + 1, 0], [k % 31 + 1, k % 4 + 1], [k % 7 + 1, 0]], list_transform(generate_series(low, high), lambda n: [n, 0]))))) a from o)
 select k o_orderkey, array_to_string(list_transform(a, lambda x: x[1]::varchar || case when x[2] > 0 then '-' || x[2]::varchar else '' end), ',') articles from a""",
    "effective_dates": """with o as (select o_orderkey k, cast(o_orderdate as date) d from orders), e as (select k, d, cast(d + cast(k % 200 + 10 as integer) as date) s, cast(d + cast(k % 200 + 300 as integer) as date) l from o)
 select k o_orderkey, case when k % 10 in (0, 1, 2) then s when k % 10 in (3, 8) then l when k % 10 in (4, 6) then d when k % 10 = 5 then make_date(year(d) + 1, 1, 1) end since from e""",
    "law_articles": f"""with t as (select doc_id, unnest([{', '.join(f"{{a: '{a}', k: {k}, t: trim(regexp_replace(substr({PAGE}, {1 + 40 * k}, {40 + k}), '[ \\t\\r\\x0b\\f]+', ' ', 'g'))}}" for k, a in enumerate(NUMBERS_))}]) x from documents),
 f as (select doc_id, x.a article, arg_min(x.t, x.k) t from t where x.t <> '' group by 1, 2) select doc_id, article, cast(length(t) as bigint) chars, left(sha256(t), 16) sha from f""",
    "normal_forms": f"""select c_custkey, c_custkey::varchar || ' 台灣fi ' || {sql_pick('c_custkey', ('1', 'A', 'é', 'kg'))} || ' ' || c_name as text from customer""",
    "semantic_texts": """select p_partkey, regexp_replace(p_name, '[^0-9A-Za-z]', '', 'g') || '之給付' || p_partkey::varchar as text from part""",
    "name_matches": r"""with n as (select distinct p_size, regexp_replace(lower(substr(p_type, 3, 6)), '[\s　（）()《》〈〉「」『』【】·・,，.。:：;；/\\_-]+', '', 'g') n from part), e as (select distinct regexp_replace(lower(p_type), '[\s　（）()《》〈〉「」『』【】·・,，.。:：;；/\\_-]+', '', 'g') e from part),
 h as (select p_size, n, min(e) h from n join e on contains(e, n) or contains(n, e) group by 1, 2), r as (select distinct p_size, h from h), k as (select *, row_number() over (partition by p_size order by h) r from r) select p_size, string_agg(h, ',' order by h) hits from k where r <= 5 group by 1""",
    "exam_questions": """select o_orderkey, o_orderkey % 5 + 1 accepted, array_to_string(list_transform(generate_series(1, o_orderkey % 5 + 1), lambda i: 'stem' || o_orderkey::varchar || '-' || i::varchar || case when i = 1 and o_orderkey % 3 = 0 then ' 7 note' else '' end), ' ') as text from orders""",
    "exam_options": """select o_orderkey, case when o_orderkey % 7 <> 0 then '題幹 ' || o_orderpriority || '|' || array_to_string(list_transform(generate_series(0, 3), lambda i: 'opt' || substr('abcd', cast(i + 1 as integer), 1) || (o_orderkey * (i + 3) % 101)::varchar), '|') end as row from orders""",
    "essay_scores": """select o_orderkey, case when o_orderkey % 4 = 0 then o_orderkey % 25 + 1 when o_orderkey % 4 = 1 and o_orderkey % 25 + o_orderkey % 30 + 2 <= 40 then o_orderkey % 25 + o_orderkey % 30 + 2 end points from orders""",
    "embedded_rows": "select s_suppkey, s_suppkey % 3 + 1 n, array_to_string(list_transform(generate_series(1, s_suppkey % 3 + 1), lambda k: 'E-' || cast(s_suppkey as varchar) || '-' || cast(k as varchar)), ',') ids from supplier",
    "relative_times": """select event_id, cast(floor(epoch(ts)) as bigint) - (event_id % 50 + 1) * [60, 3600, 86400, null][cast(event_id % 4 + 1 as integer)] published,
 cast(greatest(1, ceil(epoch(date_trunc('day', ts + interval 8 hour) + interval 1 day) - epoch(ts + interval 8 hour))) as bigint) to_midnight from events""",
    "pattern_hits": f"""select doc_id, concat_ws(' ', {', '.join(f"case when {'contains' if p == '(er' else 'regexp_matches'}(coalesce(text, ''), {quoted(p if p == '(er' else '(?i)' + p)}) then {quoted(p)} end" for p in POLICY_PATTERNS)}) hits from documents""",
}
