"""Operators on small fixtures: semantic traps, folds, state machines, law dates, shards, streams."""

import random
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import relations, rules, state
from tidemark.plans import lawtext
from tidemark.sources import shards


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_columns(spark):
    r = one(
        spark, C.half_even(F.lit(0.125), 2), C.half_away(F.lit("0.125").cast("decimal(5,3)"), 2).cast("double"), C.js_round(F.lit(-2.5)), C.percent(F.lit(1), F.lit(0)), C.local_day(F.lit("2024-01-01 17:00:00").cast("timestamp_ntz")).cast("string"),
        C.bucket(F.lit("2024-01-01 10:07:59").cast("timestamp")).cast("string"), C.qno_number(F.lit("x")), C.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), C.nfkc(F.lit("Ａ　　ﬁ")),
    )
    assert list(r) == [0.12, 0.13, -2, 0, "2024-01-02", "2024-01-01 10:05:00", 999999, 0.0, "A fi"]


@pytest.mark.parametrize("text, n, want", [("", 2, []), ("a", 2, ["a"]), ("abab", 2, ["ab", "ba"]), ("é😀x", 2, ["é😀", "😀x"])])
def test_char_ngrams(spark, text, n, want):
    assert list(one(spark, C.char_ngrams(F.lit(text), n))[0]) == want


@pytest.mark.parametrize("text, want", [("free pass", True), ("not a pass", False), ("not a pass, but this long text later has a pass", True), ("pass", True), ("notxxxxxxxxxxxxxxxxxxxx pass", True), ("", False)])
def test_affirmed(spark, text, want):
    assert one(spark, C.affirmed(F.lit(text), "pass", ["not "]))[0] is want


def test_alias_borders(spark):
    for text, alias, want in (("an AI tool", "ai", True), ("rain", "ai", False), ("long  term care", "long term", True), ("長期照顧法", "照顧", True)):
        assert one(spark, C.has_alias(F.lit(text), alias))[0] is want


def test_article_refs(spark):
    assert sorted(one(spark, C.article_refs(F.lit("第 5 條、第12條之1 及第7條至第9條")))[0]) == sorted(["5", "12-1", "12", "7", "8", "9"])


def test_url_gate(spark):
    for url, want in (("https://a.example.org/x", True), ("https://example.org", True), ("http://example.org/", False), ("https://example.org.evil.net/", False), ("https://u@example.org/", False), ("https://example.org:8443/", False), ("https://example.org:443/", True), (None, False)):
        assert one(spark, C.allowed_url(F.lit(url).cast("string"), ["example.org"]))[0] is want, url


def test_rules_are_strict(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    got = rules.check(df, [rules.Rule("r", "l", "review", "high", "m", F.col("v") != "a")]).orderBy("k").collect()
    assert [r.status for r in got] == ["passed", "review"]
    assert one(spark, rules.worst(F.array(F.lit("passed"), F.lit("odd")), rules.STATUSES))[0] == "blocked"


def test_distinct_pairs_count_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", "b")], "x string, y string")
    assert df.agg(F.count_distinct(F.struct("x", "y"))).first()[0] == 2


def test_asof_takes_the_latest_published_of_those_in_force(spark):
    r = random.Random(1)
    day = lambda k: date(2024, 1, 1 + k)
    versions = [(r.randrange(3), k, day(r.randrange(20)), None if k % 7 == 0 else day(r.randrange(25))) for k in range(60)]
    facts = [(r.randrange(4), k, None if k % 11 == 0 else day(r.randrange(28))) for k in range(80)]
    v = spark.createDataFrame(versions, "law int, version_id int, version_date date, effective_date date")
    f = spark.createDataFrame(facts, "law int, q int, at date")
    got = {x.q: x.version for x in relations.asof(f, v, "law", "at", version_date="version_date", effective_date="effective_date", carry="version_id").collect()}
    for law_, q, at in facts:
        fit = [(-d.toordinal(), i) for x, i, d, e in versions if x == law_ and at and e and e <= at and d <= at]
        assert got[q] == (min(fit)[1] if fit else None)


def test_overlay_takes_nulls_and_upsert_keeps_both(spark):
    base, patch = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, relations.overlay(base, patch, "k", ["v"]).collect())) == [(1, "a", False), (2, None, True)]
    assert [r.k for r in relations.orphans(base, patch, "k").collect()] == [3]
    merged = relations.upsert(base, patch, ["k"], {"v": F.coalesce(F.col("new")["v"], F.col("old")["v"])})
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_jaccard_pairs_against_brute_force(spark):
    r = random.Random(2)
    rows = [(k, "x" if k % 2 else "y", r.sample("abcdefghij", r.randrange(0, 7))) for k in range(60)]
    got = {(p.a, p.b) for p in relations.jaccard_pairs(spark.createDataFrame(rows, "i int, b string, t array<string>"), "i", "b", "t", 60).collect()}
    first, want = {}, set()
    for i, b, t in rows:
        if t:
            first.setdefault((b, frozenset(t)), i)
    keys = list(first.items())
    for (b1, t1), i in keys:
        for (b2, t2), j in keys:
            if b1 == b2 and i < j and 100 * len(t1 & t2) >= 60 * len(t1 | t2):
                want.add((i, j))
    assert got == want


def command(k, name, now, worker="w", **more):
    return {"task": "t", "seq": k, "command": name, "now": now, "worker": worker, "lease_seconds": 10, "max_attempts": 2, "processed": 0, **more}


def test_lease_state_machine():
    run = [("claim", 0, "w"), ("claim", 5, "x"), ("claim", 10, "x"), ("heartbeat", 12, "w"), ("checkpoint", 12, "x"), ("fail", 13, "x"), ("claim", 14, "w"), ("claim", 23, "w"), ("claim", 24, "w")]
    s, results = None, []
    for k, (name, now, worker) in enumerate(run):
        s, result = state.step(s, command(k, name, now, worker))
        results.append(result)
    assert results == ["claimed", "busy", "reclaimed", "not_owner", "saved", "failed", "retry_not_due", "attempt_limit", "already_terminal"]


def test_review_schedule(spark):
    day = 86_400
    def last(answers):
        df = spark.createDataFrame([([(right, at * day) for right, at in answers],)], "a array<struct<right: boolean, ts: long>>")
        return tuple(df.select(state.review_state(F.col("a")).alias("s")).select("s.streak", "s.due_at", "s.mastered", "s.maintenance_done").first())

    assert last([(True, 0), (True, 3), (True, 10)]) == (3, 24 * day, True, False)
    assert last([(True, 0), (True, 3), (True, 10), (False, 10)]) == (0, 11 * day, False, False)
    assert last([(True, 0), (True, 3), (True, 10), (True, 24), (True, 54)]) == (3, 84 * day, True, True)
    assert last([(False, 1)]) == (0, 2 * day, False, False)


def test_numerals(spark):
    for text, want in [("一百零五", 105), ("二十", 20), ("十", 10), ("一〇五", 5), ("113", 113), ("x", None), ("1十", None)]:
        assert one(spark, lawtext.numeral(F.lit(text)))[0] == want
    numbers = spark.range(1, 1000).select("id", lawtext.spelt(F.col("id")).alias("text"))
    assert numbers.where(lawtext.numeral(F.col("text")) != F.col("id")).count() == 0
    assert numbers.where("id in (7, 10, 12, 90, 102, 113, 210)").select("text").orderBy("id").toPandas()["text"].tolist() == ["七", "十", "十二", "九十", "一百零二", "一百一十三", "二百一十"]


def test_effective_dates(spark):
    def of(summary, article="7", whole=False, special=True, promulgated="2020-05-01"):
        return one(spark, lawtext.effective_date(F.lit(summary), F.lit(promulgated), F.lit(article), F.lit(whole), F.lit(special)))[0]

    day = date(2020, 5, 1)
    assert of("", special=False) == day and of("修正第7條", special=False) == day and of("", special=False, promulgated="05/01") is None
    assert of("第7條自一百一十年一月一日施行；其餘自公布日施行") == date(2021, 1, 1)
    assert of("第5條至第9條自111年3月1日施行", article="9") == date(2022, 3, 1)
    assert of("全文自112年1月1日施行", whole=True) == date(2023, 1, 1)
    assert of("自公布日施行") == day and of("自公布後次年一月一日施行") == date(2021, 1, 1)
    assert of("施行日期由行政院定之") is None and of("第9條自113年1月1日施行") is None


def test_shards_round_trip_and_damage(spark, tmp_path):
    rows = spark.createDataFrame([(y, r, f"q{k}") for k, (y, r) in enumerate([("113", "1"), ("113", "2"), ("114", "1")] * 5)], "year string, round string, id string")
    rev = shards.write_shards(rows, str(tmp_path), ["year", "round"], ["id"])
    again = shards.read_shards(spark, str(tmp_path), rows.schema, ["year", "round"], ["id"])
    assert sorted(again.collect()) == sorted(rows.collect()) and len(rev) == 20
    assert rev == shards.write_shards(rows.orderBy(F.desc("id")), str(tmp_path / "b"), ["year", "round"], ["id"])
    rows.where("id != 'q3'").write.mode("overwrite").partitionBy("year", "round").parquet(f"{tmp_path}/shards")
    with pytest.raises(shards.BadShards):
        shards.read_shards(spark, str(tmp_path), rows.schema, ["year", "round"], ["id"])


def test_snapshots_are_written_only_when_needed(spark):
    s = lambda t, v="x": spark.createDataFrame([(1, v, t)], "k int, v string, generated_at string").withColumn("generated_at", F.col("generated_at").cast("timestamp"))
    old = s("2024-01-01 00:00:00")
    assert not shards.must_write(s("2024-01-01 05:00:00"), old, "2024-01-01 17:59:00")
    assert shards.must_write(s("2024-01-01 05:00:00"), old, "2024-01-01 18:00:00")
    assert shards.must_write(s("2024-01-01 05:00:00", "y"), old, "2024-01-01 05:00:00") and shards.must_write(old, None, "2024-01-01 05:00:00")


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1"}]')
    (tmp_path / "b.json").write_text('{"questions": [{"id": "2"}]}')
    (tmp_path / "c.json").write_text('{"items": [{"id": "3"}, {"id": "4"}]}')
    assert sorted(r.id for r in shards.json_items(spark, str(tmp_path), "struct<id: string>").collect()) == ["1", "2", "3", "4"]


def test_expect_lists_broken_checks(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "k int, score int")
    assert [(r.k, r.broken) for r in shards.expect(df, {"score_range": F.col("score").between(0, 10)}).collect()] == [(2, ["score_range"])]


def test_alike_pairs_by_jaccard_or_overlap(spark):
    from tidemark.operators.relations import alike_pairs

    r = random.Random(11)
    sets = {k: sorted(r.sample("abcdefghijklmnop", r.randrange(1, 12))) for k in range(60)}
    rows = spark.createDataFrame([(k, "x" if k % 3 else "y", t) for k, t in sets.items()], "id long, block string, t array<string>")
    first = {}
    for k, t in sets.items():
        first.setdefault((k % 3 == 0, *t), k)
    want = set()
    for a in first.values():
        for b in first.values():
            x, y = set(sets[a]), set(sets[b])
            if a < b and (a % 3 == 0) == (b % 3 == 0) and (100 * len(x & y) >= 62 * len(x | y) or 100 * len(x & y) >= 72 * min(len(x), len(y))):
                want.add((a, b, len(x & y), len(x | y), min(len(x), len(y))))
    got = {(p.a, p.b, p.n_shared, p.n_all, p.n_less) for p in alike_pairs(rows, "id", "block", "t", 62, 72).collect()}
    assert got == want and any(100 * s < 62 * n for _, _, s, n, _ in got)


def test_numbered_places(spark):
    rows = spark.range(5_000).select((F.col("id") * 7919 % 5_003).alias("k"), F.lit("clash").alias("name"))
    got = sorted((r.k, r.place) for r in relations.numbered(rows, "k").collect())
    assert [p for _, p in got] == list(range(1, 5_001)) and relations.numbered(rows.limit(0), "k").count() == 0


def test_ranges_keep_repeated_facts(spark):
    facts = spark.createDataFrame([(1, 5), (1, 5), (2, 50), (3, None)], "q int, at int")
    ranges = spark.createDataFrame([("old", 0, 9), ("new", 4, 6)], "name string, a int, b int")
    got = sorted((r.q, r.name) for r in relations.latest_range(facts, F.col("at"), ranges, "a", "b", "name").collect() if r.q < 3)
    assert got == [(1, "new"), (1, "new"), (2, None)]


def test_trailing_counts_over_parts(spark):
    r = random.Random(3)
    times = sorted(r.randrange(400_000) for _ in range(300))
    df = spark.createDataFrame([(k % 2, k, t) for k, t in enumerate(times)], "u int, e int, t long").selectExpr("u", "e", "timestamp_seconds(t) as ts")
    got = {x.e: (x.minute, x.day) for x in state.trailing_counts(df, "u", "ts", {"minute": 60, "day": 86_400}).collect()}
    for k, t in enumerate(times):
        own = [x for j, x in enumerate(times) if j % 2 == k % 2]
        assert got[k] == (sum(t - 60 <= x <= t for x in own), sum(t - 86_400 <= x <= t for x in own))


def test_asof_carries_over_months(spark):
    r = random.Random(5)
    day = lambda: f"20{r.randrange(10, 24)}-{r.randrange(1, 13):02d}-{r.randrange(1, 28):02d}"
    versions = [("a" if k % 3 else "b", k, day(), day() if k % 5 else None) for k in range(40)]
    facts = [(k, "a" if k % 2 else "b", day() if k % 9 else None) for k in range(60)] + [(900, "zz", "2020-01-01"), (5, "a", "2020-01-01"), (5, "a", "2020-01-01")]
    v = spark.createDataFrame(versions, "law string, version_id int, p string, e string").selectExpr("law", "version_id", "cast(p as date) version_date", "cast(e as date) effective_date")
    f = spark.createDataFrame(facts, "q int, law string, d string").selectExpr("q", "law", "cast(d as date) at")
    got = sorted(((x.q, x.law, str(x.at), x.version) for x in relations.asof(f, v, "law", "at", version_date="version_date", effective_date="effective_date", carry="version_id").collect()), key=str)
    want = []
    for q, law, at in facts:
        held = [(p, -i) for w, i, p, e in versions if w == law and e and at and p <= at and e <= at]
        want.append((q, law, str(at), -max(held)[1] if held else None))
    assert got == sorted(want, key=str)


def test_set_pairs_over_several_slabs(spark, monkeypatch):
    """Slabs of few sets, and more tokens than columns: the same pairs as all against all."""
    r = random.Random(5)
    rows = [(k, "ab"[k % 2], [f"t{r.randrange(12 if k % 3 else 60)}" for _ in range(r.randrange(1, 25))]) for k in range(160)] + [(900, "a", []), (901, None, ["t1"]), (902, "a", None)]
    df = spark.createDataFrame(rows, "id long, block string, t array<string>")
    first = {}
    for k, b, t in rows:
        if t and b is not None:
            first[b, frozenset(t)] = min(k, first.get((b, frozenset(t)), k))
    sets = sorted((k, b, s) for (b, s), k in first.items())
    pairs = [(b, k, m, len(s & t), len(s | t), min(len(s), len(t))) for k, b, s in sets for m, c, t in sets if k < m and b == c]
    for slab, width in ((4_000, 2_048), (7, 2_048), (7, 8)):
        monkeypatch.setattr(relations, "SLAB", slab)
        monkeypatch.setattr(relations, "FEW", min(slab, 500))
        monkeypatch.setattr(relations, "WIDTH", width)
        monkeypatch.setattr(relations, "STEP", 3)
        assert sorted(map(tuple, relations.alike_pairs(df, "id", "block", "t", 62, 72).collect())) == sorted(p for p in pairs if 100 * p[3] >= 62 * p[4] or 100 * p[3] >= 72 * p[5])
        made = relations.jaccard_pairs(df, "id", "block", "t", 50)
        assert sorted(map(tuple, made.collect())) == sorted(p[:5] for p in pairs if 100 * p[3] >= 50 * p[4])
        assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()


def test_ranked_documents_never_leave_their_task_by_pairs(spark):
    """Many copies and frequent terms, in one part and in several: the same ranking as a loop, and no join of documents with queries."""
    import math

    from tidemark.operators.retrieval import ranked

    r = random.Random(6)
    word = lambda n: [f"w{x}" for x in sorted({min(int(r.expovariate(0.2)), 30) for _ in range(n)})]
    docs = [(k, word(k % 9)) for k in range(300)] + [(300 + k, ["w0", "w1"]) for k in range(50)] + [(400, None)]
    queries = [(f"q{k}", word(1 + k % 5) + ["unseen"] * (k % 2)) for k in range(12)] + [("none", [])]
    df = {t: sum(t in (d or ()) for _, d in docs) for _, q in queries for t in q}
    weigh = {t: int(math.floor((math.log((len(docs) + 1) / (n + 1)) + 1) * 1e6 + 0.5)) for t, n in df.items()}
    want = set()
    for q, terms in queries:
        made = []
        for d, own in docs:
            both = set(terms) & set(own or ())
            if both:
                x = min(1.0, 0.88 * (sum(weigh[t] for t in both) / sum(weigh[t] for t in terms)) + 0.12 * (len(both) / (len(terms) + len(own) - len(both))))
                made.append((-round(x, 6), -len(both), d))
        want |= {(q, d, -n, -x, p + 1) for p, (x, n, d) in enumerate(sorted(made)[:3])}
    held, asked = spark.createDataFrame(docs, "d long, terms array<string>").repartition(3), spark.createDataFrame(queries, "q string, terms array<string>")
    for entries in (1_000_000, 7):
        got = ranked(asked, held, 3, entries=entries)
        assert {tuple(x) for x in got.select("q", "d", "shared", "score", "place").collect()} == want
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert ranked(asked.where("q = 'none'"), held, 3).count() == 0


def test_a_law_text_is_made_once_for_each_row(spark):
    df = lawtext.effective_dates(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("並自公布日施行") == 1


def test_members_of_events_are_scored_once(spark):
    from tidemark.plans.canonical import canonical_events

    plan = canonical_events(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "衛福部預告長照給付修正草案" not in plan


def test_grams_of_articles_are_made_once(spark):
    from tidemark.operators.retrieval import ranked_articles

    rows = spark.createDataFrame([(1, 1, "social welfare law"), (2, 1, "welfare 12"), (3, 2, None)], "d long, law long, text string")
    got = ranked_articles(rows.select(F.col("d").alias("q"), "law", "text"), rows, 1)
    assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((x.q, x.d) for x in got.collect()) == [(1, 1), (2, 2)]


def test_articles_meet_queries_in_parts_without_broadcasts(spark):
    """Parts of a law's articles and queries: the same ranking as a loop, and no join by broadcast, however small the written tables are."""
    import math
    import re

    from tidemark.operators.retrieval import ranked_articles

    r = random.Random(9)
    text = lambda n: "".join(r.choice("社會福利 ab12.5%") for _ in range(n)) or None
    articles = [(k, r.choice([1, 1, 1, 2, None]), text(r.randrange(25))) for k in range(60)] + [(100 + k, 1, "社會福利 12") for k in range(4)]
    queries = [(k, r.choice([1, 1, 2, 3, None]), text(4 + r.randrange(12))) for k in range(25)]
    grams = lambda p: {p[i : i + n] for n in (2, 3, 4) for i in range(len(p) - n + 1)}
    plain = lambda t: "".join(c for c in t or "" if c.isalnum())
    numbers = lambda t: set(re.findall(r"[0-9]+(?:\.[0-9]+)?%?", t or ""))
    want = set()
    for q, law, asked in queries:
        own = [(d, t, grams(plain(t))) for d, w, t in articles if law is not None and w == law]
        gq = grams(plain(asked))
        if len(plain(asked)) < 4 or not own:
            continue
        w = {t: int(math.floor((math.log((len(own) + 1) / (sum(t in g for *_, g in own) + 1)) + 1) * 1e6 + 0.5)) for t in gq}
        made = []
        for d, t, g in own:
            if both := gq & g:
                bonus = 0.08 * (len(numbers(asked) & numbers(t)) / len(numbers(asked))) if numbers(asked) else 0.0
                x = min(1.0, 0.88 * (sum(w[t] for t in both) / sum(w.values())) + 0.12 * (len(both) / (len(gq) + len(g) - len(both))) + bonus)
                made.append((-round(x, 6), -len(both), d, "|".join(sorted(both, key=lambda t: (-len(t), -w[t], t))[:8])))
        want |= {(q, d, -x, -n, e, place) for place, (x, n, d, e) in enumerate(sorted(made)[:3], 1)}
    a, q = spark.createDataFrame(articles, "d long, law long, text string"), spark.createDataFrame(queries, "q long, law long, text string")
    for part, asking in ((5_000, 1_000), (7, 3)):
        got = ranked_articles(q, a, 3, part=part, asking=asking)
        rows = got.collect()
        assert {(x.q, x.d, x.score, x.shared, x.evidence, x.place) for x in rows} == want and len(rows) == len(want) > 30
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_pairs_leave_their_task_as_they_are_found(monkeypatch):
    """A slab whose sets are all alike: every pair, in batches of bounded size."""
    import numpy as np
    import pyarrow as pa

    n = 600
    slab = pa.table({"block": ["b"] * n, "slab": pa.array([0] * n, pa.int32()), "id": np.arange(n), "t": [[1, 2, 3, 10 + k] for k in range(n)]})
    row = relations._packed(slab)
    batch = pa.table({"block": row["block"], "x": row["slab"], "y": row["slab"]} | {f"{s}_{c}": row[c] for s in "xy" for c in ("ids", "sizes", "known", "codes")}).to_batches()
    monkeypatch.setattr(relations, "PAIRS", 1_000)
    run, _ = relations._compared(("string", "long"), 62, 72)
    made = list(run(iter(batch)))
    assert max(b.num_rows for b in made) == 1_000
    pairs = {(x["a"], x["b"]) for b in made for x in b.to_pylist() if (x["n_shared"], x["n_all"], x["n_less"]) == (3, 5, 4)}
    assert len(pairs) == sum(b.num_rows for b in made) == n * (n - 1) // 2 and all(a < b for a, b in pairs)


def test_slabs_are_not_copied_to_be_compared(spark, monkeypatch):
    """Many slabs, bounded by tokens too, in several partitions: the same pairs as all against all, and what is shuffled for it is each slab once."""
    r = random.Random(8)
    rows = [(k, "ab"[k % 2], [f"t{x}" for x in r.sample(range(40), r.choice([2, 5, 30]))]) for k in range(150)]
    rows += [(200 + k, b, t[1:] + ["new"]) for k, b, t in rows[:40]]
    df = spark.createDataFrame(rows, "id long, block string, t array<string>")
    first = {}
    for k, b, t in rows:
        first.setdefault((b, frozenset(t)), k)
    want = sorted((b, k, m, len(s & t), len(s | t)) for (b, s), k in first.items() for (c, t), m in first.items() if k < m and b == c and 100 * len(s & t) >= 62 * len(s | t))
    for name, x in (("SLAB", 12), ("FEW", 12), ("TOKENS", 60), ("HELD", 2), ("PARTS", 3), ("NARROW", 4), ("WIDTH", 16)):
        monkeypatch.setattr(relations, name, x)
    made = relations.jaccard_pairs(df, "id", "block", "t", 62)
    assert sorted(map(tuple, made.collect())) == want and len(want) > 30
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "hashpartitioning" not in plan and "Broadcast" not in plan
