"""Automaton, range joins, digest trees and repeated JSON keys against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import has_alias
from tidemark.functions.jsontext import repeated_keys
from tidemark.operators import hashtree, matching, ranges
from tidemark.operators.relations import containments, drift


@pytest.mark.parametrize("part", [matching.PART, 4])
def test_automaton_equals_the_expressions(spark, part):
    aliases = [("k1", "child  care"), ("k1", "care"), ("k2", "長照 3.0"), ("k3", "長照"), ("k4", "c++"), ("k5", "Élan"), ("k5", "élan"), ("k6", "a"), ("k7", "are"), ("k8", ""), (None, "x"), ("k9", None), ("k10", "she"), ("k10", "he")]
    r = random.Random(1)
    bits = ["child", "care", "\n", " ", "\t ", "長照", " 3.0", "c++", "élan", "a", "are", "scare", "she", "2", "-", "CHILD", ".", "é"]
    texts = [None, "", *("".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    keys = sorted({k for k, a in aliases if k and a})
    text = F.coalesce("text", F.lit(""))
    want = docs.select("id", *(has_alias(text, *(a.lower() if a.isascii() else a for k, a in aliases if k == key and a)).alias(key) for key in keys)).collect()
    got = {x.id: x["keys"] for x in matching.tagged(docs, spark.createDataFrame(aliases, "key string, alias string"), id_col="id", text_col="text", part=part).collect()}
    assert got == {x.id: sorted(k for k in keys if x[k]) for x in want} and any(got.values())
    assert matching.tagged(docs, spark.createDataFrame([], "key string, alias string"), id_col="id", text_col="text").where("size(keys) > 0").count() == 0


def test_the_plan_does_not_grow_with_the_dictionary(spark):
    docs = spark.createDataFrame([(1, "w7 w8")], "id long, text string")
    plans = [matching.tagged(docs, spark.range(n).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("w"), F.col("id")).alias("alias")), id_col="id", text_col="text") for n in (3, 5000)]
    sizes = [p._jdf.queryExecution().optimizedPlan().toString().count("\n") for p in plans]
    assert sizes[0] == sizes[1] and plans[1].first()["keys"] == ["7", "8"]


@pytest.mark.parametrize("hot", [ranges.HOT, 5])
def test_range_joins_equal_all_pairs(spark, hot):
    r = random.Random(2)
    points = [(k, r.choice("ab") if k % 9 else None, r.choice([None, 0, 1023, r.randrange(1024), 77])) for k in range(150)]
    spans = [(k, r.choice("ab"), low, r.choice([low, low + r.randrange(40), 1023, low - 1, None])) for k in range(60) for low in [r.randrange(1024)]]
    p = spark.createDataFrame(points, "id long, law string, at long")
    s = spark.createDataFrame(spans, "span long, law string, low long, high long")
    got = sorted((x.id, x.span) for x in ranges.containing(p, s, key="law", at="at", low="low", high="high", bits=10, hot=hot).collect())
    holds = lambda a, b: b[3] is not None and a[2] is not None and a[1] == b[1] and b[2] <= a[2] <= b[3]
    assert got == sorted((a[0], b[0]) for a in points for b in spans if holds(a, b)) and len(got) > 300
    other = s.select(F.col("span").alias("q"), F.lit("a").alias("law"), (F.col("low") * 7 % 1000).alias("x"), (F.col("low") * 7 % 1000 + F.col("span") % 20).alias("y"))
    got = sorted((x.q, x.span) for x in ranges.overlapping(other, s, key="law", left_low="x", left_high="y", right_low="low", right_high="high", bits=10, hot=hot).collect())
    rows = [(x.q, x.x, x.y) for x in other.collect()]
    assert got == sorted((q, b[0]) for q, x, y in rows for b in spans if b[1] == "a" and b[3] is not None and b[2] <= b[3] and x <= b[3] and b[2] <= y)


def test_containments_equal_all_pairs(spark):
    r = random.Random(4)
    left, right = ([r.choice([None, "", "a"]) if k % 20 == 0 else "".join(r.choice("ab甲") for _ in range(r.randrange(7))) for k in range(80)] for _ in range(2))
    frame = lambda xs, name: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    got = {tuple(x) for x in containments(frame(left, "a"), frame(right, "b"), "a", "b").collect()}
    assert got == {(a, b) for a in left for b in right if a is not None and b is not None and (a in b or b in a)}


def test_tree_drift_equals_the_full_join_and_joins_few_rows(spark):
    old = spark.range(5000).select("id", (F.col("id") % 10).alias("a"), F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise("x").alias("b"))
    new = old.where("id % 997 != 3").withColumn("b", F.when(F.col("id") % 1500 == 1, F.lit(None)).otherwise(F.col("b"))).withColumn("a", F.when(F.col("id") == 8, F.lit(-1)).otherwise(F.col("a")))
    new = new.unionByName(spark.range(9000, 9003).select("id", F.lit(1).cast("long").alias("a"), F.lit(None).cast("string").alias("b")))
    want = sorted((x.id, x.state, x.changed) for x in drift(old, new, "id", ["a", "b"]).where("state != 'same'").collect())
    kept = hashtree.digests(old, "id", ["a", "b"], 10)
    for baseline, bits, step in ((None, 10, 4), (kept, 10, 3), (None, 4, 4)):
        got = hashtree.tree_drift(old, new, "id", ["a", "b"], baseline=baseline, bits=bits, step=step)
        assert sorted((x.id, x.state, x.changed) for x in got.collect()) == want
    nodes = hashtree.differing(kept, hashtree.digests(new, "id", ["a", "b"], 10), 10, 4)
    leaves = nodes.where("level = 3").select("node")
    read = old.join(leaves, hashtree.leaf("id", 10) == leaves["node"], "left_semi").count()
    assert 0 < read < 200 and nodes.where("level = 0").count() == 1
    assert hashtree.tree_drift(old, old, "id", ["a", "b"]).count() == 0


def test_repeated_keys_equal_a_parser(spark):
    def brute(text):
        out = []

        def pairs(items):
            return ("object", items)

        def walk(x):
            if isinstance(x, tuple):
                seen = set()
                for k, v in x[1]:
                    walk(v)
                    if k in seen:
                        out.append(k)
                    seen.add(k)
            elif isinstance(x, list):
                for v in x:
                    walk(v)

        walk(json.loads(text, object_pairs_hook=pairs))
        return sorted(out)

    r = random.Random(3)

    def value(depth):
        kind = r.randrange(5 if depth else 3)
        if kind == 3:
            return "{" + ", ".join(f"{r.choice(NAMES)} : {value(depth - 1)}" for _ in range(r.randrange(5))) + "}"
        if kind == 4:
            return "[" + ",".join(value(depth - 1) for _ in range(r.randrange(4))) + "]"
        return (r.choice(NAMES), "12.5", "null")[kind]

    NAMES = ['"a"', '"\\u0061"', '"b:"', '"{"', '"q\\"a"', '"\\\\"', '"é"', '"\\u00e9"', '""']
    texts = ["{" + f'"x": {value(4)}, "y": {value(4)}, "x": 1' + "}" for _ in range(150)] + ["{}", "[]", "3"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "id long, text string")
    got = {x.id: x["keys"] for x in df.select("id", repeated_keys(F.col("text")).alias("keys")).collect()}
    assert got[-1] is None and all(sorted(got[k]) == brute(t) for k, t in enumerate(texts))


def test_repeated_keys_read_each_text_once(spark):
    """No fold that copies its stack at each token; half a surrogate pair is a ? as in Spark's own strings."""
    df = spark.createDataFrame([(1, '{"\\ud800": 1, "?": {"a": [{"b": 1, "b": 2}], "a": 3}}'), (2, '{"a": "\\"a\\": {", "a": 1}')], "id long, text string").select("id", repeated_keys(F.col("text")).alias("keys"))
    assert {x.id: x["keys"] for x in df.collect()} == {1: ["?", "b", "a"], 2: ["a"]}
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_related_items_of_one_balance_make_few_pairs(spark, tmp_path):
    """Many customers and suppliers with the same cents: the first five of each supplier, with no join of all of them."""
    from tidemark.plans.learners import related_items

    spark.range(1, 301).select(F.col("id").alias("c_custkey"), (F.col("id") % 60).alias("c_nationkey"), F.lit(1.25).alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 41).select(F.col("id").alias("s_suppkey"), (F.col("id") % 70).alias("s_nationkey"), F.lit(1.25).alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    df = related_items(spark, str(tmp_path))
    want = {(s, c, w, k + 1) for s in range(1, 41) for k, (w, c) in enumerate(sorted(((2 if c % 60 == s % 70 else 1, c) for c in range(1, 301)), key=lambda x: (-x[0], x[1]))[:5])}
    assert {tuple(x) for x in df.collect()} == want
    assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2 * 3


def test_points_of_one_place_meet_ranges_once(spark):
    """Many points at few places, many ranges of the same bounds: only distinct ones are cut into blocks and meet."""
    points = spark.range(4000).select("id", F.lit("a").alias("law"), (F.col("id") % 5 * 100).alias("at"))
    spans = spark.range(60).select(F.col("id").alias("span"), F.lit("a").alias("law"), (F.col("id") % 3 * 90).alias("low"), (F.col("id") % 3 * 90 + 200).alias("high"))
    df = ranges.containing(points, spans, key="law", at="at", low="low", high="high", hot=500)
    assert df.count() == sum(20 for k in range(4000) for n in range(3) if n * 90 <= k % 5 * 100 <= n * 90 + 200) == df.select("id", "span").distinct().count()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(_used" in plan and "_b.level" not in plan
