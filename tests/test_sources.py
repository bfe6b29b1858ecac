"""Paged listings, snapshots in two phases, sources in two passes."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import paged, shards
from tidemark.sources.passes import availability, two_passes

SCHEMA = "id long, name string, score double"


def pages(path, rows, limit, more=()):
    path.mkdir(parents=True, exist_ok=True)
    for k, at in enumerate(range(0, len(rows) + 1, limit)):
        (path / paged.page_name(k)).write_text(json.dumps(rows[at : at + limit]))
    for k, page in more:
        (path / paged.page_name(k)).write_text(json.dumps(page))


def test_pages_are_read_in_parts_up_to_the_short_one(spark, tmp_path):
    rows = [{"id": k, "name": None if k % 7 == 0 else f"n{k}", "score": k / 2} for k in range(95)]
    pages(tmp_path / "a", rows, 10)
    df = paged.read_pages(spark, str(tmp_path / "a"), SCHEMA, limit=10, pages=3)
    assert sorted(map(tuple, df.collect())) == [(k["id"], k["name"], k["score"]) for k in rows]
    assert df.rdd.getNumPartitions() == 4  # ten pages, three a part
    some = df.where("id >= 40 and name is not null and score < 30")
    assert sorted(x.id for x in some.collect()) == [k for k in range(40, 60) if k % 7]
    pages(tmp_path / "full", rows[:40], 10)  # the last page is an empty one
    assert paged.read_pages(spark, str(tmp_path / "full"), SCHEMA, limit=10).count() == 40
    pages(tmp_path / "late", rows[:15], 10, [(2, rows[20:30])])  # behind a short page nothing counts
    assert paged.read_pages(spark, str(tmp_path / "late"), SCHEMA, limit=10).count() == 15
    assert paged.read_pages(spark, str(tmp_path / "late"), SCHEMA, limit=10, pages=1).count() == 15
    pages(tmp_path / "torn", rows[:15], 10, [(k, rows[20:30]) for k in range(2, 6)])  # a short page among full ones
    with pytest.raises(Exception, match="not the last page"):
        paged.read_pages(spark, str(tmp_path / "torn"), SCHEMA, limit=10).collect()
    (tmp_path / "none").mkdir()
    assert paged.read_pages(spark, str(tmp_path / "none"), SCHEMA).count() == 0


@pytest.mark.parametrize("page", ['{"id": 1}', json.dumps([{"id": k} for k in range(11)])])
def test_a_page_that_is_no_list_or_too_long_fails(spark, tmp_path, page):
    pages(tmp_path / "bad", [], 10)
    (tmp_path / "bad" / paged.page_name(0)).write_text(page)
    with pytest.raises(Exception, match="not a list|more than 10"):
        paged.read_pages(spark, str(tmp_path / "bad"), SCHEMA, limit=10).collect()


def test_a_snapshot_is_seen_only_when_it_is_whole(spark, tmp_path):
    path = str(tmp_path / "snap")
    read = lambda: sorted(map(tuple, paged.read_snapshot(spark, path, "id long, name string").collect()))
    assert read() == [] and paged.current_run(path) is None
    first = spark.range(20).select("id", F.concat(F.lit("甲"), F.col("id").cast("string")).alias("name")).repartition(3)
    paged.write_snapshot(first, path, complete=20)
    assert read() == [(k, f"甲{k}") for k in range(20)] and paged.current_run(path)["rows"] == 20

    broken = spark.range(30).repartition(4).select("id", F.when(F.col("id") == 17, F.raise_error(F.lit("a task fails"))).otherwise("x").alias("name"))
    with pytest.raises(Exception, match="a task fails"):
        paged.write_snapshot(broken, path)
    with pytest.raises(Exception, match="not published"):
        paged.write_snapshot(first.where("id > 3"), path, complete=20)
    assert read() == [(k, f"甲{k}") for k in range(20)]  # readers stay on the last complete run
    assert len(list((tmp_path / "snap").glob("*/failed.json"))) == 2
    paged.write_snapshot(first.where("id < 2"), path)
    assert read() == [(0, "甲0"), (1, "甲1")]
    paged.write_snapshot(first.where("id < 0"), path)
    assert read() == []


def test_only_files_of_six_digits_come_in(spark, tmp_path):
    for name, text in {"000012.json": '[{"id": "a"}, {"id": "b"}]', "113001.json": '{"items": [{"id": "c"}]}', "draft.json": '[{"id": "x"}]', "0000123.json": '[{"id": "y"}]', "00001a.json": '[{"id": "z"}]'}.items():
        (tmp_path / name).write_text(text)
    assert sorted(map(tuple, shards.incoming(spark, str(tmp_path), "struct<id: string>").collect())) == [("000012", "a"), ("000012", "b"), ("113001", "c")]


def test_only_failed_mandatory_sources_are_read_again(spark):
    sources = spark.createDataFrame([("a", 1, False), ("b", 2, False), ("c", 3, True), ("d", 4, False), ("e", 5, False)], "name string, place int, optional boolean")
    asked = []

    def attempt(answers):
        def run(s):
            asked.append(sorted(x.name for x in s.collect()))
            rows = [(n, *answers[n]) for n in asked[-1] if n in answers]
            return spark.createDataFrame(rows, "name string, entries array<string>, error string")

        return run

    out = two_passes(sources, attempt({"a": (["x", "y"], None), "b": (None, "late"), "c": (None, "gone"), "e": (["half"], "cut off")}), attempt({"b": ([], None), "d": (None, "still gone"), "e": (["whole"], None)}))
    got = {x.name: (x.outcome, x.entries, x.error) for x in out.collect()}
    assert asked[:2] == [["a", "b", "c", "d", "e"], ["b", "d", "e"]]
    assert got == {"a": ("ok", ["x", "y"], None), "b": ("recovered", [], None), "c": ("optional_error", None, "gone"), "d": ("failed", None, "still gone"), "e": ("recovered", ["whole"], None)}
    assert availability(out).first() == (4, 1, 2, 3, "available")
    none = out.where("name = 'd'")
    assert availability(none).first().state == "mandatory_failed" and availability(out.where("name = 'c'")).first().state == "invalid" and availability(out.where("name = 'b'")).first().state == "empty"
