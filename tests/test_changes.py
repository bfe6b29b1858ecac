"""Row changes as a stream against their replay in batch, with a restart from the checkpoint in between."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.plans.lifecycle import FORBIDDEN
from tidemark.streaming import changes

SCHEMA = "row long, seq long, ts timestamp, core string, status string, law string, why string"


def test_steps():
    never = re.compile("(?!)")
    change = lambda at, status, core="c", law="l", why="": {"at": at, "status": status, "core": core, "law": law, "why": why}
    one, effects = changes.change_step(None, change(0.0, "analyzing"), never)
    assert effects == ["claimed"] and one["attempts"] == 1 and one["since"] == 0
    two, effects = changes.change_step(one, change(5.0, "ready"), never)
    assert effects == ["completed"] and two["completed"] == 5 and two["since"] is None
    three, effects = changes.change_step(two, change(9.0, "ready", core="d"), never)
    assert effects == ["reset", "reopened"] and three["status"] == "pending" and three["law"] is None and three["attempts"] == 0 and three["completed"] is None
    assert changes.change_step(two, change(9.0, "ready", why="bad"), re.compile("bad")) == (two, ["refused"])


def test_stream_equals_replay_over_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(5)
    rows, at = [], 0
    for seq in range(300):
        at += r.randrange(60)
        row = r.randrange(12)
        rows.append((row, seq, at, f"core{r.randrange(8) // 7}", r.choice(["pending", "analyzing", "analyzing", "ready", "reviewed"]), r.choice(["law", None]), r.choice(["", "", None, "官方答案有誤"])))
    frame = spark.createDataFrame(rows, "row long, seq long, t long, core string, status string, law string, why string").selectExpr("row", "seq", "timestamp_seconds(t) as ts", "core", "status", "law", "why")
    cut = [0, rows[100][2] + 1, rows[200][2] + 1, at + 1]
    part = lambda k: frame.where(F.unix_seconds("ts") >= cut[k]).where(F.unix_seconds("ts") < cut[k + 1]).coalesce(1)

    def run():
        q = changes.changed_rows(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), FORBIDDEN).writeStream
        q = q.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(300)

    for k in range(2):
        part(k).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    part(2).write.mode("append").parquet(f"{tmp_path}/in")
    run()  # a new query goes on from the state and timers in the checkpoint
    until = float(at - 600)  # the last watermark
    got = sorted((x.row, x.at, -1 if x.seq is None else x.seq, x.effects, x.status, str(x.law), x.attempts, x.completed) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((x.row, x.at, -1 if x.seq is None else x.seq, x.effects, x.status, str(x.law), x.attempts, x.completed) for x in changes.replayed(frame, FORBIDDEN, until).collect())
    plain = lambda rows: [tuple(None if v != v else v for v in x) for x in rows]
    assert plain(got) == plain(want)
    assert {e for x in got for e in x[3].split(",")} >= {"stale", "reset", "refused", "claimed", "completed", "reopened"}
