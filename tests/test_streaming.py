"""Streams against the same rows in batch."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.state import admitted as batch_admitted
from tidemark.operators.state import replay_commands
from tidemark.streaming import telemetry

SCHEMA = "event_id long, ts timestamp, user_id long, mode string, outcome string, latency_ms long"


@pytest.fixture
def landed(spark, tmp_path):
    rows = spark.range(400).select(
        F.col("id").alias("event_id"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * 7 % 3000).cast("int"))).alias("ts"), (F.col("id") % 5).alias("user_id"),
        F.lit("text").alias("mode"), F.when(F.col("id") % 3 == 0, "success").otherwise("timeout").alias("outcome"), (F.col("id") % 50).alias("latency_ms"),
    )
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


def drain(df, name, mode, where):
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(where)).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return df.sparkSession.table(name)


def test_windows_equal_batch(spark, landed, tmp_path):
    stream = telemetry.five_minutes(spark.readStream.schema(SCHEMA).parquet(landed))
    got = drain(stream, "five", "complete", tmp_path / "c")
    assert sorted(got.collect()) == sorted(telemetry.five_minutes(spark.read.parquet(landed)).collect())


def test_admission_equals_batch(spark, landed, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timers ask for empty batches without end
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = drain(telemetry.admitted(spark.readStream.schema(SCHEMA).parquet(landed), 20), "admission", "append", tmp_path / "c")
    rows = spark.read.parquet(landed).withColumn("day", F.to_date(F.from_utc_timestamp("ts", "Asia/Taipei")))
    want = batch_admitted(rows, ["user_id", "day"], ["ts", "event_id"], 20).select("user_id", "event_id", "accepted")
    assert sorted(got.collect()) == sorted(want.collect())


def test_leases_equal_replay(spark, landed, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    shape = lambda df: df.select(
        F.col("user_id").cast("string").alias("task"), F.col("event_id").alias("seq"), F.unix_seconds("ts").alias("now"), F.element_at(F.array(*map(F.lit, ("claim", "heartbeat", "checkpoint", "fail"))), (F.col("event_id") % 4 + 1).cast("int")).alias("command"),
        F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("worker"), F.lit(900).cast("long").alias("lease_seconds"), F.lit(9).alias("max_attempts"), F.col("latency_ms").alias("processed"),
    )
    got = drain(telemetry.leased(shape(spark.readStream.schema(SCHEMA).parquet(landed))), "leases", "append", tmp_path / "c")
    assert sorted(got.collect()) == sorted(replay_commands(shape(spark.read.parquet(landed))).collect())


def test_upserts_survive_a_repeated_batch(spark, tmp_path):
    rows = lambda x: spark.createDataFrame(x, "k int, v int")
    write = telemetry.upsert_into(str(tmp_path / "t"), ["k"], lambda old, new: new.unionByName(old.join(new, "k", "left_anti")))
    write(rows([(1, 1), (2, 2)]), 0)
    for _ in range(2):
        write(rows([(2, 5), (3, 3)]), 1)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t/v=1").collect())) == [(1, 1), (2, 5), (3, 3)]


def test_events_ahead_of_the_clock_go_aside(spark):
    df = spark.createDataFrame([("2024-01-01 00:04:00",), ("2024-01-01 00:06:00",)], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    ok, ahead = telemetry.on_time(df, "2024-01-01 00:00:00")
    assert (ok.count(), ahead.count()) == (1, 1)


def test_rate_limit_against_batch(spark, tmp_path):
    """A client's accepted events, batch after batch, against one pass over all of them."""
    from tidemark.operators.state import limit_step

    times = {u: [(7 * k * (u + 1)) % 4000 for k in range(80)] for u in range(4)}
    rows = [(u, 100 * u + k, t) for u, ts in times.items() for k, t in enumerate(sorted(ts))]
    want = {}
    for u in times:
        state = []
        for _, event, t in sorted((x for x in rows if x[0] == u), key=lambda x: (x[2], x[1])):
            state, want[event] = limit_step(state, float(t))
    landed = str(tmp_path / "in")
    frame = spark.createDataFrame(rows, "user_id long, event_id long, t long").selectExpr("user_id", "event_id", "timestamp_seconds(t) as ts")
    for k in range(3):
        frame.where(f"unix_seconds(ts) >= {k * 1400} and unix_seconds(ts) < {(k + 1) * 1400}").coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    got = drain(telemetry.rate_limited(stream), "limited", "append", tmp_path / "c")
    out = {r.event_id: r.accepted for r in got.collect()}
    assert set(out) == set(want) and not all(out.values())
    assert sum(out[e] == want[e] for e in want) == len(want)


def test_a_command_that_is_sent_again_counts_once(spark, tmp_path):
    rows = [("t1", "a", "2024-01-01 00:00:00", 1), ("t1", "a", "2024-01-01 00:00:05", 2), ("t1", "b", "2024-01-01 00:00:06", 3), ("t2", "a", "2024-01-01 00:00:07", 4)]
    frame = spark.createDataFrame(rows, "task string, idempotency_key string, t string, seq long").select("task", "idempotency_key", F.col("t").cast("timestamp").alias("ts"), "seq")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    frame.where("seq = 2").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = drain(telemetry.once(stream), "once", "append", tmp_path / "c")
    assert sorted((x.task, x.idempotency_key) for x in got.collect()) == [("t1", "a"), ("t1", "b"), ("t2", "a")]
