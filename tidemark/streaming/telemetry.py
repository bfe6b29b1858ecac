"""Telemetry and usage as Structured Streaming: windows with late data, daily admission, task leases, upserts into tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.state import limit_step, step

#: How late an event may come, how far ahead of the clock it may be.
LATE, SKEW_MINUTES = "21 days", 5


def on_time(events: DataFrame, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Events that may be counted, and those too far ahead of the clock."""
    clock = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    ahead = F.col("ts") > clock + F.expr(f"interval {SKEW_MINUTES} minutes")
    return events.where(~ahead), events.where(ahead)


def five_minutes(requests: DataFrame, late: str = LATE) -> DataFrame:
    """Requests (ts, mode, outcome, latency_ms) in tumbling windows of five minutes; counters stop at their cap when they are read."""
    w = requests.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes"), "mode", "outcome")
    counted = w.agg(F.count("*").alias("n"), F.sum("latency_ms").alias("latency_total_ms"), F.max("latency_ms").alias("latency_max_ms"))
    return counted.select(F.col("window.start").alias("bucket_start"), "mode", "outcome", F.least("n", F.lit(10_000)).alias("request_count"), "latency_total_ms", "latency_max_ms")


def local_days(views: DataFrame, late: str = LATE) -> DataFrame:
    """Views (ts, site, client) by local day with a saturating count. The window's start is shifted to local midnight."""
    w = views.withWatermark("ts", late).groupBy(F.window("ts", "1 day", "1 day", "16 hours"), "site", "client")
    return w.agg(F.count("*").alias("n")).select(F.to_date(F.from_utc_timestamp("window.start", "Asia/Taipei")).alias("usage_date"), "site", "client", F.least("n", F.lit(500)).alias("page_views"))


class Admission(StatefulProcessor):
    """The first cap events of a client and local day pass; state goes when the day is long over."""

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "day string", "n int", 172_800_000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for event, ts in sorted(zip(pdf["event_id"], pdf["ts"], strict=True), key=lambda x: (x[1], x[0])):
                day = ((pd.Timestamp(ts) + pd.Timedelta(hours=8)).date().isoformat(),)
                n = self.seen.getValue(day)[0] if self.seen.containsKey(day) else 0
                out.append((key[0], event, n < self.cap))
                self.seen.updateValue(day, (n + 1,))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "accepted"])

    def close(self) -> None:
        pass


class Leases(StatefulProcessor):
    """The task state machine: a command in, its result out."""

    FIELDS = ("status", "attempt", "worker", "lease", "retry", "processed")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("task", "status string, attempt int, worker string, lease long, retry long, processed long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        state = dict(zip(self.FIELDS, self.state.get(), strict=True)) if self.state.exists() else None
        out = []
        events = pd.concat(list(rows), ignore_index=True).sort_values(["now", "seq"])
        for event in events.to_dict("records"):
            state, result = step(state, event)
            out.append((key[0], event["seq"], result, state["status"] if state else None, state["attempt"] if state else None))
        if state is not None:
            self.state.update(tuple(state[k] for k in self.FIELDS))
        yield pd.DataFrame(out, columns=["task", "seq", "result", "status", "attempt"])

    def close(self) -> None:
        pass


class RateLimit(StatefulProcessor):
    """At most three accepted events of a client in any minute and thirty in any day, in the order of their times."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "t double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        times = [t for (t,) in self.times.get()] if self.times.exists() else []
        out = []
        for event in pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"]).to_dict("records"):
            times, fine = limit_step(times, pd.Timestamp(event["ts"]).timestamp())
            out.append((key[0], event["event_id"], fine))
        self.times.put([(t,) for t in times])
        yield pd.DataFrame(out, columns=["user_id", "event_id", "accepted"])

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame) -> DataFrame:
    """events (user_id, event_id, ts) with whether each was accepted. The state is the accepted moments of a day, thirty at most."""
    return events.groupBy("user_id").transformWithStateInPandas(RateLimit(), "user_id long, event_id long, accepted boolean", "Append", "None")


def once(commands: DataFrame, late: str = LATE) -> DataFrame:
    """commands (task, idempotency_key, ts, ...) with each key of a task once, as long as it can still come late."""
    return commands.withWatermark("ts", late).dropDuplicatesWithinWatermark(["task", "idempotency_key"])


def admitted(events: DataFrame, cap: int = 100) -> DataFrame:
    """events (user_id, event_id, ts) with whether each was accepted.

    The state's time to live needs processing time, under which Spark plans empty batches without end; a run that
    should stop when its input is used up sets spark.sql.streaming.noDataMicroBatches.enabled to false.
    """
    return events.groupBy("user_id").transformWithStateInPandas(Admission(cap), "user_id long, event_id long, accepted boolean", "Append", "ProcessingTime")


def leased(commands: DataFrame) -> DataFrame:
    return commands.groupBy("task").transformWithStateInPandas(Leases(), "task string, seq long, result string, status string, attempt int", "Append", "None")


def upsert_into(path: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: merge each batch with the latest version and write the next one. A repeated batch finds its version written and does nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        done = hadoop(f"{path}/v={epoch}/_SUCCESS")
        if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            return
        rows = merge(spark.read.parquet(f"{path}/v={epoch - 1}"), batch) if epoch else batch
        columns = [c for c in rows.columns if c not in keys]
        one = rows.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("_row")).select(*keys, "_row.*")  # of several rows of a key the largest
        one.select(*rows.columns).write.mode("overwrite").parquet(f"{path}/v={epoch}")
        old = hadoop(f"{path}/v={epoch - 2}")  # the version before the last stays for readers
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return write
