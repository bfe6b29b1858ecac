"""Counters, admission, queues and task state over event rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import utc


def admitted(events: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """events with place (1, 2, ... by key) and accepted: the first cap of each key. Equals a saturating counter that returns whether it counted."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return events.withColumn("place", place.cast("long")).withColumn("accepted", F.col("place") <= cap)


def trailing_counts(events: DataFrame, key: str, ts: str, spans: dict[str, int]) -> DataFrame:
    """events with how many of its key's events lie in the trailing span of seconds, both ends and the event itself included.

    Time is cut into parts as long as the longest span, and a part also sees the events of the one before it, so a busy
    key is spread over its parts.
    """
    size = max(spans.values()) * 1_000_000
    at = F.unix_micros(utc(F.col(ts)))
    each = events.withColumn("_at", at).withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False))))
    parts = each.withColumn("_part", F.floor(F.col("_at") / size) + F.when(F.col("_own"), 0).otherwise(1))
    order = W.partitionBy(key, "_part").orderBy("_at")
    counted = parts.withColumns({name: F.count("*").over(order.rangeBetween(-seconds * 1_000_000, 0)) for name, seconds in spans.items()})
    return counted.where("_own").drop("_at", "_own", "_part")


def spine(first: str, last: str) -> Column:
    """All days from first to last; explode it."""
    return F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key by the order, whatever its state. The order must be total."""
    row = F.struct(*[F.col(c) for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_row")).select(key, "_row.*")


#: What a claim can return, in the order in which the cases are tested.
CLAIMS = ("claimed", "already_terminal", "busy", "retry_not_due", "attempt_limit", "reclaimed")
TERMINAL = frozenset(("completed", "failed_terminal", "quarantined"))


def step(state: dict | None, event: dict) -> tuple[dict | None, str]:
    """One command on a task's state. Times are seconds; a lease that ends now has ended; processed counts never fall."""
    now, command = event["now"], event["command"]
    lease = now + event["lease_seconds"]
    if command == "claim":
        if state is None:
            return {"status": "running", "attempt": 1, "worker": event["worker"], "lease": lease, "retry": None, "processed": 0}, "claimed"
        if state["status"] in TERMINAL:
            return state, "already_terminal"
        if state["status"] == "running" and state["lease"] > now:
            return state, "busy"
        if state["status"] == "failed_retryable" and state["retry"] is not None and state["retry"] > now:
            return state, "retry_not_due"
        if state["attempt"] >= event["max_attempts"]:
            return state | {"status": "failed_terminal"}, "attempt_limit"
        return state | {"status": "running", "attempt": state["attempt"] + 1, "worker": event["worker"], "lease": lease, "retry": None}, "reclaimed"
    if state is None or state["status"] != "running" or state["worker"] != event["worker"]:
        return state, "not_owner"
    if command == "heartbeat":
        return state | {"lease": lease}, "extended"
    if command == "checkpoint":
        return (state, "went_back") if event["processed"] < state["processed"] else (state | {"processed": event["processed"], "lease": lease}, "saved")
    if command == "complete":
        return state | {"status": "completed"}, "completed"
    if command == "fail":
        return state | {"status": "failed_retryable", "retry": now + event["lease_seconds"]}, "failed"
    return state, "unknown_command"


COMMANDS = "task string, seq long, now long, command string, worker string, lease_seconds long, max_attempts int, processed long"
RESULTS = "task string, seq long, result string, status string, attempt int"


def replay(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A task's commands in order, from nothing."""
    state, out = None, []
    for event in pdf.sort_values(["now", "seq"]).to_dict("records"):
        state, result = step(state, event)
        out.append((event["task"], event["seq"], result, state["status"] if state else None, state["attempt"] if state else None))
    return pd.DataFrame(out, columns=["task", "seq", "result", "status", "attempt"])


def replay_commands(commands: DataFrame) -> DataFrame:
    """Every command's result. Tasks are independent; a task's commands are taken one by one, as they must."""
    return commands.groupBy("task").applyInPandas(replay, RESULTS)


def review_state(answers: Column) -> Column:
    """Spaced review of one item, from its answers in order (structs of right and ts in seconds): streak, due_at, mastered, maintenance_done.

    Wrong: one day, and start again; right: 3, then 7 days; three in a row are mastered, then 14 and 30 days.
    """
    day, no = 86_400, F.lit(False)
    start = F.struct(F.lit(0).alias("streak"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("due_at"), no.alias("mastered"), no.alias("maintenance_done"))

    def answer(s: Column, a: Column) -> Column:
        wrong, kept = ~a["right"], a["right"] & s["mastered"]
        streak = F.when(wrong, 0).when(kept, s["streak"]).otherwise(s["streak"] + 1)
        mastered = ~wrong & (s["mastered"] | (streak >= 3))
        step = F.when(wrong, 0).when(kept, s["step"] + 1).otherwise(s["step"])
        days = F.when(wrong, 1).when(kept, 30).when(mastered, 14).when(streak == 2, 7).otherwise(3)
        done = F.when(wrong, no).when(kept, step >= 2).otherwise(s["maintenance_done"])
        return F.struct(streak.alias("streak"), step.alias("step"), (a["ts"] + days * day).alias("due_at"), mastered.alias("mastered"), done.alias("maintenance_done"))

    return F.aggregate(answers, start, answer)


def limit_step(times: list[float], now: float, minute: int = 3, day: int = 30) -> tuple[list[float], bool]:
    """Whether a client may send at a moment (seconds) under limits of a minute and a day, and the accepted moments that still count."""
    kept = [t for t in times if t > now - 86_400]
    fine = len(kept) < day and sum(t > now - 60 for t in kept) < minute
    return (kept + [now] if fine else kept), fine
