"""Row changes as a stream: what triggers do to an updated row, with a timer for claims that nobody finishes.

A change is the new version of a row. Its effects depend on the version before, which is the state; change_step
is the rule for one change, and both the stream and the replay in batch call it in the order of time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: States that count as done, the state of a claimed row, and after how many seconds a claim is stale.
DONE, CLAIMED, STALE_SECONDS = ("ready", "reviewed"), "analyzing", 900
FIELDS = ("core", "status", "law", "attempts", "completed", "since")
STATE = "core string, status string, law string, attempts long, completed double, since double"
OUT = "row long, seq long, at double, effects string, status string, law string, attempts long, completed double"
COLUMNS = [x.split()[0] for x in OUT.split(", ")]


def change_step(state: dict | None, change: dict, forbidden: re.Pattern[str]) -> tuple[dict, list[str]]:
    """The row after a change, and what was done to it. state is the row before, none for a new one.

    A commentary on answers is refused: the row stays as it was. A changed core resets law, attempts and status. A row that
    becomes done gets the time of the change, one that stops being it loses its time. A claim counts as an attempt.
    """
    old = state or {"core": None, "status": None, "law": None, "attempts": 0, "completed": None, "since": None}
    if forbidden.search(change["why"] or ""):
        return old, ["refused"]
    effects = []
    new = {**old, "core": change["core"], "status": change["status"], "law": change["law"]}
    if state is not None and change["core"] != old["core"]:
        new |= {"status": "pending", "law": None, "attempts": 0}
        effects.append("reset")
    if new["status"] == CLAIMED and old["status"] != CLAIMED:
        new["attempts"] += 1
        effects.append("claimed")
    new["since"] = (old["since"] if old["status"] == CLAIMED else change["at"]) if new["status"] == CLAIMED else None
    was, now = old["status"] in DONE, new["status"] in DONE
    if now and not was:
        new["completed"] = change["at"]
        effects.append("completed")
    elif was and not now:
        new["completed"] = None
        effects.append("reopened")
    return new, effects


def stale_step(state: dict) -> tuple[dict, list[str]]:
    """The row when its claim has run out."""
    return {**state, "status": "pending", "since": None}, ["stale"]


def _told(row: object, seq: int | None, at: float, state: dict, effects: list[str]) -> tuple:
    return row, seq, at, ",".join(effects), state["status"], state["law"], state["attempts"], state["completed"]


def _through(row: object, state: dict | None, changes: list[dict], forbidden: re.Pattern[str]) -> tuple[dict | None, list[tuple]]:
    out = []
    for change in changes:
        if state and state["since"] is not None and change["at"] > state["since"] + STALE_SECONDS:
            at = state["since"] + STALE_SECONDS
            state, effects = stale_step(state)
            out.append(_told(row, None, at, state, effects))
        state, effects = change_step(state, change, forbidden)
        out.append(_told(row, change["seq"], change["at"], state, effects))
    return state, out


def _listed(pdfs: Iterator[pd.DataFrame]) -> list[dict]:
    rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["at", "seq"])
    return [{k: None if v is None or v != v else v for k, v in r.items()} for r in rows.to_dict("records")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    return out.astype({"row": "int64", "seq": "Int64", "at": "float64", "attempts": "int64", "completed": "float64"})


class RowChanges(StatefulProcessor):
    """A row's versions in, the effects of each change out; a claim sets a timer at which it becomes stale."""

    def __init__(self, forbidden: str) -> None:
        self.pattern = forbidden

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state, self.forbidden = handle, handle.getValueState("row", STATE), re.compile(self.pattern)

    def _read(self) -> dict | None:
        if not self.state.exists():
            return None
        return {k: None if v is None or v != v else v for k, v in zip(FIELDS, self.state.get(), strict=True)}

    def _timer(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        state, out = _through(key[0], self._read(), _listed(rows), self.forbidden)
        self._timer()
        if state is not None:
            self.state.update(tuple(state[k] for k in FIELDS))
            if state["since"] is not None:
                self.handle.registerTimer(int((state["since"] + STALE_SECONDS) * 1000))
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        state = self._read()
        if state and state["since"] is not None:
            at = state["since"] + STALE_SECONDS
            state, effects = stale_step(state)
            self.state.update(tuple(state[k] for k in FIELDS))
            yield _frame([_told(key[0], None, at, state, effects)])

    def close(self) -> None:
        pass


def changed_rows(changes: DataFrame, forbidden: str, late: str = "10 minutes") -> DataFrame:
    """changes (row, seq, ts, core, status, law, why) as a stream -> row, seq (null for a stale claim), at, effects, status, law, attempts, completed.

    Changes of a row must come in the order of their times; at and completed are seconds since the epoch.
    """
    told = changes.withWatermark("ts", late).selectExpr("row", "seq", "ts", "core", "status", "law", "why", "unix_micros(ts) / 1000000 as at")
    return told.groupBy("row").transformWithStateInPandas(RowChanges(forbidden), OUT, "Append", "EventTime")


def replayed(changes: DataFrame, forbidden: str, until: float) -> DataFrame:
    """The same over a table: each row's changes in order, with the claims that are stale before a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = _through(pdf["row"].iloc[0], None, _listed(iter([pdf])), re.compile(forbidden))
        if state and state["since"] is not None and state["since"] + STALE_SECONDS <= until:
            at = state["since"] + STALE_SECONDS
            state, effects = stale_step(state)
            out.append(_told(pdf["row"].iloc[0], None, at, state, effects))
        return _frame(out)

    told = changes.selectExpr("row", "seq", "core", "status", "law", "why", "unix_micros(ts) / 1000000 as at")
    return told.groupBy("row").applyInPandas(run, OUT)
