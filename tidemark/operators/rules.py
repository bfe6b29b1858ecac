"""Rules and ladders as data. A rule is a condition with a name and a grade; a ladder is an ordered list of outcomes."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses and risks from best to worst.
STATUSES = ("passed", "warning", "review", "blocked")
RISKS = ("low", "medium", "high", "critical")


class Rule(NamedTuple):
    rule_id: str
    layer: str
    status: str
    risk: str
    message: str
    broken: Column


def ladder(steps: Sequence[tuple[Column, str]], default: str | None) -> Column:
    """The outcome of the first step that holds. The default should be the strict one."""
    out = None
    for condition, value in steps:
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def rank_of(value: Column, order: Sequence[str]) -> Column:
    """The place in the order; unknown values rank worst."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)), F.lit(len(order))).cast("int")


def worst(values: Column, order: Sequence[str]) -> Column:
    """The worst of an array of values, the best where it is empty."""
    return F.element_at(F.array(*map(F.lit, order)), F.coalesce(F.array_max(F.transform(values, lambda v: rank_of(v, order))), F.lit(1)))


def check(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rows with issues: an array of the broken rules. A condition that is null counts as broken."""
    issue = lambda r: F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.layer).alias("layer"), F.lit(r.status).alias("status"), F.lit(r.risk).alias("risk"), F.lit(r.message).alias("message"))
    found = F.array(*(F.when(F.coalesce(r.broken, F.lit(True)), issue(r)) for r in rules))
    return rows.withColumn("issues", F.array_compact(found)).withColumns({"status": worst(F.transform("issues", lambda x: x["status"]), STATUSES), "risk": worst(F.transform("issues", lambda x: x["risk"]), RISKS)})


def names_where(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order: blockers, changed fields, reasons."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))
