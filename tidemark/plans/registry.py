"""All queries of this package by name, with their SQL statements."""

from __future__ import annotations

from tidemark.plans import canonical, events, exams, joins, lawtext, learners, lifecycle, monitoring, news, ordering, parity, quality, reports, texts, usage, versions

FAMILIES = (usage, quality, versions, parity, monitoring, learners, texts, events, news, exams, lifecycle, lawtext, ordering, canonical, joins, reports)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLE = {name: sql for family in FAMILIES for name, sql in family.ORACLE.items()}
