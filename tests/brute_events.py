"""The event operators as plain loops over all pairs, to hold the joins against."""

import pandas as pd

from tidemark.operators.events import DAYS, JOIN, PREVIOUS_DAYS, TIERS, TOPIC_DAYS, TOPIC_SHARE, TOPIC_TAGS, WEAK_TAGS


def grams(title: str) -> frozenset[str]:
    return frozenset(title[k : k + 2] for k in range(len(title) - 1)) or (frozenset((title,)) if title else frozenset())


def share(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def cover(a: frozenset, b: frozenset) -> float:
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def item(row: dict) -> dict:
    """A row as the fold compares it. Lists become sets, titles their bigrams."""
    sets = {k: frozenset(() if row.get(k) is None else row[k]) for k in ("tags", "subjects", "laws", "agencies", "facts", "concepts")}
    day = row.get("published_at")
    return row | sets | {"grams": grams(row.get("title") or ""), "day": None if day is None or day != day else pd.Timestamp(day)}


def _days(a: dict, b: dict) -> float | None:
    return None if a["day"] is None or b["day"] is None else abs((a["day"] - b["day"]).total_seconds()) / 86_400


def similarity(a: dict, b: dict, max_days: int = DAYS) -> float:
    """How alike two items are, from 0 to 1. Cheap refusals first, then the anchors, then titles with what else they share."""
    if a["category"] and b["category"] and a["category"] != b["category"]:
        return 0
    days = _days(a, b)
    if days is not None and days > max_days:
        return 0
    laws, agencies, facts = a["laws"] & b["laws"], a["agencies"] & b["agencies"], a["facts"] & b["facts"]
    if a["language"] == b["language"]:
        two_papers = a["source_name"] and b["source_name"] and a["source_name"] != b["source_name"] and a["source_type"] == b["source_type"] == "news"
        big = any(f.startswith("num:") and f[4:].isdigit() and int(f[4:]) >= 1000 for f in facts)
        if two_papers and days is not None and days <= 3 and big and (a["tags"] & b["tags"]) - set(WEAK_TAGS):
            return 72
    else:
        both = len(a["concepts"] & b["concepts"])
        if both < 2 or not (agencies or facts):
            return 0
        return min(100, 72 + min(12, 4 * (both - 2)) + (12 if agencies else 0) + (10 if facts else 0))
    j, c = share(a["grams"], b["grams"]), cover(a["grams"], b["grams"])
    tier = next((k for k, (least_j, least_c, _) in enumerate(TIERS) if 100 * j >= least_j or 100 * c >= least_c), None)
    tags = share(a["tags"], b["tags"])
    score = TIERS[tier][2] if tier is not None else 0
    score += (28 if laws else 0) + (10 if agencies else 0) + (15 if tags >= 0.5 else 8 if tags >= 0.25 else 0) + (5 if share(a["subjects"], b["subjects"]) >= 0.5 else 0)
    sure = tier == 0 or tier == 1 and (laws or agencies or tags >= 0.5) or tier is not None and laws and (tags >= 0.25 or agencies)
    return min(100, score) if sure else 0


def lead_key(x: dict) -> tuple:
    return (bool(x.get("official")), x.get("signal_score") or 0, x.get("relevance_score") or 0, str(x.get("published_at") or ""))


def cluster(items: list[dict]) -> list[int]:
    """Each item's group, in one pass over items in order. An item is compared with every group's lead of the moment; the first of the best wins."""
    leads: list[dict] = []
    out = []
    for x in items:
        scores = [similarity(x, lead) for lead in leads]
        best = max(range(len(scores)), key=scores.__getitem__, default=None)
        if best is not None and scores[best] >= JOIN:
            out.append(best)
            if lead_key(x) > lead_key(leads[best]):
                leads[best] = x
        else:
            out.append(len(leads))
            leads.append(x)
    return out


def match_previous(events: list[dict], previous: list[dict]) -> list[int | None]:
    """Each event's predecessor: the same key first, else the most similar unused one within 45 days. One pass, in order."""
    used: set[int] = set()
    by_key = {p["key"]: k for k, p in reversed(list(enumerate(previous)))}
    out: list[int | None] = []
    for e in events:
        found = by_key.get(e["key"])
        if found is None:
            scores = [(similarity(e, p, PREVIOUS_DAYS), -k) for k, p in enumerate(previous) if k not in used]
            best = max(scores, default=(0, 0))
            found = -best[1] if best[0] >= JOIN else None
        if found is not None:
            used.add(found)
        out.append(found)
    return out


def same_topic(row: dict, topic: list[dict]) -> bool:
    first = topic[0]
    if row["category"] != first["category"]:
        return False
    if row["topic"] or first["topic"]:
        return row["topic"] == first["topic"]
    if row["laws"] & frozenset().union(*(x["laws"] for x in topic)):
        return True
    for x in topic:
        days = _days(row, x)
        if row["source_name"] == x["source_name"] and days is not None and days <= TOPIC_DAYS and row["facts"] & x["facts"] and row["tags"] & x["tags"]:
            return True
    held = frozenset().union(*(x["tags"] for x in topic))
    both = len(row["tags"] & held)
    return both >= TOPIC_TAGS and 100 * both >= TOPIC_SHARE * len(row["tags"] | held)


def topics(rows: list[dict]) -> list[int]:
    found: list[list[dict]] = []
    out = []
    for x in rows:
        g = next((k for k, topic in enumerate(found) if same_topic(x, topic)), len(found))
        if g == len(found):
            found.append([])
        found[g].append(x)
        out.append(g)
    return out
