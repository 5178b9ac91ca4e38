"""Time in queries and rows: categories of questions, relative ranges, buckets, bounds.

A query is one text, so its range is resolved on the driver; what rows need is a Column.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes a question one of a category; a blank at an end only parts entries here and isn't matched.
CATEGORIES = {
    1: ["when", "before", "after", "during", "since", "until", "yesterday", "today", "ago", "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december", "last week", "last month", "last year", "last night", "last time"],
    2: ["currently", "right now", "at present", "presently", "these days", "nowadays", "at this point", "at the moment", "does he still", "does she still", "do they still", "is he still", "is she still", "are they still", "does it still", "is it still", "am i still", "do i still", "'s current", "current job", "current role", "current position", "live now", "work now", "working now", "living now", "doing now", "current status", "current stage", "current state", "current health", "current deal", "current project", "current plan", "current team", "active deal", "active deals", "active project", "active projects", "active since", "currently active", "who is the", "who are the", "up-to-date", "up to date", "authoritative", "most reliable", "official record"],
    3: ["first", "earliest", "which came", "what came", "preceding", "following", "subsequent", "in what order", "chronological", "what order did", "what sequence", "before or after", "happened first", "closed first", "created first", "came first", "started first", "completed first"],
    4: ["how many times", "how many total", "all instances", "every time", "in total", "count of", "number of times", "how often"],
    5: ["most recent", "newest", "recently", "latest", "just now", "just released", "just announced", "just shipped", "just launched", "just published", "just landed", "just happened", "just finished", "just completed", "just started", "just arrived"],
    6: ["changed", "switched", "moved to", "used to", "no longer", "anymore", "former", "previous", "ex-", "updated", "replaced", "went from", "transitioned", "turned into", "switched to", "became", "converted to", "went back to"],
}
MAY = r"\b(?:in|on|by|since|until|before|after|during|early|late|\d+)\b\W*\bmay\b|\bmay\s+\d"
DATE = r"\b\d{4}[-/]\d{1,2}|\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def term_pattern(term: str) -> str:
    """The term as a whole word or phrase."""
    return (r"\b" if term[:1].isalnum() else "") + re.escape(term).replace("\\ ", " ").replace("'", "'") + (r"\b" if term[-1:].isalnum() else "")


def patterns() -> list[tuple[int, str]]:
    return [(c, term_pattern(t)) for c, terms in CATEGORIES.items() for t in terms] + [(1, MAY)]


def category(query: Column) -> Column:
    """A struct of category (0 none, 1 explicit, 2 state, 3 order, 4 aggregate, 5 recency, 6 change) and confidence.

    The greatest category wins. One match is 0.6, two 0.8 or, of two categories, 0.85, more
    0.95; a date in figures adds 0.1.
    """
    q = F.lower(query)
    hits = {c: sum((q.rlike(p).cast("int") for k, p in patterns() if k == c), start=F.lit(0)) for c in CATEGORIES}
    best = F.greatest(*(F.when(h > 0, F.lit(c)).otherwise(0) for c, h in hits.items()))
    n, kinds = sum(hits.values(), start=F.lit(0)), sum(((h > 0).cast("int") for h in hits.values()), start=F.lit(0))
    sure = F.when(n == 1, 0.6).when((n == 2) & (kinds > 1), 0.85).when(n == 2, 0.8).otherwise(0.95)
    sure = F.when(query.rlike(DATE), F.least(sure + 0.1, F.lit(1.0))).otherwise(sure)
    return F.struct(best.alias("category"), F.when(best == 0, F.lit(0.0)).otherwise(sure).alias("confidence"))


def resolve_range(expression: str, now: datetime) -> tuple[datetime, datetime] | None:
    """The range that an expression of time names as seen from `now`, or None if it names none."""
    e = expression.lower().strip()
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    last = timedelta(days=1) - timedelta(microseconds=1)
    if "yesterday" in e:
        return midnight - timedelta(days=1), midnight - timedelta(days=1) + last
    if "today" in e:
        return midnight, midnight + last
    if m := re.search(r"(?:last\s+)?(\d+)\s+(day|week|month|year)s?\s*(?:ago)?", e):
        return now - timedelta(days=int(m[1]) * {"day": 1, "week": 7, "month": 30, "year": 365}[m[2]]), now
    for name, days in (("last week", 7), ("last month", 30)):
        if name in e:
            return now - timedelta(days=days), now
    if m := re.search(r"q([1-4])", e):
        q, y = int(m[1]), re.search(r"20\d{2}", e)
        year = int(y[0]) if y else now.year
        end = datetime(year + q // 4, q % 4 * 3 + 1, 1) - timedelta(seconds=1)
        return datetime(year, q * 3 - 2, 1), end
    if "last quarter" in e:
        return now - timedelta(days=90), now
    if m := re.search(rf"({'|'.join(MONTHS)})\s*(\d{{4}})", e):
        k, year = MONTHS.index(m[1]), int(m[2])
        return datetime(year, k + 1, 1), datetime(year + (k + 1) // 12, (k + 1) % 12 + 1, 1) - timedelta(seconds=1)
    if re.fullmatch(r"20\d{2}", e):
        return datetime(int(e), 1, 1), datetime(int(e), 12, 31, 23, 59, 59)
    if "this week" in e:
        return midnight - timedelta(days=now.weekday()), now
    if "this month" in e:
        return midnight.replace(day=1), now
    return None


def valid_range(start: Column, end: Column, now: Column) -> tuple[Column, Column]:
    """Bounds in order, cut to now; one of over ten years (3,650 days) ago is null."""
    both = start.isNotNull() & end.isNotNull()
    low, high = F.when(both, F.least(start, end)).otherwise(start), F.when(both, F.greatest(start, end)).otherwise(end)
    ok = lambda c: F.when(c.isNotNull() & (F.least(c, now) >= now - F.expr("INTERVAL 3650 DAYS")), F.least(c, now))
    return ok(low), ok(high)


def event_time(*columns: Column) -> Column:
    """The first time that a row has."""
    return F.coalesce(*columns)


def buckets(ts: Column) -> Column:
    """A struct of the day, week (from Monday), month, quarter and year that a time lies in, each by its start."""
    return F.struct(*(F.date_trunc(u, ts).alias(u) for u in ("day", "week", "month", "quarter", "year")))


def covering(start: Column, end: Column) -> Column:
    """The finest of day, week, month, quarter and year whose bucket holds both bounds, or null."""
    out = F.lit(None).cast("string")
    for unit in ("year", "quarter", "month", "week", "day"):
        out = F.when(F.date_trunc(unit, start) == F.date_trunc(unit, end), unit).otherwise(out)
    return out


def in_range(ts: Column, op: str, start: Column | None = None, end: Column | None = None) -> Column:
    """before: ts < end; after: ts > start; between: both inclusive; during and overlaps: true. A null time is never in a range."""
    if op == "before":
        return F.coalesce(ts < end, F.lit(False))
    if op == "after":
        return F.coalesce(ts > start, F.lit(False))
    if op == "between":
        return F.coalesce((ts >= start) & (ts <= end), F.lit(False))
    if op in ("during", "overlaps"):
        return F.lit(True)
    raise ValueError(f"unknown operator: {op}")
