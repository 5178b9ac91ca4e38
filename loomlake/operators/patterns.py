"""Event patterns: a key's list of values and operators is an OR, keys are an AND, `$or` branches."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
CLOSED = ("done", "cancelled", "completed", "closed")


def wildcard(pattern: str) -> str:
    """A glob of * and ? as a regular expression over the whole text."""
    return "(?s)^" + "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern) + "$"


def matches(pattern: dict[str, Any] | None, columns: dict[str, Column]) -> Column:
    """True or false, never null. A key without a column, or with a null value, is absent."""
    parts = []
    for key, wanted in (pattern or {}).items():
        if key == "$or":
            parts.append(reduce(lambda a, b: a | b, (matches(x, columns) for x in wanted), F.lit(False)))
            continue
        value = columns.get(key)
        own = [_one(x, value) for x in (wanted if isinstance(wanted, list) else [wanted])]
        parts.append(reduce(lambda a, b: a | b, own, F.lit(False)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _one(wanted: Any, value: Column | None) -> Column:
    if isinstance(wanted, dict) and "exists" in wanted:
        present = F.lit(False) if value is None else value.isNotNull()
        return present if wanted["exists"] else ~present
    if value is None:
        return F.lit(False)
    if not isinstance(wanted, dict):
        return F.coalesce(value == F.lit(wanted), F.lit(False))
    ((op, x), *_) = wanted.items()
    if op == "prefix":
        found = value.startswith(x)
    elif op == "suffix":
        found = value.endswith(x)
    elif op == "equals-ignore-case":
        found = F.lower(value) == x.lower()
    elif op == "wildcard":
        found = value.rlike(wildcard(x))
    elif op == "numeric":
        found = reduce(lambda a, b: a & b, (COMPARE[o](value, F.lit(n)) for o, n in zip(x[::2], x[1::2], strict=True)))
    elif op == "contains-all":
        found = reduce(lambda a, b: a & b, (F.array_contains(value, y) for y in x), F.lit(True))
    elif op == "anything-but":
        if isinstance(x, dict):
            known = set(x) & {"prefix", "suffix", "wildcard"}
            return value.isNotNull() & ~_one(x, value) if known else F.lit(False)
        return F.coalesce(~value.isin(*(x if isinstance(x, list) else [x])), F.lit(False))
    else:
        return F.lit(False)
    return F.coalesce(found, F.lit(False))


def open_items(kind: Column, status: Column, kinds: tuple[str, ...] = ("ACTION_ITEM", "COMMITMENT", "OPEN_QUESTION")) -> Column:
    """True but for tracked kinds with a closed status."""
    return ~(kind.isin(*kinds) & F.coalesce(F.lower(status).isin(*CLOSED), F.lit(False)))


def chunk_filter(columns: dict[str, Column], occurred_after=None, occurred_before=None, source: str | None = None, author: str | None = None, channel: str | None = None, tags: list[str] | None = None) -> Column:
    """Bounds (after inclusive, before exclusive), equal fields and tags that must all be there; a null never passes."""
    parts = []
    if occurred_after is not None:
        parts.append(columns["occurred_at"] >= occurred_after)
    if occurred_before is not None:
        parts.append(columns["occurred_at"] < occurred_before)
    parts += [columns[k] == v for k, v in (("source", source), ("author", author), ("channel", channel)) if v is not None]
    parts += [F.array_contains(columns["tags"], t) for t in tags or []]
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))
