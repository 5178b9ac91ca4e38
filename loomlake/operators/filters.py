"""The recall filter: a Mongo-style document compiled to one two-valued Column.

Every leaf is true or false, never null, so `$not` and `$nor` bring rows with absent
values in. System keys are columns; `metadata.<path>` reads a JSON column as VARIANT.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_KEYS = frozenset({"occurred_at", "created_at", "source_timestamp"})
TEXT_KEYS = frozenset({"source_type", "source_name", "source_url", "external_id", "content_type", "source", "title"})
RANGES = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}
OPERATORS = frozenset({"$eq", "$ne", "$in", "$nin", "$exists", "$not", "$date", *RANGES})
DEPTH = 100


@dataclass
class FieldError(ValueError):
    path: str
    code: str
    message: str

    def __str__(self) -> str:
        return f"{self.path}: {self.code}: {self.message}"


@dataclass(frozen=True)
class Leaf:
    path: tuple[str, ...]
    op: str
    value: Any


@dataclass(frozen=True)
class Group:
    op: str  # and, or, not
    children: tuple


def parse(document: dict, depth: int = 0) -> Group | Leaf:
    """Validates and lowers a filter: sugar goes, paths become tuples, `$nor` is not(or), same operators flatten."""
    if depth > DEPTH:
        raise FieldError("", "too_deep", f"nesting beyond {DEPTH}")
    if not isinstance(document, dict):
        raise FieldError("", "type", "a filter is an object")
    parts = []
    for key, value in document.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(value, list):
                raise FieldError(key, "type", "a list is needed")
            inner = normalize(Group("and" if key == "$and" else "or", tuple(parse(x, depth + 1) for x in value)))
            parts.append(Group("not", (inner,)) if key == "$nor" else inner)
        elif key == "$not":
            parts.append(Group("not", (parse(value, depth + 1),)))
        elif key.startswith("$"):
            raise FieldError(key, "unknown_operator", "no such operator")
        else:
            parts.append(_field(key, value))
    return normalize(Group("and", tuple(parts)))


def _field(key: str, value: Any) -> Group | Leaf:
    path = tuple(key.split("."))
    if path[0] != "metadata" and key not in DATE_KEYS | TEXT_KEYS:
        raise FieldError(key, "unknown_key", "no such key")
    if not (isinstance(value, dict) and any(k.startswith("$") for k in value)):
        return Leaf(path, "$eq", value)
    out = []
    for op, x in value.items():
        if op not in OPERATORS:
            raise FieldError(key, "unknown_operator", op)
        if op in RANGES and path[0] != "metadata" and key not in DATE_KEYS:
            raise FieldError(key, "operator_not_allowed", f"{op} on a text key")
        if op in ("$in", "$nin") and not isinstance(x, list):
            raise FieldError(key, "type", f"{op} needs a list")
        out.append(Group("not", (_field(key, x),)) if op == "$not" else Leaf(path, op, x))
    return normalize(Group("and", tuple(out)))


def normalize(node: Group | Leaf) -> Group | Leaf:
    if isinstance(node, Leaf) or node.op == "not":
        return node
    flat: list = []
    for c in node.children:
        flat += c.children if isinstance(c, Group) and c.op == node.op else [c]
    return flat[0] if len(flat) == 1 else Group(node.op, tuple(flat))


def leaves(node: Group | Leaf) -> list[Leaf]:
    """All conditions of a filter, in order."""
    return [node] if isinstance(node, Leaf) else [x for c in node.children for x in leaves(c)]


def split(node: Group | Leaf, pushable: frozenset[str] | set[str]) -> tuple[Group | Leaf, Group | Leaf]:
    """(pushed, rest), whose conjunction is the filter: what a store that knows the `pushable` keys can take, and what is left.

    A conjunction is split part by part; a disjunction or negation goes as a whole or not at all.
    """
    every = Group("and", ())
    if isinstance(node, Group) and node.op == "and":
        both = [split(c, pushable) for c in node.children]
        return tuple(normalize(Group("and", tuple(p for p in side if p != every))) for side in zip(*both, strict=True)) if both else (every, every)
    known = all(".".join(x.path) in pushable or x.path[0] in pushable for x in leaves(node))
    return (node, every) if known else (every, node)


def report(node: Group | Leaf, pushable: frozenset[str] | set[str]) -> dict[str, list[str]]:
    """The keys that are pushed down, and those that are held against the rows afterwards."""
    pushed, rest = split(node, pushable)
    names = lambda x: sorted({".".join(y.path) for y in leaves(x)})
    return {"pushed_keys": names(pushed), "post_filtered_keys": names(rest)}


def date_bounds(node: Group | Leaf, key: str = "source_timestamp") -> tuple[Any, Any]:
    """(lower, upper) that the top-level conjunction sets for a date key: the greatest lower and the least upper one, or None.

    Bounds are a superset: whether they are strict is left to the filter itself.
    """
    top = node.children if isinstance(node, Group) and node.op == "and" else (node,)
    own = [(x.op, _moment(x.value)) for x in top if isinstance(x, Leaf) and x.path == (key,) and x.value is not None and x.op in ("$eq", *RANGES)]
    low = [t for op, t in own if op in ("$gt", "$gte", "$eq")]
    high = [t for op, t in own if op in ("$lt", "$lte", "$eq")]
    return max(low, default=None), min(high, default=None)


def canonical_hash(node: Group | Leaf) -> str:
    """SHA-256 of canonical JSON; the order of children of and / or doesn't count, that of lists does."""

    def plain(x: Group | Leaf) -> Any:
        if isinstance(x, Leaf):
            return [".".join(x.path), x.op, x.value.isoformat() if isinstance(x.value, datetime) else x.value]
        kids = [plain(c) for c in x.children]
        return [x.op, sorted(kids, key=lambda c: json.dumps(c, sort_keys=True)) if x.op != "not" else kids]

    return hashlib.sha256(json.dumps(plain(node), sort_keys=True, default=str).encode()).hexdigest()


def compile_filter(document: dict | Group | Leaf, columns: dict[str, Column] | None = None, metadata: Column | None = None) -> Column:
    """The Column of a filter. columns: system key to Column; metadata: a JSON text column, `metadata` by default."""
    node = parse(document) if isinstance(document, dict) else document
    blob = F.try_parse_json(F.col("metadata") if metadata is None else metadata)
    return _compile(node, columns or {}, blob)


def _compile(node: Group | Leaf, columns: dict[str, Column], blob: Column) -> Column:
    if isinstance(node, Leaf):
        return _metadata(node, blob) if node.path[0] == "metadata" else _system(node, columns.get(node.path[0], F.col(node.path[0])))
    kids = [_compile(c, columns, blob) for c in node.children]
    if node.op == "not":
        return ~kids[0]
    return reduce(lambda a, b: a & b, kids, F.lit(True)) if node.op == "and" else reduce(lambda a, b: a | b, kids, F.lit(False))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _moment(x: Any) -> datetime:
    """A date in a filter as a time in UTC; one without a zone is UTC."""
    if isinstance(x, dict):
        x = x.get("$date")
    if isinstance(x, str):
        x = datetime.fromisoformat(x.replace("Z", "+00:00"))
    return x.replace(tzinfo=UTC) if x.tzinfo is None else x.astimezone(UTC)


def _date(x: Any) -> Column:
    return F.to_timestamp(F.lit(_moment(x).strftime("%Y-%m-%dT%H:%M:%S.%fZ")))


def _system(leaf: Leaf, c: Column) -> Column:
    key, op, x = leaf.path[0], leaf.op, leaf.value
    if op == "$exists":
        return F.lit(bool(x))  # system keys are always there
    if op in ("$eq", "$ne") and x is None:
        return c.isNull() if op == "$eq" else c.isNotNull()
    if op == "$eq" and isinstance(x, list):
        return F.lit(False)  # an exact array is no scalar
    lit, c = (_date, c.cast("timestamp")) if key in DATE_KEYS else (F.lit, c)
    if op in RANGES:
        return _sure(RANGES[op](c, lit(x)))
    if op in ("$in", "$nin"):
        found = _sure(c.isin(*map(lit, x))) if x else F.lit(False)
        return found if op == "$in" else ~found
    same = _sure(c == lit(x))
    return same if op == "$eq" else ~same


def _metadata(leaf: Leaf, blob: Column) -> Column:
    op, x = leaf.op, leaf.value
    path = "$" + "".join(f"['{p}']" for p in leaf.path[1:])
    node = F.try_variant_get(blob, path, "variant")
    kind = F.schema_of_variant(node)
    null = node.isNull() | F.is_variant_null(node)
    if op == "$exists":
        return _sure(node.isNotNull()) if x else ~_sure(node.isNotNull())
    if op in ("$eq", "$ne") and x is None:
        return _sure(null) if op == "$eq" else ~_sure(null)
    if op in RANGES:
        return _range(op, x, blob, path, kind)
    if op in ("$in", "$nin"):
        found = reduce(lambda a, b: a | b, [_contains(v, blob, path, node, kind) for v in x], F.lit(False))
        return found if op == "$in" else ~found
    same = _contains(x, blob, path, node, kind)
    return ~same if op == "$ne" else same


def _canonical(x: Any) -> str:
    return json.dumps(x, separators=(",", ":"), sort_keys=True)


def _number(kind: Column) -> Column:
    return kind.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def _contains(x: Any, blob: Column, path: str, node: Column, kind: Column) -> Column:
    """The node equals x, or is a list of which x is an element; a list or object equals as a whole. VARIANT sorts an object's keys."""
    if isinstance(x, (list, dict)):
        return _sure(F.to_json(node) == F.lit(_canonical(x)))
    if isinstance(x, bool) or isinstance(x, str):
        same = F.to_json(node) == F.lit(json.dumps(x, ensure_ascii=False))
    else:
        same = _number(kind) & (F.try_variant_get(blob, path, "double") == F.lit(float(x)))
    inside = F.exists(F.try_variant_get(blob, path, "array<variant>"), lambda e: _sure(F.to_json(e) == F.lit(json.dumps(x, ensure_ascii=False))))
    return _sure(same) | _sure(kind.startswith("ARRAY") & inside)


def _range(op: str, x: Any, blob: Column, path: str, kind: Column) -> Column:
    """Numbers with numbers, text with text, booleans with booleans; dates are ISO text read as UTC."""
    f = RANGES[op]
    if isinstance(x, dict) and "$date" in x:
        return _sure((kind == "STRING") & f(F.try_to_timestamp(F.try_variant_get(blob, path, "string")), _date(x)))
    if isinstance(x, bool):
        return _sure((kind == "BOOLEAN") & f(F.try_variant_get(blob, path, "boolean"), F.lit(x)))
    if isinstance(x, str):
        return _sure((kind == "STRING") & f(F.try_variant_get(blob, path, "string"), F.lit(x)))
    return _sure(_number(kind) & f(F.try_variant_get(blob, path, "double"), F.lit(float(x))))
