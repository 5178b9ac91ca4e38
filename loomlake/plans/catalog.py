"""Named queries over the test tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
#: Modules of this package that register queries.
MODULES = ("reference", "scoring", "joins", "maintenance", "texts")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def rounded(x: Column, digits: int = 6) -> Column:
    """A double rounded as the SQL does: scaled, rounded and scaled back in doubles.

    F.round goes by the decimal digits of the number instead, and so differs where it lies
    on or next to a half.
    """
    scale = float(10**digits)
    return F.round(x * scale) / scale


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def _load() -> None:
    for name in MODULES:
        import_module(f"{__package__}.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
