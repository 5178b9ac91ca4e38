"""Scoped reads: listings, look-ups by id or checksum, subjects' events, active versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(namespace, kind, n) over several tables with a namespace column."""
    out = None
    for kind, rows in tables.items():
        own = rows.groupBy("namespace").agg(F.count("*").alias("n")).select("namespace", F.lit(kind).alias("kind"), "n")
        out = own if out is None else out.union(own)
    return out


def listing(rows: DataFrame, created: str, id: str, limit: int, offset: int = 0, *where: Column) -> DataFrame:
    """A page by offset, the newest first; keyset pages (store.page) stay cheap at any depth, this one doesn't."""
    for condition in where:
        rows = rows.where(condition)
    return rows.orderBy(F.col(created).desc(), F.col(id).desc()).offset(offset).limit(limit)


def get(rows: DataFrame, id: str, ids: DataFrame, scope: Column) -> DataFrame:
    """Rows of stated ids within a scope: another tenant's rows never come back."""
    return rows.where(scope).join(ids.select(id).distinct(), id, "left_semi")


def by_checksum(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows with one of the checksums, failed ones left out."""
    return rows.where(F.col("status") != "FAILED").join(asked.select("checksum").distinct(), "checksum", "left_semi")


def subject_events(rows: DataFrame, subject: Column, ts: str, id: str, limit: int, since: Column | None = None, until: Column | None = None) -> DataFrame:
    rows = rows.where(subject)
    if since is not None:
        rows = rows.where(F.col(ts) >= since)
    if until is not None:
        rows = rows.where(F.col(ts) <= until)
    return rows.orderBy(F.col(ts).desc_nulls_last(), id).limit(limit)


def active_versions(rows: DataFrame) -> DataFrame:
    """(namespace, version, id): of each namespace the greatest active version."""
    return rows.where("is_active").groupBy("namespace").agg(F.max(F.struct("version", "id")).alias("x")).select("namespace", "x.*")


def canonical(label: Column, aliases: dict[str, str]) -> Column:
    """A source label, trimmed and in lower case, by its canonical name."""
    plain = F.lower(F.trim(label))
    names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.element_at(names, plain), plain)
