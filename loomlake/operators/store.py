"""Writes as new DataFrames: staging, merge, supersession, cascade deletes, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def checksum(text: Column) -> Column:
    return F.sha2(text, 256)


def stage(new: DataFrame, stored: DataFrame, order: str, text: str = "text") -> DataFrame:
    """New rows without content that is stored, and of equal content the first by `order`."""
    keyed = new.withColumn("checksum", checksum(F.col(text)))
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("checksum").orderBy(order))).where(F.col("_n") == 1).drop("_n")
    return first.join(stored.select(checksum(F.col(text)).alias("checksum")).distinct(), "checksum", "left_anti")


def detect_changes(current: DataFrame, before: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): new, updated, unchanged or deleted."""
    a, b = current.select(F.col(key).alias("k"), checksum(F.col(content)).alias("x")), before.select(F.col(key).alias("k"), checksum(F.col(content)).alias("y"))
    change = F.when(F.col("y").isNull(), "new").when(F.col("x").isNull(), "deleted").when(F.col("x") == F.col("y"), "unchanged").otherwise("updated")
    return a.join(b, "k", "full").select(F.col("k").alias(key), change.alias("change"))


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in `order`."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def merge(stored: DataFrame, incoming: DataFrame, by: list[str]) -> DataFrame:
    """Upsert: incoming values win where they aren't null; rows on one side only stay."""
    rest = [c for c in stored.columns if c not in by]
    s, i = stored.alias("s"), incoming.alias("i")
    on = [F.col(f"s.{c}") == F.col(f"i.{c}") for c in by]
    return s.join(i, on, "full").select(*(F.coalesce(f"i.{c}", f"s.{c}").alias(c) for c in by + rest))


def forget(rows: DataFrame, sources: str, gone: DataFrame) -> DataFrame:
    """Strips the ids of `gone` (id) from an array column; rows that lose their last source go.

    Rows whose array was null or empty before stay as they are; other columns, of any type,
    travel along. Only rows that name one of the ids are taken apart.
    """
    ids = gone.select(F.col("id").alias("_s")).distinct()
    # numbered once and kept: both uses must see the same numbers
    keyed = cut(rows.select(F.struct("*").alias("_row"), F.col(sources).alias("_all"), F.monotonically_increasing_id().alias("_k")))
    hit = keyed.select("_k", F.explode("_all").alias("_s")).join(ids, "_s", "left_semi").groupBy("_k").agg(F.collect_set("_s").alias("_gone"))
    left = F.when(F.col("_gone").isNull(), F.col("_all")).otherwise(F.sort_array(F.filter("_all", lambda x: ~F.array_contains("_gone", x))))
    out = keyed.join(hit, "_k", "left").withColumn("_left", left).where(F.col("_gone").isNull() | (F.size("_left") > 0))
    return out.select(*(F.col("_left").alias(c) if c == sources else F.col(f"_row.`{c}`") for c in rows.columns))


def page(rows: DataFrame, created: str, id: str, limit: int, after: tuple | None = None) -> DataFrame:
    """A keyset page in (created desc, id desc) order, behind the cursor `after`."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if after is not None:
        t, k = F.lit(after[0]), F.lit(after[1])
        rows = rows.where((F.col(created) < t) | ((F.col(created) == t) & (F.col(id) < k)))
    return rows.orderBy(F.col(created).desc(), F.col(id).desc()).limit(limit)


def supersede(facts: DataFrame, by: list[str], ts: str, id: str) -> DataFrame:
    """Of each key only the newest fact is active; the others name the next newer in superseded_by."""
    w = Window.partitionBy(*by).orderBy(ts, id)
    return facts.withColumn("superseded_by", F.lead(id).over(w)).withColumn("is_active", F.col("superseded_by").isNull())
