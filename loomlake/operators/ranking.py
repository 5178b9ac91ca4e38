"""Ranked lists as DataFrames (channel, id, score): fusion, normalisation, recency, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(lists: DataFrame, by: str = "channel") -> DataFrame:
    """Adds rank from 1 in each channel, by score descending, ties by id."""
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), "id")))


def rrf(lists: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """(id, score, channels): the sum of weight / (k + rank) over channels. A missing weight is 1."""
    w = _weight(weights)
    return ranked(lists).groupBy("id").agg(F.sum(w / (k + F.col("rank"))).alias("score"), F.count("*").alias("channels"))


def comb_mnz(lists: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    return rrf(lists, weights, k).select("id", (F.col("score") * F.col("channels")).alias("score"), "channels")


def min_max(score: Column, by: str | None = None, equal: float = 1.0) -> Column:
    """(s - min) / (max - min) within a group; `equal` if all are equal."""
    w = Window.partitionBy(by) if by else Window.partitionBy()
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.lit(equal)).otherwise((score - low) / (high - low))


def normalised_rrf(lists: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K, tie: float = 0.01) -> DataFrame:
    """weight / (k + rank) plus `tie` * weight * min-max score, so that scores break near ties."""
    w = _weight(weights)
    placed = ranked(lists).withColumn("norm", min_max(F.col("score"), "channel"))
    return placed.groupBy("id").agg(F.sum(w / (k + F.col("rank")) + tie * w * F.col("norm")).alias("score"), F.count("*").alias("channels"))


def calibrated(lists: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    placed = lists.withColumn("norm", min_max(F.col("score"), "channel"))
    return placed.groupBy("id").agg(F.sum(_weight(weights) * F.col("norm")).alias("score"), F.count("*").alias("channels"))


def interleave(lists: DataFrame, priority: list[str], k: int = RRF_K, most: int | None = None) -> DataFrame:
    """Union by best rank, then more channels, then the best channel's priority and min-max score, then id as text; score is 1 / (k + position).

    `most` cuts each channel to its best first. Positions number one whole list, so that
    step runs in one task over (id, key) rows: give `most` where channels aren't short.
    """
    at = F.array_position(F.array(*map(F.lit, priority)), F.col("channel"))
    placed = ranked(lists)
    placed = placed.where(F.col("rank") <= most) if most else placed
    placed = placed.withColumn("norm", min_max(F.col("score"), "channel"))
    best = placed.groupBy("id").agg(F.min(F.struct("rank", at.alias("at"), (-F.col("norm")).alias("norm"))).alias("x"), F.count("*").alias("channels"))
    best = best.select("id", F.col("x.rank").alias("best_rank"), "channels", "x.at", "x.norm")
    order = Window.orderBy("best_rank", F.col("channels").desc(), "at", "norm", F.col("id").cast("string"))
    return best.withColumn("position", F.row_number().over(order)).withColumn("score", 1 / (k + F.col("position"))).drop("at", "norm")


def _weight(weights: dict[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col("channel")), F.lit(1.0))


def _us(ts: Column) -> Column:
    """Microseconds of a time; one without a zone is read as in the session's (UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def age_days(ts: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (_us(now) - _us(ts)) / 86_400_000_000.0)


def half_life(age: Column, half: float) -> Column:
    return F.pow(F.lit(0.5), age / half)


def recency_score(ts: Column, now: Column, weight: float, half_days: float) -> Column:
    """(1 - w) + w * 0.5 ** (age / half-life); a null time gets 1 - w."""
    return (1 - weight) + weight * F.coalesce(half_life(age_days(ts, now), half_days), F.lit(0.0))


def decay(score: Column, ts: Column, now: Column, weight: float = 0.3, half_hours: float = 168.0) -> Column:
    """Ebbinghaus: score * ((1 - w) + w * exp(-t ln 2 / half-life))."""
    return score * recency_score(ts, now, weight, half_hours / 24)


def soft_window(score: Column, ts: Column, start: Column, end: Column, half_days: float = 7.0, drop_days: float = 30.0) -> Column:
    """Outside [start, end] the score halves every `half_days`; beyond `drop_days` it is null (dropped). A null time keeps it."""
    off = F.greatest(age_days(ts, start), age_days(end, ts))
    return F.when(ts.isNull(), score).when(off > drop_days, F.lit(None)).otherwise(score * half_life(off, half_days))


def version_decay(version: Column, by: str) -> Column:
    return F.sqrt(version / F.max(version).over(Window.partitionBy(by)))


def sessionize(events: DataFrame, by: str, ts: str, gap_seconds: int, into: str = "session") -> DataFrame:
    """Numbers sessions from 0 in each group: a new one where the gap exceeds `gap_seconds`."""
    w = Window.partitionBy(by).orderBy(ts, *[c for c in events.columns if c not in (by, ts)][:1])
    new = F.coalesce((_us(F.col(ts)) - _us(F.lag(ts).over(w)) > gap_seconds * 1_000_000).cast("int"), F.lit(0))
    return events.withColumn("_new", new).withColumn(into, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def mmr(candidates: DataFrame, k: int, lam: float = 0.7) -> DataFrame:
    """Greedy maximal marginal relevance per query_id over (query_id, id, score, embedding).

    The greedy walk needs a query's whole list in one task: candidates are what a query's
    channels have already cut to their best. Ties go to the least id.
    """
    bounded = candidates

    def pick(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("id")
        x = np.array(pdf["embedding"].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        rel, near, left, out = pdf["score"].to_numpy(), np.zeros(len(pdf)), np.ones(len(pdf), bool), []
        for place in range(min(k, len(pdf))):
            value = np.where(left, np.round(lam * rel - (1 - lam) * near, 9), -np.inf)
            i = int(value.argmax())
            out.append((pdf["query_id"].iloc[i], pdf["id"].iloc[i], place + 1))
            left[i] = False
            near = np.maximum(near, x @ x[i])
        return pd.DataFrame(out, columns=["query_id", "id", "rank"])

    schema = f"query_id {candidates.schema['query_id'].dataType.simpleString()}, id {candidates.schema['id'].dataType.simpleString()}, rank int"
    return bounded.groupBy("query_id").applyInPandas(pick, schema)
