"""Streams of events: windows, sessions, dedup on ingest, supersession as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of (ts, event_type, value) in windows, behind a watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def dedup(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def latest_fact(facts: DataFrame) -> DataFrame:
    """(user_id, event_type, value, ts): emits a fact when it is newer than all before it for its key; late ones change nothing."""

    def step(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        held = state.get[0] if state.exists else -(1 << 62)
        rows = pd.concat(list(batches)).sort_values("ts")
        newer = rows[rows["ts"].astype("int64") > held].tail(1)
        if len(newer):
            state.update((int(newer["ts"].astype("int64").iloc[0]),))
            yield newer[["user_id", "event_type", "value", "ts"]]

    schema = "user_id long, event_type string, value double, ts timestamp"
    return facts.select("user_id", "event_type", "value", "ts").groupBy("user_id", "event_type").applyInPandasWithState(step, schema, "ts long", "update", "NoTimeout")
