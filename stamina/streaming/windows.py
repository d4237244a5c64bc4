"""Windowed stream operators that need no custom state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stamina.streaming.engine import LATENESS


def stale_runs(updates: DataFrame, keys: list[str], ts: str, limit: str = "15 seconds", lateness: str = LATENESS) -> DataFrame:
    """A row when a run stays silent for ``limit``: the end of its session of updates."""
    s = updates.withWatermark(ts, lateness).groupBy(*keys, F.session_window(ts, limit).alias("w")).agg(F.count(F.lit(1)).alias("updates"))
    return s.select(*keys, F.col("w.start").alias("first_update"), F.col("w.end").alias("stale_at"), "updates")


def latest_status(updates: DataFrame, keys: list[str], ts: str, value: Column, every: str = "2 seconds", lateness: str = LATENESS) -> DataFrame:
    """At most one status per run and interval: the newest."""
    g = updates.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, every).alias("w"))
    return g.agg(F.max_by(value, ts).alias("status"), F.max(ts).alias("updated")).select(*keys, F.col("w.start").alias("slot"), "status", "updated")


def live_envelope(samples: DataFrame, keys: list[str], ts: str, value: str, length: str, slide: str, lateness: str = LATENESS) -> DataFrame:
    """Sliding minimum, maximum and count of a signal."""
    g = samples.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, length, slide).alias("w"))
    return g.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).select(*keys, F.col("w.start").alias("slot"), "lo", "hi", "n")
