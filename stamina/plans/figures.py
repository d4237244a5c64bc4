"""Cross-run figure datasets built from the snapshot operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stamina.operators import snapshots as N


def signal_levels(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Current and offset-corrected power per level, with breakdown marks."""
    rows = flagged.join(N.current_median(flagged, keys).drop("n"), keys, "left").where(F.col("ua").isNotNull())
    p = N.power_mw(F.col("kv"), F.col("ua"), F.col("ua_median"))
    return rows.groupBy(*keys, F.round("kv", 3).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ua").alias("ua_mean"), F.avg(p).alias("power_mean"),
        F.bool_or(F.col("confirmed").isNotNull()).alias("confirmed"),
        F.bool_or(F.col("advisory").isNotNull()).alias("advisory"))


def expansion_levels(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """A/A0 per level with the band of its edge convention."""
    rows = flagged.withColumn("phase", N.phase(F.col("tag"))).withColumn("is_flagged", F.col("confirmed").isNotNull())
    lv = N.levels(rows, keys, F.col("area_mm2")).join(N.rest_area(rows, keys), keys)
    return lv.select(*keys, "level", (F.col("mean") / F.col("a0")).alias("expansion"), "band_pct")
