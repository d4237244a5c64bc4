"""Quality and electrical characterisation from monitor samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stamina.functions.units import credible_rest_level
from stamina.operators.ordered import Ordered
from stamina.operators.quantiles import group_quantile


def quality(samples: DataFrame, keys: list[str], order: list[str], t: str, target_hz: float = 2.0,
            shortfall: float = 0.7) -> DataFrame:
    """Samples, achieved rate, largest gap, readings per status, and whether the rate fell short."""
    o = Ordered(samples, keys, order).lag(__pt=F.col(t)).result()
    g = o.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.max(F.col(t) - F.col("__pt")).alias("max_gap_s"),
        (F.max(t) - F.min(t)).alias("__span"), F.count_if(F.col("i_status") == "offscreen").alias("offscreen"),
        F.count_if(F.col("i_status").isin("invalid", "error")).alias("unreadable"))
    hz = F.when((F.col("samples") >= 2) & (F.col("__span") > 0), (F.col("samples") - 1) / F.col("__span"))
    return (g.withColumn("achieved_hz", hz)
            .withColumn("shortfall", F.coalesce(F.col("achieved_hz") < shortfall * target_hz, F.lit(False))).drop("__span"))


def leakage(samples: DataFrame, keys: list[str], order: list[str], ua: str, rest: Column) -> DataFrame:
    """Median of the last half of the readable hold samples, minus the rest level."""
    o = (Ordered(samples.where(F.col(ua).isNotNull()), keys, order).row_number("__k")
         .total(__n=F.count(F.lit(1))).result())
    late = o.where(F.col("__k") - 1 >= F.floor(F.col("__n") / 2))
    return group_quantile(late, keys, {"__m": F.col(ua)}).select(*keys, (F.col("__m") - rest).alias("leak_ua"))


def capacitance(samples: DataFrame, keys: list[str], order: list[str], t: str, ua: str, direction: str,
                ref_kv: Column) -> DataFrame:
    """Charge of the up and down ramp and C = (q_up - q_down) / 2V; leakage and offset cancel."""
    o = Ordered(samples, [*keys, direction], order).lag(__pt=F.col(t)).result()
    q = F.col(ua) * (F.col(t) - F.col("__pt"))
    g = o.groupBy(*keys).agg(F.sum(F.when(F.col(direction) == "up", q)).alias("q_up"),
                             F.sum(F.when(F.col(direction) == "down", q)).alias("q_down"))
    return g.withColumn("c_nf", F.when(ref_kv > 0, (F.col("q_up") - F.col("q_down")) / (2 * ref_kv)))


def rest_level(samples: DataFrame, keys: list[str], order: list[str], ua: str, trip_ua: float,
               reads: int = 10, drop: int = 2, need: int = 4) -> DataFrame:
    """Median of the early readings after settling, if there are enough and it is credible."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = samples.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= reads)
    used = F.when(F.col("__k") > drop, F.col(ua))
    g = first.groupBy(*keys).agg(F.count(used).alias("n"), F.percentile(used, F.lit(0.5)).alias("__m"))
    med = F.when(F.col("n") >= need, F.col("__m"))
    return g.select(*keys, "n", F.when(credible_rest_level(med, F.lit(trip_ua)), med).alias("rest_ua"))


def envelope(samples: DataFrame, keys: list[str], order: list[str], value: str, columns: int) -> DataFrame:
    """Min/max per display column; no sample is lost. Shorter records give one pair per sample."""
    o = Ordered(samples, keys, order).row_number("__k").total(__n=F.count(F.lit(1))).result()
    i = F.col("__k") - 1
    bucket = F.when(F.col("__n") <= columns, i).otherwise(F.floor(((i + 1) * columns - 1) / F.col("__n")))
    return (o.withColumn("column", bucket.cast("bigint")).groupBy(*keys, "column")
            .agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
