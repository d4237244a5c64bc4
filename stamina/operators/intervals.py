"""Interval and as-of joins with bucketed equi-keys (no nested-loop joins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stamina.operators.ordered import Ordered


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str,
                  bucket: float, closed: bool = False, how: str = "inner") -> DataFrame:
    """Points with ``lo <= at < hi`` (or ``<= hi``): equi-join on (keys, bucket), then filter.

    A span is copied to the buckets it touches, so a key with many points is spread
    over its buckets instead of meeting in one task.
    """
    width = F.lit(float(bucket))
    first = F.floor(F.col(lo) / width).cast("bigint")
    final = F.floor(F.col(hi) / width).cast("bigint")
    s = spans.withColumn("__b", F.explode(F.sequence(first, F.greatest(first, final))))
    p = points.withColumn("__b", F.floor(F.col(at) / width).cast("bigint"))
    inside = (F.col(at) >= F.col(lo)) & ((F.col(at) <= F.col(hi)) if closed else (F.col(at) < F.col(hi)))
    if how == "inner":
        return p.join(s, [*keys, "__b"]).where(inside).drop("__b")
    cond = inside & (F.col("p.__b") == F.col("s.__b"))
    for k in keys:
        cond = cond & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    extra = [c for c in s.columns if c not in (*keys, "__b")]
    return (p.alias("p").join(s.alias("s"), cond, how)
            .select("p.*", *[F.col(f"s.{c}") for c in extra]).drop("__b"))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], on: str,
              values: dict[str, Column], tiebreak: list[str]) -> DataFrame:
    """For each left row the latest right row at or before it, by union and a running last."""
    box = F.struct(*[v.alias(k) for k, v in values.items()])
    r = right.select(*keys, on, F.lit(0).alias("__side"), box.alias("__box"))
    l = left.withColumn("__side", F.lit(1))
    both = l.unionByName(r, allowMissingColumns=True)
    out = (Ordered(both, keys, [on, "__side", *tiebreak]).last(__hit=F.col("__box")).result()
           .where(F.col("__side") == 1))
    for k in values:
        out = out.withColumn(k, F.col("__hit")[k])
    return out.drop("__side", "__box", "__hit")
