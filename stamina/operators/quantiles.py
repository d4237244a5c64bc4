"""Exact medians and percentiles per group, also for groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stamina.operators.ordered import Ordered, find_hot, hinted


def distributed_quantile(df: DataFrame, keys: list[str], value: Column, name: str,
                         p: float, per_segment: int | None = None) -> DataFrame:
    """Linear-interpolated quantile from a value histogram ranked in segments.

    Equal values are counted before the shuffle, so a dominant value costs one row.
    """
    hist = (df.select(*keys, value.cast("double").alias("__v")).where(F.col("__v").isNotNull())
            .groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__cnt")))
    ranked = (Ordered(hist, keys, ["__v"], per_segment)
              .running_sum(__cum=F.col("__cnt")).total(__all=F.sum("__cnt")).result())
    at = (F.col("__all") - 1) * F.lit(float(p))
    before = F.col("__cum") - F.col("__cnt")

    def holds(rank: Column) -> Column:
        return F.when((before <= rank) & (rank < F.col("__cum")), F.col("__v"))

    return (ranked.groupBy(*keys)
            .agg(F.max(holds(F.floor(at))).alias("__l"), F.max(holds(F.ceil(at))).alias("__h"),
                 F.max(at - F.floor(at)).alias("__f"))
            .select(*keys, (F.col("__l") + (F.col("__h") - F.col("__l")) * F.col("__f")).alias(name)))


def group_quantile(df: DataFrame, keys: list[str], values: dict[str, Column],
                   p: float = 0.5, per_segment: int | None = None) -> DataFrame:
    """One row per key with exact quantiles; small keys use the built-in aggregate."""
    slim = df.select(*keys, *[v.cast("double").alias(k) for k, v in values.items()])

    def builtin(part: DataFrame) -> DataFrame:
        return part.groupBy(*keys).agg(
            *[F.percentile(F.col(k), F.lit(float(p))).alias(k) for k in values])

    found = find_hot(slim, keys, per_segment)
    if found is None:
        return builtin(slim)
    hot = hinted(found.select(*keys))
    large = slim.join(hot, keys, "left_semi")
    wide = found.select(*keys)
    for k in values:
        wide = wide.join(distributed_quantile(large, keys, F.col(k), k, p, per_segment), keys, "left")
    return builtin(slim.join(hot, keys, "left_anti")).unionByName(wide)


def group_quantile_grid(df: DataFrame, keys: list[str], value: Column, grid: list[float], name: str) -> DataFrame:
    """(keys, p, name) for a fixed grid of quantiles, exact at any group size."""
    slim = df.select(*keys, value.cast("double").alias("__v")).where(F.col("__v").isNotNull())
    ps = F.array(*[F.lit(float(p)) for p in grid])

    def builtin(part: DataFrame) -> DataFrame:
        q = part.groupBy(*keys).agg(F.percentile("__v", ps).alias("__q"))
        return q.select(*keys, F.explode(F.arrays_zip(ps.alias("p"), F.col("__q").alias("v"))).alias("z")).select(
            *keys, F.col("z.p").alias("p"), F.col("z.v").alias(name))

    found = find_hot(slim, keys)
    if found is None:
        return builtin(slim)
    hot = hinted(found.select(*keys))
    hist = slim.join(hot, keys, "left_semi").groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__cnt"))
    r = Ordered(hist, keys, ["__v"]).running_sum(__cum=F.col("__cnt")).total(__all=F.sum("__cnt")).result()
    before = F.col("__cum") - F.col("__cnt")
    last = F.col("__all") - 1
    touched = F.filter(ps, lambda p: (F.ceil(last * p) >= before) & (F.floor(last * p) < F.col("__cum")))
    e = r.withColumn("p", F.explode(touched)).withColumn("__at", last * F.col("p"))

    def holds(rank: Column) -> Column:
        return F.when((before <= rank) & (rank < F.col("__cum")), F.col("__v"))

    g = e.groupBy(*keys, "p").agg(F.max(holds(F.floor("__at"))).alias("l"), F.max(holds(F.ceil("__at"))).alias("h"),
                                  F.max(F.col("__at") - F.floor("__at")).alias("f"))
    large = g.select(*keys, "p", (F.col("l") + (F.col("h") - F.col("l")) * F.col("f")).alias(name))
    return builtin(slim.join(hot, keys, "left_anti")).unionByName(large)
