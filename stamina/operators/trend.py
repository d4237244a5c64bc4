"""Log-spaced trend reduction of block tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stamina.operators.ordered import Ordered


def bin_count(top: Column, per_decade: int) -> Column:
    return F.greatest(F.lit(2), F.floor(F.log10(top) * per_decade).cast("int"))


def edge(top: Column, n: Column, i: Column) -> Column:
    """The i-th log-spaced edge, rounded half to even; edge 0 is 0."""
    return F.when(i <= 0, 0).otherwise(
        F.bround(F.pow(F.lit(10.0), F.log10(top) * i / n)).cast("bigint"))


def log_bin(x: Column, top: Column, per_decade: int = 24) -> tuple[Column, Column]:
    """(lo, hi] of the bin holding ``x``, computed directly instead of joining an edge table."""
    n = bin_count(top, per_decade)
    guess = F.ceil(F.try_divide(n * F.log10(F.greatest(x - 0.5, F.lit(0.5))), F.log10(top))).cast("int")
    g = F.greatest(F.lit(1), F.least(n, guess))
    # rounding can move the first edge >= x by one place
    first = (F.when((g > 1) & (edge(top, n, g - 1) >= x), g - 1)
             .when((edge(top, n, g) < x) & (g < n), g + 1).otherwise(g))
    small = top < 10
    lo = F.when(small, 0).otherwise(edge(top, n, first - 1))
    hi = F.when(small, F.greatest(F.lit(1), F.floor(top))).otherwise(edge(top, n, first))
    return lo.cast("bigint"), hi.cast("bigint")


def bin_edges(tops: DataFrame, keys: list[str], per_decade: int = 24) -> DataFrame:
    """The edge table itself: 0 and the distinct rounded log-spaced edges up to ``top``."""
    top = F.col("top").cast("double")
    n = bin_count(top, per_decade)
    logs = F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), F.transform(
        F.sequence(F.lit(1), n), lambda i: edge(top, n, i))))
    few = F.array(F.lit(0).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), F.floor(top)))
    return tops.select(*keys, F.explode(F.when(top < 10, few).otherwise(logs)).alias("edge"))


def binned_blocks(blocks: DataFrame, keys: list[str], per_decade: int = 24) -> DataFrame:
    """Block summaries per log bin of the run's cycle total: count, means, counting modes."""
    top = Ordered(blocks.where(F.col("type") == "cycle"), keys, ["block_idx"]).total(
        __top=F.max("cycles_total")).result()
    t = F.greatest(F.col("__top").cast("double"), F.lit(1.0))
    lo, hi = log_bin(F.col("cycles_total").cast("double"), t, per_decade)
    return (top.withColumns({"cycles_lo": lo, "cycles_hi": hi}).groupBy(*keys, "cycles_lo", "cycles_hi")
            .agg(F.count(F.lit(1)).alias("n_blocks"), F.avg("imean_ua").alias("imean_ua"),
                 F.array_join(F.array_sort(F.collect_set("counting")), ";").alias("counting")))


def series(df: DataFrame, ids: list[str], axes: list[str], metrics: list[str]) -> DataFrame:
    """(axis, x, metric, y) rows with null pairs dropped."""
    long = df.unpivot([*ids, *metrics], axes, "axis", "x")
    return (long.unpivot([*ids, "axis", "x"], metrics, "metric", "y")
            .where(F.col("x").isNotNull() & F.col("y").isNotNull()))
