"""Connected components of a graph given by edges, by alternating star contraction.

Each round points every node's larger neighbours at its smallest one, then every node at the smallest of its smaller ones; the
edges end as one star per component after a number of rounds that grows with the logarithm of its size. Only edges move;
each round is written to the shared folder, and the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stamina.llm.common import discard, staged

MAX_ROUNDS = 60


def _facts(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (node, root): root is the smallest node of the component; nodes that are roots have no row."""
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = staged(ordered, "edges")
    seen = _facts(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = (large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        then, now = now, staged(small, "edges")
        discard(then)
        facts = _facts(now)
        if facts == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = facts
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
