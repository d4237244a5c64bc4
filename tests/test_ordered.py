"""Segmented computation equals plain loops, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stamina.operators.intervals import asof_join, interval_join
from stamina.operators.ordered import Ordered, find_hot, haloed
from stamina.operators.quantiles import group_quantile, group_quantile_grid


def rows_of(seed, n=90):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else rng.choice("abc")
        out.append((key, i, float(i) + rng.random() * 0.5, rng.choice([None, 1.0, 2.0, 5.0]), rng.random() < 0.4))
    return out


def by_key(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: r[2]) for k, v in groups.items()}


@pytest.mark.parametrize("seed", [1])
def test_scans_equal_loops(spark, segment, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "k string, id int, t double, v double, flag boolean")
    o = (Ordered(df, ["k"], ["t", "id"]).row_number("rn").running_sum(total=F.col("v"))
         .last(lastv=F.col("v")).last(False, before=F.col("v")).lag(pv=F.col("v")).lead(nv=F.col("v"))
         .since("since", F.col("flag"), ~F.col("flag") & F.col("v").isNotNull(), F.col("t"))
         .total(n=F.count(F.lit(1)), top=F.max("v")).total_median(med=F.col("v")))
    got = {r.id: r for r in o.result().collect()}
    for group in by_key(rows).values():
        total, last, since = 0.0, None, None
        vals = [r[3] for r in group if r[3] is not None]
        for i, (_, ident, t, v, flag) in enumerate(group):
            g = got[ident]
            assert g.before == last
            total += v or 0.0
            last = v if v is not None else last
            if flag:
                since = t if since is None else since
            elif v is not None:
                since = None
            assert (g.rn, g.total, g.lastv, g.since) == (i + 1, total, last, since)
            assert g.pv == (group[i - 1][3] if i else None)
            assert g.nv == (group[i + 1][3] if i + 1 < len(group) else None)
            assert (g.n, g.top) == (len(group), max(vals))
            assert g.med == pytest.approx(np.median(vals))


def test_hot_keys_are_found_and_segmented(spark):
    spark.conf.set("stamina.rowsPerSegment", "5")
    try:
        df = spark.createDataFrame(rows_of(3), "k string, id int, t double, v double, flag boolean")
        hot = find_hot(df, ["k"])
        assert "hot" in {r.k for r in hot.collect()}
        o = Ordered(df, ["k"], ["t", "id"])
        sizes = o.warm.groupBy("__seg").count().collect()
        assert len(sizes) > 5 and max(r["count"] for r in sizes) <= 12
    finally:
        spark.conf.unset("stamina.rowsPerSegment")


def test_quantiles_equal_numpy(spark, segment):
    rows = rows_of(4)
    df = spark.createDataFrame(rows, "k string, id int, t double, v double, flag boolean")
    grid = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    med = {r.k: r.m for r in group_quantile(df, ["k"], {"m": F.col("t")}).collect()}
    q = {(r.k, r.p): r.q for r in group_quantile_grid(df, ["k"], F.col("t"), grid, "q").collect()}
    for k, g in by_key(rows).items():
        t = [r[2] for r in g]
        assert med[k] == pytest.approx(np.median(t))
        for p in grid:
            assert q[k, p] == pytest.approx(np.quantile(t, p))


def test_asof_and_interval_join(spark, segment):
    rows = rows_of(5)
    df = spark.createDataFrame(rows, "k string, id int, t double, v double, flag boolean")
    left, right = df.where("not flag"), df.where("flag")
    got = {r.id: r.hit for r in asof_join(left, right, ["k"], "t", {"hit": F.col("id")}, ["id"]).collect()}
    spans = right.select("k", F.col("id").alias("span"), F.col("t").alias("lo"), (F.col("t") + 7).alias("hi"))
    pairs = {(r.id, r.span) for r in interval_join(left, spans, ["k"], "t", "lo", "hi", bucket=3.0).collect()}
    want = set()
    for g in by_key(rows).values():
        for r in (x for x in g if not x[4]):
            before = [x for x in g if x[4] and x[2] <= r[2]]
            assert got[r[1]] == (before[-1][1] if before else None)
            want |= {(r[1], x[1]) for x in g if x[4] and x[2] <= r[2] < x[2] + 7}
    assert pairs == want


def test_halo_keeps_every_row_once(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 0.5)
    h, keys = haloed(df, [], "x", 4.0, 1.0)
    assert h.where("__home").count() == 100
    assert h.count() > 100
