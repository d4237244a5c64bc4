import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stamina.functions.text import clip_time
from stamina.operators import expand as E
from stamina.operators import scale as C
from stamina.operators import traces as T


FPS = 32


def staircase(holds, seconds=40.0, rise=0.5, fall=0.9):
    """A first-order lag that follows (start, length, height) holds; own time constants up and down."""
    n = int(seconds * FPS)
    goal = np.zeros(n)
    for start, length, height in holds:
        goal[int(start * FPS):int((start + length) * FPS)] = height
    out, level = np.zeros(n), 0.0
    for i, g in enumerate(goal):
        level += (g - level) / (FPS * (rise if g > level else fall))
        out[i] = level
    return out


def test_pulses_of_unequal_height(spark):
    holds = [(5.5, 6.0, 48.0), (21.0, 6.0, 80.0)]
    clean = staircase(holds)
    noise = np.random.default_rng(77)
    rows = [("two", i, float(x)) for i, x in enumerate(clean + noise.uniform(-0.4, 0.4, len(clean)))]
    rows += [("quiet", i, float(x)) for i, x in enumerate(noise.uniform(-1.5, 1.5, 1000))]
    df = spark.createDataFrame(rows, "clip string, frame int, disp double")
    found = T.pulses(df, ["clip"], "frame", "disp").orderBy("onset_s").collect()
    assert [r.clip for r in found] == ["two", "two"]
    for r, (start, length, _) in zip(found, holds):
        inside = clean[int(start * FPS):int((start + length) * FPS) + 1]
        # the onset is where the motion has begun, the peak what the clean curve reaches
        assert start - 0.25 < r.onset_s < start + 0.4
        assert abs(r.peak_px - inside.max()) < 0.05 * inside.max()
        assert abs(r.t90_s - np.argmax(inside >= 0.9 * inside.max()) / FPS) < 0.3
    onsets = spark.createDataFrame([("two", r.onset_s) for r in found], "clip string, onset double")
    again = T.windowed_pulses(df, onsets, ["clip"], "frame", "disp").orderBy("onset_s").collect()
    assert [round(r.peak_px) for r in again] == [round(r.peak_px) for r in found]


def test_series_and_sampling(spark):
    start, gap, dense_h = dt.datetime(2023, 4, 2, 6, 30), 90, 2.0
    regular = [start + dt.timedelta(seconds=gap * i) for i in range(200)]
    doubled = [regular[i] - dt.timedelta(seconds=1) for i in range(40, 200, 9)]       # a second camera, one second ahead
    df = spark.createDataFrame([(f"actuation_{x:%Y%m%d_%H%M%S}.h264",) for x in regular + doubled], "name string")
    df = df.withColumn("ts", clip_time(F.col("name")))
    labelled = T.series_label(df, "ts", "name")
    assert labelled.where("series = 'B'").count() == len(doubled)
    kept = T.select_clips(labelled, "ts", "name", dense_h, {"A": 7, "B": 4})
    n = {r.series: r["count"] for r in kept.groupBy("series").count().collect()}
    late = [i for i in range(200) if gap * i > dense_h * 3600 and i % 7]
    assert n == {"A": 200 - len(late), "B": len(doubled[::4])}


def test_circle_and_photometric_fit(spark):
    rng = np.random.default_rng(5)
    th = np.linspace(0, 2 * np.pi, 90, endpoint=False)
    r = 40 + rng.normal(0, .2, 90)
    r[:6] += 25
    rows = [("c", i, float(100 + a * math.cos(t)), float(80 + a * math.sin(t))) for i, (a, t) in enumerate(zip(r, th))]
    f = C.circle_fit(spark.createDataFrame(rows, "g string, i int, x double, y double"), ["g"], ["i"]).first()
    assert (f.cx, f.cy, f.r) == pytest.approx((100, 80, 40), abs=0.3) and f.kept < 90
    base = rng.normal(120, 30, 3000)
    img = 0.75 * base + 20
    img[:150] += 60
    to = lambda v: spark.createDataFrame([("g", float(x)) for x in v], "g string, v double")
    p = C.photometric_fit(to(base), to(img), ["g"], "v").first()
    x, y = (np.quantile(v, (2 + 2 * np.arange(49)) / 100) for v in (base, img))
    keep = np.ones(49, bool)
    for _ in range(3):
        a, b = np.polyfit(x[keep], y[keep], 1)
        e = np.abs(a * x + b - y)
        nxt = e <= max(np.quantile(e, 0.67), 1e-6)
        if nxt.sum() >= 8:
            keep = nxt
    assert (p.gain, p.offset) == pytest.approx((a, b), rel=1e-6) and abs(p.gain - 0.75) < 0.06


def test_timeline_and_level_generators(spark):
    one = spark.range(1)
    lv = one.select(E.levels(F.lit(0.0), F.lit(1.0), F.lit(0.25), F.lit(None).cast("int")).alias("a"),
                    E.levels(F.lit(0.0), F.lit(1.0), F.lit(None).cast("double"), F.lit(3)).alias("b")).first()
    assert lv.a == [0.0, .25, .5, .75, 1.0] and lv.b == [0.0, .5, 1.0]
    p = one.select(F.lit(1).alias("id"), F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)).alias("levels"), F.lit(True).alias("updown"), F.lit(1).alias("repeat"),
                   F.lit(5.0).alias("ramp_s"), F.lit(60.0).alias("landing_s"), F.lit(True).alias("baseline"), F.lit(2.0).alias("warmup_s"))
    st = E.staircase_steps(p, ["id"])
    assert [r.kv for r in st.orderBy("step").collect()] == [1.0, 2.0, 1.0]
    pts = spark.createDataFrame([(1, float(t)) for t in (-1, 1, 4.5, 30, 69.5, 400)], "id int, t double")
    kv = {r.t: r.kv_at for r in E.commanded_level(pts, E.segments(st, ["id"]), ["id"], "t").collect()}
    assert kv == pytest.approx({-1: 0, 1: 0, 4.5: .5, 30: 1, 69.5: 1.5, 400: 1})


def test_frame_medians_equal_numpy():
    rng = np.random.default_rng(2)
    for n, spread in ((0, 1.0), (1, 1.0), (300, 5.0), (400, 0.0), (2000, 50.0)):
        x, y = np.round(rng.random(n) * spread, 2), np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 30, n).astype(float))
        got = T.frame_medians(x, y, x, 1.25)
        for xi, g in zip(x, got):
            own = y[(x >= xi - 1.25) & (x <= xi + 1.25) & ~np.isnan(y)]
            assert (len(own) == 0 and np.isnan(g)) or g == np.median(own)


def test_rolling_median_of_one_hot_window_is_linear(spark):
    """300,000 rows in one window: with a frame per row this would be 10^11 steps."""
    df = spark.range(300_000).select(F.lit(1).alias("k"), (F.col("id") % 1000 / 1000.0).alias("x"), (F.col("id") * 7919 % 300_007).cast("double").alias("y"))
    out = T.rolling_median(df, ["k"], "x", "y", "med", 4.0)
    assert out.columns == ["k", "x", "y", "med"] and out.count() == 300_000
    assert [r[0] for r in out.select("med").distinct().collect()] == [float(np.median(np.arange(300_000) * 7919 % 300_007))]


def test_commanded_level_sorts_no_segments_for_the_last_level(spark):
    segs = spark.createDataFrame([(1, "ramp", 0.0, 5.0, 0.0, 2.0), (1, "hold", 5.0, 9.0, 2.0, 2.0), (1, "hold", 9.0, 9.0, 7.0, 7.0),
                                  (2, "hold", 0.0, 4.0, 3.0, 3.0), (2, "hold", 2.0, 2.0, 8.0, 8.0)],
                                 "id int, kind string, t0 double, t1 double, from_kv double, to_kv double")
    pts = spark.createDataFrame([(1, 2.5), (1, 8.0), (1, 9.0), (1, 50.0), (2, 3.0), (2, 4.0), (2, -1.0)], "id int, t double")
    out = E.commanded_level(pts, segs, ["id"], "t")
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.t): r.kv_at for r in out.collect()}
    assert got == {(1, 2.5): 1.0, (1, 8.0): 2.0, (1, 9.0): 7.0, (1, 50.0): 7.0, (2, 3.0): 3.0, (2, 4.0): 3.0, (2, -1.0): 0.0}
