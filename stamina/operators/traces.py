"""Motion traces of many clips: smoothing, pulses, curvature, dose trends."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stamina.operators.intervals import interval_join
from stamina.operators.ordered import Ordered, haloed
from stamina.operators.quantiles import group_quantile

# Pulse detection constants and the finger dimension.
MIN_PEAK_PX, CROSSING, RISE_FLOOR, T90 = 5.0, 0.3, 0.05, 0.9
KEPT_GAP_S, PEAK_WINDOW_S, TAIL_S, ON_S, SMOOTH = 2.0, 5.5, 0.3, 5.0, 5
FPS, MM_PER_PX = 32.0, 0.075
FINGERS = [("UVRSE_plate", 1.806), ("UVRSE_strip", 1.557), ("CN9018_strip", 1.270), ("CN9018_plate", 1.120)]
BLOCK = 4096


def running_median(df: DataFrame, keys: list[str], frame: str, value: str, name: str, width: int = SMOOTH) -> DataFrame:
    """Centered running median over frames, shrinking at the ends, computed per block of frames."""
    half = width // 2
    h, part = haloed(df, keys, frame, BLOCK, half)
    cols = ", ".join(f"`{c}`" for c in part)
    med = F.expr(f"percentile(`{value}`, 0.5D) OVER (PARTITION BY {cols} ORDER BY `{frame}` "
                 f"ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)")
    return h.withColumn(name, med).where("__home").drop("__home", "__bucket")


def _kth(ranks: np.ndarray, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The ``k``-th smallest of ``ranks[start:end]`` for many frames at once, bit by bit: at each bit the values of a frame with a zero
    are counted from running counts, and the frame goes on among those or among the others. Work is rows x bits, whatever the frames."""
    out = np.zeros(len(k), np.int64)
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        one = (ranks >> bit & 1).astype(bool)
        zeros = np.r_[0, np.cumsum(~one)]
        before, upto = zeros[start], zeros[end]
        up = k >= upto - before
        k = np.where(up, k - (upto - before), k)
        start, end = np.where(up, zeros[-1] + start - before, before), np.where(up, zeros[-1] + end - upto, upto)
        out |= up.astype(np.int64) << bit
        ranks = np.r_[ranks[~one], ranks[one]]
    return out


def frame_medians(x: np.ndarray, y: np.ndarray, at: np.ndarray, half: float) -> np.ndarray:
    """Median of the ``y`` that are numbers with ``x`` within ``half`` of each ``at``; NaN where there is none."""
    order = np.argsort(x[~np.isnan(y)], kind="stable")
    x, y = x[~np.isnan(y)][order], y[~np.isnan(y)][order]
    values, ranks = np.unique(y, return_inverse=True)
    start, end = np.searchsorted(x, at - half, "left"), np.searchsorted(x, at + half, "right")
    some = end > start
    out, last = np.full(len(at), np.nan), (end - start)[some] - 1
    if some.any():
        low, high = (values[_kth(ranks, start[some], end[some], k)] for k in (last // 2, -(-last // 2)))
        out[some] = low + (high - low) * (last % 2) * 0.5
    return out


def rolling_median(df: DataFrame, keys: list[str], x: str, y: str, name: str, window: float) -> DataFrame:
    """Median of ``y`` within ``x`` +- window/2, per stretch of ``x`` with a halo.

    A task takes the rows of eight windows and their halo; its time is linear in them (times the bits of their number), also where all lie in one window.
    Rows without ``x`` have no median.
    """
    half, columns = window / 2, df.columns
    h, part = haloed(df, keys, x, 8 * window, half)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def medians(table: pa.Table) -> pa.Table:
        home = table.filter(table["__home"])
        xs, ys, at = (c.cast(pa.float64()).to_numpy() for c in (table[x], table[y], home[x]))
        found = frame_medians(xs[~np.isnan(xs)], ys[~np.isnan(xs)], at, half)
        return home.select(columns).append_column(name, pa.array(found, pa.float64(), from_pandas=True))

    return h.groupBy(*part).applyInArrow(medians, schema)


def dominant_direction(df: DataFrame, keys: list[str], order: list[str], dx: str, dy: str, name: str) -> DataFrame:
    """Displacement signed along the direction at the largest magnitude of the clip."""
    mag = F.hypot(dx, dy)
    o = Ordered(df, keys, order).total(__u=F.max_by(F.struct(F.col(dx).alias("x"), F.col(dy).alias("y")), mag), __m=F.max(mag))
    ok = F.col("__m") > 0
    ux = F.when(ok, F.col("__u.x") / F.col("__m")).otherwise(0.0)
    uy = F.when(ok, F.col("__u.y") / F.col("__m")).otherwise(1.0)
    return o.with_columns(**{name: F.col(dx) * ux + F.col(dy) * uy}).result().drop("__u", "__m")


def normal_displacement(df: DataFrame, keys: list[str], order: list[str], dx: str, dy: str,
                        ax: Column, ay: Column, name: str) -> DataFrame:
    """Displacement normal to the rest axis, oriented so that the larger excursion is positive."""
    length = F.hypot(ax, ay)
    ok = F.coalesce(length > 0, F.lit(False))
    nx, ny = F.when(ok, -ay / length).otherwise(0.0), F.when(ok, ax / length).otherwise(-1.0)
    v = F.col(dx) * nx + F.col(dy) * ny
    o = Ordered(df, keys, order).with_columns(__v=v).total(__hi=F.max("__v"), __lo=F.min("__v"))
    return (o.with_columns(**{name: F.when(F.col("__hi") < -F.col("__lo"), -F.col("__v")).otherwise(F.col("__v"))})
            .result().drop("__v", "__hi", "__lo"))


def _kept(crossings: DataFrame, keys: list[str], frame: str, gap: float, within: Ordered) -> DataFrame:
    """Drop crossings within ``gap`` of the last kept one.

    A crossing farther than the gap from its predecessor is always kept, so the rule only
    has to be followed inside chains of close crossings (a few frames each).
    """
    o = Ordered(crossings, keys, [frame], within=within).lag(__p=F.col(frame))
    fresh = F.col("__p").isNull() | (F.col(frame) - F.col("__p") > gap)
    chained = o.running_sum(__chain=F.when(fresh, 1).otherwise(0)).result()
    runs = chained.groupBy(*keys, "__chain").agg(F.array_sort(F.collect_list(frame)).alias("f"))
    keep = F.aggregate("f", F.array().cast(runs.schema["f"].dataType), lambda acc, f: F.when(
        (F.size(acc) == 0) | (f - F.element_at(acc, -1) > gap), F.concat(acc, F.array(f))).otherwise(acc))
    return runs.select(*keys, F.explode(keep).alias(frame))


def _measure(j: DataFrame, keys: list[str], frame: str, fps: float, within: Ordered) -> Ordered:
    """Shared part: rows of pulse windows with on, stop, lo, next known per row."""
    f, sm = F.col(frame), F.col("sm")
    tail = int(TAIL_S * fps)
    seg = (f >= F.col("on")) & (f < F.col("stop"))
    o = Ordered(j, keys, [frame], within=within).total(pk=F.max(F.when(seg, sm)))
    o = o.total(pk_i=F.min(F.when(seg & (sm == F.col("pk")), f)))
    o = o.total_median(base=F.when(F.col("in_base"), sm))
    o = o.total(sm_on=F.max(F.when(f == F.col("on"), sm)))
    o = o.with_columns(base=F.when(F.col("base_or_on"), F.coalesce("base", "sm_on")).otherwise(F.col("base")))
    o = o.total(t90=F.min(F.when((f >= F.col("on")) & (f <= F.col("pk_i")) & (
        sm - F.col("base") >= T90 * (F.col("pk") - F.col("base"))), f - F.col("on"))))
    turn = (f <= F.col("nxt")) & ((f - 1 <= F.col("pk_i")) | (F.col("psm") >= sm))
    o = o.total(walk=F.max(F.when(turn, f)))
    o = o.with_columns(nxt_on=F.when(F.col("walk_back"), F.coalesce("walk", "nxt")).otherwise(F.col("nxt")))
    low = F.greatest(F.col("pk_i") + 1, F.col("nxt_on") - tail)
    return o.total_median(res=F.when((f >= low) & (f < F.col("nxt_on")), sm))


def _measures(o: Ordered, keys: list[str]) -> DataFrame:
    return o.result().groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("on", "pk", "pk_i", "base", "t90", "res")])


def _pulse_rows(g: DataFrame, keys: list[str], fps: float) -> DataFrame:
    return g.select(
        *keys, F.round(F.col("on") / fps, 3).alias("onset_s"), F.round((F.col("pk_i") - F.col("on")) / fps, 2).alias("on_to_peak_s"),
        F.round("base", 1).alias("base_px"), F.round("pk", 1).alias("peak_px"), F.round(F.col("pk") - F.col("base"), 1).alias("amp_px"),
        F.round(F.col("t90") / fps, 2).alias("t90_s"), F.round("res", 1).alias("residual_px"),
        F.when(F.col("pk") > 0, F.round(1 - F.col("res") / F.col("pk"), 3)).alias("recovered_frac"))


def smooth(trace: DataFrame, keys: list[str], frame: str, disp: str) -> tuple[DataFrame, Ordered]:
    """Adds ``sm`` (running median), ``psm`` (its previous value), ``gmax`` and ``n_frames``; with the ordered rows behind it."""
    bare = Ordered(trace, keys, [frame])
    s = running_median(trace, keys, frame, disp, "sm")
    o = Ordered(s, keys, [frame], within=bare).lag(psm=F.col("sm")).total(gmax=F.max(disp), n_frames=F.max(frame))
    return o.result().withColumn("n_frames", F.col("n_frames") + 1), o


def pulse_measures(trace: DataFrame, keys: list[str], frame: str, disp: str, fps: float = FPS) -> DataFrame:
    """Unrounded pulses of every clip: on, peak, base, t90, residual. No clip is collected.

    Up-crossings of 30 % of the clip maximum, thinned to one per two seconds; every pulse
    then owns the frames around it and is measured by aggregates over them.
    """
    s, of = smooth(trace, keys, frame, disp)
    s = s.where(F.col("gmax") >= MIN_PEAK_PX)
    thr = CROSSING * F.col("gmax")
    ups = s.where((F.col("sm") >= thr) & (F.col("psm") < thr)).select(*keys, frame)
    k = Ordered(_kept(ups, keys, frame, KEPT_GAP_S * fps, of), keys, [frame], within=of)
    peak_w = int(PEAK_WINDOW_S * fps)
    k = k.lag(__p=F.col(frame)).lead(__n=F.col(frame)).result()
    lo = F.coalesce(F.col("__p") + peak_w, F.lit(0))
    win = k.select(*keys, F.col(frame).alias("cross"), lo.alias("lo"), F.col("__n").alias("next_cross"),
                   F.least(lo, F.col(frame)).cast("double").alias("w_lo"),
                   F.greatest(F.coalesce(F.col("__n") + 1, F.lit(2 ** 31 - 1)), F.col(frame) + peak_w).alias("w_hi"))
    ends = s.groupBy(*keys).agg(F.max("n_frames").alias("clip_end"))
    win = win.join(ends, keys).withColumn("w_hi", F.least("w_hi", "clip_end").cast("double")).drop("clip_end")
    cols = s.select(*keys, frame, "sm", "psm", "gmax", "n_frames")
    j = interval_join(cols, win, keys, frame, "w_lo", "w_hi", bucket=BLOCK)
    pk = [*keys, "cross"]
    f, sm = F.col(frame), F.col("sm")
    before = (f >= F.col("lo")) & (f < F.col("cross"))
    # a frame is in a pulse's window once, so a pulse has no more rows than its clip
    o = Ordered(j, pk, [frame], within=of).total(floor=F.min(F.when(before, sm)))
    o = o.total(__w=F.max(F.when(before & (sm <= F.col("floor") + RISE_FLOOR * F.col("gmax")), f)))
    o = o.with_columns(on=F.when(F.col("cross") > F.col("lo"), F.coalesce(F.col("__w") + 1, F.col("lo"))).otherwise(F.col("cross")))
    rows = o.result().withColumns({
        "stop": F.least(F.col("on") + peak_w, F.col("n_frames")), "nxt": F.coalesce("next_cross", "n_frames"),
        "walk_back": F.col("next_cross").isNotNull(), "base_or_on": F.lit(False),
        "in_base": (f >= F.greatest(F.col("lo"), F.col("on") - int(TAIL_S * fps))) & (f <= F.col("on"))})
    return _measures(_measure(rows, pk, frame, fps, of), pk)


def pulses(trace: DataFrame, keys: list[str], frame: str, disp: str, fps: float = FPS) -> DataFrame:
    """Pulses as reported: onset, base, peak, amplitude, t90, residual, recovered share."""
    return _pulse_rows(pulse_measures(trace, keys, frame, disp, fps), [*keys, "cross"], fps)


def windowed_measures(trace: DataFrame, onsets: DataFrame, keys: list[str], frame: str, disp: str,
                      fps: float = FPS, on_s: float = ON_S) -> DataFrame:
    """Unrounded pulse measures inside known drive windows [onset, onset + on_s)."""
    s, of = smooth(trace, keys, frame, disp)
    w = Ordered(onsets, keys, ["onset"]).lead(__n=F.col("onset")).result()
    start, tail = F.ceil(F.col("onset") * fps), int(TAIL_S * fps)
    nxt = F.ceil(F.col("__n") * fps)
    win = w.select(*keys, "onset", start.alias("on"), F.ceil((F.col("onset") + on_s) * fps).alias("off"), nxt.alias("nx"),
                   F.greatest(F.lit(0), start - tail).cast("double").alias("w_lo"))
    ends = s.groupBy(*keys).agg(F.max("n_frames").alias("end"))
    win = (win.join(ends, keys).withColumn("nxt", F.coalesce("nx", "end"))
           .withColumn("stop", F.least("off", "end"))
           .withColumn("w_hi", F.greatest("nxt", "stop").cast("double")).where("stop - on >= 3"))
    cols = s.select(*keys, frame, "sm", "psm")
    rows = interval_join(cols, win, keys, frame, "w_lo", "w_hi", bucket=BLOCK).withColumns({
        "walk_back": F.lit(False), "base_or_on": F.lit(True),
        "in_base": (F.col(frame) >= F.col("on") - tail) & (F.col(frame) < F.col("on"))})
    pk = [*keys, "onset"]
    return _measures(_measure(rows, pk, frame, fps, of), pk)


def windowed_pulses(trace: DataFrame, onsets: DataFrame, keys: list[str], frame: str, disp: str,
                    fps: float = FPS, on_s: float = ON_S) -> DataFrame:
    """Pulse measures inside known drive windows, rounded as reported."""
    return _pulse_rows(windowed_measures(trace, onsets, keys, frame, disp, fps, on_s), [*keys, "onset"], fps)


def clip_stats(p: DataFrame, keys: list[str]) -> DataFrame:
    """Pulse count, mean peak and the attributes of the first pulse."""
    first = F.min_by(F.struct("peak_px", "t90_s", "residual_px", "recovered_frac"), "onset_s")
    return (p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bends"), F.avg("peak_px").alias("peak_px"), first.alias("f"))
            .select(*keys, "n_bends", "peak_px", F.col("f.peak_px").alias("peak1_px"), F.col("f.t90_s").alias("t90_1_s"),
                    F.col("f.residual_px").alias("residual_1_px"), F.col("f.recovered_frac").alias("recovered_1")))


def summarize(trace: DataFrame, p: DataFrame, keys: list[str], disp: str) -> DataFrame:
    """One row per clip: extremes, pulse count, first three peaks as columns."""
    from pyspark.sql import Window
    peaks = (p.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("onset_s")))
             .where("k <= 3").groupBy(*keys).agg(*[F.max(F.when(F.col("k") == i, F.col("peak_px"))).alias(f"peak{i}_px") for i in (1, 2, 3)]))
    base = trace.groupBy(*keys).agg(F.round(F.max(F.abs(disp)), 1).alias("max_disp_px"), F.round(F.min(disp), 3).alias("min_reach"))
    s = clip_stats(p, keys).drop("peak1_px").withColumn("peak_mean_px", F.round("peak_px", 1)).drop("peak_px")
    return base.join(s, keys, "left").join(peaks, keys, "left").withColumn("n_bends", F.coalesce("n_bends", F.lit(0)))


def series_label(clips: DataFrame, ts: str, name: str) -> DataFrame:
    """'B' when the next clip starts exactly one second later, else 'A'.

    The next clip in time order is one second later when this is the last clip of its
    second and some clip starts in the next second: two joins on the second, no global sort.
    """
    sec = clips.withColumn("__s", F.unix_seconds(F.col(ts).cast("timestamp")))
    per = sec.groupBy("__s").agg(F.max(name).alias("__last"))
    follow = per.select((F.col("__s") - 1).alias("__s"), F.lit(True).alias("__next"))
    j = sec.join(per.join(follow, "__s", "left"), "__s")
    b = F.coalesce(F.col("__next"), F.lit(False)) & (F.col(name) == F.col("__last"))
    return j.withColumn("series", F.when(b, "B").otherwise("A")).drop("__s", "__last", "__next")


def select_clips(labelled: DataFrame, ts: str, name: str, dense_h: float = 165.0, every: dict | None = None) -> DataFrame:
    """Series A: all within ``dense_h`` hours, then every 15th; series B: every 5th.

    Hours count from the first clip; restrict ``labelled`` to the campaign beforehand.
    """
    step = every or {"A": 15, "B": 5}
    sec = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    start = labelled.agg(F.min(sec).alias("v")).scalar()
    d = labelled.withColumn("t_h", (sec - start) / 3600.0)
    o = Ordered(d, ["series"], [ts, name]).row_number("__k").result()
    i = F.col("__k") - 1
    keep = F.when(F.col("series") == "A", (F.col("t_h") <= dense_h) | (i % step["A"] == 0)).otherwise(i % step["B"] == 0)
    return o.where(keep).withColumn("t_h", F.round("t_h", 4)).drop("__k")


def binned_medians(df: DataFrame, keys: list[str], x: str, width: float, metrics: dict[str, Column]) -> DataFrame:
    """Medians per fixed-width bin of ``x``; missing values are skipped."""
    b = df.withColumn("bin_lo", F.floor(F.col(x) / width) * width)
    n = b.groupBy(*keys, "bin_lo").agg(F.count(F.lit(1)).alias("n"))
    clean = {k: F.when(~F.isnan(v), v) for k, v in metrics.items()}
    return n.join(group_quantile(b, [*keys, "bin_lo"], clean), [*keys, "bin_lo"], "left")


def with_dose(df: DataFrame, finger: str, hours: str) -> DataFrame:
    """Dose of each finger from its fixed rate and the hours since the first clip."""
    dim = df.sparkSession.createDataFrame(FINGERS, f"{finger} string, rate_gy_h double")
    return df.join(F.broadcast(dim), finger).withColumn("dose_gy", F.round(F.col("rate_gy_h") * F.col(hours), 2))


def arc_length(nodes: DataFrame, keys: list[str], order: str) -> Ordered:
    """Running arc length ``s``, and ``s_next``, the next node, and the total ``s_all``."""
    o = Ordered(nodes, keys, [order]).lag(__px=F.col("x"), __py=F.col("y"))
    step = F.coalesce(F.hypot(F.col("x") - F.col("__px"), F.col("y") - F.col("__py")), F.lit(0.0))
    o = o.running_sum(s=step).lead(s_next=F.col("s"), x_next=F.col("x"), y_next=F.col("y")).total(s_all=F.max("s"))
    o.drop("__px", "__py")
    return o


def resample(nodes: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """``n`` equally spaced stations along each polyline; each segment emits its own stations."""
    d = arc_length(nodes, keys, order).result().where("s_all > 0")
    gap = F.col("s_all") / (n - 1)
    first = F.ceil(F.round(F.col("s") / gap, 9))
    after = F.when(F.col("s_next").isNull(), F.lit(n)).otherwise(F.ceil(F.round(F.col("s_next") / gap, 9)))
    # a closing node only serves a last station that no segment reached
    d = d.withColumn("k", F.explode(F.when(after > first, F.sequence(first, after - 1)).otherwise(F.array().cast("array<bigint>"))))
    u = F.when(F.col("s_next") > F.col("s"), (F.col("k") * gap - F.col("s")) / (F.col("s_next") - F.col("s"))).otherwise(0.0)
    return d.select(*keys, F.col("k").alias("station"), (F.col("x") + u * (F.coalesce("x_next", "x") - F.col("x"))).alias("x"),
                    (F.col("y") + u * (F.coalesce("y_next", "y") - F.col("y"))).alias("y"))


def point_at(nodes: DataFrame, keys: list[str], order: str, arc: float) -> DataFrame:
    """The point at an arc length, clamped to the traced arc, and the reached share of it."""
    d = arc_length(nodes, keys, order).result()
    at = F.least(F.greatest(F.lit(arc), F.lit(0.0)), F.col("s_all"))
    hit = d.where((F.col("s") <= at) & (at < F.col("s_next")) | F.col("s_next").isNull() & (at >= F.col("s")))
    u = F.coalesce(F.try_divide(at - F.col("s"), F.col("s_next") - F.col("s")), F.lit(0.0))
    return hit.groupBy(*keys).agg(
        F.max_by(F.col("x") + u * (F.coalesce("x_next", "x") - F.col("x")), order).alias("x"),
        F.max_by(F.col("y") + u * (F.coalesce("y_next", "y") - F.col("y")), order).alias("y"),
        F.max(F.col("s_all") / arc).alias("reach"))


def curvature(nodes: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Tangent angle, its windowed mean over 15 % of ``n`` nodes, and curvature per node."""
    o = arc_length(nodes, keys, order).lag(xp=F.col("x"), yp=F.col("y"))
    xn, yn = F.coalesce("x_next", "x"), F.coalesce("y_next", "y")
    dy, dx = yn - F.coalesce("yp", "y"), xn - F.coalesce("xp", "x")
    theta = F.coalesce(F.atan(F.try_divide(dy, dx)), F.atan2(dy, dx))
    d = o.with_columns(theta=theta).result().drop("xp", "yp", "x_next", "y_next")
    win = max(5, int(0.15 * n)) | 1
    h, part = haloed(d, keys, order, BLOCK, win // 2)
    cols = ", ".join(f"`{c}`" for c in part)
    mean = F.expr(f"avg(theta) OVER (PARTITION BY {cols} ORDER BY `{order}` ROWS BETWEEN {win // 2} PRECEDING AND {win // 2} FOLLOWING)")
    sm = h.withColumn("theta_sm", mean).where("__home").drop("__home", "__bucket")
    g = Ordered(sm, keys, [order]).lag(sp=F.col("s"), tp=F.col("theta_sm")).lead(tn=F.col("theta_sm"))
    hs, hd = F.col("s") - F.col("sp"), F.col("s_next") - F.col("s")
    t = F.col("theta_sm")
    inner = F.try_divide(hs * hs * F.col("tn") + (hd * hd - hs * hs) * t - hd * hd * F.col("tp"), hs * hd * (hs + hd))
    return g.with_columns(kappa=F.coalesce(inner, F.try_divide(F.col("tn") - t, hd), F.try_divide(t - F.col("tp"), hs))).result().drop("sp", "tp", "tn", "s_next")


def bend_summary(curved: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Interior curvature, and the bend angle from line fits near both ends, extrapolated."""
    skip, win = 0.1 * F.col("s_all"), 0.3 * F.col("s_all")
    edge = max(1, int(0.1 * n))
    inner = F.when((F.col(order) >= edge) & (F.col(order) < n - edge), F.col("kappa"))
    root = (F.col("s") >= skip) & (F.col("s") <= skip + win)
    tip = (F.col("s") >= F.col("s_all") - skip - win) & (F.col("s") <= F.col("s_all") - skip)

    def sel(c, cond):
        return F.when(cond, F.col(c))
    g = curved.groupBy(*keys).agg(
        F.avg(inner).alias("kappa_mean"), F.max(F.abs(inner)).alias("kappa_max"), F.max("s_all").alias("arc_len"),
        F.regr_intercept(sel("theta", root), sel("s", root)).alias("root_angle"),
        F.regr_slope(sel("theta", tip), sel("s", tip)).alias("ta"), F.regr_intercept(sel("theta", tip), sel("s", tip)).alias("tb"),
        F.max_by("x", order).alias("tip_x"), F.max_by("y", order).alias("tip_y"))
    angle = (F.col("ta") * F.col("arc_len") + F.col("tb") - F.col("root_angle")) * 180 / math.pi
    return g.select(*keys, "kappa_mean", "kappa_max", "arc_len", "root_angle", angle.alias("bend_angle_deg"), "tip_x", "tip_y")


def tip_offset(bends: DataFrame, rest: DataFrame, key: str, sign: float = 1.0) -> DataFrame:
    """Tip displacement perpendicular to the root tangent of the rest frame of the same key."""
    r = rest.select(key, F.col("root_angle").alias("ra"), F.col("tip_x").alias("rx"), F.col("tip_y").alias("ry"))
    off = sign * ((F.col("tip_x") - F.col("rx")) * -F.sin("ra") + (F.col("tip_y") - F.col("ry")) * F.cos("ra"))
    return bends.join(r, key).withColumn("tip_offset", off).drop("ra", "rx", "ry")
