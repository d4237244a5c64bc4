"""Row generators: level staircases, timelines, plan flattening, chunks, waveforms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stamina.functions.text import circular_resample  # noqa: F401  (part of the waveform family)
from stamina.operators.intervals import asof_join

# Staircase timing defaults in seconds, burst margin and chunk size.
RAMP_S, LANDING_S, SETTLE_S, LEAD_S, WARMUP_S = 5.0, 60.0, 2.0, 1.0, 2.0
CHUNK = 1000


def levels(start: Column, end: Column, step: Column, n_steps: Column) -> Column:
    """Array of levels: by a positive step (last not past the end), else by count, else null."""
    n = F.floor(F.abs(end - start) / step + 1e-9).cast("int")
    sign = F.when(end >= start, 1.0).otherwise(-1.0)
    by_step = F.transform(F.sequence(F.lit(0), n), lambda i: F.round(start + sign * i * step, 6))
    by_count = F.when(n_steps == 1, F.array(end)).otherwise(F.transform(
        F.sequence(F.lit(0), (n_steps - 1).cast("int")), lambda i: F.round(start + (end - start) * i / (n_steps - 1), 6)))
    return F.when(step > 0, by_step).when(n_steps >= 1, by_count)


def stepped_range(start: Column, stop: Column, step: Column) -> Column:
    """Inclusive stepped range; null when the step does not lead from start to stop."""
    n = F.floor((stop - start) / step + 1e-9).cast("int")
    ok = (step != 0) & ((stop > start) == (step > 0))
    return F.when((stop == start) & (step != 0), F.array(start)).when(ok, F.transform(
        F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: start + i * step))


def staircase_sequence(lv: Column, updown: Column, repeat: Column) -> Column:
    """Landing levels in order: a leading 0 dropped, mirrored down, repeated."""
    lead = F.when(F.abs(F.get(lv, F.lit(0))) < 1e-9, F.slice(lv, 2, F.greatest(F.size(lv) - 1, F.lit(0)))).otherwise(lv)
    down = F.reverse(F.slice(lead, 1, F.greatest(F.size(lead) - 1, F.lit(0))))
    one = F.when(updown & (F.size(lead) > 1), F.concat(lead, down)).otherwise(lead)
    return F.flatten(F.array_repeat(one, F.greatest(repeat, F.lit(1)).cast("int")))


def staircase_steps(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """One row per landing with closed-form times.

    ``profiles``: levels, updown, repeat, ramp_s, landing_s, baseline, warmup_s. Step k
    starts at t0 + k (ramp + landing), so no row depends on another.
    """
    seq = staircase_sequence(F.col("levels"), F.col("updown"), F.col("repeat"))
    t0 = F.when(F.col("baseline"), F.greatest("warmup_s", F.lit(0.0))).otherwise(0.0)
    d = profiles.withColumn("__seq", seq).withColumn("__t0", t0).select("*", F.posexplode("__seq").alias("k", "kv"))
    start = F.col("__t0") + F.col("k") * (F.col("ramp_s") + F.col("landing_s"))
    prev = F.when(F.col("k") > 0, F.get("__seq", F.col("k") - 1)).otherwise(0.0)
    return (d.withColumns({"step": (F.col("k") + 1).cast("bigint"), "from_kv": prev, "t_start": start})
            .drop("__seq", "k", "levels"))


def segments(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Ramp and hold segments (t0, t1, from_kv, to_kv)."""
    mid = F.col("t_start") + F.col("ramp_s")
    two = F.array(F.struct(F.lit("ramp").alias("kind"), F.col("t_start").alias("t0"), mid.alias("t1"), F.col("from_kv").alias("a"), F.col("kv").alias("b")),
                  F.struct(F.lit("hold").alias("kind"), mid.alias("t0"), (mid + F.col("landing_s")).alias("t1"), F.col("kv").alias("a"), F.col("kv").alias("b")))
    return (steps.select(*keys, "step", F.explode(two).alias("s"))
            .select(*keys, "step", "s.kind", "s.t0", "s.t1", F.col("s.a").alias("from_kv"), F.col("s.b").alias("to_kv")))


def snapshot_plan(profiles: DataFrame, steps: DataFrame, keys: list[str], settle_s: float = SETTLE_S, lead_s: float = LEAD_S) -> DataFrame:
    """Warm-up, baseline, post-ramp and pre-ramp captures with their times."""
    warm = F.greatest("warmup_s", F.lit(0.0))
    at_rest = F.array_compact(F.array(
        F.when(warm > 0, F.struct(F.lit(0.0).alias("t"), F.lit("warmup").alias("tag"))),
        F.struct(warm.alias("t"), F.lit("baseline").alias("tag"))))
    rest = (profiles.where("baseline").select(*keys, F.explode(at_rest).alias("s"))
            .select(*keys, F.col("s.t").alias("t"), F.lit(0).cast("bigint").alias("step"), F.lit(0.0).alias("kv"), F.col("s.tag").alias("tag")))
    end = F.col("t_start") + F.col("ramp_s")
    pair = F.array(F.struct((end + settle_s).alias("t"), F.lit("post-ramp").alias("tag")),
                   F.struct((end + F.col("landing_s") - lead_s).alias("t"), F.lit("pre-ramp").alias("tag")))
    return rest.unionByName(steps.select(*keys, "step", "kv", F.explode(pair).alias("s"))
                            .select(*keys, F.col("s.t").alias("t"), "step", "kv", F.col("s.tag").alias("tag")))


def commanded_level(points: DataFrame, segs: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Commanded kV at each time: 0 before the first segment, linear in ramps, last level after the end.

    Segments of a key do not overlap, so the one a time lies in is the last that begins by then. Where one without length stands at the
    end, its level is the last. Single numbers as orderings let Spark aggregate by hash: a struct would sort all segments of a task.
    """
    long, at = F.col("t1") > F.col("t0"), F.col("t1")
    ends = segs.groupBy(*keys).agg(
        F.max("t1").alias("__end"), F.max_by("to_kv", F.when(long, at)).alias("__final"),
        F.max(F.when(~long, at)).alias("__point"), F.max_by("to_kv", F.when(~long, at)).alias("__point_kv"))
    ends = ends.select(*keys, "__end", F.when(F.col("__point") == F.col("__end"), F.col("__point_kv")).otherwise(F.col("__final")).alias("__final"))
    begun = segs.where("t1 > t0").select(*keys, F.col("t0").alias(t), F.struct("kind", "t0", "t1", "from_kv", "to_kv").alias("__seg_box"))
    j = asof_join(points, begun, keys, t, {"__s": F.col("__seg_box")}, [])
    s = F.col("__s")
    u = (F.col(t) - s["t0"]) / (s["t1"] - s["t0"])
    inside = F.when(s["kind"] == "hold", s["to_kv"]).otherwise(s["from_kv"] + (s["to_kv"] - s["from_kv"]) * u)
    out = j.join(ends, keys)
    return out.withColumn("kv_at", F.when((F.col(t) < s["t1"]) & (F.col(t) > 0), inside).when(
        F.col(t) >= F.col("__end"), F.col("__final")).otherwise(0.0)).drop("__s", "__end", "__final")


def flatten_plan(plan: DataFrame, keys: list[str]) -> DataFrame:
    """Block instances of nested loops in execution order with their loop path.

    ``plan``: one row per leaf block with outer/inner loop positions and repeats (null
    where not nested), and its own position. Order follows the tuple of positions.
    """
    one = F.lit(1)
    d = plan.withColumn("__o", F.explode(F.sequence(one, F.coalesce("outer_repeat", one))))
    d = d.withColumn("__i", F.explode(F.sequence(one, F.coalesce("inner_repeat", one))))
    tag = lambda pos, it, rep: F.when(F.col(rep).isNotNull(), F.concat(F.col(pos), F.lit("["), F.col(it), F.lit("/"), F.col(rep), F.lit("].")))
    path = F.concat(F.coalesce(tag("outer_pos", "__o", "outer_repeat"), F.lit("")), F.coalesce(tag("inner_pos", "__i", "inner_repeat"), F.lit("")), F.col("pos"))
    order = F.struct(F.coalesce("outer_pos", "pos").alias("a"), F.when(F.col("outer_pos").isNotNull(), F.col("__o")).alias("b"),
                     F.coalesce("inner_pos", "pos").alias("c"), F.when(F.col("inner_pos").isNotNull(), F.col("__i")).alias("d"), F.col("pos").alias("e"))
    return d.withColumn("loop_path", path).withColumn("exec_order", order).drop("__o", "__i")


def resolve_blocks(blocks: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with inherited defaults and concrete end levels."""
    j = blocks.join(defaults.select(*keys, F.col("waveform").alias("__w"), F.col("freq_hz").alias("__f"), F.col("v_pk_kv").alias("__v"),
                                    F.col("v_min_kv").alias("__m")), keys, "left")
    return j.withColumns({
        "waveform": F.coalesce("waveform", "__w"), "freq_hz": F.coalesce("freq_hz", "__f"), "v_pk_kv": F.coalesce("v_pk_kv", "__v"),
        "v_min_kv": F.coalesce("v_min_kv", "__m", F.lit(0.0)),
        "end_kv": F.coalesce("end_kv", F.round(F.col("fraction_of_vpk") * F.col("__v"), 4))}).drop("__w", "__f", "__v", "__m")


def chunks(blocks: DataFrame, cycles: str, freq: str, size: int = CHUNK, hw_max: int | None = None) -> DataFrame:
    """Burst chunks of at most ``size`` cycles with their nominal duration."""
    s = min(size, hw_max) if hw_max else size
    n = F.col(cycles)
    d = blocks.where(n > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / s) - 1)))
    c = F.least(F.lit(s).cast("bigint"), n - F.col("chunk") * s)
    return d.withColumn("chunk_cycles", c).withColumn("expected_s", F.col("chunk_cycles") / F.col(freq) + 0.5 + 2 / F.col(freq))


def unit_sample(waveform: Column, t: Column, duty: Column, sym: Column, rise: Column, fall: Column) -> Column:
    """One sample in [-1, 1] at phase t in [0, 1)."""
    high = F.greatest(duty, F.lit(1e-6))
    r = F.least(F.greatest(rise, F.lit(0.0)), high / 2)
    f = F.least(F.greatest(fall, F.lit(0.0)), high / 2)
    ramp = (F.when(sym <= 0, 1 - 2 * t).when(sym >= 1, 2 * t - 1).when(t < sym, 2 * F.try_divide(t, sym) - 1)
            .otherwise(1 - 2 * F.try_divide(t - sym, 1 - sym)))
    pulse = (F.when(t < r, 2 * F.try_divide(t, r) - 1).when(t < high - f, 1.0)
             .when(t < high, F.coalesce(1 - 2 * F.try_divide(t - (high - f), f), F.lit(1.0))).otherwise(-1.0))
    return (F.when(waveform == "SINE", F.sin(2 * math.pi * t)).when(waveform == "SQUARE", F.when(t < duty, 1.0).otherwise(-1.0))
            .when(waveform == "RAMP", ramp).when(waveform == "PULSE", pulse).otherwise(0.0))


def waveform_samples(specs: DataFrame, periods: int, points: int) -> DataFrame:
    """Samples of every spec: waveform, duty_pct, sym_pct, rise, fall, phase_deg, samples (for ARB)."""
    n = max(1, periods) * max(2, points)
    d = specs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    t = (F.col("i") / points + F.pmod(F.col("phase_deg") / 360.0, F.lit(1.0))) % 1.0
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(100.0)) / 100.0
    shape = unit_sample(F.upper("waveform"), t, clip("duty_pct"), clip("sym_pct"), F.col("rise"), F.col("fall"))
    peak = F.array_max(F.transform("samples", lambda s: F.abs(s)))
    arb = F.get("samples", F.floor(t * F.size("samples")).cast("int") % F.size("samples")) / F.when(peak == 0, 1.0).otherwise(peak)
    w = F.upper("waveform")
    return d.withColumn("y", F.when(w == "ARB", F.coalesce(arb, F.lit(0.0))).when(w == "NOISE", F.rand(0) * 2 - 1).otherwise(shape))


def capture_schedule(explicit: Column, start: Column, interval: Column, count: Column) -> Column:
    """Sorted distinct delays from a list, else start + i * interval; null when invalid."""
    regular = F.when((count >= 1) & ((count == 1) | (interval > 0)), F.transform(
        F.sequence(F.lit(0), F.greatest(count, F.lit(1)).cast("int") - 1), lambda i: start + i * interval))
    v = F.coalesce(explicit, regular)
    return F.when(~F.exists(v, lambda x: x < 0), F.array_sort(F.array_distinct(v)))
