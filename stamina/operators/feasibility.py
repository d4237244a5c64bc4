"""Drive feasibility, duration estimates and required-life factors as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Amplifier limits and budget fractions.
I_LIMIT_UA, SLEW_V_PER_US, BANDWIDTH_HZ = 2000.0, 35.0, 1200.0
WARN, REFUSE = 0.60, 0.90
EDGE_WARN, EDGE_REFUSE = 0.05, 0.25
LEAK_MARGIN_UA = 50.0
# Tier upper edges and factors of the piecewise life-test convention.
GROUND_TIERS = [(1e3, 4.0), (1e5, 2.0), (float("inf"), 1.25)]
ORBIT_TIERS = [(10.0, 10.0), (1e3, 4.0), (1e5, 2.0), (float("inf"), 1.25)]
GROUND_MINIMUM = 10.0


def peak_current(f: Column, c: Column, vpk: Column, vmin: Column) -> Column:
    return 2 * math.pi * f * c * 0.5 * F.abs(vpk - vmin)


def max_hz(c: Column, vpk: Column, vmin: Column, leak: float = LEAK_MARGIN_UA) -> Column:
    amp = 0.5 * F.abs(vpk - vmin)
    budget = max(0.0, REFUSE * I_LIMIT_UA - leak)
    return F.when((amp > 0) & (c > 0), budget / (2 * math.pi * c * amp))


def sine_drive(f: Column, c: Column, vpk: Column, vmin: Column) -> dict[str, Column]:
    known = F.coalesce(c > 0, F.lit(False))
    ipk = F.when(known, peak_current(f, c, vpk, vmin))
    frac = (ipk + LEAK_MARGIN_UA) / I_LIMIT_UA
    slew = 2 * math.pi * f * 0.5 * F.abs(vpk - vmin) * 1000.0 / 1e6
    verdict = (F.when(~known, "warn")
               .when((frac >= REFUSE) | (slew > SLEW_V_PER_US) | (f > BANDWIDTH_HZ), "refuse")
               .when(frac >= WARN, "warn").otherwise("ok"))
    return {"verdict": verdict, "i_pk_ua": ipk, "i_frac": frac, "slew_v_per_us": slew,
            "max_feasible_hz": F.when(known, max_hz(c, vpk, vmin))}


def square_drive(f: Column, c: Column, vpk: Column, vmin: Column) -> dict[str, Column]:
    known = F.coalesce(c > 0, F.lit(False))
    dv = F.abs(vpk - vmin)
    edge = F.when(known, F.greatest(c * dv / (I_LIMIT_UA - LEAK_MARGIN_UA), dv * 1000.0 / SLEW_V_PER_US / 1e6))
    current = F.when(edge > 0, c * dv / edge).otherwise(F.when(known, 0.0))
    frac = F.try_divide(edge, F.try_divide(F.lit(0.5), f))
    verdict = (F.when(~known, "warn").when((frac >= EDGE_REFUSE) | (f > BANDWIDTH_HZ), "refuse")
               .when(frac >= EDGE_WARN, "warn").otherwise("ok"))
    return {"verdict": verdict, "i_pk_ua": current, "i_frac": current / I_LIMIT_UA, "edge_s": edge,
            "edge_frac": frac, "max_feasible_hz": F.when(edge > 0, EDGE_REFUSE / (2.0 * edge))}


def drive_summary(square: bool, d: dict[str, Column]) -> Column:
    """One line per condition; a square edge leads with its edge time."""
    if square:
        return F.when(d["edge_s"].isNull(), "square edge: C unknown").otherwise(F.format_string(
            "square edge %.1f ms = %.1f%% of the half-period (%.0f uA)", 1000 * d["edge_s"],
            100 * d["edge_frac"], d["i_pk_ua"]))
    return F.when(d["i_pk_ua"].isNull(), "I_pk: C unknown").otherwise(F.format_string(
        "I_pk %.0f uA (%.0f%% of limit)", d["i_pk_ua"], 100 * d["i_frac"]))


def window_ok(f: Column, window_s: Column) -> Column:
    return F.when(f <= 0, True).otherwise(window_s >= 2.0 / f)


def run_estimate(cycles: Column, f: Column, n_fast: Column, fast_s: Column, n_full: Column,
                 full_s: Column) -> dict[str, Column]:
    frames = n_fast * 3 + n_full * 40
    return {"duration_s": F.when(f > 0, cycles / f).otherwise(0.0) + n_fast * fast_s + n_full * full_s,
            "frames_est": frames, "disk_mb": frames * 1.5}


def tiered(n: Column, tiers: list[tuple[float, float]]) -> Column:
    """Cycles weighted per tier: each tier counts only what falls inside it."""
    total, lower = F.lit(0.0), 0.0
    for upper, factor in tiers:
        top = n if math.isinf(upper) else F.least(n, F.lit(upper))
        total = total + F.greatest(F.lit(0.0), top - lower) * factor
        lower = upper
    return total


def required_flat(operational: Column, ground: Column, functional: Column, human_rated: Column,
                  margin: Column) -> Column:
    """Margin joins the operational count before its factor of 2 (4 if human-rated)."""
    op = F.when(human_rated, 4.0).otherwise(2.0) * (operational + margin)
    return F.bround(op + 4.0 * ground + 4.0 * functional).cast("bigint")


def required_tiered(ground: Column, orbit: Column) -> Column:
    g = F.greatest(F.coalesce(ground, F.lit(0.0)), F.lit(GROUND_MINIMUM))
    return F.bround(tiered(g, GROUND_TIERS) + tiered(orbit, ORBIT_TIERS)).cast("bigint")


def advisory(cap: Column, required: Column) -> Column:
    return F.when(cap >= required, "SATISFIES").otherwise("FALLS SHORT of")


def sweep(specimens: DataFrame, levels: list[float], frequencies: list[float]) -> DataFrame:
    """Specimens x fixed grid of drive levels and frequencies (exploded literals)."""
    grid = F.array(*[F.struct(F.lit(v).alias("v_pk_kv"), F.lit(f).alias("freq_hz"))
                     for v in levels for f in frequencies])
    out = specimens.withColumn("g", F.explode(grid)).select("*", "g.v_pk_kv", "g.freq_hz").drop("g")
    d = sine_drive(F.col("freq_hz"), F.col("c_est_nf"), F.col("v_pk_kv"), F.lit(0.0))
    return out.withColumns({k: d[k] for k in ("verdict", "i_pk_ua", "max_feasible_hz")})
