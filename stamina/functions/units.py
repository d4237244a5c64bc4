"""Scalar conversions, classifications and checks as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Amplifier and monitor gains.
KV_PER_CONTROL_V = 1.0
KV_PER_MONITOR_V = 1.0
UA_PER_MONITOR_V = 200.0
MAX_KV = 10.0
# Readings beyond this are the instrument's off-screen sentinel.
OFFSCREEN_ABOVE = 1e30
# Baseline exposure thresholds (mean grey level, percent saturated).
DARK_MEAN, BRIGHT_MEAN, BRIGHT_SAT, CLIP_MEAN, CLIP_SAT = 40.0, 215.0, 8.0, 225.0, 20.0
SATURATED_LEVEL = 250
# Electrode families by needle, first family with a match wins.
ELECTRODE_NEEDLES = {
    "cnt": ["cnt", "carbon nanotube", "nanotube", "swnt", "mwnt", "invisicon", "nano-c"],
    "carbon_black": ["carbon black", "carbonblack", "cb ", " cb", "c-black"],
    "liquid_metal": ["egain", "e-gain", "galinstan", "liquid metal", "liquidmetal"],
}
# Vertical scales of the monitor channels, V per division.
SCALE_LADDER = [0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0]
DIVISIONS = 8
# Actuated share of one cycle, by waveform.
DUTY = {"SINE": 0.5, "SQUARE": 0.5, "RAMP": 0.5}


def lenient_double(text: Column, finite: bool = False, nan_for_missing: bool = False) -> Column:
    """Trimmed cell to double; blank or junk is null (or NaN), optionally ±inf too."""
    v = F.trim(text).try_cast("double")
    if finite:
        v = F.when(F.abs(v) < float("inf"), v)
    return F.coalesce(v, F.lit(float("nan"))) if nan_for_missing else v


def control_volts(kv: Column) -> Column:
    return kv / KV_PER_CONTROL_V


def monitor_value(kind: Column, channel: Column, stats: Column, sign: Column) -> Column:
    """Statistic ``kind`` of a channel in kV or µA from a map of raw scope volts.

    An inverting amplifier swaps MAXIMUM and MINIMUM; a span has no sign; a frequency
    is not scaled.
    """
    gain = F.when(channel == "v", KV_PER_MONITOR_V).otherwise(UA_PER_MONITOR_V)
    twin = (F.when((sign < 0) & (kind == "MAXIMUM"), "MINIMUM")
            .when((sign < 0) & (kind == "MINIMUM"), "MAXIMUM").otherwise(kind))
    raw = F.coalesce(stats[twin], stats[kind])
    return (F.when(kind == "FREQUENCY", stats[kind])
            .when(kind == "PK2PK", F.abs(stats[kind] * gain)).otherwise(sign * raw * gain))


def reading_status(text: Column) -> tuple[Column, Column]:
    """(value or null, 'ok' | 'offscreen' | 'invalid')."""
    v = F.trim(text).try_cast("double")
    status = (F.when(v.isNull() | F.isnan(v) & ~F.lower(F.trim(text)).contains("nan"), "invalid")
              .when(F.abs(v) > OFFSCREEN_ABOVE, "offscreen").otherwise("ok"))
    return F.when(status == "ok", v), status


def electrode_family(text: Column) -> Column:
    t = F.lower(F.trim(text))
    padded = F.concat(F.lit(" "), t, F.lit(" "))
    out = F.when(text.isNull() | (t == ""), None)
    for family, needles in ELECTRODE_NEEDLES.items():
        hit = F.lit(False)
        for n in needles:
            hit = hit | padded.contains(n)
        out = out.when(hit, family)
    return out.otherwise("other")


def concentration_applies(text: Column) -> Column:
    return ~F.coalesce(electrode_family(text), F.lit("")).isin("carbon_black", "liquid_metal")


def concentration_ml(text: Column) -> Column:
    v = F.trim(text).try_cast("double")
    return F.when((v > 0) & (v < float("inf")) & ~F.isnan(v), v)


def exposure_verdict(mean: Column, sat_pct: Column) -> Column:
    return (F.when((sat_pct >= CLIP_SAT) | (mean >= CLIP_MEAN), "clipped").when(mean < DARK_MEAN, "dark")
            .when((mean > BRIGHT_MEAN) | (sat_pct > BRIGHT_SAT), "bright").otherwise("ok"))


def saturation_pct(pixels: Column) -> Column:
    return F.size(F.filter(pixels, lambda p: p >= SATURATED_LEVEL)) * 100.0 / F.size(pixels)


def credible_rest_level(level: Column, trip: Column) -> Column:
    return F.coalesce(F.abs(level) <= F.least(F.lit(30.0), 0.5 * trip), F.lit(False))


def frequency_ok(measured: Column, commanded: Column, tol: float = 0.02) -> Column:
    return F.coalesce(F.when(commanded > 0, F.abs(measured - commanded) / commanded <= tol), F.lit(False))


def environment_state(t_c: Column, p_mbar: Column, age_s: Column, t_band: tuple, p_band: tuple,
                      stale_s: float = 1800.0) -> tuple[Column, Column]:
    """(fresh, in band); a missing attestation is neither."""
    return (F.coalesce(age_s <= stale_s, F.lit(False)),
            F.coalesce(t_c.between(*t_band) & p_mbar.between(*p_band), F.lit(False)))


def pressure_advisory(p_pa: Column, lo: float = 1.0, hi: float = 10_000.0) -> Column:
    """Advisory code; it never blocks."""
    return (F.when(p_pa.isNull(), "not evaluated: no pressure attested")
            .when(p_pa.between(lo, hi), "inside the low-breakdown pressure band").otherwise(""))


def suggested_scale(volts: Column, divisions: int = DIVISIONS) -> Column:
    need = volts * 1.3 / divisions
    ladder = F.array(*[F.lit(s) for s in SCALE_LADDER])
    return F.when(volts <= 0, 1.0).otherwise(
        F.coalesce(F.get(F.filter(ladder, lambda s: s >= need), F.lit(0)), F.lit(10.0)))


def monitor_problems(max_kv: Column, v: dict[str, Column], i: dict[str, Column], trip_ua: Column,
                     sign: Column, divisions: int = DIVISIONS) -> Column:
    """Codes of channel-setup problems. ``v``/``i`` hold scale, atten, position, offset."""
    v_need = max_kv / KV_PER_MONITOR_V
    i_need = F.greatest(F.lit(1.0), 2.0 * trip_ua / UA_PER_MONITOR_V)
    specs = [("V", v, v_need, F.when(sign >= 0, 0.0).otherwise(-v_need), F.when(sign >= 0, v_need).otherwise(0.0)),
             ("I", i, 2.0 * i_need, -i_need, i_need)]
    out = []
    for label, ch, span_need, lo, hi in specs:
        half = divisions / 2.0
        top = ch["offset"] + (half - ch["position"]) * ch["scale"]
        bottom = ch["offset"] - (half + ch["position"]) * ch["scale"]
        short = ch["scale"] * divisions < span_need
        out += [F.when(F.abs(ch["atten"] - 1.0) > 1e-6, f"{label}: probe factor"),
                F.when(short, f"{label}: span too small"),
                F.when(~short & ((top < hi) | (bottom > lo)), f"{label}: window misses the swing")]
    return F.array_compact(F.array(*out))


def monitor_fix(max_kv: Column, trip_ua: Column, sign: Column) -> dict[str, Column]:
    i_need = F.greatest(F.lit(1.0), 2.0 * trip_ua / UA_PER_MONITOR_V)
    return {"v_scale": suggested_scale(max_kv / KV_PER_MONITOR_V), "i_scale": suggested_scale(2.0 * i_need),
            "atten": F.lit(1.0), "v_position": F.when(sign < 0, 3.0).otherwise(-3.0), "i_position": F.lit(0.0)}


def compare(op: Column, value: Column, threshold: Column) -> Column:
    """Comparison whose operator is data; null operands give null."""
    return (F.when(op == ">", value > threshold).when(op == ">=", value >= threshold)
            .when(op == "<", value < threshold).when(op == "<=", value <= threshold)
            .when(op == "==", value == threshold))


def waveform_duty(waveform: Column) -> Column:
    table = F.create_map(*[x for k, d in DUTY.items() for x in (F.lit(k), F.lit(d))])
    return F.coalesce(F.try_element_at(table, F.upper(waveform)), F.lit(0.5))


def disc_area(diam: Column) -> Column:
    return F.lit(math.pi) * diam * diam / 4.0
