"""String, date, array and map helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SI prefixes, ascending.
SI = [(1e-12, "p"), (1e-9, "n"), (1e-6, "µ"), (1e-3, "m"), (1.0, ""), (1e3, "k"), (1e6, "M"), (1e9, "G")]
NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"


def clip_time(name: Column) -> Column:
    """The yyyyMMdd_HHmmss stamp inside a file name."""
    return F.try_to_timestamp(F.regexp_extract(name, r"(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss"))


# Measurement mode -> primary unit, secondary name, secondary unit.
MODE_UNITS = {
    "CPD": ("F", "D", ""), "CPQ": ("F", "Q", ""), "CPG": ("F", "G", "S"), "CPRP": ("F", "Rp", "Ω"),
    "CSD": ("F", "D", ""), "CSQ": ("F", "Q", ""), "CSRS": ("F", "Rs", "Ω"), "LSRS": ("H", "Rs", "Ω"),
    "LSRD": ("H", "Rdc", "Ω"), "LPRS": ("H", "Rs", "Ω"), "LPRP": ("H", "Rp", "Ω"), "RX": ("Ω", "X", "Ω"),
    "ZTD": ("Ω", "θ", "°"), "ZTR": ("Ω", "θ", "rad"),
}
UNSCALED_UNITS = ("", "°", "rad")
# Calibration mode names, and the meaning of letters in old records.
MODE_NAMES = ("verify", "circle", "twopoint")
MODE_LETTERS = {"A": "circle", "B": "twopoint", "C": "verify"}
TELEMETRY_HZ_RANGE = (0.1, 2.0)


def _trim_zeros(text: Column) -> Column:
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")).otherwise(text)


def four_digits(x: Column) -> Column:
    """Four significant digits without trailing zeros; scientific below 1e-4 and from 1e4 on."""
    parts = F.split(F.format_string("%.3e", x), "e")

    def shape(p: Column) -> Column:
        power = F.get(p, F.lit(1)).cast("int")
        sci = F.concat(_trim_zeros(F.get(p, F.lit(0))), F.lit("e"), F.get(p, F.lit(1)))
        plain = _trim_zeros(F.format_string("%.7f", F.concat_ws("e", p).cast("double")))
        return F.when(power.between(-4, 3), plain).otherwise(sci)
    # the one-element array names the split once instead of repeating it
    return F.get(F.transform(F.array(parts), shape), F.lit(0))


def si_format(value: Column, unit: Column) -> Column:
    """'3.3 nF': the prefix puts the mantissa in [1, 1000); null prints as '--'."""
    def scaled(mag: Column) -> Column:
        pick = F.filter(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(p).alias("p")) for s, p in SI]), lambda e: mag >= e["s"])
        best = F.coalesce(F.get(pick, F.size(pick) - 1), F.struct(F.lit(SI[0][0]).alias("s"), F.lit(SI[0][1]).alias("p")))
        return best
    best = scaled(F.abs(value))
    plain = unit.isin(*UNSCALED_UNITS)
    body = four_digits(F.when(plain, value).otherwise(value / best["s"]))
    return (F.when(value.isNull(), "--").when(plain, F.rtrim(F.concat(body, F.lit(" "), unit)))
            .when(value == 0, F.concat(F.lit("0 "), unit)).otherwise(F.concat(body, F.lit(" "), best["p"], unit)))


def _mode_field(mode: Column, i: int) -> Column:
    table = F.create_map(*[x for k, v in MODE_UNITS.items() for x in (F.lit(k), F.lit(v[i]))])
    return F.coalesce(F.try_element_at(table, F.upper(mode)), F.lit(""))


def measurement_pair(mode: Column, primary: Column, secondary: Column) -> tuple[Column, Column]:
    name = _mode_field(mode, 1)
    second = si_format(secondary, _mode_field(mode, 2))
    return si_format(primary, _mode_field(mode, 0)), F.when(name != "", F.concat(name, F.lit(": "), second)).otherwise(second)


def duration(seconds: Column) -> Column:
    s = F.bround(seconds).cast("bigint")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def safe_name(name: Column, size: int = 16) -> Column:
    """Letters, digits and underscore only; null when nothing is left."""
    return F.nullif(F.substring(F.regexp_replace(F.trim(name), "[^A-Za-z0-9_]", "_"), 1, size), F.lit(""))


def frame_name(prefix: str, step: Column, kv: Column, tag: Column) -> Column:
    return F.concat(F.format_string(prefix + "_s%02d_%05.2fkV_", step, kv), tag, F.lit(".png"))


def general(x: Column) -> Column:
    """Six significant digits in plain notation without trailing zeros (magnitudes 1e-4 to 1e6)."""
    a = F.abs(x)
    text = F.format_string("%.0f", x)
    for limit, places in ((1e5, 1), (1e4, 2), (1e3, 3), (1e2, 4), (10.0, 5), (1.0, 6)):
        text = F.when(a < limit, F.format_string(f"%.{places}f", x)).otherwise(text)
    return F.when(x.isNotNull(), _trim_zeros(text))


def capture_name(prefix: Column, index: Column, ts: Column, value: Column, unit: str = "V", ext: str = "png") -> Column:
    """prefix_0001_20240101-000000_m2p5V.png; sign as 'm', decimal point as 'p'."""
    clean = F.coalesce(F.nullif(F.regexp_replace(prefix, r"[^\p{L}\p{N}_-]", "_"), F.lit("")), F.lit("cap"))
    v = F.translate(F.concat(general(value), F.lit(unit)), "-.", "mp")
    return F.concat(F.concat_ws("_", clean, F.format_string("%04d", index), F.date_format(ts, "yyyyMMdd-HHmmss"), v), F.lit("." + ext))


def leading_number(text: Column) -> Column:
    """The number before a unit suffix, or null."""
    return F.nullif(F.regexp_extract(F.trim(text), "^(" + NUMBER + ")", 1), F.lit("")).try_cast("double")


def plain_decimal(x: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.format_string("%.12f", x), r"0+$", ""), r"\.$", "")
    return F.when(t.isin("", "-0", "-"), "0").otherwise(t)


def reading_fragment(kv: Column, ua: Column) -> Column:
    """Either value may be unreadable on its own."""
    k = F.when(kv.isNull(), "?").otherwise(F.format_string("%.2f", kv))
    i = F.when(ua.isNull(), "?").otherwise(F.format_string("%.0f", ua))
    return F.when(kv.isNull() & ua.isNull(), "").otherwise(F.concat(F.lit("  meas "), k, F.lit(" kV / "), i, F.lit(" µA")))


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def key_value_line(fields: dict[str, Column]) -> Column:
    """'k=v k=v', absent values left out, line breaks flattened."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(k + "="), v.cast("string"))) for k, v in fields.items()]
    return F.regexp_replace(F.concat_ws(" ", *parts), r"[\r\n]", " ")


def html_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def run_id(ts: Column, prefix: str = "LC") -> Column:
    return F.concat(F.lit(prefix + "_"), F.date_format(ts, "yyyyMMdd_HHmmss"))


def calibration_mode(text: Column) -> Column:
    """Mode name; a bare letter is an old record and keeps its old meaning; junk is null."""
    t = F.trim(text)
    letters = F.create_map(*[x for k, v in MODE_LETTERS.items() for x in (F.lit(k), F.lit(v))])
    return F.when(F.lower(t).isin(*MODE_NAMES), F.lower(t)).otherwise(F.try_element_at(letters, F.upper(t)))


def clamp_rate(hz: Column) -> Column:
    lo, hi = TELEMETRY_HZ_RANGE
    return F.when(hz.isNull() | F.isnan(hz), hi).otherwise(F.least(F.lit(hi), F.greatest(F.lit(lo), hz)))


def level_list(text: Column) -> Column:
    """Numbers separated by commas or spaces; null for blank or any junk."""
    parts = F.filter(F.split(F.trim(text), r"[,\s]+"), lambda p: p != "")
    nums = F.transform(parts, lambda p: p.try_cast("double"))
    return F.when((F.size(nums) > 0) & ~F.exists(nums, lambda v: v.isNull()), nums)


def joined_rounds(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.format_string("%.2f", v)), "; ")


def split_rounds(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[;,]"), lambda p: F.trim(p).try_cast("double")), lambda v: v.isNotNull())


def nice_ticks(lo: Column, hi: Column, target: int = 6) -> Column:
    """Tick positions on a 1-2-5 step covering [lo, hi]."""
    span = hi - lo
    decade = F.pow(F.lit(10.0), F.floor(F.log10(span / target)))
    mult = F.lit(1.0)
    for m in (10.0, 5.0, 2.0, 1.0):
        mult = F.when(span / (decade * m) <= target, m).otherwise(mult)
    step = decade * mult
    first, last = F.ceil(lo / step), F.floor((hi + step * 1e-9) / step)
    ticks = F.transform(F.sequence(first, F.greatest(first, last)), lambda i: i * step)
    return F.when(hi > lo, ticks).otherwise(F.array(lo))


def to_int16(samples: Column) -> Column:
    """Full-scale signed 16-bit; a record exceeding 1 is normalised by its peak."""
    peak = F.array_max(F.transform(samples, lambda s: F.abs(s)))
    scale = 32767.0 / F.greatest(peak, F.lit(1.0))
    return F.transform(samples, lambda s: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.bround(s * scale).cast("int"))))


def circular_resample(samples: Column, n: int) -> Column:
    """Linear resampling of one period to ``n`` points."""
    m = F.size(samples)

    def at(i):
        x = i * m / n
        lo = F.floor(x)
        return (F.element_at(samples, (lo % m + 1).cast("int")) * (1 - (x - lo))
                + F.element_at(samples, ((lo + 1) % m + 1).cast("int")) * (x - lo))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def scale_samples(samples: Column, vpp: Column, offset: Column) -> Column:
    return F.transform(samples, lambda y: y * (vpp / 2.0) + offset)


def full_range(luma: Column) -> Column:
    """Video-range grey (16..235) to 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.round((luma - 16) * 255.0 / 219.0).cast("int")))


def raw_to_volts(samples: Column, yoff: Column, ymult: Column, yzero: Column, xzero: Column, xincr: Column) -> Column:
    """Array of (t, v) from raw digitizer counts."""
    return F.transform(samples, lambda s, i: F.struct((xzero + i * xincr).alias("t"), ((s - yoff) * ymult + yzero).alias("v")))
