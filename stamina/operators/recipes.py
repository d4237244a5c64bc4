"""Data quality of test plans and the pre-arm gate chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stamina.session import cut_lineage

# Accepted keys, vocabularies and ranges of a plan.
TOP_KEYS = ["schema", "name", "description", "geometry", "drive", "reference", "environment", "counting",
            "camera_track_max_hz", "stop", "milestones", "failure_rules", "blocks"]
PLAN_GEOMETRIES = ["planar", "bender"]
WAVEFORMS = ["SINE", "SQUARE", "RAMP"]
BLOCK_TYPES = ["cycle", "fast_interlude", "full_interlude", "dc_hold", "ramp", "wait_env", "loop"]
COUNTING = ["burst", "timed"]
RANGES = {"freq_hz": (0.001, 10.0), "v_min_kv": (0.0, 10.0), "ref_kv": (0.0, 10.0), "leak_hold_s": (1.0, 600.0), "max_cycles": (1.0, None),
          "max_wall_h": (0.001, None)}
REQUIRED = ("freq_hz", "max_cycles", "max_wall_h")
MAX_LOOP_DEPTH = 2


# Accepted keys of each kind of object in a plan, and which keys hold objects or lists of blocks.
KEYS = {"plan": TOP_KEYS, "drive": ["waveform", "freq_hz", "v_pk", "v_min_kv"],
        "reference": ["ref_kv", "ref_freq_hz", "ref_cycles", "leak_hold_kv", "leak_hold_s"],
        "environment": ["t_c_band", "p_mbar_band", "stale_after_s", "reattest_on_rearm"], "stop": ["max_cycles", "max_wall_h"],
        "staircase": ["start_kv", "end_kv", "step_kv", "n_steps", "ramp_s", "landing_s", "settle_s", "snap_lead_s"],
        "cycle": ["type", "n_cycles", "role", "waveform", "freq_hz", "v_pk_kv", "v_min_kv"],
        "fast_interlude": ["type", "ref_kv", "ref_freq_hz", "ref_cycles", "leak_hold_kv", "leak_hold_s"],
        "full_interlude": ["type", "staircase", "set_baseline"], "dc_hold": ["type", "kv", "hold_s", "sample_hz"], "ramp": ["type", "to_kv", "rate_kv_s"],
        "wait_env": ["type", "prompt", "t_c_band", "p_mbar_band"], "loop": ["type", "blocks", "repeat"]}
OBJECTS = {"plan": ["drive", "reference", "environment", "stop"], "full_interlude": ["staircase"]}
LISTS = {"plan": ["blocks"], "loop": ["blocks"]}


def _listed(table: dict[str, list[str]], kind: Column, key: Column) -> Column:
    """Whether ``table`` has ``key`` for ``kind``."""
    flat = [f"{k}/{v}" for k, vs in table.items() for v in vs]
    return F.concat(kind, F.lit("/"), key).isin(*flat)


def unknown_paths(plans: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """(keys, path): every key that its object doesn't accept, at any depth of the plan's JSON, with its whole path.

    One step a level of nesting: entries of the objects of a level as rows, unknown ones out, objects and blocks below as the next level. An
    object of unknown block type is not looked into (its type is a problem of its own). A text that is no object has no paths.
    """
    level = plans.select(*keys, F.lit("plan").alias("kind"), F.lit("").alias("path"), F.col(doc).alias("v"))
    out = None
    while True:
        entry = level.select(*keys, "kind", "path", F.explode(F.from_json("v", T.MapType(T.StringType(), T.StringType()))).alias("key", "value"))
        entry = entry.withColumn("path", F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "key"))
        bad = entry.where(~_listed(KEYS, F.col("kind"), F.col("key"))).select(*keys, "path")
        out = bad if out is None else out.unionByName(bad)
        objects = entry.where(_listed(OBJECTS, F.col("kind"), F.col("key"))).select(*keys, F.col("key").alias("kind"), "path", F.col("value").alias("v"))
        blocks = entry.where(_listed(LISTS, F.col("kind"), F.col("key"))).select(
            *keys, "path", F.posexplode(F.from_json("value", T.ArrayType(T.StringType()))).alias("at", "v"))
        blocks = blocks.select(*keys, F.get_json_object("v", "$.type").alias("kind"), F.concat("path", F.lit("["), F.col("at"), F.lit("]")).alias("path"), "v")
        below = objects.unionByName(blocks.where(F.col("kind").isin(*BLOCK_TYPES)))
        if below.isEmpty():
            return out
        level = cut_lineage(below)


def unknown_keys(present: Column, allowed: list[str], where: str) -> Column:
    extra = F.array_sort(F.array_except(present, F.array(*[F.lit(k) for k in allowed])))
    return F.when(F.size(extra) > 0, F.concat(F.lit(where + ": unknown key(s) "), F.array_join(extra, ",")))


def number_problem(text: Column, name: str) -> Column:
    """Missing, not a number, or outside the accepted range."""
    lo, hi = RANGES[name]
    v = text.try_cast("double")
    out = F.when(text.isNull(), F.lit(f"missing {name}") if name in REQUIRED else None)
    out = out.when(v.isNull(), F.lit(f"{name} is not a number"))
    if lo is not None:
        out = out.when(v < lo, F.lit(f"{name} below minimum"))
    if hi is not None:
        out = out.when(v > hi, F.lit(f"{name} above maximum"))
    return out


def member_problem(value: Column, allowed, name: str) -> Column:
    return F.when(~F.coalesce(value.isin(*allowed), F.lit(False)), F.lit(f"{name} not accepted"))


def band_problem(lo: Column, hi: Column, name: str) -> Column:
    return F.when(~F.coalesce(lo < hi, F.lit(False)), F.lit(f"{name} must be lo < hi"))


def milestone_problem(marks: Column, max_cycles: Column) -> Column:
    inc = F.forall(F.sequence(F.lit(1), F.size(marks)), lambda i: (i == 1) | (F.get(marks, i - 1) > F.get(marks, i - 2)))
    return (F.when(F.exists(marks, lambda m: m < 1), "milestone not positive")
            .when((F.size(marks) > 0) & ~inc, "milestones must increase")
            .when(F.element_at(marks, -1) >= max_cycles, "last milestone not below the cap"))


def staircase_problem(landing: Column, settle: Column, lead: Column) -> Column:
    return F.when(settle + lead >= landing, "settle + lead must be below landing")


def structure_problems(types: Column, baselines: Column, break_ins: Column) -> list[Column]:
    """Exactly one baseline, at least one break-in, and the baseline after it (arrays of positions)."""
    return [F.when(F.exists(types, lambda b: ~b.isin(*BLOCK_TYPES)), "unknown block type"),
            F.when(F.size(types) == 0, "no blocks"),
            F.when(F.size(baselines) != 1, "exactly one baseline required"),
            F.when(F.size(break_ins) == 0, "break-in block required"),
            F.when((F.size(baselines) > 0) & (F.size(break_ins) > 0) & (F.get(baselines, F.lit(0)) < F.get(break_ins, F.lit(0))),
                   "baseline before break-in")]


def plan_problems(c: dict[str, Column]) -> Column:
    """All problems of a plan row at once; ``c`` maps the field names used below to columns."""
    return F.array_compact(F.array(
        unknown_keys(c["keys"], TOP_KEYS, "top level"), F.when(F.coalesce(F.trim(c["name"]), F.lit("")) == "", "missing name"),
        member_problem(c["geometry"], PLAN_GEOMETRIES, "geometry"), member_problem(c["waveform"], WAVEFORMS, "waveform"),
        member_problem(c["counting"], COUNTING, "counting"),
        *[number_problem(c[k], k) for k in RANGES if k in c], band_problem(c["t_lo"], c["t_hi"], "t_c_band"),
        milestone_problem(c["milestones"], c["max_cycles"].try_cast("double")),
        staircase_problem(c["landing_s"], c["settle_s"], c["lead_s"]),
        F.when(c["loop_depth"] > MAX_LOOP_DEPTH, "loops nest at most 2 deep"),
        *structure_problems(c["types"], c["baselines"], c["break_ins"])))


def gate_chain(c: dict[str, Column]) -> Column:
    """Ordered pre-arm gates as an array of (gate, ok, warn); the pressure gate only warns."""
    live = c["mode"] == "live"

    def gate(name, ok, warn=None):
        return F.struct(F.lit(name).alias("gate"), F.coalesce(ok, F.lit(False)).alias("ok"),
                        (warn if warn is not None else F.lit("")).alias("warn"))
    return F.array(
        gate("platform", c["platform_ok"]), gate("drive_connected", ~live | c["drive_ok"]),
        gate("monitor_connected", c["monitor_ok"] | ~live | c["confirmed_blind"]),
        gate("monitor_window", ~c["monitor_ok"] | (c["window_problems"] == 0)),
        gate("feasibility", F.coalesce(c["feasibility"] != "refuse", F.lit(True))),
        gate("specimen_cap", c["drive_kv"] <= c["cap_kv"] + 1e-9), gate("pressure", F.lit(True), c["pressure_note"]),
        gate("energize_confirm", ~live | c["confirmed_energize"]))


def all_pass(gates: Column) -> Column:
    return F.forall(gates, lambda g: g["ok"])


def config_hash(df: DataFrame, config: str) -> Column:
    """SHA-256 of a configuration struct of ``df`` as JSON, fields sorted by name at every level, nulls kept."""
    def ordered(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            fields = sorted(kind.fields, key=lambda f: f.name)
            return F.when(value.isNotNull(), F.struct(*[ordered(value[f.name], f.dataType).alias(f.name) for f in fields]))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return F.transform(value, lambda x: ordered(x, kind.elementType))
        return value
    return F.sha2(F.to_json(ordered(F.col(config), df.schema[config].dataType), {"ignoreNullFields": "false"}), 256)
