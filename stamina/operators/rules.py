"""Failure rules over telemetry, blocks and characterisations of many runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stamina.functions.units import compare
from stamina.operators.ordered import Ordered, hinted

# The default rule set (tier, rule_id, metric, op, threshold, sustain_s, flag_at, action).
DEFAULT_RULES = [
    ("fast", "overcurrent", "i_dev_ua", ">=", 100.0, 3.0, None, "abort"),
    ("fast", "drive_fidelity", "v_err_frac", ">", 0.05, 5.0, None, "pause"),
    ("fast", "monitor_loss", "blind_s", ">=", 60.0, 0.0, None, "pause"),
    ("medium", "transient_cap", "soft_flags_per_kcycle", ">", 5.0, None, None, "pause"),
    ("medium", "env_band", "env_out_of_band", ">=", 1.0, None, None, "pause"),
    ("medium", "ipk_headroom", "ipk_frac", ">", 0.9, None, None, "pause"),
    ("slow", "amplitude", "disp_ratio", "<", 0.80, None, 0.90, "abort"),
    ("slow", "capacitance", "c_ratio_dev", ">", 0.20, None, 0.10, "abort"),
    ("slow", "leakage", "leak_ratio", ">", 100.0, None, 10.0, "abort"),
    ("slow", "zero_drift", "zero_drift", ">", 0.10, None, 0.05, "warn"),
    ("slow", "wrinkle", "wrinkle_idx", ">", 2.0, None, 1.5, "flag"),
]
RULE_SCHEMA = ("tier string, rule_id string, metric string, op string, threshold double, "
               "sustain_s double, flag_at double, action string")
TIERS = ("fast", "medium", "slow")
ACTIONS = ("log", "flag", "warn", "pause", "abort")
OPS = (">", ">=", "<", "<=", "==")
LEAK_FLOOR_UA = 0.05


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, RULE_SCHEMA)


def merge_rules(defaults: DataFrame, overrides: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Field-wise overrides by (tier, rule_id); unknown ids become new rules."""
    keys = [*(scope or []), "tier", "rule_id"]
    fields = [c for c in defaults.columns if c not in keys]
    joined = defaults.alias("d").join(overrides.alias("o"), keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(F.col(f"o.{c}"), F.col(f"d.{c}")).alias(c) for c in fields])


def rule_problems(known_ids: Column) -> Column:
    """All problems of an override row; ``known_ids`` is the array of default "tier/id"."""
    new = ~F.array_contains(known_ids, F.concat_ws("/", "tier", "rule_id"))
    missing = [F.when(new & F.col(c).isNull(), f"new rule is missing {c}")
               for c in ("metric", "op", "threshold", "action")]
    return F.array_compact(F.array(
        F.when(~F.col("tier").isin(*TIERS), F.concat(F.lit("unknown tier "), F.col("tier"))), *missing,
        F.when(F.col("op").isNotNull() & ~F.col("op").isin(*OPS), F.concat(F.lit("unknown op "), F.col("op"))),
        F.when(F.col("action").isNotNull() & ~F.col("action").isin(*ACTIONS),
               F.concat(F.lit("unknown action "), F.col("action"))),
        F.when(F.size(F.col("extra_keys")) > 0, F.concat(F.lit("unknown keys "), F.array_join("extra_keys", ",")))))


def known_rule_ids() -> Column:
    return F.array(*[F.lit(f"{r[0]}/{r[1]}") for r in DEFAULT_RULES])


def to_metrics(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Wide metric columns to (ids, metric, value) rows; null values are no evidence."""
    return df.unpivot(ids, metrics, "metric", "value").where(F.col("value").isNotNull())


def match_rules(metrics: DataFrame, rules: DataFrame, tier: str) -> DataFrame:
    """Metric rows next to their rule (a rule pack is a configuration of a few rows).

    There are as many metrics as rules, so a shuffle by metric would put all rows into a few tasks: the pack is broadcast.
    """
    return metrics.join(hinted(rules.where(F.col("tier") == tier)), "metric")


def fire_plain(metrics: DataFrame, rules: DataFrame, tier: str) -> DataFrame:
    m = match_rules(metrics, rules, tier)
    return m.where(compare(F.col("op"), F.col("value"), F.col("threshold")))


def fire_slow(metrics: DataFrame, rules: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every hard crossing, and the first amber crossing per run and rule."""
    m = match_rules(metrics, rules, "slow")
    hard = F.coalesce(compare(F.col("op"), F.col("value"), F.col("threshold")), F.lit(False))
    amber = F.coalesce(compare(F.col("op"), F.col("value"), F.col("flag_at")), F.lit(False))
    cols = [*keys, *order, "tier", "rule_id", "value"]
    trips = m.where(hard).select(*cols, F.col("threshold").alias("limit"), "action", F.lit(False).alias("is_flag"))
    flags = (m.where(~hard & amber).groupBy(*keys, "rule_id")
             .agg(F.min_by(F.struct(*order, "tier", "value", "flag_at"), F.struct(*order)).alias("f"))
             .select(*keys, *[F.col(f"f.{o}").alias(o) for o in order], F.col("f.tier").alias("tier"),
                     "rule_id", F.col("f.value").alias("value"), F.col("f.flag_at").alias("limit"),
                     F.lit("flag").alias("action"), F.lit(True).alias("is_flag")))
    return trips.unionByName(flags)


def first_cause(firings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The failure mode of a run: its first firing with action abort."""
    return (firings.where(F.col("action") == "abort").groupBy(*keys)
            .agg(F.min_by("rule_id", F.struct(*order, "rule_id")).alias("failure_mode")))


def sustained(df: DataFrame, keys: list[str], order: list[str], t: str, over: Column,
              sustain: Column) -> DataFrame:
    """Rows where a condition has held for ``sustain`` seconds, once per streak.

    ``over`` null is no evidence: such rows neither start nor reset a streak. Adds
    ``since``, the start of the streak.
    """
    rows = df.withColumn("__over", over).withColumn("__sus", sustain).where(F.col("__over").isNotNull())
    o = (Ordered(rows, keys, order)
         .since("since", F.col("__over"), ~F.col("__over"), F.col(t))
         .lag(__po=F.col("__over"), __pt=F.col(t)))
    held = F.col(t) - F.col("since") >= F.col("__sus")
    before = F.coalesce(F.col("__po") & (F.col("__pt") - F.col("since") >= F.col("__sus")), F.lit(False))
    return o.result().where(F.col("__over") & held & ~before).drop("__over", "__sus", "__po", "__pt")


def watchdog(df: DataFrame, keys: list[str], order: list[str], t: str, value: Column, offscreen: Column,
             trip: float, confirm_s: float, rest: Column | None = None) -> DataFrame:
    """First confirmed overcurrent per run; it latches.

    Deviation from the rest level if known, else absolute. An off-screen reading counts
    as over. Confirmation needs a second over sample at least ``confirm_s`` after the first.
    """
    level = value if rest is None else value - F.coalesce(rest, F.lit(0.0))
    over = F.when(offscreen, True).when(value.isNotNull(), F.abs(level) >= trip)
    rows = df.withColumn("__over", over).where(F.col("__over").isNotNull())
    o = (Ordered(rows, keys, order)
         .since("since", F.col("__over"), ~F.col("__over"), F.col(t)).lag(__po=F.col("__over")))
    hits = o.result().where(F.col("__over") & F.col("__po") & (F.col(t) - F.col("since") >= confirm_s))
    keep = [c for c in df.columns if c not in keys] + ["since"]
    return (hits.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("h"))
            .select(*keys, *[F.col(f"h.{c}").alias(c) for c in keep]))


def blind_ladder(df: DataFrame, keys: list[str], order: list[str], t: str, readable: Column,
                 warn_s: float = 10.0) -> DataFrame:
    """Seconds without a reading, the warning row of each blind streak, and its recovery.

    ``readable`` is true also for off-screen samples: clipping is not blindness.
    """
    rows = df.withColumn("__ok", readable)
    o = Ordered(rows, keys, order).since("__since", ~F.col("__ok"), F.col("__ok"), F.col(t))
    blind = F.when(~F.col("__ok"), F.col(t) - F.col("__since"))
    o = o.with_columns(blind_s=blind).lag(__pb=F.col("blind_s"))
    warned = F.coalesce(F.col("__pb") >= warn_s, F.lit(False))
    step = (F.when((F.col("blind_s") >= warn_s) & ~warned, "warn")
            .when(F.col("__ok") & warned, "recovered"))
    return o.with_columns(ladder=step).result().drop("__ok", "__since", "__pb")


def silence_ladder(df: DataFrame, keys: list[str], order: list[str], t: str, limits: list[tuple[float, str]]) -> DataFrame:
    """A run without rows for each of the ``limits`` (seconds, name) after a row, also after its last one, and the row that ends a silence."""
    o = Ordered(df, keys, order).lead(__nt=F.col(t)).result()
    gap = F.col("__nt") - F.col(t)
    steps = F.array(*[F.struct((F.col(t) + limit).alias("at"), F.lit(name).alias("ladder"), F.lit(float(limit)).alias("silent_s")) for limit, name in limits])
    due = F.filter(steps, lambda s: F.coalesce(gap >= s["silent_s"], F.lit(True)))
    back = F.when(gap >= limits[0][0], F.array(F.struct(F.col("__nt").alias("at"), F.lit("recovered").alias("ladder"), gap.alias("silent_s"))))
    return o.select(*keys, F.inline(F.concat(due, F.coalesce(back, F.array().cast("array<struct<at:double,ladder:string,silent_s:double>>")))))


def evidence_ring(samples: DataFrame, trips: DataFrame, keys: list[str], order: list[str],
                  trip_id: str, size: int = 120) -> DataFrame:
    """The last ``size`` samples up to each trip, by row number instead of pairing rows."""
    from stamina.operators.intervals import interval_join
    o = Ordered(samples, keys, order).row_number("__rn").result()
    at = o.join(trips.select(*keys, *order, trip_id), [*keys, *order]).select(
        *keys, trip_id, (F.col("__rn") - (size - 1)).alias("__from"), F.col("__rn").alias("__to"))
    hit = interval_join(o, at, keys, "__rn", "__from", "__to", bucket=10.0 * size, closed=True)
    return hit.withColumn("age", F.col("__to") - F.col("__rn")).drop("__from", "__to", "__rn")


def recent(df: DataFrame, keys: list[str], order: list[str], n: int = 10) -> DataFrame:
    """Latest ``n`` rows per key; Spark prunes to n per partition before the shuffle."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def ratios(interludes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Measurements against the latest earlier baseline of their run; baselines have none."""
    parts = ["disp_value", "leak_ua", "c_est_nf", "rest_value"]
    o = Ordered(interludes, keys, order).last(False, base=F.when(F.col("is_baseline"), F.struct(*parts)))
    live = ~F.col("is_baseline") & F.col("base").isNotNull()
    b = {p: F.col(f"base.{p}") for p in parts}
    c_ratio = F.try_divide(F.col("c_est_nf"), b["c_est_nf"])
    scale = F.greatest(F.abs(F.when(F.coalesce(b["disp_value"], F.lit(0.0)) != 0, b["disp_value"])
                             .otherwise(1.0)), F.lit(1e-9))
    out = {"disp_ratio": F.try_divide(F.col("disp_value"), b["disp_value"]),
           "leak_ratio": F.when(b["leak_ua"].isNotNull(), F.col("leak_ua") / F.greatest(
               F.abs(b["leak_ua"]), F.lit(LEAK_FLOOR_UA))),
           "c_ratio": c_ratio, "c_ratio_dev": F.abs(c_ratio - 1),
           "zero_drift": F.abs(F.col("rest_value") - b["rest_value"]) / scale}
    return o.with_columns(**{k: F.when(live, v) for k, v in out.items()}).result().drop("base")


def block_metrics(blocks: DataFrame, i_limit_ua: float = 2000.0) -> DataFrame:
    """Medium-tier metrics of a block: soft flags per 1000 cycles, environment, current share."""
    out_of_band = ~(F.col("env_t_c").between(F.col("t_lo"), F.col("t_hi"))
                    & F.col("env_p_mbar").between(F.col("p_lo"), F.col("p_hi")))
    return blocks.withColumns({
        "soft_flags_per_kcycle": F.try_divide(F.col("soft_flags") * 1000.0, F.col("cycles_done")),
        "env_out_of_band": out_of_band.cast("double"), "ipk_frac": F.col("ipk_ua") / i_limit_ua})


def drive_error(mean_kv: Column, expected_kv: Column) -> Column:
    """Relative drive error, only where a voltage is expected."""
    return F.when(expected_kv > 0.05, F.abs(mean_kv - expected_kv) / expected_kv)


def flag_lifecycle(flags: DataFrame, acks: DataFrame, keys: list[str]) -> DataFrame:
    """Flags with the first acknowledgement at or after they were raised.

    An as-of join forward in time: both inputs in one order, latest first, so the last
    acknowledgement seen is the next one in time. No flag meets every acknowledgement.
    """
    f = flags.withColumn("__at", -F.col("raised_at")).withColumn("__side", F.lit(1))
    a = acks.select(*keys, (-F.col("acked_at")).alias("__at"), F.lit(0).alias("__side"),
                    F.struct("acked_by", "acked_at").alias("__ack"))
    ids = [c for c in flags.columns if c not in (*keys, "raised_at")]
    both = f.unionByName(a, allowMissingColumns=True)
    out = Ordered(both, keys, ["__at", "__side", *ids]).last(__hit=F.col("__ack")).result().where("__side = 1")
    return out.select(*flags.columns, F.col("__hit.acked_by").alias("acked_by"), F.col("__hit.acked_at").alias("acked_at"))
