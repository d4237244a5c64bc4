"""Specimen registry, caps, dispositions and resume decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stamina.operators.ordered import Ordered

# Geometry names and statuses of a specimen.
GEOMETRIES = ("planar16", "bender_10x20", "bender_20x40", "bender_20x80", "custom")
STATUSES = ("virgin", "in_test", "failed", "suspended", "retired")
# Default hard caps in kV by geometry, and the ceiling over all of them.
GEOMETRY_CAPS = {"planar16": 10.0, "bender_10x20": 2.5, "bender_20x40": 2.5, "bender_20x80": 2.5, "custom": 2.0}
CEILING_KV = 10.0


def hard_cap(specimens: DataFrame, geometry_caps: DataFrame, specimen_caps: DataFrame,
             ceiling: float = CEILING_KV) -> DataFrame:
    """Specimen cap, else geometry cap, else the ceiling; never above the ceiling."""
    j = (specimens.join(specimen_caps.withColumnRenamed("cap_kv", "__s"), "specimen_id", "left")
         .join(geometry_caps.withColumnRenamed("cap_kv", "__g"), "geometry", "left"))
    return j.withColumn("cap_kv", F.least(F.coalesce("__s", "__g", F.lit(ceiling)), F.lit(ceiling))).drop("__s", "__g")


def over_cap(levels: DataFrame, max_kv: float = 10.0) -> DataFrame:
    """Reachable levels above the specimen cap or the amplifier (tolerance 1e-9)."""
    return levels.withColumn("problem", F.when(F.col("kv") > F.col("cap_kv") + 1e-9, "above specimen cap")
                             .when(F.col("kv") > max_kv + 1e-9, "above amplifier")).where("problem is not null")


def upsert_outcomes(registry: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Fold run outcomes into the registry: totals add up, a failure latches.

    Outcomes of specimens that nobody registered change nothing; ``unregistered_outcomes`` has them.

    ``outcomes``: specimen_id, run_seq, run_id, disposition, cycles, actuated_s, failure_mode.
    """
    failed = F.col("disposition") == "failed"
    agg = outcomes.groupBy("specimen_id").agg(
        F.sum("cycles").alias("__c"), F.sum("actuated_s").alias("__a"),
        F.max_by("run_id", "run_seq").alias("__run"), F.bool_or(failed).alias("__failed"),
        F.min_by(F.when(failed, F.coalesce("failure_mode", F.lit("unspecified"))),
                 F.when(failed, F.col("run_seq"))).alias("__mode"))
    j = registry.join(agg, "specimen_id", "left")
    zero = F.lit(0.0)
    status = (F.when((F.col("status") == "failed") | F.coalesce("__failed", F.lit(False)), "failed")
              .when(F.col("__run").isNotNull(), "suspended").otherwise(F.col("status")))
    return j.select(
        "specimen_id", status.alias("status"),
        (F.coalesce("cycles_accum", zero) + F.coalesce("__c", zero)).alias("cycles_accum"),
        (F.coalesce("actuated_s_accum", zero) + F.coalesce("__a", zero)).alias("actuated_s_accum"),
        F.coalesce("__run", "last_run_id").alias("last_run_id"), F.coalesce("failure_mode", "__mode").alias("failure_mode"))


def unregistered_outcomes(registry: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes refused because their specimen is not in the registry."""
    return outcomes.join(registry.select("specimen_id"), "specimen_id", "left_anti")


def transition_problems(log: DataFrame, order: list[str]) -> DataFrame:
    """Registry changes that are refused: back to test after failure, unknown geometry or status."""
    o = Ordered(log, ["specimen_id"], order).lag(__prev=F.col("status")).result()
    probs = F.array_compact(F.array(
        F.when(F.col("__prev").isin("failed", "retired") & (F.col("status") == "in_test"),
               F.concat(F.col("__prev"), F.lit(" specimen back in test"))),
        F.when(~F.col("geometry").isin(*GEOMETRIES), "unknown geometry"),
        F.when(~F.col("status").isin(*STATUSES), "unknown status")))
    return o.withColumn("problems", probs).where(F.size("problems") > 0).drop("__prev")


def verdict(disposition: Column, cycles: Column, mode: Column, milestone: Column | None = None) -> tuple[Column, Column]:
    """(verdict text, how the run enters survival analysis); a report at a milestone is of a run that still goes on."""
    n = F.format_number(cycles, 0)
    mark = F.lit(None).cast("long") if milestone is None else milestone
    snapshot = F.concat(F.lit("Milestone "), F.format_number(mark, 0), F.lit(" passed, now at "), n, F.lit(" cycles; the run goes on"))
    text = (F.when(mark.isNotNull(), snapshot).when(disposition == "failed", F.concat(F.lit("FAILED at "), n, F.lit(" cycles: "), mode))
            .when(disposition == "NOT_ZEROED", "ENDED WITH DRIVE NOT ZEROED")
            .when(disposition == "complete", F.concat(F.lit("Reached its stop cap at "), n, F.lit(" cycles")))
            .when(disposition == "suspended", F.concat(F.lit("Suspended at "), n, F.lit(" cycles")))
            .otherwise(F.concat(F.lit("Run ended: "), disposition, F.lit(" at "), n, F.lit(" cycles"))))
    return text, F.when(mark.isNotNull(), None).when(disposition == "failed", "failed").otherwise("suspended")


def health(allowed: Column, flag_count: Column, disposition: Column) -> Column:
    return (F.when(~allowed | disposition.isin("failed", "NOT_ZEROED"), "RED")
            .when(flag_count > 0, "AMBER").otherwise("GREEN"))


def unclean(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.where(~F.coalesce("clean_shutdown", F.lit(False)))


def resume_decision(requests: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Whether a run may resume, with the reason when it may not."""
    j = requests.join(checkpoints.withColumn("__has", F.lit(True)), "run_id", "left")
    reason = (F.when(F.col("__has").isNull(), "no checkpoint")
              .when(F.col("config_sha") != F.col("ckpt_sha"), "configuration changed")
              .when(F.col("clean_shutdown"), "clean end, nothing to resume"))
    return j.select("run_id", reason.isNull().alias("may_resume"), reason.alias("reason"))


def stale_heartbeat(status: DataFrame, keys: list[str], now: Column, limit_s: float = 15.0) -> DataFrame:
    """Runs whose last update is too old, unless they ended."""
    last = status.groupBy(*keys).agg(F.max("updated_s").alias("updated_s"),
                                     F.max_by("state", "updated_s").alias("state"))
    age = now - F.col("updated_s")
    return last.withColumn("age_s", age).withColumn(
        "stale", (age > limit_s) & ~F.col("state").isin("DONE", "NOT_ZEROED"))


def resolve_voltage(spec_kv: Column, fraction: Column, ebd_v_per_um: Column, thickness_um: Column,
                    temp_c: Column, ref_temp_c: Column, guard_c: float = 5.0) -> tuple[Column, Column]:
    """(drive kV, problem): explicit, or a share of the breakdown voltage measured near the test temperature."""
    far = F.coalesce(F.abs(temp_c - ref_temp_c) > guard_c, F.lit(False))
    prob = (F.when(spec_kv.isNotNull(), None).when(fraction.isNull(), "no voltage given")
            .when(ebd_v_per_um.isNull() | thickness_um.isNull(), "no breakdown reference")
            .when(far, "reference temperature too far"))
    kv = F.coalesce(spec_kv, F.when(prob.isNull(), F.round(fraction * ebd_v_per_um * thickness_um / 1000.0, 4)))
    return kv, prob
