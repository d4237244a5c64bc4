"""Cycle and dose accounting, caps, milestones and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stamina.functions.units import frequency_ok, waveform_duty
from stamina.operators.ordered import Ordered


def dose(kind: Column, cycles: Column, freq: Column, waveform: Column, hold_s: Column, hold_kv: Column) -> Column:
    """Actuated seconds of a block: n/f * duty when cycling, the full time of a hold above 0 kV."""
    return (F.when(kind == "cycle", F.when(freq > 0, cycles / freq * waveform_duty(waveform)).otherwise(0.0))
            .when((kind == "dc_hold") & (hold_kv > 0), hold_s).otherwise(0.0))


def profile_dose(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Actuated seconds of a staircase: integral of V over its segments, relative to its peak."""
    area = F.sum((F.col("t1") - F.col("t0")) * 0.5 * (F.col("from_kv") + F.col("to_kv")))
    peak = F.max(F.greatest("from_kv", "to_kv"))
    return segments.groupBy(*keys).agg(F.when(peak > 0, area / peak).otherwise(0.0).alias("actuated_s"))


def ledger(blocks: DataFrame, keys: list[str], order: list[str], cycles: Column, actuated: Column,
           wall: Column) -> DataFrame:
    """The three progress axes as running totals."""
    return (Ordered(blocks, keys, order)
            .running_sum(cycles_total=cycles, actuated_s_total=actuated, wall_s_total=wall).result())


def timed_count(samples: DataFrame, keys: list[str], order: list[str], t: str, freq: Column,
                commanded: Column, hold_s: float = 10.0) -> DataFrame:
    """Cycles credited by integrating measured frequency, holding a stale one up to ``hold_s``."""
    rows = samples.withColumn("__f", freq).withColumn("__cmd", commanded)
    o = (Ordered(rows, keys, order).lag(__pt=F.col(t)).last(False, __lf=F.col("__f"))
         .since("__stale", F.col("__f").isNull() & F.col("__lf").isNotNull(), F.col("__f").isNotNull(), F.col(t)))
    used = F.coalesce(F.col("__f"), F.when(F.col(t) - F.col("__stale") <= hold_s, F.col("__lf")))
    dt = F.col(t) - F.col("__pt")
    bad = F.col("__f").isNotNull() & ~frequency_ok(F.col("__f"), F.col("__cmd"))
    return o.result().groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(dt > 0, used * dt)), F.lit(0.0)).alias("cycles"),
        F.bool_or(bad).alias("mismatch")).withColumn("credited", F.floor("cycles"))


def cap_crossing(ledgered: DataFrame, keys: list[str], order: list[str], max_cycles: float,
                 max_wall_s: float) -> DataFrame:
    """The first record of each run at or past a stop cap, and which cap it was."""
    by_cycles = F.col("cycles_total") >= max_cycles
    hit = ledgered.where(by_cycles | (F.col("wall_s_total") >= max_wall_s))
    out = hit.groupBy(*keys).agg(F.min_by(F.struct(
        *order, "cycles_total", "wall_s_total",
        F.when(by_cycles, "cycles").otherwise("wall").alias("cap")), F.struct(*order)).alias("h"))
    return out.select(*keys, "h.*")


def milestones(blocks: DataFrame, keys: list[str], order: list[str], cycles: Column, kind: str,
               after: list[str], interludes: list[str], marks: list[int]) -> DataFrame:
    """The block boundary that reports each milestone.

    A boundary is safe when the block is of a type in ``after`` and the next one is no
    interlude. A milestone is reported at the first safe boundary at or past it, so each
    safe row reports the marks between the previous safe total and its own.
    """
    o = Ordered(blocks, keys, order).running_sum(cycles_total=cycles).lead(__next=F.col(kind))
    safe = F.col(kind).isin(*after) & ~F.coalesce(F.col("__next"), F.lit("")).isin(*interludes)
    o = o.with_columns(__safe=safe).last(False, __prev=F.when(F.col("__safe"), F.col("cycles_total")))
    due = F.filter(F.array(*[F.lit(m).cast("bigint") for m in marks]),
                   lambda m: (m > F.coalesce(F.col("__prev"), F.lit(0))) & (m <= F.col("cycles_total")))
    return (o.result().where("__safe").withColumn("milestone", F.explode(due))
            .select(*keys, *order, "milestone", "cycles_total"))


def reconcile(blocks: DataFrame, checkpoints: DataFrame, keys: list[str]) -> DataFrame:
    """Block sums and row counts against the checkpoint counters."""
    sums = blocks.groupBy(*keys).agg(F.sum("cycles_done").alias("block_cycles"), F.count(F.lit(1)).alias("block_count"))
    j = checkpoints.join(sums, keys, "left")
    d_cycles = F.coalesce(F.col("block_cycles"), F.lit(0)) - F.col("cycles")
    d_rows = F.coalesce(F.col("block_count"), F.lit(0)) - F.col("block_rows")
    return j.select(*keys, d_cycles.alias("cycles_diff"), d_rows.alias("rows_diff"),
                    ((d_cycles == 0) & (d_rows == 0)).alias("reconciled"))


def paused_seconds(events: DataFrame, keys: list[str], order: list[str], t: str, is_pause: Column) -> DataFrame:
    """Wall seconds spent paused: from each pause to the next pause or resume event."""
    o = Ordered(events.withColumn("__p", is_pause), keys, order).lead(__nt=F.col(t)).result()
    return o.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("__p"), F.col("__nt") - F.col(t))), F.lit(0.0)).alias("paused_s"),
        F.count_if("__p").alias("pauses"))
