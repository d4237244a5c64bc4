"""Report tables over all runs, compliance of claims, campaign context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stamina.functions.units import compare


def counts(blocks: DataFrame, interludes: DataFrame, keys: list[str]) -> DataFrame:
    b = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"),
                                  F.array_join(F.array_sort(F.collect_set("counting")), ";").alias("modes"))
    i = interludes.groupBy(*keys).agg(F.count(F.lit(1)).alias("interludes"),
                                      F.count_if("is_baseline").alias("baselines"))
    # a run may have blocks only, or interludes only
    both = b.join(i, keys, "full_outer")
    return both.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) if c != "modes" else F.coalesce(c, F.lit("")).alias(c)
                                for c in ("blocks", "modes", "interludes", "baselines")])


# Colours of the event log by action, and the rules whose events are the environment record.
EVENT_COLOURS = {"abort": "red", "pause": "amber", "warn": "amber", "flag": "amber"}
ENVIRONMENT_RULES = ["env_entry", "wait_env", "env_band"]
INVENTORY_SUFFIXES = ("csv", "json")


def event_log(events: DataFrame, keys: list[str]) -> DataFrame:
    """The audit events of each run as the report shows them: rule with its tier, and a colour by action."""
    colour = F.create_map(*[F.lit(x) for kv in EVENT_COLOURS.items() for x in kv])
    return events.select(*keys, "t", "cycles_total", F.concat_ws("/", F.coalesce("tier", F.lit("")), F.coalesce("rule_id", F.lit(""))).alias("rule"),
                         "action", "message", F.coalesce(F.try_element_at(colour, "action"), F.lit("grey")).alias("colour"))


def environment_record(events: DataFrame, keys: list[str]) -> DataFrame:
    """Attestations and waits for the environment, in the order of the log."""
    return events.where(F.col("rule_id").isin(*ENVIRONMENT_RULES)).select(*keys, "t", "rule_id", "message")


def inventory(files: DataFrame) -> DataFrame:
    """The tables and documents of each run with size and hash, images and traces left out."""
    return files.where(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*INVENTORY_SUFFIXES))


def summaries(runs: DataFrame, events: DataFrame, interludes: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """Three lines a run: the verdict, the totals, and the amber flags nobody has acknowledged.

    ``runs``: disposition, cycles, actuated_s, failure_mode, milestone (of a snapshot while the run goes on, else null). ``flags``: rule_id,
    acked_at. A run has at most as many open flags as there are rules, so they fit a line.
    """
    from stamina.operators.registry import verdict
    n_events = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"))
    n_inter = interludes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_interludes"))
    amber = flags.where(F.col("acked_at").isNull()).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ", ").alias("open"))
    all_ = runs.join(n_events, keys, "left").join(n_inter, keys, "left").join(amber, keys, "left")
    text, _ = verdict(F.col("disposition"), F.col("cycles"), F.col("failure_mode"), F.col("milestone"))
    cycles = F.format_number("cycles", 0)
    total = F.concat(cycles, F.lit(" cycles | "), F.format_number("actuated_s", 0), F.lit(" s actuated | "), F.coalesce("n_interludes", F.lit(0)),
                     F.lit(" interludes | "), F.coalesce("n_events", F.lit(0)), F.lit(" events"))
    return all_.select(*keys, text.alias("verdict"), total.alias("totals"),
                       F.coalesce(F.concat(F.lit("open amber flags: "), "open"), F.lit("no open amber flags")).alias("amber"))


def context_rows(df: DataFrame, keys: list[str], paths: dict[str, Column]) -> DataFrame:
    """A context as (path, value) rows, values as text."""
    pairs = F.array(*[F.struct(F.lit(p).alias("path"), v.cast("string").alias("value")) for p, v in paths.items()])
    return df.select(*keys, F.explode(pairs).alias("c")).select(*keys, "c.path", "c.value")


def evaluate_claims(claims: DataFrame, context: DataFrame, keys: list[str]) -> DataFrame:
    """Claims against achieved values; hand-set statuses stand, missing data never comply."""
    ctx = context.select(*keys, F.col("path").alias("achieved_path"), F.col("value").alias("achieved"))
    j = claims.join(ctx, [*keys, "achieved_path"], "left")
    hand = F.coalesce(F.col("status").isin("tailored", "pending"), F.lit(False))
    a, r = F.col("achieved").try_cast("double"), F.col("required").try_cast("double")
    ok = F.coalesce(F.when(a.isNotNull() & r.isNotNull(), compare(F.col("op"), a, r))
                    .otherwise(F.col("achieved") == F.col("required")), F.lit(False))
    missing = F.col("achieved").isNull() | F.col("op").isNull() | F.col("required").isNull()
    status = (F.when(hand, F.col("status")).when(missing, "deviate").when(ok, "comply").otherwise("deviate"))
    note = F.when(~hand & missing, "no achieved data").when(~hand & ~ok, "misses the requirement")
    return j.withColumns({"status": status, "auto_note": note, "achieved": F.when(~hand, F.col("achieved"))})


def claim_problems() -> Column:
    def blank(c):
        return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return F.array_compact(F.array(
        *[F.when(blank(c), f"missing {c}") for c in ("req_id", "source_clause", "statement")],
        F.when((F.col("status") == "tailored") & blank("tailoring_note"), "tailored without a note"),
        F.when(F.col("op").isNotNull() & (F.col("op") != "") & ~F.col("op").isin(">=", ">", "<=", "<", "=="), "unknown op")))


def campaign_context(survival: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    c = survival.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("cycles").alias("min_cycles"),
                                    F.max("cycles").alias("max_cycles"))
    return c.join(fits.select(*keys, "b10"), keys, "left")
