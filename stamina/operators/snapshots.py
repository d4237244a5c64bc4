"""Voltage-staircase snapshots: breakdown classification, levels, consistency, tidy export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stamina.functions.units import disc_area
from stamina.operators.ordered import Ordered
from stamina.operators.quantiles import group_quantile

# Review and breakdown settings.
SETTINGS = {"diam_mm": 16.0, "accept_conf": 0.75, "spread_pct": 12.0, "audit_nostep_pct": 15.0,
            "audit_bias_px": 3.0, "breakdown_dev_ua": 20.0, "breakdown_ua": 50.0, "area_jump_pct": 35.0,
            "wrinkle_ratio": 1.4}
SCALE_FIX_DATE = "2026-07-28"
MIN_READINGS = 5
TELEMETRY_PERIOD_S, COARSE_S = 0.5, 1.0
MACHINE_BAND_PCT, TRACED_BAND_PCT = 2.0, 1.0
NOTE = r"edge:([A-Za-z_-]+) conf ([0-9.]+)(\s*\(user\))?"
TIDY = ["run", "snapshot", "nominal_kV", "phase", "tag", "area_mm2", "convention", "expansion_A_A0",
        "measured_uA", "power_mW", "traced", "method", "conf", "user_reviewed", "breakdown_confirmed",
        "breakdown_advisory", "saved_breakdown_brand", "notes"]


def note_fields(notes: Column) -> dict[str, Column]:
    """method, conf, user and traced from a notes cell."""
    method = F.regexp_extract(notes, NOTE, 1)
    return {"method": F.coalesce(method, F.lit("")), "conf": F.nullif(F.regexp_extract(notes, NOTE, 2), F.lit("")).try_cast("double"),
            "user": F.coalesce(F.regexp_extract(notes, NOTE, 3) != "", F.lit(False)),
            "traced": F.coalesce(method == "manual-trace", F.lit(False))}


def phase(tag: Column) -> Column:
    out = F.when(F.startswith(tag, F.lit("baseline")), "baseline")
    for p in ("post", "pre"):
        out = out.when(F.startswith(tag, F.lit(p)), p)
    return out.otherwise("")


def breakdown(rows: DataFrame, keys: list[str], settings: dict = SETTINGS) -> DataFrame:
    """Adds ``confirmed`` and ``advisory`` breakdown kinds with their size.

    Rows need row_idx, kv, ua, area. Current: an event deviates from the run median; it is
    confirmed next to another event row (a blank row between breaks adjacency) or as the
    last readable row, else advisory. With fewer than five readings an absolute limit
    applies. Area: a collapse without falling voltage is confirmed when a current event
    exists at the same level (or there is no median), else advisory. Confirmed rows carry
    no advisory.
    """
    base = (Ordered(rows, keys, ["row_idx"])
            .total(n_ua=F.count("ua"), last_ua=F.max(F.when(F.col("ua").isNotNull(), F.col("row_idx"))))
            .total_median(__m=F.col("ua")))
    has = F.col("n_ua") >= MIN_READINGS
    dev = F.when(has, F.col("ua") - F.col("__m"))
    base = base.with_columns(deviation=dev, event=F.coalesce(F.abs(dev) >= settings["breakdown_dev_ua"], F.lit(False)))
    base = base.lag(__pe=F.col("event")).lead(__ne=F.col("event"))
    near = F.coalesce("__pe", F.lit(False)) | F.coalesce("__ne", F.lit(False)) | (F.col("row_idx") == F.col("last_ua"))
    seen = F.col("area") > 0
    base = base.last(False, __prev=F.when(seen, F.struct("area", "kv")))
    drop = F.coalesce(seen & (F.col("kv") >= F.col("__prev.kv")) & (
        F.col("area") < F.col("__prev.area") * (1 - settings["area_jump_pct"] / 100)), F.lit(False))
    base = base.with_columns(
        current=F.when(F.col("event") & near, "current").when(
            ~has & (F.abs("ua") > settings["breakdown_ua"]), "absolute"),
        transient=F.col("event") & ~near, collapse=drop,
        collapse_pct=F.when(drop, 100 * (1 - F.col("area") / F.col("__prev.area"))),
        has_median=has, __lv=F.round("kv", 6))           # tolerance far below any level step
    out = (base.total(by=("__lv",), __hit=F.max(F.col("event") & F.col("__lv").isNotNull())).result()
           .drop("__pe", "__ne", "__prev", "__m", "n_ua", "last_ua", "__lv"))
    certain = F.col("collapse") & (~F.col("has_median") | F.coalesce("__hit", F.lit(False)))
    confirmed = F.coalesce(F.col("current"), F.when(certain, "area"))
    advisory = F.concat_ws("; ", F.when(F.col("transient"), "transient"), F.when(F.col("collapse") & ~certain, "collapse"))
    return (out.withColumn("confirmed", confirmed)
            .withColumn("advisory", F.when(F.col("confirmed").isNull() & (advisory != ""), advisory))
            .drop("__hit", "current", "transient", "collapse", "has_median"))


def collapse_corroborated(collapses: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Collapse rows that share their voltage level with any event of the run."""
    lv = F.round("kv", 6)
    e = events.select(*keys, lv.alias("__lv")).distinct()
    return collapses.withColumn("__lv", lv).join(e, [*keys, "__lv"], "left_semi").drop("__lv")


def strip_brand(notes: Column) -> Column:
    """Notes without breakdown branding tokens."""
    return F.array_join(F.filter(F.split(F.coalesce(notes, F.lit("")), "; "), lambda p: (p != "")
                                 & (p != "post-breakdown") & ~F.startswith(p, F.lit("breakdown?"))), "; ")


def brand(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Branding in line with ``confirmed``: new notes, new frame name, and the rename of the file.

    Rows at or after the first confirmed row are branded, all others are un-branded.
    """
    o = Ordered(rows, keys, ["row_idx"]).total(__first=F.min(F.when(F.col("confirmed").isNotNull(), F.col("row_idx"))))
    zone = F.coalesce(F.col("row_idx") >= F.col("__first"), F.lit(False))
    name = F.col("frame_file")
    marked = F.regexp_replace(name, r"(\.[^.]*)$", "_BREAKDOWN$1")
    new = (F.when(zone & ~name.contains("_BREAKDOWN"), marked)
           .when(~zone, F.regexp_replace(name, "_BREAKDOWN", "")).otherwise(name))
    notes = F.coalesce("notes", F.lit(""))
    added = F.when(F.col("confirmed").isNotNull() | notes.contains("post-breakdown"), notes).otherwise(
        F.concat_ws("; ", F.when(notes != "", notes), F.lit("post-breakdown")))
    return o.with_columns(zone=zone, new_file=new, new_notes=F.when(zone, added).otherwise(strip_brand(F.col("notes")))
                          ).result().drop("__first")


def rename_plan(branded: DataFrame, keys: list[str]) -> DataFrame:
    return branded.where(F.col("frame_file") != F.col("new_file")).select(
        *keys, "row_idx", F.col("frame_file").alias("src"), F.col("new_file").alias("dst"))


def brand_mismatch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Saved brands no recomputed flag explains, and flags without a saved brand."""
    o = Ordered(rows, keys, ["row_idx"]).total(__first=F.min(F.when(F.col("confirmed").isNotNull(), F.col("row_idx"))))
    kind = (F.when(F.col("saved_brand") & (F.col("__first").isNull() | (F.col("row_idx") < F.col("__first"))), "stale")
            .when(F.col("confirmed").isNotNull() & ~F.col("saved_brand"), "unbranded"))
    return o.with_columns(mismatch=kind).result().where("mismatch is not null").drop("__first")


def texture_onset(rows: DataFrame, keys: list[str], limit: float = 1.6) -> DataFrame:
    """First row at or above the limit is the onset, later ones are in the mode."""
    over = F.coalesce(F.col("wrinkle") >= limit, F.lit(False))
    o = Ordered(rows, keys, ["row_idx"]).with_columns(__w=over).total(
        __first=F.min(F.when(F.col("__w"), F.col("row_idx"))))
    return (o.with_columns(texture=F.when(F.col("__w") & (F.col("row_idx") == F.col("__first")), "onset")
                           .when(F.col("__w"), "mode")).result().drop("__w", "__first"))


def consistency(rows: DataFrame, keys: list[str], pair_tol: float = 0.12, slack: float = 0.10) -> DataFrame:
    """Pair mismatch at one level, else an area dip while the level did not fall."""
    usable = rows.where((F.col("area") > 0) & F.col("kv").isNotNull())
    o = Ordered(usable, keys, ["row_idx"]).lag(__pa=F.col("area"), __pk=F.col("kv")).result()
    pair = Ordered(o, [*keys, "kv"], ["row_idx"]).total(
        __lo=F.min("area"), __hi=F.max("area"), __n=F.count(F.lit(1))).result()
    rel = (F.col("__hi") - F.col("__lo")) / ((F.col("__hi") + F.col("__lo")) / 2)
    bad = (F.col("__n") > 1) & (rel > pair_tol)
    dip = F.coalesce((F.col("kv") >= F.col("__pk")) & (F.col("area") < F.col("__pa") * (1 - slack)), F.lit(False))
    out = pair.withColumn("issue", F.when(bad, "pair mismatch").when(dip, "area dip")).withColumn(
        "pct", F.when(bad, 100 * rel).when(dip, 100 * (1 - F.col("area") / F.col("__pa"))))
    return out.where("issue is not null").drop("__pa", "__pk", "__lo", "__hi", "__n")


def reconcile_pairs(best: DataFrame, keys: list[str], accept: float = SETTINGS["accept_conf"]) -> DataFrame:
    """Confidence of the best candidates after comparing snapshots of one level.

    ``best``: row_idx, kv, area, conf, ci85_pct (null = no interval), audited.
    """
    rows = best.where(F.col("kv").isNotNull())
    share = F.coalesce(1.5 * F.col("ci85_pct") / 100, F.lit(0.06))
    o = Ordered(rows, [*keys, "kv"], ["row_idx"]).total(
        __n=F.count(F.lit(1)), __lo=F.min("area"), __hi=F.max("area"), __t=F.sum(share)).result()
    mid = (F.col("__hi") + F.col("__lo")) / 2
    rel, tol = F.try_divide(F.col("__hi") - F.col("__lo"), mid), F.greatest(F.lit(0.04), F.col("__t"))
    live = (F.col("__n") > 1) & (mid > 0)
    under = round(accept - 0.01, 3)
    agree, clash = live & (rel <= tol), live & (rel > 2 * tol)
    conf = (F.when(agree, F.least(F.when(F.col("audited"), under).otherwise(0.99), F.col("conf") + 0.05))
            .when(clash, F.least(F.col("conf"), F.lit(under))).otherwise(F.col("conf")))
    return (o.withColumn("pair", F.when(agree, "confirmed").when(clash, "mismatch"))
            .withColumn("mismatch_pct", F.when(clash, 100 * rel)).withColumn("conf", conf)
            .drop("__n", "__lo", "__hi", "__t"))


def levels(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """One row per voltage level; a mean never mixes hand-traced and machine values.

    ``rows``: row_idx, kv, phase, traced, is_flagged. ``value`` may be any column.
    """
    r = rows.withColumn("__v", value).where(F.col("kv").isNotNull() & F.col("__v").isNotNull())
    traced = F.col("traced")
    g = r.groupBy(*keys, F.round("kv", 3).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__v").alias("__all"), F.avg(F.when(~traced, F.col("__v"))).alias("__machine"),
        F.bool_or(traced).alias("traced"), F.bool_and(traced).alias("all_traced"), F.bool_or("is_flagged").alias("confirmed"),
        F.max_by(F.when(F.col("phase") == "post", F.col("__v")), F.when(F.col("phase") == "post", F.col("row_idx"))).alias("post"),
        F.max_by(F.when(F.col("phase") == "pre", F.col("__v")), F.when(F.col("phase") == "pre", F.col("row_idx"))).alias("pre"))
    mixed = F.col("traced") & ~F.col("all_traced")
    return (g.withColumn("mixed", mixed).withColumn("mean", F.when(mixed, F.col("__machine")).otherwise(F.col("__all")))
            .withColumn("band_pct", F.when(F.col("all_traced"), TRACED_BAND_PCT).otherwise(MACHINE_BAND_PCT))
            .drop("__all", "__machine"))


def rest_area(rows: DataFrame, keys: list[str], area: str = "area_mm2") -> DataFrame:
    """A0: median of the non-null, non-zero baseline areas."""
    return group_quantile(rows.where((F.col("phase") == "baseline") & (F.col(area) != 0)), keys, {"a0": F.col(area)})


def current_median(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Run median current where at least five readings exist."""
    ua = rows.where(F.col("ua").isNotNull())
    enough = ua.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_READINGS)
    return group_quantile(ua, keys, {"ua_median": F.col("ua")}).join(enough, keys)


def cadence(rows: DataFrame, keys: list[str], monitored: DataFrame) -> DataFrame:
    """Seconds between current samples: the monitor period, else the median positive gap."""
    stamped = rows.where(F.col("ts").isNotNull())
    o = Ordered(stamped, keys, ["row_idx"]).lag(__pt=F.col("ts")).result()
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("__pt").cast("timestamp"))) / 1e6
    med = group_quantile(o.where(gap > 0), keys, {"gap": gap})
    runs = rows.select(*keys).distinct()
    j = runs.join(med, keys, "left").join(monitored.select(*keys).distinct().withColumn("__tel", F.lit(True)), keys, "left")
    secs = F.when(F.col("__tel"), TELEMETRY_PERIOD_S).otherwise(F.col("gap"))
    source = F.when(F.col("__tel"), "telemetry").when(F.col("gap").isNotNull(), "snapshot spacing").otherwise("unknown")
    return j.select(*keys, secs.alias("cadence_s"), source.alias("source"),
                    F.coalesce(secs > COARSE_S, F.lit(False)).alias("coarse"))


def power_mw(kv: Column, ua: Column, median: Column) -> Column:
    return F.abs(kv * (ua - F.coalesce(median, F.lit(0.0))))


def suspect_scale(rows: DataFrame, a0: DataFrame, keys: list[str], diam_mm: Column, fix_date: str = SCALE_FIX_DATE) -> DataFrame:
    """Runs whose areas predate the scale fix and cannot be verified against the nominal disc."""
    g = rows.groupBy(*keys).agg(F.min(F.to_date("ts")).alias("first_day"), F.bool_or(F.col("area_mm2").isNotNull()).alias("has_areas"))
    nominal = disc_area(diam_mm)
    off = F.abs(F.col("a0") - nominal) / nominal > 0.05
    old = F.coalesce(F.col("first_day") < F.to_date(F.lit(fix_date)), F.lit(False))
    return g.join(a0, keys, "left").withColumn("suspect", old & F.when(F.col("a0").isNull(), F.col("has_areas")).otherwise(off))


def eligibility(runs: DataFrame, mode: str, vs_area: bool = False, allow_suspect: bool = False) -> DataFrame:
    """(keep, reason) per run for a figure mode. ``runs``: suspect, has_areas, a0."""
    uses = mode == "area" or vs_area
    reason = F.lit(None).cast("string")
    if uses:
        reason = (F.when(F.col("suspect") & ~F.lit(allow_suspect), "areas predate the scale fix")
                  .when(~F.col("has_areas"), "no reviewed areas")
                  .when(F.lit(mode == "area") & (F.coalesce("a0", F.lit(0.0)) == 0), "no baseline area"))
    hide = F.col("suspect") & ~F.lit(uses) & ~F.lit(allow_suspect)
    return runs.withColumns({"reason": reason, "keep": reason.isNull(), "hide_areas": hide})


def mixed_provenance(runs: DataFrame) -> DataFrame:
    """One row telling whether kept runs with and without a recorded anchor are mixed."""
    return runs.agg(F.count_if("has_anchor").alias("anchored"), F.count_if(~F.col("has_anchor")).alias("unanchored")).withColumn(
        "mixed", (F.col("anchored") > 0) & (F.col("unanchored") > 0))


def tidy(rows: DataFrame, run_facts: DataFrame, keys: list[str]) -> DataFrame:
    """Per-snapshot export: every row kept, areas blanked for suspect runs.

    ``rows`` is the breakdown result with phase, notes fields and saved_brand;
    ``run_facts`` has a0, ua_median, hide_areas per run.
    """
    j = rows.join(run_facts, keys, "left")
    area = F.when(~F.coalesce("hide_areas", F.lit(False)), F.col("area_mm2"))
    conv = (F.when(area.isNull(), "").when(F.col("traced"), "outer-toe").when(F.col("method") != "", "half-height").otherwise(""))
    cols = [F.col(keys[0]).alias("run"), "snapshot", F.col("kv").alias("nominal_kV"), "phase", "tag", area.alias("area_mm2"),
            conv.alias("convention"), F.round(F.try_divide(area, F.col("a0")), 4).alias("expansion_A_A0"),
            F.col("ua").alias("measured_uA"), F.round(power_mw(F.col("kv"), F.col("ua"), F.col("ua_median")), 3).alias("power_mW"),
            "traced", "method", "conf", F.col("user").alias("user_reviewed"), F.col("confirmed").alias("breakdown_confirmed"),
            F.col("advisory").alias("breakdown_advisory"), F.col("saved_brand").alias("saved_breakdown_brand"), "notes"]
    return j.select(*cols).select(*TIDY)


def axis_scale(values: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """'log' if all positive, 'symlog' with a decade threshold if mixed, null if nothing to scale."""
    v = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    g = values.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.min(F.when(v != 0, F.abs(v))).alias("small"))
    kind = F.when((F.col("n") > 0) & (F.col("lo") > 0), "log").when(F.col("small").isNotNull(), "symlog")
    floor = F.greatest(F.pow(F.lit(10.0), F.floor(F.log10("small"))), F.lit(1e-12))
    return g.select(*keys, kind.alias("scale"), F.when(kind == "symlog", floor).alias("threshold"))


def apply_results(rows: DataFrame, accepted: DataFrame, key: str, scale: Column) -> DataFrame:
    """Review results onto rows: accepted, rejected, or absent and therefore re-derived.

    ``rows``: px, mm2, diam. ``accepted``: key, area_px (null = rejected), diam_px. Absent
    rows keep their pixels and get areas at the new scale; without pixels they are blanked.
    """
    a = accepted.select(key, F.col("area_px").alias("__a"), F.col("diam_px").alias("__d"), F.lit(True).alias("__in"))
    j = rows.join(a, key, "left")
    seen = F.coalesce("__in", F.lit(False))
    ok = seen & F.col("__a").isNotNull()
    px = F.when(F.col("px") > 0, F.col("px"))
    old_scale = F.sqrt(F.when(F.col("mm2") > 0, F.col("mm2")) / px)
    diam = F.coalesce(F.when(F.col("diam") != 0, F.col("diam")) * scale / old_scale,
                      2 * F.sqrt(px / F.pi()) * scale)
    return j.select(
        key, F.when(ok, "accepted").when(seen, "rejected").otherwise("absent").alias("state"),
        F.when(ok, F.col("__a")).when(~seen, F.col("px")).alias("px"),
        F.when(ok, F.col("__a") * scale * scale).when(~seen, px * scale * scale).alias("mm2"),
        F.when(ok, F.col("__d") * scale).when(~seen, F.when(px.isNotNull(), diam)).alias("diam"))


def needs_review(top: DataFrame, settings: dict = SETTINGS) -> Column:
    """True when a human should choose: nothing, a fallback, low confidence, wide spread."""
    return (F.col("conf").isNull() | F.coalesce("fallback", F.lit(False)) | (F.col("conf") < settings["accept_conf"])
            | (F.col("spread_pct") > settings["spread_pct"]))
