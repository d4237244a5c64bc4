"""Calibration statistics, rescaling plans and detector roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stamina.functions.units import disc_area
from stamina.operators.ordered import Ordered
from stamina.operators.quantiles import group_quantile, group_quantile_grid

# Expected range of n normal samples in units of sigma.
D2 = {2: 1.128, 3: 1.693, 4: 2.059, 5: 2.326, 6: 2.534, 7: 2.704, 8: 2.847}
SE_LIMIT_PCT, RANGE_LIMIT_PCT, GUARD_PCT, MIXED_TOL_PCT, MATCH_PCT = 0.4, 1.0, 1.0, 0.05, 0.05


def d2_of(n: Column) -> Column:
    table = F.create_map(*[x for k, v in D2.items() for x in (F.lit(k).cast("bigint"), F.lit(v))])
    return F.try_element_at(table, n.cast("bigint"))


def calibration_stats(rounds: DataFrame, keys: list[str], diam: str) -> DataFrame:
    """Mean, range and, where a range factor exists for n, sigma and standard errors."""
    g = rounds.where(F.col(diam) != 0).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(diam).alias("mean"), (F.max(diam) - F.min(diam)).alias("spread_px"))
    sigma = F.when(F.col("mean") != 0, F.col("spread_px") / d2_of(F.col("n")))
    g = g.withColumns({"spread_pct": F.coalesce(F.try_divide(100 * F.col("spread_px"), F.col("mean")), F.lit(0.0)),
                       "sigma_pct": 100 * sigma / F.col("mean")})
    return g.withColumn("se_pct", F.col("sigma_pct") / F.sqrt("n")).withColumn("area_se_pct", 2 * F.col("se_pct"))


def se_gate(n: Column, se_pct: Column, limit: float = SE_LIMIT_PCT) -> Column:
    """True / False / null when the set cannot be judged."""
    return F.when((n >= 2) & se_pct.isNotNull(), se_pct <= limit)


def rounds_needed(sigma_pct: Column, limit: float = SE_LIMIT_PCT) -> Column:
    return F.when(sigma_pct > 0, F.greatest(F.lit(2).cast("bigint"), F.ceil(F.pow(sigma_pct / limit, 2))))


def range_gate(n: Column, spread_pct: Column, limit: float = RANGE_LIMIT_PCT) -> Column:
    return F.coalesce((n < 2) | (spread_pct <= limit), F.lit(True))


def rescale_pct(old_px: Column, new_px: Column) -> Column:
    return F.when((old_px != 0) & (new_px != 0), 100 * (F.pow(old_px / new_px, 2) - 1))


def anchor_guard(mean_px: Column, auto_px: Column, auto_area: Column, diam_mm: Column) -> dict[str, Column]:
    """An accepted anchor against the automatic fit and the nominal resting area."""
    ok = F.coalesce((mean_px > 0) & (diam_mm > 0) & (auto_px > 0), F.lit(False))
    nominal = disc_area(diam_mm)
    area = F.when(auto_area > 0, auto_area).otherwise(disc_area(auto_px))
    rest = F.when(ok, area * F.pow(diam_mm / mean_px, 2))
    d = F.when(ok, 100 * (mean_px - auto_px) / auto_px)
    a = 100 * (rest - nominal) / nominal
    warn = F.concat_ws("; ", F.when(F.abs(d) > GUARD_PCT, "diameter off the automatic fit"),
                       F.when(F.abs(a) > GUARD_PCT, "resting area off the nominal disc"))
    return {"available": ok, "diam_pct": d, "rest_area_mm2": rest, "area_pct": a, "warn": warn}


def guard_is_vacuous(method: Column) -> Column:
    return F.coalesce(method == "auto-verified", F.lit(False))


def fit_residual_pct(resid_px: Column, diam_px: Column) -> Column:
    return F.when(diam_px > 0, 100 * resid_px / diam_px)


def reanchor_plan(rows: DataFrame, keys: list[str], new_scale: float, diam_mm: float,
                  recorded: DataFrame | None = None) -> DataFrame:
    """What a change of scale would do to each run, in one aggregation.

    ``rows``: row_idx, tag, px, mm2, diam (null = blank). ``recorded``: keys, recorded_px.
    """
    px, mm2 = F.when(F.col("px") > 0, F.col("px")), F.when(F.col("mm2") > 0, F.col("mm2"))
    r = rows.withColumn("__px", px).withColumn("__sc", F.sqrt(mm2 / px))
    old = (F.coalesce("mm2", F.lit(0.0)) != 0) | (F.coalesce("diam", F.lit(0.0)) != 0)
    has = F.col("__px").isNotNull()
    rest = F.struct(F.col("row_idx").alias("row"), F.col("px").alias("px"), F.col("mm2").alias("mm2"), F.col("__sc").alias("sc"))
    at = F.when(has, F.struct((F.col("tag") != "baseline").alias("b"), F.col("row_idx").alias("i")))
    g = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(has).alias("n_derive"), F.count_if(~has & old).alias("n_blank"),
        F.count_if(has & F.col("__sc").isNull()).alias("n_fresh"), F.count_if(~has & ~old).alias("n_untouched"),
        F.count("__sc").alias("n_scales"), F.min("__sc").alias("__lo"), F.max("__sc").alias("__hi"),
        F.min_by(rest, at).alias("r"), F.min(at).alias("at"))
    med = group_quantile(r.where(F.col("__sc").isNotNull()), keys, {"__med": F.col("__sc")})
    g = g.join(med, keys, "left")
    g = g.join(recorded, keys, "left") if recorded is not None else g.withColumn("recorded_px", F.lit(None).cast("double"))
    scale = F.coalesce(F.col("r.sc"), F.col("__med"))
    span = 100 * (F.pow(F.col("__hi") / F.col("__lo"), 2) - 1)
    nominal = disc_area(F.lit(diam_mm))
    after = F.col("r.px") * new_scale * new_scale
    return g.select(
        *keys, "n_rows", "n_derive", "n_blank", "n_fresh", "n_untouched", "n_scales", scale.alias("old_scale"),
        (diam_mm / scale).alias("old_diam_px"), F.lit(diam_mm / new_scale).alias("new_diam_px"), span.alias("scale_span_pct"),
        F.coalesce(span > MIXED_TOL_PCT, F.lit(False)).alias("mixed"), F.col("r.row").alias("rest_row"),
        (~F.col("at.b")).alias("rest_is_baseline"), F.col("r.mm2").alias("rest_before"), after.alias("rest_after"),
        (100 * (F.col("r.mm2") - nominal) / nominal).alias("rest_dev_before"), (100 * (after - nominal) / nominal).alias("rest_dev_after"),
        F.pow(new_scale / scale, 2).alias("mult"),
        (F.abs(100 * (F.col("recorded_px") / (diam_mm / scale) - 1)) <= MATCH_PCT).alias("anchor_matches_data"))


def ensemble(cands: DataFrame, keys: list[str], prev_method: DataFrame | None = None) -> DataFrame:
    """Confidence and rank of the candidate outlines of each frame.

    ``cands``: cand, method, area, solidity, contrast, wrinkle, cx, cy, diam, conf_own,
    ci85_pct. Tiers are the methods starting with 'diff'.
    """
    tier, fit, m = F.startswith("method", F.lit("diff")), F.col("method") == "disc-fit", F.col("method")
    o = Ordered(cands, keys, ["cand"]).total(
        __n=F.count_if(tier), __sd=F.stddev_pop(F.when(tier, F.col("area"))), __mu=F.avg(F.when(tier, F.col("area"))),
        __fit=F.min_by(F.struct("area", "cx", "cy", "diam"), F.when(fit, F.col("cand"))))
    o = o.total_median(__med=F.when(tier, F.col("area")))
    d = o.result()
    spread = F.when(F.col("__n") > 1, F.try_divide("__sd", "__mu")).otherwise(0.0)
    agree = F.greatest(F.lit(0.0), 1 - spread)
    dist = F.hypot(F.col("cx") - F.col("__fit.cx"), F.col("cy") - F.col("__fit.cy"))
    inside = F.coalesce((dist <= 0.5 * F.col("__fit.diam")) & (F.col("area") <= 1.2 * F.col("__fit.area")), F.lit(False))
    agree_fit = F.when(F.col("__n") > 0, F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.abs(
        F.col("__med") - F.col("area")) / F.greatest(F.col("area"), F.lit(1.0))))).otherwise(1.0)
    bonus = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("wrinkle") - 1) / 1.5))
    agr = F.when((m == "tex-ratio") & F.col("__fit").isNotNull(), F.when(inside, 1.0).otherwise(0.3)).otherwise(agree)
    blend = 0.3 * F.col("solidity") + 0.3 * F.col("contrast") + 0.2 * agr + 0.2 * bonus
    conf = (F.when(fit, F.least(F.lit(0.99), F.col("conf_own") * (0.85 + 0.15 * agree_fit)))
            .when(m == "resting", F.col("conf_own")).otherwise(blend))
    d = d.withColumns({"conf": conf, "spread_pct": F.when(fit, F.col("ci85_pct")).when(m == "resting", 0.0).otherwise(100 * spread),
                       "__inside": inside})
    if prev_method is not None:
        d = d.join(prev_method, keys, "left").withColumn("conf", F.when(
            m == F.col("prev_method"), F.least(F.lit(0.99), F.col("conf") + 0.05)).otherwise(F.col("conf"))).drop("prev_method")
    o = Ordered(d, keys, ["cand"]).total(__fc=F.min_by("conf", F.when(fit, F.col("cand"))))
    capped = F.coalesce(((m == "tex-ratio") | tier) & (F.col("conf") >= F.col("__fc")) & F.col("__inside"), F.lit(False))
    out = o.with_columns(capped=capped, conf=F.when(capped, F.greatest(F.lit(0.0), F.col("__fc") - 0.01)).otherwise(F.col("conf"))).result()
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def top_candidates(cands: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """The ``n`` best per frame, earlier candidate first on ties."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(F.col("conf").desc(), F.col("cand"))
    return cands.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def previous_winner(ranked: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The winning method of the previous frame, for the hysteresis bonus."""
    best = ranked.where("rank = 1")
    return Ordered(best, keys, order).lag(prev_method=F.col("method")).result().select(*keys, *order, "prev_method")


def boundary_audit(rays: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Bias, spread and share of rays without a step; needs 12 rays, 6 good ones for a bias."""
    o = (Ordered(rays, keys, [order]).total_median(__m=F.when(F.col("step") > 2, F.col("step")))
         .with_columns(__cut=F.greatest(F.lit(3.0), 0.35 * F.coalesce("__m", F.lit(3.0))))
         .with_columns(__good=F.col("step") >= F.col("__cut"))
         .total_median(__b=F.when(F.col("__good"), F.col("off")))
         .total_median(__mad=F.when(F.col("__good"), F.abs(F.col("off") - F.col("__b")))).result())
    g = o.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rays"), F.count_if("__good").alias("n_good"),
                             F.max("__b").alias("bias_px"), F.max("__mad").alias("mad_px"))
    enough = F.col("n_good") >= 6
    return g.where("n_rays >= 12").select(
        *keys, "n_rays", F.when(enough, F.col("bias_px")).alias("bias_px"), F.when(enough, F.col("mad_px")).alias("mad_px"),
        (100.0 * (F.col("n_rays") - F.col("n_good")) / F.col("n_rays")).alias("nostep_pct"))


def audit_cap(conf: Column, nostep_pct: Column, bias_px: Column, accept: float = 0.75,
              nostep_limit: float = 15.0, bias_limit: float = 3.0) -> tuple[Column, Column]:
    """(capped, confidence) after the audit gates."""
    hit = (nostep_pct > nostep_limit) | F.coalesce(F.abs(bias_px) > bias_limit, F.lit(False))
    return hit, F.when(hit, F.least(conf, F.lit(round(accept - 0.01, 3)))).otherwise(conf)


def photometric_fit(base: DataFrame, image: DataFrame, keys: list[str], value: str, passes: int = 3) -> DataFrame:
    """Gain and offset taking one sample onto another, by matched quantiles with trimming.

    Only 49 quantile pairs per group reach the fit, whatever the size of the samples.
    """
    grid = [(2 + 2 * i) / 100 for i in range(49)]
    q = (group_quantile_grid(base, keys, F.col(value), grid, "xb")
         .join(group_quantile_grid(image, keys, F.col(value), grid, "xi"), [*keys, "p"]))
    o = Ordered(q, keys, ["p"]).with_columns(keep=F.lit(True))
    for i in range(passes):
        kept_x, kept_y = F.when(F.col("keep"), F.col("xb")), F.when(F.col("keep"), F.col("xi"))
        o = o.total(a=F.regr_slope(kept_y, kept_x), b=F.regr_intercept(kept_y, kept_x))
        if i == passes - 1:
            break
        o = o.with_columns(r=F.abs(F.col("a") * F.col("xb") + F.col("b") - F.col("xi")))
        o = o.total(cut=F.percentile("r", F.lit(0.67))).with_columns(nxt=F.col("r") <= F.greatest("cut", F.lit(1e-6)))
        o = o.total(m=F.count_if("nxt")).with_columns(keep=F.when(F.col("m") >= 8, F.col("nxt")).otherwise(F.col("keep")))
    return o.result().groupBy(*keys).agg(F.max("a").alias("gain"), F.max("b").alias("offset"))


def circle_fit(points: DataFrame, keys: list[str], order: list[str], passes: int = 4) -> DataFrame:
    """Algebraic least-squares circle per group with residual trimming, from sums alone."""
    o = Ordered(points, keys, order).with_columns(keep=F.lit(True), z=F.col("x") * F.col("x") + F.col("y") * F.col("y"))

    def k(c):
        return F.when(F.col("keep"), F.col(c))
    for i in range(passes):
        o = o.total(mx=F.avg(k("x")), my=F.avg(k("y")), mz=F.avg(k("z")), sxx=F.var_pop(k("x")), syy=F.var_pop(k("y")),
                    sxy=F.covar_pop(k("x"), k("y")), sxz=F.covar_pop(k("x"), k("z")), syz=F.covar_pop(k("y"), k("z")))
        det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
        a = F.try_divide(F.col("sxz") * F.col("syy") - F.col("syz") * F.col("sxy"), det)
        b = F.try_divide(F.col("syz") * F.col("sxx") - F.col("sxz") * F.col("sxy"), det)
        c = F.col("mz") - a * F.col("mx") - b * F.col("my")
        o = o.with_columns(cx=a / 2, cy=b / 2).with_columns(
            r=F.sqrt(F.greatest(c + F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy"), F.lit(1e-9))))
        if i == passes - 1:
            break
        o = o.with_columns(e=F.abs(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("r")))
        o = o.total(sd=F.stddev_pop(k("e"))).with_columns(nxt=F.col("e") <= 2.5 * F.greatest("sd", F.lit(1.0)))
        o = o.total(m=F.count_if("nxt")).with_columns(keep=F.when(F.col("m") >= 24, F.col("nxt")).otherwise(F.col("keep")))
    return o.result().groupBy(*keys).agg(F.max("cx").alias("cx"), F.max("cy").alias("cy"), F.max("r").alias("r"),
                                         F.count_if("keep").alias("kept"))
