"""Censoring-correct Weibull analysis for many groups at once.

Median-rank regression is windows and regression aggregates. Likelihood fits of groups
that fit a task run there after one shuffle; a larger group reduces to repeated sums over
its rows where they lie, so no group is ever collected whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stamina.operators.ordered import Ordered, find_hot, hinted
from stamina.session import cut_lineage

# 90 % point of chi-square with one degree of freedom, bracket of the
# shape search, and the factors that bound the interval search.
CHI2_90 = 2.705543454095404
BETA_MIN, BETA_MAX = 0.02, 80.0
SEARCH_DOWN, SEARCH_UP = 0.01, 100.0
K10 = -math.log(0.9)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows with a reason)."""
    reason = (F.when(F.col("cycles").isNull() | (F.col("cycles") <= 0), "non-positive cycles")
              .when(F.col("status").isNull() | ~F.col("status").isin("failed", "suspended"),
                    "status is neither failed nor suspended"))
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def from_registry(specimens: DataFrame, in_test_as_suspended: bool = False) -> DataFrame:
    """Only failed and suspended specimens carry information."""
    keep = ["failed", "suspended"] + (["in_test"] if in_test_as_suspended else [])
    return (specimens.where(F.col("status").isin(*keep))
            .withColumn("status", F.when(F.col("status") == "in_test", "suspended")
                        .otherwise(F.col("status"))))


def median_ranks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Failures with Johnson-adjusted rank ``ar`` and Bernard median rank ``f``.

    The rank recurrence telescopes to (n+1)(1 - prod((n+1-k)/(n+2-k))) over failures,
    which is a running sum of logarithms.
    """
    o = (Ordered(df, keys, ["cycles", "specimen_id"]).row_number("k")
         .total(n=F.count(F.lit(1))))
    step = F.when(F.col("status") == "failed",
                  F.ln((F.col("n") + 1 - F.col("k")) / (F.col("n") + 2 - F.col("k"))))
    out = o.running_sum(__lp=step).result().where(F.col("status") == "failed")
    return (out.withColumn("ar", (F.col("n") + 1) * (1 - F.exp("__lp")))
            .withColumn("f", (F.col("ar") - 0.3) / (F.col("n") + 0.4)).drop("__lp"))


def b_life(beta: Column, eta: Column, fraction: float = 0.10) -> Column:
    return eta * F.pow(F.lit(-math.log(1.0 - fraction)), 1.0 / beta)


def fit_mrr(df: DataFrame, keys: list[str]) -> DataFrame:
    """Median-rank regression of ln t on ln(-ln(1-F)); needs two failures."""
    pts = median_ranks(df, keys).select(
        *keys, "n", F.ln("cycles").alias("x"), F.ln(-F.ln(1 - F.col("f"))).alias("y"))
    fit = pts.groupBy(*keys).agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("r_failures"),
        F.regr_slope("x", "y").alias("a"), F.regr_intercept("x", "y").alias("b"),
        F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("c")).where("r_failures >= 2 and a <> 0")
    beta, eta = 1 / F.col("a"), F.exp("b")
    return fit.select(*keys, beta.alias("beta"), eta.alias("eta"), b_life(beta, eta).alias("b10"),
                      "n", "r_failures", (F.col("n") - F.col("r_failures")).alias("suspensions"),
                      F.when(F.col("r_failures") > 2, F.col("c")).otherwise(1.0).alias("plot_r"))


def _log_units(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows as (keys, lt, failed) and per-group constants incl. the geometric mean."""
    rows = df.select(*keys, F.ln("cycles").alias("lt"), (F.col("status") == "failed").alias("failed"))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("r"), F.avg("lt").alias("tau"),
        F.stddev_pop("lt").alias("sd"), F.sum(F.when(F.col("failed"), F.col("lt"))).alias("lf"))
    base = base.where("r >= 2").select(
        *keys, "n", "r", "tau", "sd", (F.col("lf") - F.col("r") * F.col("tau")).alias("lf"),
        F.greatest(F.lit(BETA_MIN), F.least(F.lit(BETA_MAX), F.coalesce(
            F.try_divide(F.lit(1.2825), F.col("sd")), F.lit(BETA_MAX)))).alias("beta"))
    return rows, base


def _hot_split(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(rows of groups that fit a task, rows of hot groups, hot keys)."""
    found = find_hot(df, keys)
    if found is None:
        return df, None, None
    hot = hinted(found.select(*keys))
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi"), hot


def _moments(rows: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of u^beta, u^beta ln u, u^beta (ln u)^2 per hot group (params: one row each)."""
    lu = F.col("lt") - F.col("tau")
    w = F.exp(F.col("beta") * lu)
    sums = (rows.join(hinted(params.select(*keys, "tau", "beta")), keys).groupBy(*keys)
            .agg(F.sum(w).alias("s0"), F.sum(w * lu).alias("s1"), F.sum(w * lu * lu).alias("s2")))
    return params.join(sums, keys)


MLE_COLS = "beta double, eta double, b10 double, loglik double, n bigint, r_failures bigint, " \
           "suspensions bigint, tau double, lf double, ln_beta_se double, converged boolean"


def _keyed(keys: list[str], head, n: int) -> dict[str, pd.Series]:
    """Key columns of a task's result; plain objects whatever the key type."""
    return {k: pd.Series([head[k]] * n, dtype=object) for k in keys}


def _no_rows(columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def _mle_task(keys: list[str], steps: int):
    """Maximum likelihood of one group held by a task (bounded by the hot-key limit)."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        lt, failed = np.log(pdf["cycles"].to_numpy(float)), (pdf["status"] == "failed").to_numpy()
        out = _keyed(keys, pdf.iloc[0], 1)
        r, n = int(failed.sum()), len(pdf)
        cols = [c.split()[0] for c in MLE_COLS.split(", ")]
        if r < 2:
            return _no_rows(keys + cols)
        tau = lt.mean()
        u, lf = lt - tau, float((lt - tau)[failed].sum())
        lo, hi, beta = BETA_MIN, BETA_MAX, 1.2825 / max(u.std(), 1e-12)
        for _ in range(steps):
            beta = beta if lo < beta < hi else (lo * hi) ** 0.5
            w = np.exp(beta * u)
            m1 = (w * u).sum() / w.sum()
            score = 1 / beta + lf / r - m1
            lo, hi = (beta, hi) if score > 0 else (lo, beta)
            var = (w * u * u).sum() / w.sum() - m1 * m1
            step = score / (1 / beta ** 2 + var)
            beta += step
            if done := bool(abs(step) < 1e-13 * abs(beta) or hi - lo < 1e-14):
                break
        if not BETA_MIN * 1.0001 < beta < BETA_MAX * 0.9999:
            return _no_rows(keys + cols)
        w = np.exp(beta * u)
        s0, m1 = w.sum(), (w * u).sum() / w.sum()
        eta = np.exp(tau + np.log(s0 / r) / beta)
        ll = r * np.log(beta) - r * np.log(s0) + (beta - 1) * lf + r * np.log(r) - r - r * tau
        se = 1 / np.sqrt(r * (1 + beta ** 2 * ((w * u * u).sum() / s0 - m1 * m1)))
        vals = [beta, eta, eta * K10 ** (1 / beta), ll, n, r, n - r, tau, lf, se, done]
        return pd.DataFrame({**out, **{c: [v] for c, v in zip(cols, vals)}})
    return fit


def _key_ddl(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def fit_mle(df: DataFrame, keys: list[str], steps: int = 200) -> DataFrame:
    """Maximum likelihood with right censoring: safeguarded Newton on the shape score.

    A group that fits one task is solved there, after one shuffle. A hot group is solved
    by aggregations: each step sums over its rows where they lie and broadcasts the next
    shape. Groups whose score has no root in the bracket (for example all times equal)
    give no row; one whose fit has not settled after ``steps`` steps has what it came to, with ``converged`` false, at any size.
    """
    df = df.select(*keys, "cycles", "status")
    small, large, hot = _hot_split(df, keys)
    schema = f"{_key_ddl(df, keys)}, {MLE_COLS}"
    fitted = small.groupBy(*keys).applyInPandas(_mle_task(keys, steps), schema)
    if large is None:
        return fitted
    rows, params = _log_units(large, keys)
    start = F.when((F.col("beta") > BETA_MIN) & (F.col("beta") < BETA_MAX), F.col("beta")).otherwise(F.sqrt(F.lit(BETA_MIN * BETA_MAX)))
    params = cut_lineage(params.select(*keys, "n", "r", "tau", "lf", start.alias("beta"), F.lit(float(BETA_MIN)).alias("lo"),
                                       F.lit(float(BETA_MAX)).alias("hi"), F.lit(False).alias("done")))
    m1 = F.col("s1") / F.col("s0")
    score = 1 / F.col("beta") + F.col("lf") / F.col("r") - m1
    step = score / (1 / (F.col("beta") * F.col("beta")) + F.col("s2") / F.col("s0") - m1 * m1)
    for _ in range(steps):                               # the bracket and the stop rule of a group in one task
        m = _moments(rows, params, keys).withColumn("__up", score > 0).withColumn("__step", step)
        m = m.withColumn("lo", F.when(F.col("__up"), F.col("beta")).otherwise(F.col("lo"))).withColumn(
            "hi", F.when(F.col("__up"), F.col("hi")).otherwise(F.col("beta"))).withColumn("__to", F.col("beta") + F.col("__step"))
        end = F.col("done") | (F.abs("__step") < 1e-13 * F.abs("__to")) | (F.col("hi") - F.col("lo") < 1e-14)
        inside = (F.col("__to") > F.col("lo")) & (F.col("__to") < F.col("hi"))
        to = F.when(F.col("done"), F.col("beta")).when(inside | end, F.col("__to")).otherwise(F.sqrt(F.col("lo") * F.col("hi")))
        params = cut_lineage(m.select(*keys, "n", "r", "tau", "lf", to.alias("beta"), "lo", "hi", end.alias("done")))
        if params.where("not done").isEmpty():
            break
    m = _moments(rows, params, keys).where(
        (F.col("beta") > BETA_MIN * 1.0001) & (F.col("beta") < BETA_MAX * 0.9999))
    r, beta = F.col("r").cast("double"), F.col("beta")
    eta = F.exp(F.col("tau") + F.ln(F.col("s0") / r) / beta)
    ll = r * F.ln(beta) - r * F.ln(F.col("s0")) + (beta - 1) * F.col("lf") + r * F.ln(r) - r
    spread = 1 / F.sqrt(r * (1 + beta * beta * (F.col("s2") / F.col("s0") - m1 * m1)))
    return fitted.unionByName(m.select(
        *keys, "beta", eta.alias("eta"), b_life(beta, eta).alias("b10"),
        (ll - r * F.col("tau")).alias("loglik"), "n", F.col("r").alias("r_failures"),
        (F.col("n") - F.col("r")).alias("suspensions"), "tau", "lf", spread.alias("ln_beta_se"), F.col("done").alias("converged")))


def _scan_edges(beta, s, r, lf, llh):
    """(feasible shapes, ln B10 lower edge, ln B10 upper edge) for shapes with S(beta) = s."""
    k = llh - CHI2_90 / 2 - (r * np.log(beta) - r * np.log(s) + (beta - 1) * lf)
    ok = k <= r * np.log(r) - r
    beta, s, k = beta[ok], s[ok], k[ok]
    gap = np.sqrt(np.maximum(0.0, 2 * (r * np.log(r) - r - k) / r))
    edges = []
    for side in (1, -1):
        y = np.log(r) + side * gap
        for _ in range(40):
            slope = r - np.exp(y)
            y = np.where(np.abs(slope) < 1e-9, y, y - (r * y - np.exp(y) - k) / np.where(slope == 0, 1, slope))
        edges.append((math.log(K10) + np.log(s) - y) / beta)
    return beta, edges[0], edges[1]


GRID = 48
CI_COLS = "b10_lo double, b10_hi double"


def _bounds_row(keys, head, lo, hi):
    b10 = head["b10"]
    lo = lo if lo >= b10 * SEARCH_DOWN else None
    hi = hi if hi <= b10 * SEARCH_UP else None
    return pd.DataFrame({**_keyed(keys, head, 1), "b10_lo": [lo], "b10_hi": [hi]})


def b10_interval(df: DataFrame, mle: DataFrame, keys: list[str]) -> DataFrame:
    """90 % likelihood-ratio bounds on B10 (``b10_lo``, ``b10_hi``).

    The region of acceptable (shape, B10) is scanned over the shape: for a given shape
    the likelihood depends on B10 only through z = sum((t/eta)^shape), so the two edges
    follow from z, a root in one variable. The data enter only through S(shape) =
    sum(u^shape) on a grid of shapes, refined once around each extreme. Small groups
    evaluate S in their task; a hot group gets it from one aggregation per grid.
    """
    cols = ["beta", "tau", "lf", "r_failures", "b10", "loglik", "ln_beta_se"]
    fits = mle.select(*keys, *cols)
    rows = df.select(*keys, "cycles")
    small, large, hot = _hot_split(rows, keys)
    schema = f"{_key_ddl(df, keys)}, {CI_COLS}"

    def grids(head):
        span = max(0.02, 6 * head["ln_beta_se"])
        rel = np.linspace(-1, 1, 2 * GRID + 1)
        return np.clip(head["beta"] * np.exp(span * rel), BETA_MIN, BETA_MAX), span / GRID * rel * 1.5

    def solve(left, right):
        if len(left) == 0 or len(right) == 0:
            return _no_rows([*keys, "b10_lo", "b10_hi"])
        head = right.iloc[0]
        u = np.log(left["cycles"].to_numpy(float)) - head["tau"]
        r, llh = float(head["r_failures"]), head["loglik"] + head["r_failures"] * head["tau"]

        def edges(beta):
            s = np.array([np.exp(b * u).sum() for b in beta])
            return _scan_edges(beta, s, r, head["lf"], llh)
        coarse, step = grids(head)
        b, lo, hi = edges(coarse)
        _, lo, _ = edges(b[lo.argmin()] * np.exp(step))
        _, _, hi = edges(b[hi.argmax()] * np.exp(step))
        return _bounds_row(keys, head, np.exp(lo.min() + head["tau"]), np.exp(hi.max() + head["tau"]))

    out = small.groupBy(*keys).cogroup(fits.groupBy(*keys)).applyInPandas(solve, schema)
    if large is None:
        return out
    # a hot group brings at most 4*GRID+2 shapes and sums per grid, so these tables stay
    # within the hot-key bound as well
    heads = cut_lineage(fits.join(hot, keys, "left_semi"))
    grid_schema = f"{_key_ddl(df, keys)}, tau double, beta double"

    def sums(grid):
        w = F.exp(F.col("beta") * (F.ln("cycles") - F.col("tau")))
        return (large.join(hinted(cut_lineage(grid)), keys).groupBy(*keys, "beta").agg(F.sum(w).alias("s"))
                .withColumnRenamed("beta", "b"))

    def coarse_grid(pdf):
        head = pdf.iloc[0]
        g = np.unique(grids(head)[0])
        return pd.DataFrame({**_keyed(keys, head, len(g)), "tau": head["tau"], "beta": g})

    def extremes(left, right):
        head = right.iloc[0]
        b, lo, hi = _scan_edges(left["b"].to_numpy(), left["s"].to_numpy(), float(head["r_failures"]),
                                head["lf"], head["loglik"] + head["r_failures"] * head["tau"])
        return head, b, lo, hi

    def fine_grid(left, right):
        head, b, lo, hi = extremes(left, right)
        step = grids(head)[1]
        g = np.unique(np.concatenate([b[lo.argmin()] * np.exp(step), b[hi.argmax()] * np.exp(step)]))
        return pd.DataFrame({**_keyed(keys, head, len(g)), "tau": head["tau"], "beta": g})

    def bounds(left, right):
        head, b, lo, hi = extremes(left, right)
        return _bounds_row(keys, head, np.exp(lo.min() + head["tau"]), np.exp(hi.max() + head["tau"]))

    first = sums(heads.groupBy(*keys).applyInPandas(coarse_grid, grid_schema))
    grid = cut_lineage(first.groupBy(*keys).cogroup(heads.groupBy(*keys)).applyInPandas(fine_grid, grid_schema))
    return out.unionByName(sums(grid).groupBy(*keys).cogroup(heads.groupBy(*keys))
                           .applyInPandas(bounds, schema))


def regime(beta: Column) -> Column:
    return F.when(beta < 0.8, "infant mortality").when(beta < 1.2, "random").otherwise("wear-out")


def analyze(df: DataFrame, keys: list[str], interval: bool = True) -> DataFrame:
    """Both fits, the headline (MLE, else MRR), counts and the reasons of a refusal."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                   F.count_if(F.col("status") == "failed").alias("r_failures"))
    mrr = fit_mrr(df, keys).select(*keys, F.struct("beta", "eta", "b10", "plot_r").alias("mrr"))
    raw = fit_mle(df, keys)
    mle = raw.select(*keys, F.struct("beta", "eta", "b10", "loglik").alias("mle"))
    out = counts.join(mrr, keys, "left").join(mle, keys, "left")
    if interval:
        out = out.join(b10_interval(df, raw, keys), keys, "left")
    else:
        out = out.withColumn("b10_lo", F.lit(None).cast("double")).withColumn("b10_hi", F.lit(None).cast("double"))
    few = F.col("r_failures") < 2
    errors = F.array_compact(F.array(
        F.when(few, F.concat(F.lit("mrr: MRR needs >= 2 failures (have "), F.col("r_failures"), F.lit(")"))),
        F.when(few, F.concat(F.lit("mle: MLE needs >= 2 failures (have "), F.col("r_failures"), F.lit(")")))
        .when(F.col("mle").isNull(), F.lit("mle: no root of the shape score in range"))))
    return out.select(
        *keys, "n", "r_failures", (F.col("n") - F.col("r_failures")).alias("suspensions"),
        F.when(F.col("mle").isNotNull(), "MLE").when(F.col("mrr").isNotNull(), "MRR").alias("method"),
        *[F.coalesce(F.col(f"mle.{c}"), F.col(f"mrr.{c}")).alias(c) for c in ("beta", "eta", "b10")],
        "b10_lo", "b10_hi", errors.alias("errors"))


def summary_line(df: DataFrame) -> Column:
    """One sentence per analysed group; interval text has three cases."""
    def whole(c):
        return F.format_number(F.col(c), 0)
    ci = (F.when(F.col("b10_lo").isNotNull() & F.col("b10_hi").isNotNull(), F.concat(
        F.lit(" (90% CI "), whole("b10_lo"), F.lit(".."), whole("b10_hi"), F.lit(")")))
        .when(F.col("b10_lo").isNotNull(), F.concat(F.lit(" (90% LCB "), whole("b10_lo"), F.lit(")")))
        .otherwise(""))
    text = F.concat(F.lit("B10 = "), whole("b10"), F.lit(" cycles"), ci, F.lit("  |  beta "),
                    F.format_string("%.2f", F.col("beta")), F.lit(" ("), regime(F.col("beta")),
                    F.lit("), eta "), whole("eta"), F.lit("  |  "), F.col("method"), F.lit(", n="),
                    F.col("n"), F.lit(" ("), F.col("r_failures"), F.lit(" failures, "),
                    F.col("suspensions"), F.lit(" susp)"))
    return F.when(F.col("method").isNull(), F.concat(
        F.lit("no Weibull fit possible: "), F.array_join("errors", "; "))).otherwise(text)


def plot_points(df: DataFrame, keys: list[str], fit: DataFrame, samples: int = 50) -> DataFrame:
    """Probability-plot rows: failures, suspension marks and the fitted line."""
    fails = median_ranks(df, keys).select(
        *keys, F.lit("failure").alias("kind"), F.ln("cycles").alias("x"),
        F.ln(-F.ln(1 - F.col("f"))).alias("y"))
    susp = df.where("status = 'suspended'").select(
        *keys, F.lit("suspension").alias("kind"), F.ln("cycles").alias("x"),
        F.lit(None).cast("double").alias("y"))
    ends = df.groupBy(*keys).agg(
        (F.min(F.when(F.col("status") == "failed", F.col("cycles"))) * 0.7).alias("t0"),
        (F.max("cycles") * 1.3).alias("t1"))
    line = (fit.join(ends, keys).select(*keys, "beta", "eta", "t0", "t1",
                                        F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("i"))
            .withColumn("x", F.ln(F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("i") / (samples - 1)))
            .select(*keys, F.lit("fit").alias("kind"), "x",
                    (F.col("beta") * (F.col("x") - F.ln("eta"))).alias("y")))
    return fails.unionByName(susp).unionByName(line)


def accrual(df: DataFrame, keys: list[str], stages: int = 4) -> DataFrame:
    """Interval width as specimens accrue: refit on the first 1/stages, 2/stages, ... of them."""
    o = Ordered(df, keys, ["specimen_id"]).row_number("__k").total(__n=F.count(F.lit(1))).result()
    first = F.ceil(F.col("__k") * stages / F.col("__n")).cast("int")
    grown = o.withColumn("stage", F.explode(F.sequence(first, F.lit(stages)))).drop("__k", "__n")
    res = analyze(grown, [*keys, "stage"])
    return res.select(*keys, "stage", "n", "r_failures", "b10", "b10_lo", "b10_hi",
                      (F.ln("b10_hi") - F.ln("b10_lo")).alias("ln_width"))
