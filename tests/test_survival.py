import math

import numpy as np
import pytest

from stamina.operators import survival as S


def table(spark, rows):
    return spark.createDataFrame([(g, i, float(t), s) for i, (g, t, s) in enumerate(rows)],
                                 "grp string, specimen_id int, cycles double, status string")


def sample(seed, n, censor):
    rng = np.random.default_rng(seed)
    t = 1e5 * rng.weibull(2.2, n)
    return [("g", min(x, censor), "failed" if x < censor else "suspended") for x in t]


def loglik(beta, eta, t, f):
    z = (t / eta) ** beta
    return -z.sum() + (np.log(beta / eta) + (beta - 1) * np.log(t[f] / eta)).sum()


def test_exact_quantiles_are_recovered(spark):
    rows = []
    for i in range(1, 11):
        p = (i - 0.3) / 10.4
        rows.append(("g", 1e5 * (-math.log(1 - p)) ** (1 / 2.5), "failed"))
    f = S.fit_mrr(table(spark, rows), ["grp"]).first()
    assert f.beta == pytest.approx(2.5, rel=0.01) and f.eta == pytest.approx(1e5, rel=0.01) and f.plot_r > 0.999


def test_ranks_follow_the_recurrence(spark, segment):
    rows = sample(7, 40, 9e4)
    got = {r.cycles: r.ar for r in S.median_ranks(table(spark, rows), ["grp"]).collect()}
    ordered, prev, n = sorted(rows, key=lambda r: r[1]), 0.0, len(rows)
    for k, (_, t, s) in enumerate(ordered, 1):
        if s == "failed":
            prev += (n + 1 - prev) / (n + 2 - k)
            assert got[t] == pytest.approx(prev)


def test_mle_and_interval(spark, segment):
    rows = sample(3, 30, 1.2e5)
    df = table(spark, rows)
    m = S.fit_mle(df, ["grp"])
    fit = m.first()
    t, f = np.array([r[1] for r in rows]), np.array([r[2] == "failed" for r in rows])
    lo, hi = 0.02, 80.0
    u = t / np.exp(np.log(t).mean())
    for _ in range(200):
        mid = (lo + hi) / 2
        score = 1 / mid + np.log(u[f]).mean() - (u ** mid * np.log(u)).sum() / (u ** mid).sum()
        lo, hi = (mid, hi) if score > 0 else (lo, mid)
    assert fit.beta == pytest.approx(lo, rel=1e-8)
    assert fit.loglik == pytest.approx(loglik(fit.beta, fit.eta, t, f), rel=1e-9)
    ci = S.b10_interval(df, m, ["grp"]).first()

    def excess(b10):
        k10 = -math.log(0.9)
        best = max(loglik(b, b10 / k10 ** (1 / b), t, f) for b in np.exp(np.linspace(math.log(fit.beta / 3), math.log(fit.beta * 3), 4000)))
        return 2 * (fit.loglik - best) - S.CHI2_90
    assert ci.b10_lo < fit.b10 < ci.b10_hi
    assert abs(excess(ci.b10_lo)) < 2e-3 and abs(excess(ci.b10_hi)) < 2e-3


def test_headline_and_refusal(spark):
    mixed = [("m", 1e4, "failed"), ("m", 2e4, "failed"), ("m", 3e4, "suspended"), ("m", 4e4, "failed"), ("m", 5e4, "suspended"),
             ("x", 1e4, "failed"), ("x", 2e4, "suspended"), ("x", 3e4, "suspended"), ("e", 5.0, "failed"), ("e", 5.0, "failed"), ("e", 5.0, "failed")]
    a = S.analyze(table(spark, mixed), ["grp"])
    r = {x.grp: x for x in a.withColumn("line", S.summary_line(a)).collect()}
    assert (r["m"].method, r["m"].suspensions, r["m"].r_failures) == ("MLE", 2, 3)
    assert r["m"].line.startswith("B10 = ") and "MLE, n=5 (3 failures, 2 susp)" in r["m"].line
    assert r["x"].method is None and len(r["x"].errors) == 2 and r["x"].line.startswith("no Weibull fit possible")
    assert any("no root" in e for e in r["e"].errors)


def test_invalid_rows_are_rejected(spark):
    df = table(spark, [("g", 0.0, "failed"), ("g", 5.0, "virgin"), ("g", 5.0, "failed")])
    good, bad = S.split_valid(df)
    assert good.count() == 1 and bad.count() == 2


def test_unsettled_fits_have_one_rule_at_any_size(spark, segment):
    """Too few steps: small groups and hot ones both return what they came to, and say so."""
    rows = [(g, float(10 + 7 * i * i % 90 + i), "failed") for g in ("a", "b") for i in range(3 if g == "a" else 40)]
    df = spark.createDataFrame(rows, "grp string, cycles double, status string")
    fits = {steps: {r.grp: r for r in S.fit_mle(df, ["grp"], steps=steps).collect()} for steps in (1, 200)}
    assert {r.converged for r in fits[1].values()} == {False} and {r.converged for r in fits[200].values()} == {True}
    assert all(abs(fits[1][g].beta - fits[200][g].beta) < 1.0 for g in fits[200])
