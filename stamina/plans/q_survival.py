"""Survival analysis queries."""

from pyspark.sql import functions as F

from stamina.operators import survival as S
from stamina.plans.bindings import oracle
from stamina.plans.registry import query, rounded

RANKS = """r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY cycles, specimen_id) AS k,
  COUNT(*) OVER (PARTITION BY grp) AS n FROM survival),
m AS (SELECT *, (n+1)*(1-exp(SUM(CASE WHEN status='failed' THEN ln((n+1-k)/CAST(n+2-k AS DOUBLE)) ELSE 0 END)
  OVER (PARTITION BY grp ORDER BY k ROWS UNBOUNDED PRECEDING))) AS ar FROM r),
ranks AS (SELECT *, (ar-0.3e0)/(n+0.4e0) AS f FROM m WHERE status='failed')"""
MRR = RANKS + """, pts AS (SELECT grp, n, ln(cycles) AS x, ln(-ln(1-f)) AS y FROM ranks),
fit AS (SELECT grp, MAX(n) AS n, COUNT(*) AS r_failures, regr_slope(x,y) AS a, regr_intercept(x,y) AS b, corr(x,y) AS c
  FROM pts GROUP BY grp HAVING COUNT(*) >= 2),
mrr AS (SELECT grp, 1/a AS beta, exp(b) AS eta, exp(b)*pow(-ln(0.9e0), a) AS b10, n, r_failures,
  n-r_failures AS suspensions, CASE WHEN r_failures>2 THEN c ELSE 1e0 END AS plot_r FROM fit)"""
MLE = """g AS (SELECT grp, COUNT(*) AS n, COUNT(*) FILTER (status='failed') AS r, AVG(ln(cycles)) AS tau,
  list(ln(cycles)) AS lts, SUM(CASE WHEN status='failed' THEN ln(cycles) ELSE 0 END) AS lf FROM survival GROUP BY grp
  HAVING COUNT(*) FILTER (status='failed') >= 2),
u AS (SELECT grp, n, r, tau, list_transform(lts, lambda x: x-tau) AS lu, lf/r-tau AS mf FROM g),
bis AS (SELECT grp, 0.02e0 AS lo, 80e0 AS hi, 0 AS i FROM u UNION ALL
  SELECT b.grp, CASE WHEN s > 0 THEN mid ELSE lo END, CASE WHEN s > 0 THEN hi ELSE mid END, i+1 FROM (
   SELECT q.grp, q.lo, q.hi, q.i, q.mid, 1/q.mid + u.mf - list_sum(list_transform(u.lu, lambda x: exp(q.mid*x)*x))
     / list_sum(list_transform(u.lu, lambda x: exp(q.mid*x))) AS s
   FROM (SELECT *, (lo+hi)/2 AS mid FROM bis WHERE i < 70) q JOIN u USING (grp)) b),
mle AS (SELECT u.grp, b.lo AS beta, exp(u.tau + ln(list_sum(list_transform(u.lu, lambda x: exp(b.lo*x)))/u.r)/b.lo) AS eta,
  u.n, u.r AS r_failures, u.n-u.r AS suspensions, u.lu, u.tau, u.mf FROM u JOIN bis b ON u.grp=b.grp AND b.i=70)"""


@query("w1_median_ranks", oracle(
    "SELECT grp, specimen_id, k, n, round(ar,6) AS ar, round(f,6) AS f FROM ranks", "survival", ctes=RANKS))
def _(t):
    return rounded(S.median_ranks(t.survival, ["grp"]).select("grp", "specimen_id", "k", "n", "ar", "f"))


@query("l2_weibull_mrr", oracle(
    """SELECT grp, round(beta,6) AS beta, round(eta,4) AS eta, round(b10,4) AS b10, n, r_failures, suspensions,
    round(plot_r,6) AS plot_r FROM mrr""", "survival", ctes=MRR))
def _(t):
    return rounded(S.fit_mrr(t.survival, ["grp"]), eta=4, b10=4)


@query("l3_weibull_mle", oracle(
    """SELECT grp, round(beta,6) AS beta, round(eta,4) AS eta, round(eta*pow(-ln(0.9e0),1/beta),4) AS b10,
    round(r_failures*ln(beta)-r_failures*beta*ln(eta)+(beta-1)*r_failures*(mf+tau)-r_failures,5) AS loglik,
    n, r_failures, suspensions, true AS converged FROM mle""", "survival", ctes=MLE))
def _(t):
    return rounded(S.fit_mle(t.survival, ["grp"]).drop("tau", "lf", "ln_beta_se"), eta=4, b10=4, loglik=5)


@query("l1_survival_reject", oracle(
    """SELECT specimen_id, cycles, status, CASE WHEN cycles IS NULL OR cycles <= 0 THEN 'non-positive cycles'
    ELSE 'status is neither failed nor suspended' END AS reason FROM (
    SELECT c_custkey AS specimen_id, round(c_acctbal,2) AS cycles, CASE c_custkey%5 WHEN 0 THEN 'virgin' WHEN 1 THEN NULL
    ELSE 'failed' END AS status FROM customer)
    WHERE cycles IS NULL OR cycles <= 0 OR status IS NULL OR status NOT IN ('failed','suspended')"""))
def _(t):
    k = F.col("c_custkey") % 5
    src = t("customer").select(F.col("c_custkey").alias("specimen_id"), F.round("c_acctbal", 2).alias("cycles"),
                               F.when(k == 0, "virgin").when(k != 1, "failed").alias("status"))
    return S.split_valid(src)[1]


@query("l4_b_life", oracle(
    """SELECT grp, CAST(pct AS INTEGER) AS pct, round(eta*pow(-ln(1-pct/100e0),1/beta),4) AS life FROM mrr,
    (VALUES (1),(10),(50)) v(pct)""", "survival", ctes=MRR))
def _(t):
    fit = S.fit_mrr(t.survival, ["grp"])
    lives = F.explode(F.array(*[F.struct(F.lit(p).alias("pct"), S.b_life(F.col("beta"), F.col("eta"), p / 100)
                                         .alias("life")) for p in (1, 10, 50)]))
    return rounded(fit.select("grp", lives.alias("v")).select("grp", "v.pct", "v.life"), 4)


@query("l5_b10_interval")
def _(t):
    return rounded(S.b10_interval(t.survival, S.fit_mle(t.survival, ["grp"]), ["grp"]), 2)


@query("l6_headline", oracle(
    """, c AS (SELECT grp, COUNT(*) AS n, COUNT(*) FILTER (status='failed') AS r FROM survival GROUP BY grp)
    SELECT c.grp, c.n, c.r AS r_failures, c.n-c.r AS suspensions,
    CASE WHEN mle.grp IS NOT NULL THEN 'MLE' WHEN mrr.grp IS NOT NULL THEN 'MRR' END AS method,
    round(coalesce(mle.beta,mrr.beta),6) AS beta, round(coalesce(mle.eta,mrr.eta),4) AS eta,
    CASE WHEN c.r<2 THEN 'mrr: MRR needs >= 2 failures (have '||c.r||'); mle: MLE needs >= 2 failures (have '||c.r||')' ELSE '' END AS errors
    FROM c LEFT JOIN mrr USING (grp) LEFT JOIN mle USING (grp)""", "survival", ctes=MRR + ", " + MLE))
def _(t):
    a = S.analyze(t.survival, ["grp"], interval=False)
    return rounded(a.select("grp", "n", "r_failures", "suspensions", "method", "beta", "eta",
                            F.array_join("errors", "; ").alias("errors")), eta=4)


@query("l7_probability_plot", oracle(
    """, pl AS (SELECT grp, 'failure' AS kind, x, y FROM pts UNION ALL
    SELECT grp, 'suspension', ln(cycles), NULL FROM survival WHERE status='suspended' UNION ALL
    SELECT grp, 'fit', x, beta*(x-ln(eta)) FROM (SELECT mrr.grp, beta, eta, ln(t0+(t1-t0)*i/49e0) AS x FROM mrr
      JOIN (SELECT grp, MIN(cycles) FILTER (status='failed')*0.7e0 AS t0, MAX(cycles)*1.3e0 AS t1 FROM survival GROUP BY grp) e
      USING (grp), (SELECT unnest(range(50)) AS i)))
    SELECT grp, kind, round(x,6) AS x, round(y,6) AS y FROM pl""", "survival", ctes=MRR))
def _(t):
    return rounded(S.plot_points(t.survival, ["grp"], S.fit_mrr(t.survival, ["grp"])))


REG = """reg AS (SELECT c_custkey AS specimen_id, c_acctbal*100 AS cycles, CASE c_custkey%5 WHEN 0 THEN 'virgin'
 WHEN 1 THEN 'in_test' WHEN 2 THEN 'failed' WHEN 3 THEN 'suspended' ELSE 'retired' END AS status FROM customer)"""


def _registry(t):
    k = F.col("c_custkey") % 5
    return t("customer").select(
        F.col("c_custkey").alias("specimen_id"), (F.col("c_acctbal") * 100).alias("cycles"),
        F.when(k == 0, "virgin").when(k == 1, "in_test").when(k == 2, "failed").when(k == 3, "suspended")
        .otherwise("retired").alias("status"))


@query("l8_survival_rows", oracle(
    """SELECT specimen_id, round(cycles,4) AS cycles, CASE WHEN status='in_test' THEN 'suspended' ELSE status END AS status
    FROM reg WHERE status IN ('failed','suspended','in_test')""", ctes=REG))
def _(t):
    return rounded(S.from_registry(_registry(t), in_test_as_suspended=True), 4)


@query("l9_accrual")
def _(t):
    return rounded(S.accrual(t.survival, ["grp"]), 4)


@query("p32_regime", oracle(
    """SELECT grp, CASE WHEN beta<0.8 THEN 'infant mortality' WHEN beta<1.2 THEN 'random' ELSE 'wear-out' END AS regime,
    'B10 = '||format('{:,}',CAST(round(b10) AS BIGINT))||' cycles  |  beta '||printf('%.2f',beta)||' ('||CASE WHEN beta<0.8
    THEN 'infant mortality' WHEN beta<1.2 THEN 'random' ELSE 'wear-out' END||'), eta '||format('{:,}',CAST(round(eta) AS BIGINT))
    ||'  |  MRR, n='||n||' ('||r_failures||' failures, '||suspensions||' susp)' AS summary FROM mrr""", "survival", ctes=MRR))
def _(t):
    f = (S.fit_mrr(t.survival, ["grp"]).withColumn("method", F.lit("MRR"))
         .withColumn("b10_lo", F.lit(None).cast("double")).withColumn("b10_hi", F.lit(None).cast("double"))
         .withColumn("errors", F.array().cast("array<string>")))
    return f.select("grp", S.regime(F.col("beta")).alias("regime"), S.summary_line(f).alias("summary"))
