"""Scalar conversions, classifications, feasibility and data-quality queries."""

from pyspark.sql import functions as F

from stamina.functions import units as U
from stamina.operators import feasibility as D
from stamina.plans.bindings import oracle
from stamina.plans.registry import query, rounded

CELLS = """cells AS (SELECT doc_id, CASE doc_id%6 WHEN 0 THEN ' '||n_chars||'.5 ' WHEN 1 THEN '' WHEN 2 THEN lang
 WHEN 3 THEN '1e999' WHEN 4 THEN '-'||n_chars WHEN 5 THEN 'NaN' END AS cell FROM documents)"""


def _cells(t):
    k, n = F.col("doc_id") % 6, F.col("n_chars").cast("string")
    return t("documents").select("doc_id", F.when(k == 0, F.concat(F.lit(" "), n, F.lit(".5 "))).when(k == 1, "")
                                 .when(k == 2, F.col("lang")).when(k == 3, "1e999")
                                 .when(k == 4, F.concat(F.lit("-"), n)).otherwise("NaN").alias("cell"))


@query("s2_lenient_cell", oracle(
    """SELECT doc_id, CASE WHEN doc_id%6 IN (0,4) THEN CAST(trim(cell) AS DOUBLE) END AS finite,
    CASE WHEN doc_id%6 IN (0,4) THEN CAST(trim(cell) AS DOUBLE) WHEN doc_id%6=5 THEN -1e0 ELSE -2e0 END AS coded FROM cells""",
    ctes=CELLS))
def _(t):
    num = U.lenient_double(F.col("cell"), nan_for_missing=True)
    return _cells(t).select(
        "doc_id", F.when(~F.isnan(U.lenient_double(F.col("cell"), finite=True)),
                         U.lenient_double(F.col("cell"), finite=True)).alias("finite"),
        F.when(F.abs(num) == float("inf"), -2.0).when(F.isnan(num) & (F.col("cell") == "NaN"), -1.0)
        .when(F.isnan(num), -2.0).otherwise(num).alias("coded"))


@query("p1_monitor_units", oracle(
    """SELECT event_id, round(value*0.01e0,6) AS control_v, kind, round(CASE kind WHEN 'FREQUENCY' THEN event_id%7
    WHEN 'PK2PK' THEN abs(value*0.02e0*gain) WHEN 'MAXIMUM' THEN sign*gain*(CASE WHEN sign<0 THEN -value ELSE value END)*0.01e0
    ELSE sign*gain*(CASE WHEN sign<0 THEN value ELSE -value END)*0.01e0 END,6) AS v FROM (SELECT *, CASE event_id%4 WHEN 0 THEN
    'FREQUENCY' WHEN 1 THEN 'PK2PK' WHEN 2 THEN 'MAXIMUM' ELSE 'MINIMUM' END AS kind, CASE WHEN event_id%3=0 THEN -1e0 ELSE 1e0
    END AS sign, CASE WHEN event_id%2=0 THEN 1e0 ELSE 200e0 END AS gain FROM events)"""))
def _(t):
    i, v = F.col("event_id"), F.col("value")
    e = t("events").select(
        "event_id", U.control_volts(v * 0.01).alias("control_v"),
        F.when(i % 4 == 0, "FREQUENCY").when(i % 4 == 1, "PK2PK").when(i % 4 == 2, "MAXIMUM")
        .otherwise("MINIMUM").alias("kind"), F.when(i % 3 == 0, -1.0).otherwise(1.0).alias("sign"),
        F.when(i % 2 == 0, "v").otherwise("i").alias("ch"),
        F.create_map(F.lit("FREQUENCY"), (i % 7).cast("double"), F.lit("PK2PK"), v * 0.02, F.lit("MAXIMUM"), v * 0.01,
                     F.lit("MINIMUM"), -v * 0.01).alias("st"))
    return rounded(e.select("event_id", "control_v", "kind", U.monitor_value(
        F.col("kind"), F.col("ch"), F.col("st"), F.col("sign")).alias("v")))


@query("p2_reading_status", oracle(
    """SELECT event_id, CASE WHEN event_id%5=0 THEN NULL WHEN event_id%5=1 THEN NULL ELSE value END AS val,
    CASE event_id%5 WHEN 0 THEN 'invalid' WHEN 1 THEN 'offscreen' ELSE 'ok' END AS status FROM events"""))
def _(t):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.col("event_type")).when(k == 1, "9.9E37").otherwise(F.col("value").cast("string"))
    v, s = U.reading_status(raw)
    return t("events").select("event_id", v.alias("val"), s.alias("status"))


ELEC = """el AS (SELECT p_partkey, CASE p_partkey%9 WHEN 0 THEN 'SWNT ink '||p_size WHEN 1 THEN 'Invisicon 3900' WHEN 2 THEN 'CB'
 WHEN 3 THEN ' Carbon Black' WHEN 4 THEN 'eGaIn' WHEN 5 THEN '  ' WHEN 6 THEN NULL ELSE p_name END AS txt,
 CASE p_partkey%4 WHEN 0 THEN '2.5' WHEN 1 THEN 'inf' WHEN 2 THEN '-1' ELSE p_brand END AS conc FROM part)"""


@query("p3_electrode_family", oracle(
    """, f AS (SELECT *, ' '||lower(trim(txt))||' ' AS p FROM el), g AS (SELECT *, CASE WHEN txt IS NULL OR trim(txt)='' THEN NULL
    WHEN regexp_matches(p,'cnt|carbon nanotube|nanotube|swnt|mwnt|invisicon|nano-c') THEN 'cnt'
    WHEN regexp_matches(p,'carbon black|carbonblack|cb | cb|c-black') THEN 'carbon_black'
    WHEN regexp_matches(p,'egain|e-gain|galinstan|liquid metal|liquidmetal') THEN 'liquid_metal' ELSE 'other' END AS family FROM f)
    SELECT p_partkey, family, coalesce(family,'') NOT IN ('carbon_black','liquid_metal') AS applies,
    CASE WHEN p_partkey%4=0 THEN 2.5e0 END AS ml FROM g""", ctes=ELEC))
def _(t):
    k = F.col("p_partkey")
    e = t("part").select(
        "p_partkey", F.when(k % 9 == 0, F.concat(F.lit("SWNT ink "), F.col("p_size"))).when(k % 9 == 1, "Invisicon 3900")
        .when(k % 9 == 2, "CB").when(k % 9 == 3, " Carbon Black").when(k % 9 == 4, "eGaIn").when(k % 9 == 5, "  ")
        .when(k % 9 == 6, None).otherwise(F.col("p_name")).alias("txt"),
        F.when(k % 4 == 0, "2.5").when(k % 4 == 1, "inf").when(k % 4 == 2, "-1").otherwise(F.col("p_brand")).alias("conc"))
    return e.select("p_partkey", U.electrode_family(F.col("txt")).alias("family"),
                    U.concentration_applies(F.col("txt")).alias("applies"), U.concentration_ml(F.col("conc")).alias("ml"))


@query("p4_exposure", oracle(
    """SELECT vec_id, round(m,6) AS mean, round(s,6) AS sat_pct, CASE WHEN s>=20 OR m>=225 THEN 'clipped' WHEN m<40 THEN 'dark'
    WHEN m>215 OR s>8 THEN 'bright' ELSE 'ok' END AS verdict FROM (SELECT vec_id, list_avg(px) AS m,
    len(list_filter(px, lambda p: p>=250))*100e0/len(px) AS s FROM (SELECT vec_id,
    list_transform(embedding, lambda x: least(255e0, abs(CAST(x AS DOUBLE))*(200+vec_id%9*150))) AS px FROM embeddings))"""))
def _(t):
    px = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.abs(x.cast("double")) * (200 + F.col("vec_id") % 9 * 150)))
    e = t("embeddings").select("vec_id", px.alias("px")).select(
        "vec_id", (F.aggregate("px", F.lit(0.0), lambda a, x: a + x) / F.size("px")).alias("mean"),
        U.saturation_pct(F.col("px")).alias("sat_pct"))
    return rounded(e.withColumn("verdict", U.exposure_verdict(F.col("mean"), F.col("sat_pct"))))


@query("p5_credible_rest", oracle("""SELECT sample_id, coalesce(abs(ua-50) <= least(30e0, 0.5e0*kv*100), false) AS credible
    FROM telemetry""", "telemetry"))
def _(t):
    return t.telemetry.select("sample_id", U.credible_rest_level(F.col("ua") - 50, F.col("kv") * 100).alias("credible"))


@query("p6_frequency_ok", oracle("""SELECT sample_id, coalesce(CASE WHEN cmd>0 THEN abs(f_meas*(1+kv/20)-cmd)/cmd<=0.02e0 END,false) AS ok
    FROM (SELECT *, CAST(sample_id%4 AS DOUBLE) AS cmd FROM telemetry)""", "telemetry"))
def _(t):
    return t.telemetry.select("sample_id", U.frequency_ok(F.col("f_meas") * (1 + F.col("kv") / 20),
                                                          (F.col("sample_id") % 4).cast("double")).alias("ok"))


@query("p7_environment", oracle(
    """SELECT o_orderkey, coalesce(age<=1800,false) AS fresh, coalesce(tc BETWEEN 15 AND 30 AND p BETWEEN 900 AND 1100,false) AS in_band
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey%7=0 THEN NULL ELSE o_orderkey%3600 END AS age, 10e0+o_orderkey%25 AS tc,
    850e0+o_custkey%300 AS p FROM orders)"""))
def _(t):
    k = F.col("o_orderkey")
    fresh, band = U.environment_state(10.0 + k % 25, 850.0 + F.col("o_custkey") % 300, F.when(k % 7 != 0, k % 3600),
                                      (15.0, 30.0), (900.0, 1100.0))
    return t("orders").select("o_orderkey", fresh.alias("fresh"), band.alias("in_band"))


@query("p8_pressure_advisory", oracle(
    """SELECT event_id, CASE WHEN p IS NULL THEN 'not evaluated: no pressure attested' WHEN p BETWEEN 1 AND 10000 THEN
    'inside the low-breakdown pressure band' ELSE '' END AS note FROM (SELECT event_id, CASE WHEN event_type='error' THEN NULL
    ELSE value*1000 END AS p FROM events)"""))
def _(t):
    p = F.when(F.col("event_type") != "error", F.col("value") * 1000)
    return t("events").select("event_id", U.pressure_advisory(p).alias("note"))


@query("p9_sine_feasibility", oracle(
    """, d AS (SELECT specimen_id, c_est_nf>0 AS known, 2*pi()*f*c_est_nf*0.5e0*vpk AS ipk, 2*pi()*f*0.5e0*vpk*1000/1e6 AS slew, f,
    (0.9e0*2000-50)/nullif(2*pi()*c_est_nf*0.5e0*vpk,0) AS fmax FROM (SELECT *, 1e0+specimen_id%50*30 AS f, 1e0+specimen_id%9 AS vpk FROM specimens))
    SELECT specimen_id, CASE WHEN NOT coalesce(known,false) THEN 'warn' WHEN (ipk+50)/2000>=0.9e0 OR slew>35 OR f>1200 THEN 'refuse'
    WHEN (ipk+50)/2000>=0.6e0 THEN 'warn' ELSE 'ok' END AS verdict, CASE WHEN known THEN round(ipk,4) END AS i_pk_ua,
    CASE WHEN known THEN round((ipk+50)/2000,6) END AS i_frac, round(slew,6) AS slew_v_per_us,
    CASE WHEN known THEN round(fmax,4) END AS max_feasible_hz,
    CASE WHEN known THEN printf('I_pk %.0f uA (%.0f%% of limit)', ipk, 100*(ipk+50)/2000) ELSE 'I_pk: C unknown' END AS line FROM d""",
    "specimens"))
def _(t):
    d = D.sine_drive(1.0 + F.col("specimen_id") % 50 * 30, F.col("c_est_nf"), 1.0 + F.col("specimen_id") % 9, F.lit(0.0))
    s = t.specimens.select("specimen_id", *[v.alias(k) for k, v in d.items()], D.drive_summary(False, d).alias("line"))
    return rounded(s, i_pk_ua=4, max_feasible_hz=4)


@query("p10_square_feasibility", oracle(
    """, b AS (SELECT specimen_id, c_est_nf AS c, c_est_nf>0 AS known, 0.1e0+specimen_id%40*35 AS f, 1e0+specimen_id%9 AS dv FROM specimens),
    d AS (SELECT *, CASE WHEN known THEN greatest(c*dv/1950, dv*1000/35/1e6) END AS edge FROM b)
    SELECT specimen_id, CASE WHEN NOT coalesce(known,false) THEN 'warn' WHEN edge/(0.5e0/f)>=0.25e0 OR f>1200 THEN 'refuse'
    WHEN edge/(0.5e0/f)>=0.05e0 THEN 'warn' ELSE 'ok' END AS verdict, round(c*dv/edge,4) AS i_pk_ua, round(c*dv/edge/2000,6) AS i_frac,
    round(edge,8) AS edge_s, round(edge/(0.5e0/f),6) AS edge_frac, round(0.25e0/(2*edge),4) AS max_feasible_hz FROM d""",
    "specimens"))
def _(t):
    d = D.square_drive(0.1 + F.col("specimen_id") % 40 * 35, F.col("c_est_nf"), 1.0 + F.col("specimen_id") % 9, F.lit(0.0))
    return rounded(t.specimens.select("specimen_id", *[v.alias(k) for k, v in d.items()]), i_pk_ua=4, edge_s=8, max_feasible_hz=4)


@query("p11_window", oracle("""SELECT sample_id, CASE WHEN f_meas<=0 THEN true ELSE kv>=2/f_meas END AS ok FROM telemetry""", "telemetry"))
def _(t):
    return t.telemetry.select("sample_id", D.window_ok(F.col("f_meas"), F.col("kv")).alias("ok"))


@query("p12_monitor_window", oracle(
    """, b AS (SELECT sample_id AS id, kv*3 AS mk, 0.5e0+sample_id%3 AS vs, CASE WHEN sample_id%5=0 THEN 10e0 ELSE 1e0 END AS va,
    CASE WHEN sample_id%4=0 THEN NULL ELSE -3e0 END AS vp, 0.25e0*(1+sample_id%2) AS isc, 40e0+sample_id%200 AS trip,
    CASE WHEN sample_id%7=0 THEN -1e0 ELSE 1e0 END AS sg FROM telemetry),
    c AS (SELECT *, greatest(1e0, 2*trip/200) AS need, CASE WHEN sg>=0 THEN 0 ELSE -mk END AS lo, CASE WHEN sg>=0 THEN mk ELSE 0 END AS hi FROM b)
    SELECT id, concat_ws('; ', CASE WHEN abs(va-1)>1e-6 THEN 'V: probe factor' END, CASE WHEN vs*8<mk THEN 'V: span too small' END,
     CASE WHEN NOT vs*8<mk AND ((4-vp)*vs<hi OR -(4+vp)*vs>lo) THEN 'V: window misses the swing' END,
     CASE WHEN isc*8<2*need THEN 'I: span too small' END,
     CASE WHEN NOT isc*8<2*need AND (4*isc<need OR -4*isc>-need) THEN 'I: window misses the swing' END) AS problems,
    CASE WHEN mk<=0 THEN 1e0 ELSE coalesce(list_filter([0.01e0,0.02e0,0.05e0,0.1e0,0.2e0,0.5e0,1e0,2e0,5e0,10e0], lambda x: x>=mk*1.3e0/8)[1],10e0) END AS v_scale,
    coalesce(list_filter([0.01e0,0.02e0,0.05e0,0.1e0,0.2e0,0.5e0,1e0,2e0,5e0,10e0], lambda x: x>=2*need*1.3e0/8)[1],10e0) AS i_scale,
    CASE WHEN sg<0 THEN 3e0 ELSE -3e0 END AS v_position FROM c""", "telemetry"))
def _(t):
    i = F.col("sample_id")
    mk, trip, sg = F.col("kv") * 3, 40.0 + i % 200, F.when(i % 7 == 0, -1.0).otherwise(1.0)
    v = {"scale": 0.5 + i % 3, "atten": F.when(i % 5 == 0, 10.0).otherwise(1.0),
         "position": F.when(i % 4 != 0, -3.0), "offset": F.lit(0.0)}
    cur = {"scale": 0.25 * (1 + i % 2), "atten": F.lit(1.0), "position": F.lit(0.0), "offset": F.lit(0.0)}
    fix = U.monitor_fix(mk, trip, sg)
    return t.telemetry.select(i.alias("id"), F.array_join(U.monitor_problems(mk, v, cur, trip, sg), "; ").alias("problems"),
                              fix["v_scale"].alias("v_scale"), fix["i_scale"].alias("i_scale"), fix["v_position"].alias("v_position"))


@query("p14_compare_op", oracle(
    """SELECT event_id, CASE event_id%5 WHEN 0 THEN v>t WHEN 1 THEN v>=t WHEN 2 THEN v<t WHEN 3 THEN v<=t ELSE v=t END AS hit FROM
    (SELECT event_id, CASE WHEN event_type='error' THEN NULL ELSE value END AS v, CAST(event_id%40 AS DOUBLE) AS t FROM events)"""))
def _(t):
    ops = F.array(*[F.lit(o) for o in (">", ">=", "<", "<=", "==")])
    op = F.get(ops, (F.col("event_id") % 5).cast("int"))
    v = F.when(F.col("event_type") != "error", F.col("value"))
    return t("events").select("event_id", U.compare(op, v, (F.col("event_id") % 40).cast("double")).alias("hit"))


@query("p29_life_factors", oracle(
    """, b AS (SELECT c_custkey AS id, floor(abs(c_acctbal))*20 AS op, CAST(c_custkey%30 AS DOUBLE) AS gr, CAST(c_custkey%11 AS DOUBLE) AS fn,
     c_custkey%3=0 AS hr, CAST(c_custkey%100 AS DOUBLE) AS mg, 250000 AS cap FROM customer),
    c AS (SELECT *, CAST(round_even((CASE WHEN hr THEN 4e0 ELSE 2e0 END)*(op+mg)+4*gr+4*fn,0) AS BIGINT) AS flat_req, greatest(gr,10e0) AS g FROM b),
    d AS (SELECT *, CAST(round_even(least(g,1e3)*4+greatest(0,least(g,1e5)-1e3)*2+greatest(0,g-1e5)*1.25e0
      + least(op,10e0)*10+greatest(0,least(op,1e3)-10)*4+greatest(0,least(op,1e5)-1e3)*2+greatest(0,op-1e5)*1.25e0,0) AS BIGINT) AS tier_req FROM c)
    SELECT id, flat_req, tier_req, CASE WHEN cap>=flat_req THEN 'SATISFIES' ELSE 'FALLS SHORT of' END AS flat_says,
    CASE WHEN cap>=tier_req THEN 'SATISFIES' ELSE 'FALLS SHORT of' END AS tier_says FROM d"""))
def _(t):
    k = F.col("c_custkey")
    op = (F.floor(F.abs("c_acctbal")) * 20).cast("double")
    gr, fn, mg = (k % 30).cast("double"), (k % 11).cast("double"), (k % 100).cast("double")
    c = t("customer").select(k.alias("id"), D.required_flat(op, gr, fn, k % 3 == 0, mg).alias("flat_req"),
                             D.required_tiered(gr, op).alias("tier_req"))
    return c.withColumns({"flat_says": D.advisory(F.lit(250000), F.col("flat_req")),
                          "tier_says": D.advisory(F.lit(250000), F.col("tier_req"))})


DUTY_NAMES = ["SINE", "square", "Ramp", "TRIANGLE", "pulse", "DC"]


@query("p33_duty", "SELECT event_id, CASE WHEN event_id%7=6 THEN 0.5e0 ELSE [" + ",".join(f"{U.DUTY.get(n.upper(), 0.5)}e0" for n in DUTY_NAMES)
       + "][event_id%7+1] END AS duty FROM events")
def _(t):
    names = F.get(F.array(*[F.lit(n) for n in DUTY_NAMES]), (F.col("event_id") % 7).cast("int"))      # null for the seventh
    return t("events").select("event_id", U.waveform_duty(names).alias("duty"))


SWEEP = """g AS (SELECT s.*, v.v, f.f FROM specimens s, (VALUES (0.5e0),(1e0),(2e0),(4e0)) v(v), (VALUES (1e0),(5e0),(25e0)) f(f)),
 w AS (SELECT specimen_id, geometry, v AS v_pk_kv, f AS freq_hz, CASE WHEN NOT coalesce(c_est_nf>0,false) THEN 'warn'
  WHEN (2*pi()*f*c_est_nf*0.5e0*v+50)/2000>=0.9e0 OR 2*pi()*f*0.5e0*v*1000/1e6>35 THEN 'refuse'
  WHEN (2*pi()*f*c_est_nf*0.5e0*v+50)/2000>=0.6e0 THEN 'warn' ELSE 'ok' END AS verdict,
  CASE WHEN c_est_nf>0 THEN 1750/(2*pi()*c_est_nf*0.5e0*v) END AS mx FROM g)"""
LEVELS, FREQS = [0.5, 1.0, 2.0, 4.0], [1.0, 5.0, 25.0]


@query("a28_feasible_sweep", oracle(
    """SELECT specimen_id, round(max(mx),4) AS best_hz, max(v_pk_kv) FILTER (verdict='ok') AS top_ok_kv FROM w GROUP BY specimen_id""",
    "specimens", ctes=SWEEP))
def _(t):
    s = D.sweep(t.specimens, LEVELS, FREQS).groupBy("specimen_id").agg(
        F.max("max_feasible_hz").alias("best_hz"),
        F.max(F.when(F.col("verdict") == "ok", F.col("v_pk_kv"))).alias("top_ok_kv"))
    return rounded(s, 4)


@query("a28_sweep_cube", oracle(
    """SELECT geometry, verdict, count(*) AS n FROM w GROUP BY CUBE (geometry, verdict)""", "specimens", ctes=SWEEP))
def _(t):
    return D.sweep(t.specimens, LEVELS, FREQS).cube("geometry", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("a25_run_estimate", oracle(
    """SELECT run_id, cast(sum(cycles_done) AS BIGINT) AS cycles, round(sum(cycles_done)/5e0+count(*)*30e0+count(*) FILTER (counting='timed')*600e0,4) AS duration_s,
    count(*)*3+count(*) FILTER (counting='timed')*40 AS frames_est, (count(*)*3+count(*) FILTER (counting='timed')*40)*1.5e0 AS disk_mb
    FROM blocks GROUP BY run_id""", "blocks"))
def _(t):
    b = t.blocks.groupBy("run_id").agg(F.sum("cycles_done").alias("cycles"), F.count(F.lit(1)).alias("nf"),
                                       F.count_if(F.col("counting") == "timed").alias("nu"))
    e = D.run_estimate(F.col("cycles"), F.lit(5.0), F.col("nf"), F.lit(30.0), F.col("nu"), F.lit(600.0))
    return rounded(b.select("run_id", "cycles", *[v.alias(k) for k, v in e.items()]), 4)
