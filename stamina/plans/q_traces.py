"""Queries over motion traces and monitor samples."""

from pyspark.sql import functions as F

from stamina.functions import text as X
from stamina.operators import telemetry as M
from stamina.operators import traces as T
from stamina.operators.intervals import interval_join
from stamina.plans.bindings import oracle
from stamina.plans.registry import query, rounded

K, ORDER = ["run_id"], ["ts", "sample_id"]


@query("a15_telemetry_quality", oracle(
    """, g AS (SELECT *, t_s-lag(t_s) OVER (PARTITION BY run_id ORDER BY ts) AS gap FROM telemetry)
    SELECT run_id, count(*) AS samples, round(max(gap),3) AS max_gap_s, count(*) FILTER (i_status='offscreen') AS offscreen, count(*) FILTER (i_status='invalid') AS unreadable,
    round((count(*)-1)/(max(t_s)-min(t_s)),8) AS achieved_hz, coalesce((count(*)-1)/(max(t_s)-min(t_s))<0.7e0*0.0001e0,false) AS shortfall FROM g GROUP BY run_id""", "telemetry"))
def _(t):
    return rounded(M.quality(t.telemetry, K, ORDER, "t_s", 0.0001), 3, achieved_hz=8)


@query("a16_leakage", oracle(
    """, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM telemetry WHERE ua IS NOT NULL)
    SELECT run_id, round(median(ua)-1.5e0,6) AS leak_ua FROM k WHERE rn-1>=n//2 GROUP BY run_id""", "telemetry"))
def _(t):
    return rounded(M.leakage(t.telemetry, K, ORDER, "ua", F.lit(1.5)))


@query("a17_capacitance", oracle(
    """, d AS (SELECT *, CASE WHEN sample_id%2=0 THEN 'up' ELSE 'down' END AS dir FROM telemetry),
    q AS (SELECT *, ua*(t_s-lag(t_s) OVER (PARTITION BY run_id,dir ORDER BY ts)) AS q FROM d),
    g AS (SELECT run_id, sum(CASE WHEN dir='up' THEN q END) AS u, sum(CASE WHEN dir='down' THEN q END) AS dn FROM q GROUP BY run_id)
    SELECT run_id, round(u,1) AS q_up, round(dn,1) AS q_down, round((u-dn)/4,1) AS c_nf FROM g""", "telemetry"))
def _(t):
    s = t.telemetry.withColumn("dir", F.when(F.col("sample_id") % 2 == 0, "up").otherwise("down"))
    return rounded(M.capacitance(s, K, ORDER, "t_s", "ua", "dir", F.lit(2.0)), 1)


@query("a18_rest_level", oracle(
    """, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts) AS rn FROM telemetry), m AS (SELECT run_id, count(CASE WHEN rn>2 THEN ua END) AS n, median(CASE WHEN rn>2 THEN ua END) AS md FROM k WHERE rn<=10 GROUP BY run_id)
    SELECT run_id, n, round(CASE WHEN n>=4 AND abs(md)<=least(30,0.5e0*12) THEN md END,6) AS rest_ua FROM m""", "telemetry"))
def _(t):
    return rounded(M.rest_level(t.telemetry, K, ORDER, "ua", 12.0))


@query("w26_envelope", oracle(
    """, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts)-1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM telemetry)
    SELECT run_id, CAST(CASE WHEN n<=20 THEN i ELSE ((i+1)*20-1)//n END AS BIGINT) AS "column", min(kv) AS lo, max(kv) AS hi FROM k GROUP BY ALL""", "telemetry"))
def _(t):
    return M.envelope(t.telemetry, K, ORDER, "kv", 20)


@query("w14_rolling_median", oracle(
    """, d AS (SELECT series_no, clip, frame, frame*0.5e0+(clip%10)*0.01e0 AS dose, disp FROM trace)
    SELECT clip, frame, round(quantile_cont(disp,0.5) OVER (PARTITION BY series_no ORDER BY dose RANGE BETWEEN 1.25e0 PRECEDING AND 1.25e0 FOLLOWING),6) AS med FROM d""", "trace"))
def _(t):
    d = t.trace.withColumn("dose", F.col("frame") * 0.5 + (F.col("clip") % 10) * 0.01)
    return rounded(T.rolling_median(d, ["series_no"], "dose", "disp", "med", 2.5).select("clip", "frame", "med"))


SM = """sm AS (SELECT *, median(disp) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM trace)"""


@query("w15_running_median", oracle("SELECT clip, frame, round(sm,6) AS sm FROM sm", "trace", ctes=SM))
def _(t):
    return rounded(T.running_median(t.trace, ["clip"], "frame", "disp", "sm").select("clip", "frame", "sm"))


def drive(t):
    """A pulse-like signal derived from the table: three on/off phases over each clip."""
    ph = F.col("frame") % 21
    lift = F.when((ph >= 4) & (ph < 14), 30 + F.abs("disp")).otherwise(F.abs("disp") / 20)
    return t.trace.select("clip", "frame", lift.alias("disp"))


DRIVE = """tr AS (SELECT clip, frame, CASE WHEN frame%21>=4 AND frame%21<14 THEN 30+abs(disp) ELSE abs(disp)/20 END AS disp FROM trace),
 s5 AS (SELECT *, median(disp) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM tr),
 onw AS (SELECT c.clip, o.onset, CAST(ceil(o.onset*32) AS BIGINT) AS i0, CAST(ceil((o.onset+0.5e0)*32) AS BIGINT) AS i1, CAST(ceil(o.nx*32) AS BIGINT) AS nx FROM (SELECT DISTINCT clip FROM tr) c,
  (VALUES (0.15e0,0.7e0),(0.7e0,1.35e0),(1.35e0,2e0)) o(onset,nx)),
 seg AS (SELECT w.*, max(sm) AS pk, arg_min(frame,(-sm,frame)) AS pk_i FROM onw w JOIN s5 ON s5.clip=w.clip AND frame>=i0 AND frame<i1 GROUP BY ALL),
 bs AS (SELECT g.*, (SELECT median(sm) FROM s5 WHERE s5.clip=g.clip AND frame>=g.i0-9 AND frame<g.i0) AS base FROM seg g),
 fin AS (SELECT b.*, (SELECT min(frame-b.i0) FROM s5 WHERE s5.clip=b.clip AND frame>=b.i0 AND frame<=b.pk_i AND sm-b.base>=0.9e0*(b.pk-b.base)) AS t90,
  (SELECT median(sm) FROM s5 WHERE s5.clip=b.clip AND frame>=greatest(b.pk_i+1,b.nx-9) AND frame<b.nx) AS res FROM bs b)"""


@query("j8_w17_windowed_pulses", oracle(
    """SELECT clip, onset, (pk_i-i0) AS to_peak, round(base,4) AS base, round(pk,4) AS pk, t90, round(res,4) AS res FROM fin""", "trace", ctes=DRIVE))
def _(t):
    # raw measures before display rounding, so both engines compare exact values
    on = t.trace.select("clip").distinct().select("clip", F.explode(F.array(F.lit(0.15), F.lit(0.7), F.lit(1.35))).alias("onset"))
    g = T.windowed_measures(drive(t), on, ["clip"], "frame", "disp", on_s=0.5)
    return rounded(g.select("clip", "onset", (F.col("pk_i") - F.col("on")).cast("bigint").alias("to_peak"), "base", "pk", F.col("t90").cast("bigint").alias("t90"), "res"), 4)


@query("j8_drive_windows", oracle(
    """, w AS (SELECT user_id AS run_id, event_id AS win, epoch_us(ts)/1e6 AS onset FROM events WHERE event_type='purchase')
    SELECT s.run_id, w.win, count(*) AS n, round(max(s.kv),6) AS peak FROM telemetry s JOIN w ON s.run_id=w.run_id AND s.t_s>=onset AND s.t_s<onset+21600 GROUP BY ALL""", "telemetry"))
def _(t):
    w = t("events").where("event_type = 'purchase'").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("win"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("lo"))
    j = interval_join(t.telemetry, w.withColumn("hi", F.col("lo") + 21600), K, "t_s", "lo", "hi", bucket=21600)
    return rounded(j.groupBy("run_id", "win").agg(F.count(F.lit(1)).alias("n"), F.max("kv").alias("peak")))


PULSE = DRIVE.split(",\n onw AS")[0] + """,
 s6 AS (SELECT *, lag(sm) OVER (PARTITION BY clip ORDER BY frame) AS psm, max(disp) OVER (PARTITION BY clip) AS g, max(frame) OVER (PARTITION BY clip)+1 AS n FROM s5),
 ups AS (SELECT clip, frame FROM s6 WHERE g>=5 AND sm>=0.3e0*g AND psm<0.3e0*g),
 kpt AS (SELECT clip, min(frame) AS c FROM ups GROUP BY clip UNION ALL SELECT k.clip, min(u.frame) FROM kpt k JOIN ups u ON u.clip=k.clip AND u.frame>k.c+8 GROUP BY k.clip),
 w1 AS (SELECT clip, c, coalesce(lag(c) OVER v+22,0) AS lo, lead(c) OVER v AS nx FROM kpt WINDOW v AS (PARTITION BY clip ORDER BY c)),
 w2 AS (SELECT w1.*, (SELECT min(sm) FROM s6 WHERE s6.clip=w1.clip AND frame>=lo AND frame<c) AS fl, (SELECT max(g) FROM s6 WHERE s6.clip=w1.clip) AS g, (SELECT max(n) FROM s6 WHERE s6.clip=w1.clip) AS n FROM w1),
 w3 AS (SELECT w2.*, CASE WHEN c>lo THEN coalesce((SELECT max(frame)+1 FROM s6 WHERE s6.clip=w2.clip AND frame>=lo AND frame<c AND sm<=fl+0.05e0*w2.g), lo) ELSE c END AS o FROM w2),
 w4 AS (SELECT w3.*, (SELECT median(sm) FROM s6 WHERE s6.clip=w3.clip AND frame>=greatest(lo,o-1) AND frame<=o) AS base, (SELECT max(sm) FROM s6 WHERE s6.clip=w3.clip AND frame>=o AND frame<least(o+22,w3.n)) AS pk,
  (SELECT arg_min(frame,(-sm,frame)) FROM s6 WHERE s6.clip=w3.clip AND frame>=o AND frame<least(o+22,w3.n)) AS pi FROM w3),
 w5 AS (SELECT w4.*, (SELECT min(frame) FROM s6 WHERE s6.clip=w4.clip AND frame>=o AND frame<=pi AND sm-base>=0.9e0*(pk-base))-o AS t90,
  CASE WHEN nx IS NULL THEN n ELSE coalesce((SELECT max(frame) FROM s6 WHERE s6.clip=w4.clip AND frame<=nx AND (frame-1<=pi OR psm>=sm)),nx) END AS no FROM w4),
 w6 AS (SELECT w5.*, (SELECT median(sm) FROM s6 WHERE s6.clip=w5.clip AND frame>=greatest(pi+1,no-1) AND frame<no) AS res FROM w5)"""


def _pulses(t):
    return T.pulse_measures(drive(t), ["clip"], "frame", "disp", fps=4.0)


@query("w16_pulses", oracle(
    "SELECT clip, o AS \"on\", pi AS pk_i, round(base,4) AS base, round(pk,4) AS pk, t90, round(res,4) AS res FROM w6", "trace", ctes=PULSE))
def _(t):
    p = _pulses(t)
    return rounded(p.select("clip", *[F.col(c).cast("int").alias(c) for c in ("on", "pk_i")], "base", "pk", F.col("t90").cast("int").alias("t90"), "res"), 4)


@query("a13_clip_stats", oracle(
    """SELECT clip, count(*) AS n_bends, round(avg(pk),4) AS peak, round(arg_min(pk,o),4) AS peak1, arg_min(t90,o) AS t90_1 FROM w6 GROUP BY clip""", "trace", ctes=PULSE))
def _(t):
    p = _pulses(t).withColumns({"onset_s": F.col("on"), "peak_px": F.col("pk"), "t90_s": F.col("t90"), "residual_px": F.col("res"),
                                "recovered_frac": F.col("res") / F.col("pk")})
    s = T.clip_stats(p, ["clip"])
    return rounded(s.select("clip", "n_bends", F.col("peak_px").alias("peak"), F.col("peak1_px").alias("peak1"), F.col("t90_1_s").cast("int").alias("t90_1")), 4)


@query("a14_clip_summary", oracle(
    """, pq AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY o) AS k FROM w6), pp AS (SELECT clip, count(*) AS n_bends, max(CASE WHEN k=1 THEN pk END) AS p1, max(CASE WHEN k=2 THEN pk END) AS p2,
     max(CASE WHEN k=3 THEN pk END) AS p3 FROM pq GROUP BY clip), b AS (SELECT clip, max(abs(disp)) AS md FROM tr GROUP BY clip)
    SELECT b.clip, coalesce(n_bends,0) AS n_bends, round(md,1) AS max_disp_px, round(p1,4) AS peak1_px, round(p2,4) AS peak2_px, round(p3,4) AS peak3_px FROM b LEFT JOIN pp USING (clip)""", "trace", ctes=PULSE))
def _(t):
    d = drive(t)
    p = _pulses(t).withColumns({"onset_s": F.col("on"), "peak_px": F.col("pk"), "t90_s": F.col("t90"), "residual_px": F.col("res"),
                                "recovered_frac": F.col("res") / F.col("pk")})
    s = T.summarize(d, p, ["clip"], "disp")
    return rounded(s.select("clip", "n_bends", "max_disp_px", "peak1_px", "peak2_px", "peak3_px"), 4)


CL = """cl AS (SELECT *, strptime(regexp_extract(name,'(\\d{8}_\\d{6})',1),'%Y%m%d_%H%M%S') AS cts FROM clips),
 lb AS (SELECT *, CASE WHEN epoch(lead(cts) OVER (ORDER BY cts, name, event_id)-cts)=1 THEN 'B' ELSE 'A' END AS series FROM cl)"""


def labelled(t):
    c = t.clips.withColumn("name", F.concat("name", F.lit("#"), F.lpad(F.col("event_id").cast("string"), 9, "0")))
    return T.series_label(c.withColumn("cts", X.clip_time(F.col("name"))), "cts", "name")


@query("s12_clip_catalogue", oracle(
    "SELECT event_id, name, CAST(epoch(cts) AS BIGINT) AS start_s FROM cl WHERE name LIKE '%.h264'", "clips", ctes=CL.split(",\n lb")[0]))
def _(t):
    return t.clips.where(F.endswith("name", F.lit(".h264"))).select("event_id", "name", F.unix_seconds(X.clip_time(F.col("name"))).alias("start_s"))


@query("w18_series_label", oracle("SELECT event_id, series FROM lb", "clips", ctes=CL))
def _(t):
    return labelled(t).select("event_id", "series")


@query("w19_systematic_sample", oracle(
    """, s AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY cts, name, event_id)-1 AS i, epoch(cts-min(cts) OVER ())/3600e0 AS th FROM lb)
    SELECT event_id, series, round(th,4) AS t_h FROM s WHERE CASE WHEN series='A' THEN th<=165 OR i%15=0 ELSE i%5=0 END""", "clips", ctes=CL))
def _(t):
    return T.select_clips(labelled(t), "cts", "name").select("event_id", "series", "t_h")


@query("j7_skip_done", oracle(
    "SELECT event_id, name FROM clips WHERE event_id%3=0 AND event_id NOT IN (SELECT doc_id FROM labels)", "clips"))
def _(t):
    wanted = t("events").where("event_id % 3 = 0").select("event_id")
    done = t("labels").select(F.col("doc_id").alias("event_id"))
    return t.clips.join(wanted, "event_id", "left_semi").join(done, "event_id", "left_anti")


@query("j17_provenance", oracle(
    "SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'listed' ELSE 'local' END AS machine FROM documents d LEFT JOIN labels l USING (doc_id)"))
def _(t):
    side = t("labels").select("doc_id").distinct().withColumn("in_list", F.lit(True))
    return t("documents").join(side, "doc_id", "left").select("doc_id", F.when(F.col("in_list"), "listed").otherwise("local").alias("machine"))


@query("t4_resume_cut", oracle("SELECT event_id, name FROM cl WHERE cts>=TIMESTAMP '2024-01-20'", "clips", ctes=CL.split(",\n lb")[0]))
def _(t):
    return t.clips.where(X.clip_time(F.col("name")) >= F.lit("2024-01-20").cast("timestamp"))


@query("t3_frame_stride", oracle("SELECT clip, frame FROM trace WHERE frame%5=0", "trace"))
def _(t):
    return t.trace.where("frame % 5 = 0").select("clip", "frame")


DIR = """xy AS (SELECT clip, frame, disp AS dx, disp*0.5e0+CAST(frame%7 AS DOUBLE) AS dy FROM trace),
 mx AS (SELECT clip, max(sqrt(dx*dx+dy*dy)) AS m FROM xy GROUP BY clip)"""


def _xy(t):
    return t.trace.select("clip", "frame", F.col("disp").alias("dx"), (F.col("disp") * 0.5 + F.col("frame") % 7).alias("dy"))


@query("w22_dominant_direction", oracle(
    """, u AS (SELECT xy.clip, dx/m AS ux, dy/m AS uy FROM xy JOIN mx USING (clip) WHERE sqrt(dx*dx+dy*dy)=m)
    SELECT clip, frame, round(dx*ux+dy*uy,4) AS disp FROM xy JOIN u USING (clip)""", "trace", ctes=DIR))
def _(t):
    return rounded(T.dominant_direction(_xy(t), ["clip"], ["frame"], "dx", "dy", "disp").select("clip", "frame", "disp"), 4)


@query("w22_normal_displacement", oracle(
    """, v AS (SELECT clip, frame, (-dx*CAST(clip%3 AS DOUBLE)+dy*2)/sqrt(4+pow(clip%3,2)) AS v FROM xy), r AS (SELECT *, max(v) OVER (PARTITION BY clip) AS hi, min(v) OVER (PARTITION BY clip) AS lo FROM v)
    SELECT clip, frame, round(CASE WHEN hi < -lo THEN -v ELSE v END,4) AS disp FROM r""", "trace", ctes=DIR))
def _(t):
    n = T.normal_displacement(_xy(t), ["clip"], ["frame"], "dx", "dy", F.lit(2.0), (F.col("clip") % 3).cast("double"), "disp")
    return rounded(n.select("clip", "frame", "disp"), 4)


ARC = """nd AS (SELECT clip, frame, frame*5e0 AS x, disp/10 AS y FROM trace),
 st AS (SELECT *, coalesce(sqrt(pow(x-lag(x) OVER w,2)+pow(y-lag(y) OVER w,2)),0) AS d FROM nd WINDOW w AS (PARTITION BY clip ORDER BY frame)),
 sc AS (SELECT *, sum(d) OVER (PARTITION BY clip ORDER BY frame ROWS UNBOUNDED PRECEDING) AS s FROM st),
 sn AS (SELECT *, lead(s) OVER w AS sn, lead(x) OVER w AS xn, lead(y) OVER w AS yn, max(s) OVER (PARTITION BY clip) AS L FROM sc WINDOW w AS (PARTITION BY clip ORDER BY frame))"""


def _nodes(t):
    return t.trace.select("clip", "frame", (F.col("frame") * 5.0).alias("x"), (F.col("disp") / 10).alias("y"))


@query("w23_resample", oracle(
    """, k AS (SELECT clip, CAST(k AS BIGINT) AS station, L*k/15e0 AS pos FROM (SELECT DISTINCT clip, L FROM sn), (SELECT unnest(range(16)) AS k))
    SELECT k.clip, station, round(CASE WHEN station=15 THEN (SELECT arg_max(x,frame) FROM nd WHERE nd.clip=k.clip) ELSE x+(xn-x)*(pos-s)/(sn-s) END,5) AS x,
    round(CASE WHEN station=15 THEN (SELECT arg_max(y,frame) FROM nd WHERE nd.clip=k.clip) ELSE y+(yn-y)*(pos-s)/(sn-s) END,5) AS y
    FROM k JOIN sn ON sn.clip=k.clip AND CASE WHEN station=15 THEN sn IS NULL ELSE pos>=s AND pos<sn END""", "trace", ctes=ARC))
def _(t):
    return rounded(T.resample(_nodes(t), ["clip"], "frame", 16), 5)


@query("w23_point_at_arc", oracle(
    """, p AS (SELECT *, least(330e0,L) AS pos FROM sn) SELECT clip, round(x+(coalesce(xn,x)-x)*coalesce((pos-s)/(sn-s),0),5) AS x, round(y+(coalesce(yn,y)-y)*coalesce((pos-s)/(sn-s),0),5) AS y,
    round(L/330e0,6) AS reach FROM p WHERE (s<=pos AND pos<sn) OR (sn IS NULL AND pos>=s)""", "trace", ctes=ARC))
def _(t):
    return rounded(T.point_at(_nodes(t), ["clip"], "frame", 330.0), 5, reach=6)


CURV = ARC + """, th AS (SELECT *, atan((coalesce(yn,y)-coalesce(lag(y) OVER w,y))/(coalesce(xn,x)-coalesce(lag(x) OVER w,x))) AS theta FROM sn WINDOW w AS (PARTITION BY clip ORDER BY frame)),
 ts AS (SELECT *, avg(theta) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS t FROM th),
 kp AS (SELECT *, s-lag(s) OVER w AS hs, sn-s AS hd, lag(t) OVER w AS tp, lead(t) OVER w AS tn FROM ts WINDOW w AS (PARTITION BY clip ORDER BY frame)),
 kk AS (SELECT *, coalesce((hs*hs*tn+(hd*hd-hs*hs)*t-hd*hd*tp)/(hs*hd*(hs+hd)), (tn-t)/hd, (t-tp)/hs) AS kappa FROM kp),
 bd AS (SELECT clip, avg(kappa) FILTER (frame>=6 AND frame<58) AS km, max(abs(kappa)) FILTER (frame>=6 AND frame<58) AS kx, max(L) AS arc,
  regr_intercept(theta,s) FILTER (s>=0.1e0*L AND s<=0.1e0*L+0.3e0*L) AS ra, regr_slope(theta,s) FILTER (s>=L-0.1e0*L-0.3e0*L AND s<=L-0.1e0*L) AS ta,
  regr_intercept(theta,s) FILTER (s>=L-0.1e0*L-0.3e0*L AND s<=L-0.1e0*L) AS tb, arg_max(x,frame) AS tx, arg_max(y,frame) AS ty FROM kk GROUP BY clip)"""


def _bends(t):
    return T.bend_summary(T.curvature(_nodes(t), ["clip"], "frame", 64), ["clip"], "frame", 64)


@query("w24_curvature", oracle("SELECT clip, frame, round(t,7) AS theta_sm, round(kappa,7) AS kappa FROM kk", "trace", ctes=CURV))
def _(t):
    return rounded(T.curvature(_nodes(t), ["clip"], "frame", 64).select("clip", "frame", "theta_sm", "kappa"), 7)


@query("w24_bend_summary", oracle(
    """, o AS (SELECT b.*, r.ra AS rra, r.tx AS rtx, r.ty AS rty FROM bd b JOIN bd r ON r.clip=b.clip-b.clip%10)
    SELECT clip, round(km,7) AS kappa_mean, round(kx,7) AS kappa_max, round(arc,5) AS arc_len, round((ta*arc+tb-ra)*180/pi(),5) AS bend_angle_deg,
    round((tx-rtx)*-sin(rra)+(ty-rty)*cos(rra),5) AS tip_offset FROM o""", "trace", ctes=CURV))
def _(t):
    b = _bends(t).withColumn("unit", F.col("clip") - F.col("clip") % 10)
    out = T.tip_offset(b, b.where("clip % 10 = 0"), "unit")
    return rounded(out.select("clip", "kappa_mean", "kappa_max", "arc_len", "bend_angle_deg", "tip_offset"), 5, kappa_mean=7, kappa_max=7)


DOSE = """cs AS (SELECT clip, series_no, clip*0.25e0 AS t_h, max(disp) AS peak, avg(disp) AS res FROM trace GROUP BY clip, series_no),
 dz AS (SELECT cs.*, f.finger, round(f.rate*t_h,2) AS dose_gy FROM cs JOIN (VALUES ('UVRSE_plate',1.806e0),('UVRSE_strip',1.557e0),('CN9018_strip',1.27e0),('CN9018_plate',1.12e0)) f(finger,rate)
  ON finger=['UVRSE_plate','UVRSE_strip','CN9018_strip','CN9018_plate'][clip%4+1])"""


def _dosed(t):
    names = F.array(*[F.lit(n) for n, _ in T.FINGERS])
    c = t.trace.groupBy("clip", "series_no").agg(F.max("disp").alias("peak"), F.avg("disp").alias("res"))
    c = c.withColumn("t_h", F.col("clip") * 0.25).withColumn("finger", F.get(names, (F.col("clip") % 4).cast("int")))
    return T.with_dose(c, "finger", "t_h")


@query("j13_dose", oracle("SELECT clip, finger, round(dose_gy,1) AS dose_gy FROM dz", "trace", ctes=DOSE))
def _(t):
    return rounded(_dosed(t).select("clip", "finger", "dose_gy"), 1)


@query("a12_binned_medians", oracle(
    "SELECT floor(t_h/5)*5 AS bin_lo, count(*) AS n, round(median(peak*0.075e0),6) AS peak_mm, round(median(res),6) AS res_px FROM cs GROUP BY 1", "trace", ctes=DOSE))
def _(t):
    b = T.binned_medians(_dosed(t).withColumn("all", F.lit(1)), ["all"], "t_h", 5.0,
                         {"peak_mm": F.col("peak") * T.MM_PER_PX, "res_px": F.col("res")}).drop("all")
    return rounded(b.withColumn("bin_lo", F.col("bin_lo").cast("double")))


@query("r4_dose_curves", oracle(
    """SELECT clip, finger, round(peak*0.075e0,6) AS peak_mm, round(quantile_cont(peak*0.075e0,0.5) OVER (PARTITION BY finger ORDER BY t_h RANGE BETWEEN 1.25e0 PRECEDING AND 1.25e0 FOLLOWING),6) AS rolling_mm FROM dz""",
    "trace", ctes=DOSE))
def _(t):
    d = _dosed(t).withColumn("peak_mm", F.col("peak") * T.MM_PER_PX)
    return rounded(T.rolling_median(d, ["finger"], "t_h", "peak_mm", "rolling_mm", 2.5).select("clip", "finger", "peak_mm", "rolling_mm"))
