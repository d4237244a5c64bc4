"""Queries over staircase snapshots and calibration tables."""

from pyspark.sql import functions as F

from stamina.operators import scale as C
from stamina.operators import snapshots as N
from stamina.operators.ordered import Ordered
from stamina.plans.bindings import oracle
from stamina.plans.registry import query, rounded

K = ["run_id"]
SNAP = """s0 AS (SELECT *, coalesce(area_px,0)*0.0018e0 AS mm2_raw, CASE WHEN area_px IS NOT NULL AND row_idx%11<>0 THEN area_px*0.0018e0*(1+(row_idx%5)*1e-5) END AS area_mm2,
  'edge:'||CASE WHEN traced THEN 'manual-trace' ELSE 'disc-fit' END||' conf '||printf('%.2f',conf)||CASE WHEN row_idx%3=0 THEN ' (user)' ELSE '' END AS note0,
  'f'||run_id||'_'||row_idx||CASE WHEN row_idx%13=5 THEN '_BREAKDOWN' ELSE '' END||'.png' AS frame_file FROM snapshots),
 s AS (SELECT *, CASE row_idx%4 WHEN 0 THEN note0 WHEN 1 THEN note0||'; post-breakdown' WHEN 2 THEN 'breakdown? I dev; '||note0 ELSE NULL END AS notes FROM s0)"""
BRK = """m AS (SELECT *, median(ua) OVER (PARTITION BY run_id) AS md, count(ua) OVER (PARTITION BY run_id) AS nu,
  max(CASE WHEN ua IS NOT NULL THEN row_idx END) OVER (PARTITION BY run_id) AS lu FROM s),
 ev AS (SELECT *, CASE WHEN nu>=5 THEN ua-md END AS deviation, coalesce(nu>=5 AND abs(ua-md)>=20,false) AS event FROM m),
 ad AS (SELECT *, coalesce(lag(event) OVER w,false) OR coalesce(lead(event) OVER w,false) OR row_idx=lu AS near FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY row_idx)),
 ar AS (SELECT run_id, row_idx, lag(area_px) OVER w AS pa, lag(kv) OVER w AS pk FROM s WHERE area_px>0 WINDOW w AS (PARTITION BY run_id ORDER BY row_idx)),
 co AS (SELECT ad.*, coalesce(kv>=pk AND area_px<pa*0.65e0,false) AS collapse, CASE WHEN kv>=pk AND area_px<pa*0.65e0 THEN 100*(1-area_px/pa) END AS collapse_pct,
  EXISTS (SELECT 1 FROM ev e WHERE e.run_id=ad.run_id AND e.event AND abs(e.kv-ad.kv)<1e-9) AS corr FROM ad LEFT JOIN ar USING (run_id,row_idx)),
 f0 AS (SELECT *, CASE WHEN event AND near THEN 'current' WHEN nu<5 AND abs(ua)>50 THEN 'absolute' WHEN collapse AND (nu<5 OR corr) THEN 'area' END AS confirmed,
  nullif(concat_ws('; ', CASE WHEN event AND NOT near THEN 'transient' END, CASE WHEN collapse AND NOT (nu<5 OR corr) THEN 'collapse' END),'') AS adv FROM co),
 flg AS (SELECT * EXCLUDE (adv), CASE WHEN confirmed IS NULL THEN adv END AS advisory, row_idx%13=5 OR coalesce(contains(notes,'breakdown?'),false) OR coalesce(contains(notes,'post-breakdown'),false) AS saved_brand FROM f0)"""


def snaps(t):
    s, i = t.snapshots, F.col("row_idx")
    note = F.concat(F.lit("edge:"), F.when(F.col("traced"), "manual-trace").otherwise("disc-fit"), F.lit(" conf "),
                    F.format_string("%.2f", F.col("conf")), F.when(i % 3 == 0, " (user)").otherwise(""))
    s = s.withColumn("area", F.col("area_px")).withColumn(
        "area_mm2", F.when(F.col("area_px").isNotNull() & (i % 11 != 0), F.col("area_px") * 0.0018 * (1 + (i % 5) * 1e-5)))
    s = s.withColumn("frame_file", F.concat(F.lit("f"), "run_id", F.lit("_"), i, F.when(i % 13 == 5, "_BREAKDOWN").otherwise(""), F.lit(".png")))
    return s.withColumn("notes", F.when(i % 4 == 0, note).when(i % 4 == 1, F.concat(note, F.lit("; post-breakdown")))
                        .when(i % 4 == 2, F.concat(F.lit("breakdown? I dev; "), note)))


def flagged(t):
    b = N.breakdown(snaps(t), K)
    return b.withColumn("saved_brand", F.col("frame_file").contains("_BREAKDOWN") | F.coalesce(
        F.col("notes").contains("breakdown?") | F.col("notes").contains("post-breakdown"), F.lit(False)))


@query("w9_w10_breakdown", oracle(
    "SELECT run_id, row_idx, confirmed, advisory, round(deviation,6) AS deviation, round(collapse_pct,6) AS collapse_pct FROM flg",
    "snapshots", ctes=SNAP + ", " + BRK))
def _(t):
    return rounded(flagged(t).select("run_id", "row_idx", "confirmed", "advisory", "deviation", "collapse_pct"))


@query("j12_corroborated", oracle(
    "SELECT run_id, row_idx FROM co WHERE collapse AND corr", "snapshots", ctes=SNAP + ", " + BRK))
def _(t):
    f = flagged(t)
    return N.collapse_corroborated(f.where("collapse_pct is not null"), f.where("event"), K).select("run_id", "row_idx")


@query("w11_branding", oracle(
    """, z AS (SELECT *, coalesce(row_idx>=min(CASE WHEN confirmed IS NOT NULL THEN row_idx END) OVER (PARTITION BY run_id),false) AS zone FROM flg)
    SELECT run_id, row_idx, zone, CASE WHEN zone AND NOT contains(frame_file,'_BREAKDOWN') THEN replace(frame_file,'.png','_BREAKDOWN.png')
     WHEN NOT zone THEN replace(frame_file,'_BREAKDOWN','') ELSE frame_file END AS new_file,
    CASE WHEN zone THEN CASE WHEN confirmed IS NOT NULL OR contains(coalesce(notes,''),'post-breakdown') THEN coalesce(notes,'')
      WHEN coalesce(notes,'')='' THEN 'post-breakdown' ELSE notes||'; post-breakdown' END
     ELSE array_to_string(list_filter(string_split(coalesce(notes,''),'; '), lambda p: p<>'' AND p<>'post-breakdown' AND NOT starts_with(p,'breakdown?')),'; ') END AS new_notes FROM z""",
    "snapshots", ctes=SNAP + ", " + BRK))
def _(t):
    return N.brand(flagged(t), K).select("run_id", "row_idx", "zone", "new_file", "new_notes")


@query("w11_rename_plan", oracle(
    """, z AS (SELECT *, coalesce(row_idx>=min(CASE WHEN confirmed IS NOT NULL THEN row_idx END) OVER (PARTITION BY run_id),false) AS zone FROM flg),
    p AS (SELECT run_id, row_idx, frame_file AS src, CASE WHEN zone AND NOT contains(frame_file,'_BREAKDOWN') THEN replace(frame_file,'.png','_BREAKDOWN.png')
     WHEN NOT zone THEN replace(frame_file,'_BREAKDOWN','') ELSE frame_file END AS dst FROM z) SELECT * FROM p WHERE src<>dst""", "snapshots", ctes=SNAP + ", " + BRK))
def _(t):
    return N.rename_plan(N.brand(flagged(t), K), K)


@query("j16_brand_mismatch", oracle(
    """, z AS (SELECT *, min(CASE WHEN confirmed IS NOT NULL THEN row_idx END) OVER (PARTITION BY run_id) AS fst FROM flg),
    q AS (SELECT run_id, row_idx, CASE WHEN saved_brand AND (fst IS NULL OR row_idx<fst) THEN 'stale' WHEN confirmed IS NOT NULL AND NOT saved_brand THEN 'unbranded' END AS mismatch FROM z)
    SELECT * FROM q WHERE mismatch IS NOT NULL""", "snapshots", ctes=SNAP + ", " + BRK))
def _(t):
    return N.brand_mismatch(flagged(t), K).select("run_id", "row_idx", "mismatch")


@query("w12_texture_onset", oracle(
    """, w AS (SELECT *, coalesce(conf*2>=1.6e0,false) AS ov FROM s), f AS (SELECT *, min(CASE WHEN ov THEN row_idx END) OVER (PARTITION BY run_id) AS fst FROM w)
    SELECT run_id, row_idx, CASE WHEN row_idx=fst THEN 'onset' ELSE 'mode' END AS texture FROM f WHERE ov""", "snapshots", ctes=SNAP))
def _(t):
    return N.texture_onset(snaps(t).withColumn("wrinkle", F.col("conf") * 2), K).where("texture is not null").select("run_id", "row_idx", "texture")


@query("w13_a20_consistency", oracle(
    """, u AS (SELECT *, lag(area_px) OVER w AS pa, lag(kv) OVER w AS pk, min(area_px) OVER q AS lo, max(area_px) OVER q AS hi, count(*) OVER q AS n FROM s
      WHERE area_px>0 WINDOW w AS (PARTITION BY run_id ORDER BY row_idx), q AS (PARTITION BY run_id, kv)),
    r AS (SELECT *, n>1 AND (hi-lo)/((hi+lo)/2)>0.12e0 AS bad, coalesce(kv>=pk AND area_px<pa*0.9e0,false) AS dip FROM u)
    SELECT run_id, row_idx, CASE WHEN bad THEN 'pair mismatch' ELSE 'area dip' END AS issue, round(CASE WHEN bad THEN 100*(hi-lo)/((hi+lo)/2) ELSE 100*(1-area_px/pa) END,6) AS pct
    FROM r WHERE bad OR dip""", "snapshots", ctes=SNAP))
def _(t):
    return rounded(N.consistency(snaps(t), K).select("run_id", "row_idx", "issue", "pct"))


@query("a19_pair_agreement", oracle(
    """, b AS (SELECT *, CASE WHEN row_idx%3=0 THEN NULL ELSE 2e0+row_idx%4 END AS ci, row_idx%7=0 AS aud FROM s WHERE area_px>0),
    g AS (SELECT *, min(area_px) OVER q AS lo, max(area_px) OVER q AS hi, count(*) OVER q AS n, greatest(0.04e0, sum(coalesce(1.5e0*ci/100,0.06e0)) OVER q) AS tol FROM b WINDOW q AS (PARTITION BY run_id, kv)),
    h AS (SELECT *, (hi-lo)/((hi+lo)/2) AS rel FROM g)
    SELECT run_id, row_idx, round(CASE WHEN n>1 AND rel<=tol THEN least(CASE WHEN aud THEN 0.74e0 ELSE 0.99e0 END, conf+0.05e0) WHEN n>1 AND rel>2*tol THEN least(conf,0.74e0) ELSE conf END,6) AS conf,
    CASE WHEN n>1 AND rel<=tol THEN 'confirmed' WHEN n>1 AND rel>2*tol THEN 'mismatch' END AS pair, round(CASE WHEN n>1 AND rel>2*tol THEN 100*rel END,6) AS mismatch_pct FROM h""",
    "snapshots", ctes=SNAP))
def _(t):
    i = F.col("row_idx")
    b = snaps(t).where("area > 0").withColumn("ci85_pct", F.when(i % 3 != 0, 2.0 + i % 4)).withColumn("audited", i % 7 == 0)
    return rounded(N.reconcile_pairs(b, K).select("run_id", "row_idx", "conf", "pair", "mismatch_pct"))


PH = "CASE WHEN tag LIKE 'baseline%' THEN 'baseline' WHEN tag LIKE 'post%' THEN 'post' WHEN tag LIKE 'pre%' THEN 'pre' ELSE '' END"


@query("a3_levels", oracle(
    f""", l AS (SELECT *, {PH} AS ph FROM flg WHERE area_mm2 IS NOT NULL),
    g AS (SELECT run_id, round(kv,3) AS level, count(*) AS n, bool_or(traced) AS traced, bool_and(traced) AS all_traced, bool_or(confirmed IS NOT NULL) AS confirmed,
     avg(area_mm2) AS a, avg(area_mm2) FILTER (NOT traced) AS ma, arg_max(area_mm2,row_idx) FILTER (ph='post') AS post, arg_max(area_mm2,row_idx) FILTER (ph='pre') AS pre FROM l GROUP BY run_id, round(kv,3))
    SELECT run_id, level, n, traced, all_traced, confirmed, traced AND NOT all_traced AS mixed, round(CASE WHEN traced AND NOT all_traced THEN ma ELSE a END,6) AS mean,
    round(post,6) AS post, round(pre,6) AS pre, CASE WHEN all_traced THEN 1e0 ELSE 2e0 END AS band_pct FROM g""", "snapshots", ctes=SNAP + ", " + BRK))
def _(t):
    r = flagged(t).withColumn("phase", N.phase(F.col("tag"))).withColumn("is_flagged", F.col("confirmed").isNotNull())
    return rounded(N.levels(r, K, F.col("area_mm2")))


@query("r7_level_accessor", oracle(
    """SELECT run_id, round(kv,3) AS level, count(*) AS n, round(CASE WHEN bool_or(traced) AND NOT bool_and(traced) THEN avg(abs(kv*ua)) FILTER (NOT traced) ELSE avg(abs(kv*ua)) END,6) AS mean
    FROM s WHERE ua IS NOT NULL GROUP BY run_id, round(kv,3)""", "snapshots", ctes=SNAP))
def _(t):
    r = snaps(t).withColumn("phase", N.phase(F.col("tag"))).withColumn("is_flagged", F.lit(False))
    return rounded(N.levels(r, K, F.abs(F.col("kv") * F.col("ua"))).select("run_id", "level", "n", "mean"))


A0 = f"a0 AS (SELECT run_id, median(area_mm2) AS a0 FROM s WHERE area_mm2<>0 AND {PH}='baseline' GROUP BY run_id)"
UM = "um AS (SELECT run_id, count(ua) AS n, median(ua) AS ua_median FROM s GROUP BY run_id HAVING count(ua)>=5)"


@query("a4_rest_area", oracle("SELECT run_id, round(a0,6) AS a0 FROM a0", "snapshots", ctes=SNAP + ", " + A0))
def _(t):
    return rounded(N.rest_area(snaps(t).withColumn("phase", N.phase(F.col("tag"))), K))


@query("a5_current_median", oracle("SELECT run_id, n, round(ua_median,6) AS ua_median FROM um", "snapshots", ctes=SNAP + ", " + UM))
def _(t):
    return rounded(N.current_median(snaps(t), K).select("run_id", "n", "ua_median"))


@query("a6_cadence", oracle(
    """, g AS (SELECT run_id, epoch_us(ts)/1e6 - lag(epoch_us(ts)/1e6) OVER (PARTITION BY run_id ORDER BY row_idx) AS gap FROM s),
    c AS (SELECT r.run_id, CASE WHEN r.run_id%3=0 THEN 0.5e0 ELSE md END AS cad, CASE WHEN r.run_id%3=0 THEN 'telemetry' WHEN md IS NOT NULL THEN 'snapshot spacing' ELSE 'unknown' END AS source
     FROM (SELECT DISTINCT run_id FROM s) r LEFT JOIN (SELECT run_id, median(gap) AS md FROM g WHERE gap>0 GROUP BY run_id) USING (run_id))
    SELECT run_id, round(cad,3) AS cadence_s, source, coalesce(cad>1,false) AS coarse FROM c""", "snapshots", ctes=SNAP))
def _(t):
    s = t.snapshots
    return rounded(N.cadence(s, K, s.where("run_id % 3 = 0")), 3)


@query("p17_note_fields", oracle(
    """SELECT run_id, row_idx, coalesce(regexp_extract(notes,'edge:([A-Za-z_-]+) conf ([0-9.]+)( \\(user\\))?',1),'') AS method,
    CASE WHEN notes IS NOT NULL THEN round(conf,2) END AS conf, coalesce(contains(notes,'(user)'),false) AS "user", coalesce(contains(notes,'manual-trace'),false) AS traced FROM s""", "snapshots", ctes=SNAP))
def _(t):
    n = N.note_fields(F.col("notes"))
    return snaps(t).select("run_id", "row_idx", *[v.alias(k) for k, v in n.items()])


@query("p18_phase", oracle(f"SELECT run_id, row_idx, {PH} AS phase FROM (SELECT *, CASE row_idx%5 WHEN 0 THEN 'warmup' ELSE tag END AS tag FROM (SELECT * RENAME (tag AS tag) FROM s))".replace(
    "SELECT *, CASE row_idx%5 WHEN 0 THEN 'warmup' ELSE tag END AS tag FROM (SELECT * RENAME (tag AS tag) FROM s)", "SELECT run_id, row_idx, CASE row_idx%5 WHEN 0 THEN 'warmup' ELSE tag END AS tag FROM s"), "snapshots", ctes=SNAP))
def _(t):
    tag = F.when(F.col("row_idx") % 5 == 0, "warmup").otherwise(F.col("tag"))
    return t.snapshots.select("run_id", "row_idx", N.phase(tag).alias("phase"))


@query("p19_power", oracle(
    """SELECT run_id, row_idx, round(abs(kv*(ua-coalesce(ua_median,0))),6) AS power_mw FROM s LEFT JOIN um USING (run_id)""", "snapshots", ctes=SNAP + ", " + UM))
def _(t):
    s = snaps(t)
    j = s.join(N.current_median(s, K), K, "left")
    return rounded(j.select("run_id", "row_idx", N.power_mw(F.col("kv"), F.col("ua"), F.col("ua_median")).alias("power_mw")))


@query("p21_suspect_scale", oracle(
    """, g AS (SELECT run_id, min(CAST(ts AS DATE)) AS d, bool_or(area_mm2 IS NOT NULL) AS ha FROM s GROUP BY run_id)
    SELECT run_id, CASE WHEN d<DATE '1992-09-01' THEN CASE WHEN a0 IS NULL THEN ha ELSE abs(a0-pi()*81)/(pi()*81)>0.05e0 END ELSE false END AS suspect FROM g LEFT JOIN a0 USING (run_id)""",
    "snapshots", ctes=SNAP + ", " + A0))
def _(t):
    s = snaps(t).withColumn("phase", N.phase(F.col("tag")))
    return N.suspect_scale(s, N.rest_area(s, K), K, F.lit(18.0), "1992-09-01").select("run_id", "suspect")


ELIG = """, g AS (SELECT run_id, bool_or(area_mm2 IS NOT NULL) AS ha, run_id%5=0 AS suspect FROM s GROUP BY run_id),
 e AS (SELECT g.*, CASE WHEN run_id%7>0 THEN a0 END AS a0 FROM g LEFT JOIN a0 USING (run_id)),
 el AS (SELECT run_id, CASE WHEN suspect THEN 'areas predate the scale fix' WHEN NOT ha THEN 'no reviewed areas' WHEN coalesce(a0,0)=0 THEN 'no baseline area' END AS reason FROM e)"""


def _elig(t):
    s = snaps(t).withColumn("phase", N.phase(F.col("tag")))
    runs = s.groupBy("run_id").agg(F.bool_or(F.col("area_mm2").isNotNull()).alias("has_areas")).join(N.rest_area(s, K), K, "left")
    runs = runs.withColumn("suspect", F.col("run_id") % 5 == 0).withColumn("a0", F.when(F.col("run_id") % 7 > 0, F.col("a0")))
    return N.eligibility(runs, "area")


@query("p22_eligibility", oracle(ELIG + " SELECT run_id, reason, reason IS NULL AS keep FROM el", "snapshots", ctes=SNAP + ", " + A0)
       .replace(", a0 AS (SELECT run_id, median", ", a0 AS (SELECT run_id, median"))
def _(t):
    return _elig(t).select("run_id", "reason", "keep")


@query("p22_mixed_provenance", oracle(
    ELIG + " SELECT count(*) FILTER (run_id%3=0) AS anchored, count(*) FILTER (run_id%3<>0) AS unanchored, count(*) FILTER (run_id%3=0)>0 AND count(*) FILTER (run_id%3<>0)>0 AS mixed FROM el WHERE reason IS NULL",
    "snapshots", ctes=SNAP + ", " + A0))
def _(t):
    return N.mixed_provenance(_elig(t).where("keep").withColumn("has_anchor", F.col("run_id") % 3 == 0))


@query("k3_tidy_export", oracle(
    f"""SELECT run_id AS run, CAST(row_idx AS VARCHAR) AS snapshot, kv AS "nominal_kV", {PH} AS phase, tag, round(CASE WHEN run_id%5>0 THEN area_mm2 END,6) AS area_mm2,
    CASE WHEN run_id%5=0 OR area_mm2 IS NULL THEN '' WHEN coalesce(contains(notes,'manual-trace'),false) THEN 'outer-toe' WHEN notes IS NOT NULL THEN 'half-height' ELSE '' END AS convention,
    round(CASE WHEN run_id%5>0 THEN area_mm2 END/a0,4) AS "expansion_A_A0", ua AS "measured_uA", round(abs(kv*(ua-coalesce(ua_median,0))),3) AS "power_mW",
    coalesce(contains(notes,'manual-trace'),false) AS traced, CASE WHEN notes IS NULL THEN '' WHEN contains(notes,'manual-trace') THEN 'manual-trace' ELSE 'disc-fit' END AS method,
    CASE WHEN notes IS NOT NULL THEN round(conf,2) END AS conf, coalesce(contains(notes,'(user)'),false) AS user_reviewed, confirmed AS breakdown_confirmed,
    advisory AS breakdown_advisory, saved_brand AS saved_breakdown_brand, notes FROM flg LEFT JOIN a0 USING (run_id) LEFT JOIN um USING (run_id)""",
    "snapshots", ctes=SNAP + ", " + BRK + ", " + A0 + ", " + UM))
def _(t):
    s = flagged(t).withColumn("phase", N.phase(F.col("tag"))).withColumn("snapshot", F.col("row_idx").cast("string"))
    facts = (N.rest_area(s, K).join(N.current_median(s, K).drop("n"), K, "full_outer")
             .withColumn("hide_areas", F.col("run_id") % 5 == 0))
    s = s.withColumns(N.note_fields(F.col("notes")))
    return rounded(N.tidy(s, facts, K), 6)


@query("r3_figure_power", oracle(
    """SELECT run_id, round(kv,3) AS level, count(*) AS n, bool_or(confirmed IS NOT NULL) AS confirmed, round(avg(abs(kv*(ua-coalesce(ua_median,0)))),6) AS mean
    FROM flg LEFT JOIN um USING (run_id) WHERE ua IS NOT NULL GROUP BY run_id, round(kv,3)""", "snapshots", ctes=SNAP + ", " + BRK + ", " + UM))
def _(t):
    from stamina.plans.figures import signal_levels
    return rounded(signal_levels(flagged(t), K).select("run_id", "level", "n", "confirmed", F.col("power_mean").alias("mean")))


@query("r3_figure_expansion", oracle(
    """SELECT run_id, round(kv,3) AS level, round(CASE WHEN bool_or(traced) AND NOT bool_and(traced) THEN avg(area_mm2) FILTER (NOT traced) ELSE avg(area_mm2) END/any_value(a0),6) AS expansion,
    CASE WHEN bool_and(traced) THEN 1e0 ELSE 2e0 END AS band_pct FROM s JOIN a0 USING (run_id) WHERE area_mm2 IS NOT NULL GROUP BY run_id, round(kv,3)""", "snapshots", ctes=SNAP + ", " + A0))
def _(t):
    from stamina.plans.figures import expansion_levels
    return rounded(expansion_levels(flagged(t), K))


@query("p36_axis_scale", oracle(
    """, g AS (SELECT run_id, count(ua) AS n, min(ua) AS lo, min(abs(ua)) FILTER (ua<>0) AS sm FROM s GROUP BY run_id)
    SELECT run_id, CASE WHEN n>0 AND lo>0 THEN 'log' WHEN sm IS NOT NULL THEN 'symlog' END AS scale, CASE WHEN NOT (n>0 AND lo>0) THEN greatest(pow(10e0,floor(log10(sm))),1e-12) END AS threshold FROM g""", "snapshots", ctes=SNAP))
def _(t):
    return N.axis_scale(snaps(t), K, F.col("ua"))


@query("j3_apply_results", oracle(
    """, r AS (SELECT doc_id AS row_key, CASE WHEN doc_id%9=0 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS px, CASE WHEN doc_id%5>0 THEN n_chars*0.0018e0 END AS mm2,
      CASE WHEN doc_id%4>0 THEN 16e0+doc_id%3 END AS diam FROM documents),
    j AS (SELECT r.*, a.row_key IS NOT NULL AS seen, a.area_px FROM r LEFT JOIN accepted a USING (row_key))
    SELECT row_key, CASE WHEN seen AND area_px IS NOT NULL THEN 'accepted' WHEN seen THEN 'rejected' ELSE 'absent' END AS state,
    CASE WHEN seen THEN area_px ELSE px END AS px, round(CASE WHEN seen THEN area_px*0.05e0*0.05e0 ELSE CASE WHEN px>0 THEN px*0.05e0*0.05e0 END END,6) AS mm2,
    round(CASE WHEN seen THEN 2*sqrt(area_px/pi())*0.05e0 WHEN px>0 THEN coalesce(diam*0.05e0/sqrt(mm2/px), 2*sqrt(px/pi())*0.05e0) END,6) AS diam FROM j""", "accepted"))
def _(t):
    k = F.col("doc_id")
    r = t("documents").select(k.alias("row_key"), F.when(k % 9 != 0, F.col("n_chars").cast("double")).alias("px"),
                              F.when(k % 5 > 0, F.col("n_chars") * 0.0018).alias("mm2"), F.when(k % 4 > 0, 16.0 + k % 3).alias("diam"))
    a = t.accepted.withColumn("diam_px", 2 * F.sqrt(F.col("area_px") / F.pi()))
    return rounded(N.apply_results(r, a, "row_key", F.lit(0.05)))


CAL = """c0 AS (SELECT l_orderkey AS grp, count(*) AS n, avg(l_quantity*0.1e0+500) AS mean, max(l_quantity*0.1e0+500)-min(l_quantity*0.1e0+500) AS sp FROM lineitem GROUP BY l_orderkey),
 d2 AS (SELECT * FROM (VALUES (2,1.128e0),(3,1.693e0),(4,2.059e0),(5,2.326e0),(6,2.534e0),(7,2.704e0),(8,2.847e0)) v(n,f)),
 cal AS (SELECT grp, c0.n, mean, sp, 100*sp/mean AS spread_pct, 100*sp/f/mean AS sigma_pct, 100*sp/f/mean/sqrt(c0.n) AS se_pct FROM c0 LEFT JOIN d2 USING (n))"""


def cal(t):
    r = t("lineitem").select(F.col("l_orderkey").alias("grp"), (F.col("l_quantity") * 0.1 + 500).alias("diam"))
    return C.calibration_stats(r, ["grp"], "diam")


@query("a7_calibration", oracle(
    """SELECT grp, n, round(mean,6) AS mean, round(sp,6) AS spread_px, round(spread_pct,6) AS spread_pct, round(sigma_pct,6) AS sigma_pct, round(se_pct,6) AS se_pct,
    round(2*se_pct,6) AS area_se_pct FROM cal""", ctes=CAL))
def _(t):
    return rounded(cal(t))


@query("a8_gates", oracle(
    """SELECT grp, CASE WHEN n>=2 AND se_pct IS NOT NULL THEN se_pct<=0.15e0 END AS se_ok, CASE WHEN sigma_pct>0 THEN greatest(2, CAST(ceil(pow(sigma_pct/0.15e0,2)) AS BIGINT)) END AS rounds,
    n<2 OR spread_pct<=0.5e0 AS range_ok FROM cal""", ctes=CAL))
def _(t):
    return cal(t).select("grp", C.se_gate(F.col("n"), F.col("se_pct"), 0.15).alias("se_ok"), C.rounds_needed(F.col("sigma_pct"), 0.15).alias("rounds"),
                         C.range_gate(F.col("n"), F.col("spread_pct"), 0.5).alias("range_ok"))


@query("a9_anchor_guard", oracle(
    """, b AS (SELECT *, CASE WHEN grp%6=0 THEN NULL ELSE mean*(1+(grp%7-3)*0.005e0) END AS au FROM cal),
    g AS (SELECT grp, au IS NOT NULL AS available, 100*(mean-au)/au AS dp, CASE WHEN au IS NOT NULL THEN pi()*au*au/4*pow(16/mean,2) END AS ra, mean, au, sp FROM b)
    SELECT grp, available, round(dp,6) AS diam_pct, round(ra,6) AS rest_area_mm2, round(100*(ra-pi()*64)/(pi()*64),6) AS area_pct,
    concat_ws('; ', CASE WHEN abs(dp)>1 THEN 'diameter off the automatic fit' END, CASE WHEN abs(100*(ra-pi()*64)/(pi()*64))>1 THEN 'resting area off the nominal disc' END) AS warn,
    grp%4=0 AS vacuous, round(100*(pow(mean/au,2)-1),6) AS rescale, round(100*sp/mean,6) AS resid FROM g""", ctes=CAL))
def _(t):
    k = F.col("grp")
    b = cal(t).withColumn("au", F.when(k % 6 != 0, F.col("mean") * (1 + (k % 7 - 3) * 0.005)))
    g = C.anchor_guard(F.col("mean"), F.col("au"), F.lit(None).cast("double"), F.lit(16.0))
    return rounded(b.select("grp", *[v.alias(n) for n, v in g.items()],
                            C.guard_is_vacuous(F.when(k % 4 == 0, "auto-verified").otherwise("manual")).alias("vacuous"),
                            C.rescale_pct(F.col("mean"), F.col("au")).alias("rescale"), C.fit_residual_pct(F.col("spread_px"), F.col("mean")).alias("resid")))


@query("a10_reanchor_plan", oracle(
    """, r AS (SELECT run_id, row_idx, tag, area_px AS px, CASE WHEN row_idx%11<>0 THEN mm2_raw*(1+(row_idx%5)*1e-4) END AS mm2, CASE WHEN row_idx%2=0 THEN 16e0 END AS diam FROM s),
    q AS (SELECT *, px>0 AS has, CASE WHEN px>0 AND mm2>0 THEN sqrt(mm2/px) END AS sc, coalesce(mm2,0)<>0 OR coalesce(diam,0)<>0 AS old FROM r),
    g AS (SELECT run_id, count(*) AS n_rows, count(*) FILTER (has) AS n_derive, count(*) FILTER (NOT coalesce(has,false) AND old) AS n_blank, count(*) FILTER (has AND sc IS NULL) AS n_fresh,
     count(*) FILTER (NOT coalesce(has,false) AND NOT old) AS n_untouched, count(sc) AS n_scales, min(sc) AS lo, max(sc) AS hi, median(sc) AS md,
     arg_min({'r':row_idx,'b':tag='baseline','px':px,'mm2':mm2,'sc':sc}, (tag<>'baseline', row_idx)) FILTER (has) AS rr FROM q GROUP BY run_id),
    h AS (SELECT *, coalesce(rr.sc, md) AS os FROM g)
    SELECT run_id, n_rows, n_derive, n_blank, n_fresh, n_untouched, n_scales, round(os,8) AS old_scale, round(16/os,6) AS old_diam_px, round(100*(pow(hi/lo,2)-1),6) AS scale_span_pct,
    coalesce(100*(pow(hi/lo,2)-1)>0.05e0,false) AS mixed, rr.r AS rest_row, rr.b AS rest_is_baseline, round(rr.mm2,6) AS rest_before, round(rr.px*0.05e0*0.05e0,6) AS rest_after,
    round(pow(0.05e0/os,2),6) AS mult FROM h""", "snapshots", ctes=SNAP))
def _(t):
    i = F.col("row_idx")
    r = t.snapshots.select("run_id", "row_idx", "tag", F.col("area_px").alias("px"),
                           F.when(i % 11 != 0, F.coalesce("area_px", F.lit(0.0)) * 0.0018 * (1 + (i % 5) * 1e-4)).alias("mm2"),
                           F.when(i % 2 == 0, 16.0).alias("diam"))
    p = C.reanchor_plan(r, K, 0.05, 16.0)
    return rounded(p.drop("new_diam_px", "rest_dev_before", "rest_dev_after", "anchor_matches_data"), old_scale=8)


CAND = """c AS (SELECT l_orderkey AS frame, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS cand,
  CASE l_linenumber WHEN 1 THEN 'disc-fit' WHEN 2 THEN 'diff-lo' WHEN 3 THEN 'diff-mid' WHEN 4 THEN 'diff-hi' WHEN 5 THEN 'tex-ratio' ELSE 'resting' END AS method,
  l_extendedprice/1000 AS area, l_discount*10 AS solidity, l_tax*12 AS contrast, l_quantity/20 AS wrinkle, CAST(l_suppkey%50 AS DOUBLE) AS cx, CAST(l_partkey%50 AS DOUBLE) AS cy, 60e0 AS diam,
  0.5e0+l_discount*4 AS conf_own, 2e0+l_linenumber AS ci FROM lineitem),
 e AS (SELECT *, count(*) FILTER (method LIKE 'diff%') OVER w AS nt, stddev_pop(CASE WHEN method LIKE 'diff%' THEN area END) OVER w AS sd, avg(CASE WHEN method LIKE 'diff%' THEN area END) OVER w AS mu,
  median(CASE WHEN method LIKE 'diff%' THEN area END) OVER w AS md, min(CASE WHEN method='disc-fit' THEN cand END) OVER w AS fc FROM c WINDOW w AS (PARTITION BY frame)),
 f AS (SELECT e.*, x.area AS fa, sqrt(pow(e.cx-x.cx,2)+pow(e.cy-x.cy,2))<=30 AND e.area<=1.2e0*x.area AS ins, CASE WHEN nt>1 THEN sd/mu ELSE 0 END AS spread FROM e LEFT JOIN c x ON x.frame=e.frame AND x.cand=e.fc),
 g AS (SELECT *, CASE WHEN method='disc-fit' THEN least(0.99e0, conf_own*(0.85e0+0.15e0*CASE WHEN nt>0 THEN greatest(0,1-least(1,abs(md-area)/greatest(area,1))) ELSE 1 END)) WHEN method='resting' THEN conf_own
  ELSE 0.3e0*solidity+0.3e0*contrast+0.2e0*(CASE WHEN method='tex-ratio' AND fa IS NOT NULL THEN CASE WHEN coalesce(ins,false) THEN 1e0 ELSE 0.3e0 END ELSE greatest(0,1-spread) END)+0.2e0*greatest(0,least(1,(wrinkle-1)/1.5e0)) END AS cf FROM f),
 h AS (SELECT *, min(CASE WHEN cand=fc THEN cf END) OVER (PARTITION BY frame) AS fcf FROM g),
 ens AS (SELECT frame, cand, method, coalesce((method='tex-ratio' OR method LIKE 'diff%') AND cf>=fcf AND ins,false) AS capped,
  CASE WHEN coalesce((method='tex-ratio' OR method LIKE 'diff%') AND cf>=fcf AND ins,false) THEN greatest(0,fcf-0.01e0) ELSE cf END AS conf,
  CASE WHEN method='disc-fit' THEN ci WHEN method='resting' THEN 0 ELSE 100*spread END AS spread_pct FROM h)"""


def cands(t):
    n = F.col("l_linenumber")
    li = Ordered(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).row_number("cand").result()
    c = li.select(
        F.col("l_orderkey").alias("frame"), "cand", F.when(n == 1, "disc-fit").when(n == 2, "diff-lo").when(n == 3, "diff-mid")
        .when(n == 4, "diff-hi").when(n == 5, "tex-ratio").otherwise("resting").alias("method"), (F.col("l_extendedprice") / 1000).alias("area"),
        (F.col("l_discount") * 10).alias("solidity"), (F.col("l_tax") * 12).alias("contrast"), (F.col("l_quantity") / 20).alias("wrinkle"),
        (F.col("l_suppkey") % 50).cast("double").alias("cx"), (F.col("l_partkey") % 50).cast("double").alias("cy"), F.lit(60.0).alias("diam"),
        (0.5 + F.col("l_discount") * 4).alias("conf_own"), (2.0 + n).alias("ci85_pct"))
    return C.ensemble(c, ["frame"])


@query("a10_recorded_anchor", oracle(
    """, r AS (SELECT run_id, row_idx, tag, area_px AS px, CASE WHEN row_idx%11<>0 THEN mm2_raw*(1+(row_idx%5)*1e-4) END AS mm2, CASE WHEN row_idx%2=0 THEN 16e0 END AS diam FROM s),
    q AS (SELECT *, px>0 AS has, CASE WHEN px>0 AND mm2>0 THEN sqrt(mm2/px) END AS sc, coalesce(mm2,0)<>0 OR coalesce(diam,0)<>0 AS old FROM r),
    g AS (SELECT run_id, count(*) AS n_rows, count(*) FILTER (has) AS n_derive, count(*) FILTER (NOT coalesce(has,false) AND old) AS n_blank, count(*) FILTER (has AND sc IS NULL) AS n_fresh,
     count(*) FILTER (NOT coalesce(has,false) AND NOT old) AS n_untouched, count(sc) AS n_scales, min(sc) AS lo, max(sc) AS hi, median(sc) AS md,
     arg_min({'r':row_idx,'b':tag='baseline','px':px,'mm2':mm2,'sc':sc}, (tag<>'baseline', row_idx)) FILTER (has) AS rr FROM q GROUP BY run_id),
    h AS (SELECT *, coalesce(rr.sc, md) AS os FROM g)
    SELECT run_id, CASE WHEN run_id%7>0 THEN abs(100*(16/sqrt(0.0018e0)*(1+(run_id%9-4)*2e-4)/(16/os)-1))<=0.05e0 END AS anchor_matches_data, round(16/0.05e0,6) AS new_diam_px,
    round(100*(rr.mm2-pi()*64)/(pi()*64),5) AS rest_dev_before, round(100*(rr.px*0.0025e0-pi()*64)/(pi()*64),5) AS rest_dev_after FROM h""", "snapshots", ctes=SNAP))
def _(t):
    i = F.col("row_idx")
    r = t.snapshots.select("run_id", "row_idx", "tag", F.col("area_px").alias("px"),
                           F.when(i % 11 != 0, F.coalesce("area_px", F.lit(0.0)) * 0.0018 * (1 + (i % 5) * 1e-4)).alias("mm2"),
                           F.when(i % 2 == 0, 16.0).alias("diam"))
    recorded = t.snapshots.select("run_id").distinct().where("run_id % 7 > 0").withColumn(
        "recorded_px", 16 / F.sqrt(F.lit(0.0018)) * (1 + (F.col("run_id") % 9 - 4) * 2e-4))
    p = C.reanchor_plan(r, K, 0.05, 16.0, recorded)
    return rounded(p.select("run_id", "anchor_matches_data", "new_diam_px", "rest_dev_before", "rest_dev_after"), rest_dev_before=5, rest_dev_after=5)


@query("a21_ensemble", oracle(
    "SELECT frame, cand, method, capped, round(conf,6) AS conf, round(spread_pct,6) AS spread_pct FROM ens", ctes=CAND))
def _(t):
    return rounded(cands(t).select("frame", "cand", "method", "capped", "conf", "spread_pct"))


TOP3 = "tp AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY round(conf,6) DESC, cand) AS rank FROM ens)"


def top(t, n=3):
    return C.top_candidates(cands(t).withColumn("conf", F.round("conf", 6)), ["frame"], n)


@query("t1_top_candidates", oracle("SELECT frame, rank, cand, method FROM tp WHERE rank<=3", ctes=CAND + ", " + TOP3))
def _(t):
    return top(t).select("frame", "rank", "cand", "method")


@query("p20_needs_review", oracle(
    "SELECT frame, conf IS NULL OR conf<0.75e0 OR spread_pct>12 AS review FROM (SELECT frame, round(conf,6) AS conf, spread_pct FROM tp WHERE rank=1)", ctes=CAND + ", " + TOP3))
def _(t):
    b = top(t, 1).withColumn("fallback", F.lit(False))
    return b.select("frame", N.needs_review(b).alias("review"))


@query("w27_hysteresis", oracle(
    """, b AS (SELECT frame%1000 AS series, frame, method FROM tp WHERE rank=1)
    SELECT series, frame, method, lag(method) OVER (PARTITION BY series ORDER BY frame) AS prev_method,
    coalesce(method=lag(method) OVER (PARTITION BY series ORDER BY frame),false) AS bonus FROM b""", ctes=CAND + ", " + TOP3))
def _(t):
    b = top(t, 1).withColumn("series", F.col("frame") % 1000)
    p = C.previous_winner(b, ["series"], ["frame"])
    return (b.join(p, ["series", "frame"]).select("series", "frame", "method", "prev_method",
                                                  F.coalesce(F.col("method") == F.col("prev_method"), F.lit(False)).alias("bonus")))


AUD = """m AS (SELECT clip, frame, disp/4 AS o, abs(disp) AS st, greatest(3e0, 0.35e0*coalesce(median(CASE WHEN abs(disp)>2 THEN abs(disp) END) OVER (PARTITION BY clip),3e0)) AS cut FROM trace),
 b AS (SELECT *, st>=cut AS good, median(CASE WHEN st>=cut THEN o END) OVER (PARTITION BY clip) AS bias FROM m),
 aud AS (SELECT clip, count(*) AS n_rays, count(*) FILTER (good) AS ng, max(bias) AS bias, median(CASE WHEN good THEN abs(o-bias) END) AS mad FROM b GROUP BY clip HAVING count(*)>=12)"""


@query("a22_boundary_audit", oracle(
    """, r AS (SELECT *, 100e0*(n_rays-ng)/n_rays AS ns, CASE WHEN ng>=6 THEN bias END AS bp FROM aud)
    SELECT clip, n_rays, round(bp,6) AS bias_px, round(CASE WHEN ng>=6 THEN mad END,6) AS mad_px, round(ns,6) AS nostep_pct,
    ns>15 OR coalesce(abs(bp)>3,false) AS capped, CASE WHEN ns>15 OR coalesce(abs(bp)>3,false) THEN 0.74e0 ELSE 0.9e0 END AS conf FROM r""", "trace", ctes=AUD))
def _(t):
    r = t.trace.select("clip", "frame", (F.col("disp") / 4).alias("off"), F.abs("disp").alias("step"))
    a = C.boundary_audit(r, ["clip"], "frame")
    capped, conf = C.audit_cap(F.lit(0.9), F.col("nostep_pct"), F.col("bias_px"))
    return rounded(a.withColumns({"capped": capped, "conf": conf}))


def _trim_sql(first: str, passes: int, fit: str, keys: str, resid: str, cut: str, least: int) -> str:
    """CTEs of a fit repeated on the points it keeps; a cut that keeps too few changes nothing."""
    out = [f"k0 AS (SELECT *, true AS keep FROM {first})"]
    for i in range(passes):
        out.append(f"f{i} AS (SELECT *, {fit} FROM k{i} WINDOW w AS (PARTITION BY {keys}))")
        if i < passes - 1:
            out.append(f"e{i} AS (SELECT *, {resid} AS e FROM f{i})")
            out.append(f"c{i} AS (SELECT *, e <= {cut} AS nxt FROM e{i} WINDOW w AS (PARTITION BY {keys}))")
            out.append(f"k{i + 1} AS (SELECT * EXCLUDE (keep, nxt, e, p0, p1, p2), CASE WHEN count(*) FILTER (nxt) OVER (PARTITION BY {keys}) >= {least} THEN nxt ELSE keep END AS keep FROM c{i})")
    return ", ".join(out)


PHOTO = """q AS (SELECT series_no, quantile_cont(disp, list_transform(range(49), lambda i: (2+2*i)/100e0)) AS a,
  quantile_cont(disp*0.8e0+12+CASE WHEN frame%20=0 THEN 30 ELSE 0 END, list_transform(range(49), lambda i: (2+2*i)/100e0)) AS b FROM trace GROUP BY series_no),
 pts AS (SELECT series_no, unnest(a) AS xb, unnest(b) AS xi FROM q), """ + _trim_sql(
    "pts", 3, "regr_slope(CASE WHEN keep THEN xi END, CASE WHEN keep THEN xb END) OVER w AS p0, regr_intercept(CASE WHEN keep THEN xi END, CASE WHEN keep THEN xb END) OVER w AS p1, 0 AS p2",
    "series_no", "abs(p0*xb+p1-xi)", "greatest(quantile_cont(e,0.67) OVER w, 1e-6)", 8)


@query("a23_photometric_fit", oracle(
    "SELECT series_no, round(any_value(p0),5) AS gain, round(any_value(p1),5) AS \"offset\" FROM f2 GROUP BY series_no", "trace", ctes=PHOTO))
def _(t):
    base = t.trace.select("series_no", "disp")
    img = t.trace.select("series_no", (F.col("disp") * 0.8 + 12 + F.when(F.col("frame") % 20 == 0, 30.0).otherwise(0.0)).alias("disp"))
    return rounded(C.photometric_fit(base, img, ["series_no"], "disp"), 5)


def _kept_sql(f):
    return f.replace("X", "CASE WHEN keep THEN x END").replace("Y", "CASE WHEN keep THEN y END").replace("Z", "CASE WHEN keep THEN x*x+y*y END")


_DET = "(var_pop(X) OVER w*var_pop(Y) OVER w-covar_pop(X,Y) OVER w*covar_pop(X,Y) OVER w)"
_A = f"((covar_pop(X,Z) OVER w*var_pop(Y) OVER w-covar_pop(Y,Z) OVER w*covar_pop(X,Y) OVER w)/{_DET})"
_B = f"((covar_pop(Y,Z) OVER w*var_pop(X) OVER w-covar_pop(X,Z) OVER w*covar_pop(X,Y) OVER w)/{_DET})"
CIRCLE = """cp AS (SELECT clip, frame, 320+(100+disp/10)*cos(frame*(2*3.141592653589793e0/64)) AS x, 240+(100+disp/10)*sin(frame*(2*3.141592653589793e0/64)) AS y FROM trace), """ + _trim_sql(
    "cp", 4, _kept_sql(f"{_A}/2 AS p0, {_B}/2 AS p1, sqrt(greatest(avg(Z) OVER w-{_A}*avg(X) OVER w-{_B}*avg(Y) OVER w+pow({_A}/2,2)+pow({_B}/2,2),1e-9)) AS p2"),
    "clip", "abs(sqrt(pow(x-p0,2)+pow(y-p1,2))-p2)", "2.5e0*greatest(stddev_pop(CASE WHEN keep THEN e END) OVER w, 1e0)", 24)


@query("a24_circle_fit", oracle(
    "SELECT clip, round(any_value(p0),5) AS cx, round(any_value(p1),5) AS cy, round(any_value(p2),5) AS r, count(*) FILTER (keep) AS kept FROM f3 GROUP BY clip", "trace", ctes=CIRCLE))
def _(t):
    th = F.col("frame") * (2 * 3.141592653589793 / 64)
    r = 100 + F.col("disp") / 10
    p = t.trace.select("clip", "frame", (320 + r * F.cos(th)).alias("x"), (240 + r * F.sin(th)).alias("y"))
    return rounded(C.circle_fit(p, ["clip"], ["frame"]), 5)
