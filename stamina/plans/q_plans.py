"""Plan expansion, gates, data quality, compliance and report queries."""

from pyspark.sql import functions as F

from stamina.operators import expand as E
from stamina.operators import recipes as Q
from stamina.operators import reports as P
from stamina.operators import survival as S
from stamina.operators import feasibility as D
from stamina.operators import ledger as L
from stamina.plans import q_survival as QS
from stamina.plans.bindings import oracle
from stamina.plans.registry import query, rounded

LV = """prof AS (SELECT p_partkey AS id, 0.25e0*(p_partkey%3) AS st, 1e0+p_size%9 AS en, CASE WHEN p_partkey%4>0 THEN 0.25e0*(1+p_partkey%3) END AS step, 2+p_partkey%5 AS ns,
  p_partkey%2=0 AS updown, 1+p_partkey%3 AS rep FROM part),
 lv AS (SELECT *, CASE WHEN step>0 THEN list_transform(range(CAST(floor(abs(en-st)/step+1e-9) AS BIGINT)+1), lambda i: round(st+i*step,6))
   ELSE list_transform(range(ns), lambda i: round(st+(en-st)*i/(ns-1),6)) END AS l FROM prof),
 sq0 AS (SELECT id, updown, rep, CASE WHEN abs(l[1])<1e-9 THEN l[2:] ELSE l END AS l FROM lv),
 sq AS (SELECT id, rep, CASE WHEN updown AND len(l)>1 THEN list_concat(l, list_reverse(l[:-2])) ELSE l END AS one FROM sq0),
 ss AS (SELECT id, (r.r*len(one)+k.k) AS k, one[k.k+1] AS kv FROM sq, (SELECT unnest(range(3)) AS r) r, (SELECT unnest(range(200)) AS k) k WHERE r.r<rep AND k.k<len(one)),
 stp AS (SELECT id, k+1 AS step, kv, coalesce(lag(kv) OVER (PARTITION BY id ORDER BY k),0) AS from_kv, 2+k*65e0 AS t_start FROM ss),
 seg AS (SELECT id, step, 'ramp' AS kind, t_start AS t0, t_start+5 AS t1, from_kv, kv AS to_kv FROM stp UNION ALL SELECT id, step, 'hold', t_start+5, t_start+65, kv, kv FROM stp)"""


def profiles(t):
    k = F.col("p_partkey")
    p = t("part").select(
        k.alias("id"), E.levels(0.25 * (k % 3), 1.0 + F.col("p_size") % 9, F.when(k % 4 > 0, 0.25 * (1 + k % 3)), 2 + k % 5).alias("levels"),
        (k % 2 == 0).alias("updown"), (1 + k % 3).alias("repeat"))
    return p.withColumns({"ramp_s": F.lit(5.0), "landing_s": F.lit(60.0), "baseline": F.lit(True), "warmup_s": F.lit(2.0)})


@query("g1_levels", oracle("SELECT id, unnest(l) AS kv FROM lv", ctes=LV))
def _(t):
    return profiles(t).select("id", F.explode("levels").alias("kv"))


@query("g2_segments", oracle("SELECT id, CAST(step AS BIGINT) AS step, kind, t0, t1, from_kv, to_kv FROM seg", ctes=LV))
def _(t):
    return E.segments(E.staircase_steps(profiles(t), ["id"]), ["id"])


@query("g2_snapshot_plan", oracle(
    """SELECT id, 0e0 AS t, CAST(0 AS BIGINT) AS step, 0e0 AS kv, 'warmup' AS tag FROM prof UNION ALL SELECT id, 2e0, 0, 0, 'baseline' FROM prof UNION ALL
    SELECT id, t_start+7, step, kv, 'post-ramp' FROM stp UNION ALL SELECT id, t_start+64, step, kv, 'pre-ramp' FROM stp""", ctes=LV))
def _(t):
    p = profiles(t)
    return E.snapshot_plan(p, E.staircase_steps(p, ["id"]), ["id"])


@query("w7_profile_dose", oracle(
    "SELECT id, round(sum((t1-t0)*0.5e0*(from_kv+to_kv))/max(greatest(from_kv,to_kv)),4) AS actuated_s FROM seg GROUP BY id", ctes=LV))
def _(t):
    return rounded(L.profile_dose(E.segments(E.staircase_steps(profiles(t), ["id"]), ["id"]), ["id"]), 4)


@query("j9_commanded_level", oracle(
    """, pt AS (SELECT l_partkey AS id, l_orderkey*10+l_linenumber AS pid, l_suppkey*7.3e0-20.05e0 AS t FROM lineitem WHERE l_partkey>0),
    fin AS (SELECT id, max(t1) AS te, arg_max(to_kv,(t1,t0)) AS fk FROM seg GROUP BY id)
    SELECT p.id, p.pid, round(p.t,4) AS t, round(CASE WHEN s.kind IS NOT NULL THEN CASE WHEN s.kind='hold' THEN to_kv ELSE from_kv+(to_kv-from_kv)*(p.t-t0)/(t1-t0) END WHEN p.t>=te THEN fk ELSE 0 END,6) AS kv_at
    FROM pt p JOIN fin USING (id) LEFT JOIN seg s ON s.id=p.id AND p.t>=t0 AND p.t<t1""", ctes=LV))
def _(t):
    li = t("lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pid"),
                              (F.col("l_suppkey") * 7.3 - 20.05).alias("t")).where("id > 0")
    return rounded(E.commanded_level(li, E.segments(E.staircase_steps(profiles(t), ["id"]), ["id"]), ["id"], "t"), 6, t=4)


PLAN = """pl AS (SELECT c_custkey AS id, p.pos, p.op, CASE WHEN p.op IS NOT NULL THEN 1+c_custkey%3 END AS orp, p.ip, CASE WHEN p.ip IS NOT NULL THEN 2 END AS irp, p.ty FROM customer,
  (VALUES (0,NULL,NULL,'cycle'),(1,NULL,NULL,'full_interlude'),(0,2,NULL,'cycle'),(0,2,1,'cycle'),(1,2,1,'fast_interlude')) p(pos,op,ip,ty)),
 fl AS (SELECT id, ty, coalesce(op||'['||o||'/'||orp||'].','')||coalesce(ip||'['||i||'/'||irp||'].','')||pos AS loop_path, row_number() OVER (PARTITION BY id ORDER BY coalesce(op,pos), CASE WHEN op IS NULL THEN 0 ELSE o END, coalesce(ip,pos),
   CASE WHEN ip IS NULL THEN 0 ELSE i END, pos)-1 AS flat_idx FROM pl, (SELECT unnest(range(1,4)) AS o), (SELECT unnest(range(1,3)) AS i) WHERE o<=coalesce(orp,1) AND i<=coalesce(irp,1))"""


def flat(t):
    rows = [(0, None, None, "cycle"), (1, None, None, "full_interlude"), (0, 2, None, "cycle"), (0, 2, 1, "cycle"), (1, 2, 1, "fast_interlude")]
    b = F.array(*[F.struct(F.lit(a).alias("pos"), F.lit(o).cast("int").alias("outer_pos"), F.lit(i).cast("int").alias("inner_pos"), F.lit(ty).alias("type"))
                  for a, o, i, ty in rows])
    p = t("customer").select(F.col("c_custkey").alias("id"), F.explode(b).alias("b")).select("id", "b.*")
    p = p.withColumn("outer_repeat", F.when(F.col("outer_pos").isNotNull(), (1 + F.col("id") % 3).cast("int"))).withColumn(
        "inner_repeat", F.when(F.col("inner_pos").isNotNull(), 2))
    return E.flatten_plan(p, ["id"])


@query("g3_flatten_plan", oracle("SELECT id, flat_idx, loop_path, ty AS type FROM fl", ctes=PLAN))
def _(t):
    from pyspark.sql import Window
    # a plan is a bounded document, so numbering its blocks is a small window
    w = Window.partitionBy("id").orderBy("exec_order")
    return flat(t).select("id", (F.row_number().over(w) - 1).cast("bigint").alias("flat_idx"), "loop_path", "type")


@query("g4_resolve_blocks", oracle(
    """SELECT o_orderkey AS blk, coalesce(CASE WHEN o_orderkey%3=0 THEN 'SQUARE' END, CASE WHEN c_custkey%2=0 THEN 'SINE' ELSE 'RAMP' END) AS waveform,
    coalesce(CASE WHEN o_orderkey%4=0 THEN 2e0 END, 0.5e0*(1+c_custkey%4)) AS freq_hz, round(coalesce(CASE WHEN o_orderkey%5=0 THEN o_totalprice/1e5 END, abs(c_acctbal)/1000),8) AS v_pk_kv,
    0.1e0 AS v_min_kv, round(coalesce(CASE WHEN o_orderkey%7=0 THEN 1.5e0 END, round(CASE WHEN o_orderkey%7>3 THEN 0.8e0 END*abs(c_acctbal)/1000,4)),4) AS end_kv
    FROM orders JOIN customer ON o_custkey=c_custkey"""))
def _(t):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    b = t("orders").select(F.col("o_custkey").alias("id"), k.alias("blk"), F.when(k % 3 == 0, "SQUARE").alias("waveform"), F.when(k % 4 == 0, 2.0).alias("freq_hz"),
                           F.when(k % 5 == 0, F.col("o_totalprice") / 1e5).alias("v_pk_kv"), F.lit(None).cast("double").alias("v_min_kv"),
                           F.when(k % 7 == 0, 1.5).alias("end_kv"), F.when(k % 7 > 3, 0.8).alias("fraction_of_vpk"))
    d = t("customer").select(c.alias("id"), F.when(c % 2 == 0, "SINE").otherwise("RAMP").alias("waveform"), (0.5 * (1 + c % 4)).alias("freq_hz"),
                             (F.abs("c_acctbal") / 1000).alias("v_pk_kv"), F.lit(0.1).alias("v_min_kv"))
    r = E.resolve_blocks(b.join(d.select("id"), "id", "left_semi"), d, ["id"])
    return rounded(r.select("blk", "waveform", "freq_hz", "v_pk_kv", "v_min_kv", "end_kv"), 8, end_kv=4)


@query("g5_chunks", oracle(
    """SELECT run_id, block_idx, CAST(c AS BIGINT) AS chunk, least(500, cycles_done-c*500) AS chunk_cycles, round(least(500, cycles_done-c*500)/freq_hz+0.5e0+2/freq_hz,4) AS expected_s
    FROM blocks, (SELECT unnest(range(20)) AS c) WHERE type='cycle' AND cycles_done>0 AND c*500<cycles_done""", "blocks"))
def _(t):
    c = E.chunks(t.blocks.where("type = 'cycle'"), "cycles_done", "freq_hz", 1000, 500)
    return rounded(c.select("run_id", "block_idx", "chunk", "chunk_cycles", "expected_s"), 4)


@query("g6_waveforms", oracle(
    """, sp AS (SELECT n_nationkey AS id, ['SINE','SQUARE','RAMP','PULSE','DC','ARB'][n_nationkey%6+1] AS w, 0.2e0+0.1e0*(n_nationkey%7) AS du, 0.25e0*(n_nationkey%5) AS sy FROM nation),
    s AS (SELECT *, (i/16e0+0.25e0)%1.0e0 AS t, least(0.05e0,du/2) AS r, least(0.1e0,du/2) AS f FROM sp, (SELECT unnest(range(32)) AS i))
    SELECT id, CAST(i AS INTEGER) AS i, round(CASE w WHEN 'SINE' THEN sin(2*pi()*t) WHEN 'SQUARE' THEN CASE WHEN t<du THEN 1e0 ELSE -1e0 END WHEN 'RAMP' THEN CASE WHEN sy<=0 THEN 1-2*t WHEN sy>=1 THEN 2*t-1 WHEN t<sy THEN 2*t/sy-1 ELSE 1-2*(t-sy)/(1-sy) END
     WHEN 'ARB' THEN [0e0,2e0,-4e0,1e0,3e0][CAST(floor(t*5) AS INTEGER)%5+1]/4 WHEN 'PULSE' THEN CASE WHEN t<r THEN 2*t/r-1 WHEN t<du-f THEN 1e0 WHEN t<du THEN 1-2*(t-(du-f))/f ELSE -1e0 END ELSE 0e0 END,6) AS y FROM s"""))
def _(t):
    k = F.col("n_nationkey")
    sp = t("nation").select(k.alias("id"), F.get(F.array(*[F.lit(w) for w in ("SINE", "SQUARE", "RAMP", "PULSE", "DC", "ARB")]), (k % 6).cast("int")).alias("waveform"),
                            (20.0 + 10 * (k % 7)).alias("duty_pct"), (25.0 * (k % 5)).alias("sym_pct"), F.lit(0.05).alias("rise"), F.lit(0.1).alias("fall"),
                            F.lit(90.0).alias("phase_deg"), F.array(*[F.lit(v) for v in (0.0, 2.0, -4.0, 1.0, 3.0)]).alias("samples"))
    return rounded(E.waveform_samples(sp, 2, 16).select("id", "i", "y"))


@query("g7_capture_schedule", oracle(
    """SELECT c_custkey AS id, round(unnest(CASE WHEN c_custkey%3=0 THEN list_sort(list_distinct([5e0,1e0,5e0,c_nationkey])) ELSE list_transform(range(1+c_custkey%4), lambda i: 0.5e0+i*(1+c_nationkey)) END),4) AS delay FROM customer"""))
def _(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    ex = F.when(k % 3 == 0, F.array(F.lit(5.0), F.lit(1.0), F.lit(5.0), n.cast("double")))
    s = E.capture_schedule(ex, F.lit(0.5), (1 + n).cast("double"), 1 + k % 4)
    return rounded(t("customer").select(k.alias("id"), F.explode(s).alias("delay")), 4)


@query("p13_gate_chain", oracle(
    """, g AS (SELECT c_custkey AS id, c_custkey%2=0 AS live, c_custkey%3>0 AS dr, c_custkey%5>0 AS mo, c_custkey%7=0 AS bl, c_custkey%11 AS wp, c_custkey%13=0 AS rf, abs(c_acctbal)/1000 AS kv, c_custkey%17>0 AS en FROM customer),
    c AS (SELECT id, unnest([{'n':1,'gate':'platform','ok':true},{'n':2,'gate':'drive_connected','ok':NOT live OR dr},{'n':3,'gate':'monitor_connected','ok':mo OR NOT live OR bl},{'n':4,'gate':'monitor_window','ok':NOT mo OR wp=0},
     {'n':5,'gate':'feasibility','ok':NOT rf},{'n':6,'gate':'specimen_cap','ok':kv<=5+1e-9},{'n':7,'gate':'pressure','ok':true},{'n':8,'gate':'energize_confirm','ok':NOT live OR en}]) AS s FROM g)
    SELECT id, CAST(s.n AS INTEGER) AS pos, s.gate AS gate, s.ok AS ok, CASE WHEN s.gate='pressure' AND id%4=0 THEN 'pressure low' ELSE '' END AS warn, bool_and(s.ok) OVER (PARTITION BY id) AS all_ok FROM c"""))
def _(t):
    k = F.col("c_custkey")
    g = Q.gate_chain({"mode": F.when(k % 2 == 0, "live").otherwise("mock"), "platform_ok": F.lit(True), "drive_ok": k % 3 > 0, "monitor_ok": k % 5 > 0,
                      "confirmed_blind": k % 7 == 0, "window_problems": k % 11, "feasibility": F.when(k % 13 == 0, "refuse").otherwise("ok"),
                      "drive_kv": F.abs("c_acctbal") / 1000, "cap_kv": F.lit(5.0), "pressure_note": F.when(k % 4 == 0, "pressure low").otherwise(""), "confirmed_energize": k % 17 > 0})
    d = t("customer").select(k.alias("id"), g.alias("g")).withColumn("all_ok", Q.all_pass(F.col("g")))
    return d.select("id", "all_ok", F.posexplode("g").alias("p", "s")).select("id", (F.col("p") + 1).alias("pos"), "s.gate", "s.ok", "s.warn", "all_ok")


@query("p16_plan_quality", oracle(
    """, r AS (SELECT c_custkey AS k, CASE WHEN c_custkey%9=0 THEN 'colour' END AS xk, CASE WHEN c_custkey%8>0 THEN c_name END AS nm, CASE WHEN c_custkey%3=0 THEN 'planar' WHEN c_custkey%3=1 THEN 'bender' ELSE c_mktsegment END AS geo,
      CASE WHEN c_custkey%10=0 THEN 'SAW' ELSE 'SINE' END AS wf, CASE c_custkey%6 WHEN 0 THEN NULL WHEN 1 THEN 'fast' WHEN 2 THEN '12.5' ELSE '0.5' END AS fq, CASE WHEN c_custkey%7=0 THEN '0' ELSE '100000' END AS mc, 10e0+c_custkey%30 AS tlo,
      c_nationkey AS nk, c_custkey%4 AS nb FROM customer),
    p AS (SELECT k, concat_ws('; ', CASE WHEN xk IS NOT NULL THEN 'top level: unknown key(s) colour' END, CASE WHEN nm IS NULL THEN 'missing name' END, CASE WHEN geo NOT IN ('planar','bender') THEN 'geometry not accepted' END,
     CASE WHEN wf='SAW' THEN 'waveform not accepted' END, CASE WHEN fq IS NULL THEN 'missing freq_hz' WHEN fq='fast' THEN 'freq_hz is not a number' WHEN fq='12.5' THEN 'freq_hz above maximum' END, CASE WHEN mc='0' THEN 'max_cycles below minimum' END,
     CASE WHEN NOT tlo<30 THEN 't_c_band must be lo < hi' END, CASE WHEN nk%5=0 THEN 'milestone not positive' WHEN nk%5=1 THEN 'milestones must increase' WHEN 50000>=CAST(mc AS DOUBLE) THEN 'last milestone not below the cap' END,
     CASE WHEN 2+nk%10>=8 THEN 'settle + lead must be below landing' END, CASE WHEN nb<>1 THEN 'exactly one baseline required' END, CASE WHEN nb=3 THEN 'baseline before break-in' END) AS problems FROM r)
    SELECT k, problems FROM p WHERE problems<>''"""))
def _(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    keys = F.concat(F.array(F.lit("name"), F.lit("drive")), F.when(k % 9 == 0, F.array(F.lit("colour"))).otherwise(F.array().cast("array<string>")))
    nb = k % 4
    ms = F.when(n % 5 == 0, F.array(F.lit(0), F.lit(50000))).when(n % 5 == 1, F.array(F.lit(50000), F.lit(50000))).otherwise(F.array(F.lit(10), F.lit(50000)))
    c = {"keys": keys, "name": F.when(k % 8 > 0, F.col("c_name")), "geometry": F.when(k % 3 == 0, "planar").when(k % 3 == 1, "bender").otherwise(F.col("c_mktsegment")),
         "waveform": F.when(k % 10 == 0, "SAW").otherwise("SINE"), "counting": F.lit("burst"),
         "freq_hz": F.when(k % 6 == 0, None).when(k % 6 == 1, "fast").when(k % 6 == 2, "12.5").otherwise("0.5"),
         "max_cycles": F.when(k % 7 == 0, "0").otherwise("100000"), "t_lo": 10.0 + k % 30, "t_hi": F.lit(30.0), "milestones": ms,
         "landing_s": F.lit(8.0), "settle_s": F.lit(2.0), "lead_s": (n % 10).cast("double"), "loop_depth": F.lit(1),
         "types": F.array(F.lit("cycle"), F.lit("full_interlude")), "break_ins": F.array(F.lit(1)),
         "baselines": F.when(nb == 0, F.array().cast("array<int>")).when(nb == 1, F.array(F.lit(2))).when(nb == 2, F.array(F.lit(2), F.lit(4))).otherwise(F.array(F.lit(0), F.lit(4)))}
    return t("customer").select("c_custkey", F.array_join(Q.plan_problems(c), "; ").alias("problems")).select(k.alias("k"), "problems").where("problems <> ''")


CLAIM = """ctx AS (SELECT grp, 'campaign.min_cycles' AS path, CAST(min(cycles) AS VARCHAR) AS value FROM survival GROUP BY grp UNION ALL SELECT grp, 'campaign.n', CAST(count(*) AS VARCHAR) FROM survival GROUP BY grp
  UNION ALL SELECT grp, 'run.disposition', 'complete' FROM survival GROUP BY grp),
 clm AS (SELECT g.grp, c.* FROM (SELECT DISTINCT grp FROM survival) g, (VALUES ('R1','campaign.min_cycles','>=','5000',NULL),('R2','campaign.n','>','60',NULL),('R3','run.disposition','==','complete',NULL),
  ('R4','campaign.b99','>=','1',NULL),('R5','campaign.n','>','1','tailored'),('R6','campaign.n',NULL,'1','comply')) c(req_id,achieved_path,op,required,status))"""


@query("p30_compliance", oracle(
    """, j AS (SELECT clm.*, value, coalesce(status IN ('tailored','pending'),false) AS hand, CASE op WHEN '>=' THEN try_cast(value AS DOUBLE)>=try_cast(required AS DOUBLE) WHEN '>' THEN try_cast(value AS DOUBLE)>try_cast(required AS DOUBLE) END AS num FROM clm LEFT JOIN ctx ON ctx.grp=clm.grp AND path=achieved_path)
    SELECT grp, req_id, CASE WHEN hand THEN status WHEN value IS NULL OR op IS NULL THEN 'deviate' WHEN coalesce(num, value=required) THEN 'comply' ELSE 'deviate' END AS status,
    CASE WHEN hand THEN NULL WHEN value IS NULL OR op IS NULL THEN 'no achieved data' WHEN NOT coalesce(num, value=required) THEN 'misses the requirement' END AS auto_note FROM j""", "survival", ctes=CLAIM))
def _(t):
    s = t.survival.groupBy("grp").agg(F.min("cycles").alias("lo"), F.count(F.lit(1)).alias("n"))
    ctx = P.context_rows(s, ["grp"], {"campaign.min_cycles": F.col("lo"), "campaign.n": F.col("n"), "run.disposition": F.lit("complete")})
    rows = [("R1", "campaign.min_cycles", ">=", "5000", None), ("R2", "campaign.n", ">", "60", None), ("R3", "run.disposition", "==", "complete", None),
            ("R4", "campaign.b99", ">=", "1", None), ("R5", "campaign.n", ">", "1", "tailored"), ("R6", "campaign.n", None, "1", "comply")]
    names = ["req_id", "achieved_path", "op", "required", "status"]
    c = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, r)]) for r in rows])
    claims = s.select("grp", F.explode(c).alias("c")).select("grp", "c.*")
    return P.evaluate_claims(claims, ctx, ["grp"]).select("grp", "req_id", "status", "auto_note")


@query("p31_claim_problems", oracle(
    """, p AS (SELECT doc_id, concat_ws('; ', CASE WHEN doc_id%5=0 THEN 'missing req_id' END, CASE WHEN doc_id%7=0 THEN 'missing source_clause' END, CASE WHEN trim(coalesce(text,''))='' THEN 'missing statement' END,
     CASE WHEN doc_id%3=0 AND doc_id%2=0 THEN 'tailored without a note' END, CASE WHEN doc_id%11=0 THEN 'unknown op' END) AS problems FROM documents) SELECT * FROM p WHERE problems<>''"""))
def _(t):
    k = F.col("doc_id")
    d = t("documents").select("doc_id", F.when(k % 5 > 0, "R").otherwise(" ").alias("req_id"), F.when(k % 7 > 0, "c").alias("source_clause"), F.col("text").alias("statement"),
                              F.when(k % 3 == 0, "tailored").alias("status"), F.when(k % 2 > 0, "note").alias("tailoring_note"), F.when(k % 11 == 0, "~").otherwise(">=").alias("op"))
    return d.select("doc_id", F.array_join(P.claim_problems(), "; ").alias("problems")).where("problems <> ''")


@query("k8_config_hash", oracle("""SELECT c_custkey, sha256('{"cap_kv":'||c_custkey||',"drive":{"hz":0.5,"note":null},"geometry":"'||c_mktsegment||'"}') AS sha FROM customer"""))
def _(t):
    drive = F.struct(F.lit(None).cast("string").alias("note"), F.lit(0.5).alias("hz"))
    config = F.struct(F.col("c_mktsegment").alias("geometry"), drive.alias("drive"), F.col("c_custkey").alias("cap_kv"))
    c = t("customer").select("c_custkey", config.alias("config"))
    return c.select("c_custkey", Q.config_hash(c, "config").alias("sha"))


@query("a11_campaign_context", oracle(
    """, c AS (SELECT grp, count(*) AS n, min(cycles) AS lo, max(cycles) AS hi FROM survival GROUP BY grp)
    SELECT c.grp, c.n, round(lo,4) AS min_cycles, round(hi,4) AS max_cycles, round(b10,4) AS b10 FROM c LEFT JOIN mrr USING (grp)""", "survival", ctes=QS.MRR))
def _(t):
    return rounded(P.campaign_context(t.survival, S.fit_mrr(t.survival, ["grp"]), ["grp"]), 4)


@query("t2_survival_order", oracle("SELECT specimen_id, round(cycles,4) AS cycles, status, row_number() OVER (PARTITION BY grp ORDER BY cycles, specimen_id) AS pos FROM survival", "survival"))
def _(t):
    from stamina.operators.ordered import Ordered
    o = Ordered(t.survival, ["grp"], ["cycles", "specimen_id"]).row_number("pos").result()
    return rounded(o.select("specimen_id", "cycles", "status", "pos"), 4)


@query("u1_drifting_union", oracle(
    """SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS VARCHAR) AS segment FROM nation UNION ALL SELECT CAST(c_custkey AS INTEGER), NULL, c_mktsegment FROM customer"""))
def _(t):
    a = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    b = t("customer").select(F.col("c_custkey").cast("int").alias("id"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("p16_unknown_keys", oracle(
    """, c AS (SELECT c_custkey AS k FROM customer)
    SELECT k, 'colour' AS path FROM c WHERE k%9=0 UNION ALL SELECT k, 'drive.amps' FROM c WHERE k%4=0 UNION ALL SELECT k, 'blocks[0].kv' FROM c WHERE k%5=0
    UNION ALL SELECT k, 'blocks[1].staircase.colour' FROM c WHERE k%6=0 UNION ALL SELECT k, 'blocks[2].blocks[0].blocks[1].hold' FROM c WHERE k%7=0
    UNION ALL SELECT k, 'blocks[2].blocks[1].speed' FROM c WHERE k%3=0"""))
def _(t):
    k = F.col("c_custkey")
    extra = lambda m, name: F.when(k % m == 0, F.lit(f', "{name}": 1')).otherwise(F.lit(""))
    doc = F.concat(F.lit('{"name": "p", "drive": {"waveform": "SINE"'), extra(4, "amps"), F.lit('}, "stop": {"max_cycles": 9}'), extra(9, "colour"),
                   F.lit(', "blocks": [{"type": "cycle", "n_cycles": 5'), extra(5, "kv"), F.lit('}, {"type": "full_interlude", "staircase": {"start_kv": 0'), extra(6, "colour"),
                   F.lit('}}, {"type": "loop", "repeat": 2, "blocks": [{"type": "loop", "repeat": 1, "blocks": [{"type": "ramp", "to_kv": 1}, {"type": "dc_hold", "kv": 1'), extra(7, "hold"),
                   F.lit('}]}, {"type": "wait_env", "prompt": "x"'), extra(3, "speed"), F.lit('}]}, {"type": "no such", "odd": 1}]}'))
    return Q.unknown_paths(t("customer").select(k.alias("k"), doc.alias("doc")), ["k"], "doc")


@query("r1_run_report", oracle(
    """, i AS (SELECT run_id+CASE WHEN rest_value>4.5 THEN 1000000 ELSE 0 END AS run_id, count(*) AS ni, count(*) FILTER (is_baseline) AS nb FROM interludes GROUP BY 1),
    b AS (SELECT run_id, count(*) AS blocks, CAST(sum(CASE WHEN type='cycle' THEN cycles_done ELSE 0 END) AS BIGINT) AS cycles, bool_or(counting='burst' AND cycles_done>4800) AS f FROM blocks GROUP BY run_id),
    j AS (SELECT run_id, coalesce(blocks,0) AS blocks, coalesce(cycles,0) AS cycles, coalesce(ni,0) AS interludes, coalesce(nb,0) AS baselines, coalesce(f,false) AS f FROM b FULL JOIN i USING (run_id))
    SELECT run_id, blocks, cycles, interludes, baselines, CASE WHEN f THEN 'FAILED at '||format('{:,}',cycles)||' cycles: leakage' ELSE 'Reached its stop cap at '||format('{:,}',cycles)||' cycles' END AS verdict,
    CASE WHEN f THEN 'failed' ELSE 'suspended' END AS enters_as FROM j""", "blocks", "interludes"))
def _(t):
    """All runs of both tables; the stiffest interludes stand for runs that have no blocks."""
    from stamina.operators.registry import verdict
    interludes = t.interludes.withColumn("run_id", F.col("run_id") + F.when(F.col("rest_value") > 4.5, 1_000_000).otherwise(0))
    c = P.counts(t.blocks, interludes, ["run_id"]).drop("modes")
    b = t.blocks.groupBy("run_id").agg(F.sum(F.when(F.col("type") == "cycle", F.col("cycles_done")).otherwise(0)).alias("cycles"),
                                       F.bool_or((F.col("counting") == "burst") & (F.col("cycles_done") > 4800)).alias("f"))
    c = c.join(b, "run_id", "left").withColumns({"cycles": F.coalesce("cycles", F.lit(0)), "f": F.coalesce("f", F.lit(False))})
    text, enters = verdict(F.when(F.col("f"), "failed").otherwise("complete"), F.col("cycles"), F.lit("leakage"))
    return c.select("run_id", "blocks", "cycles", "interludes", "baselines", text.alias("verdict"), enters.alias("enters_as"))


AUDIT_SQL = """a AS (SELECT user_id AS run_id, event_id, epoch_us(ts)/1e6 AS t, event_id%977*10 AS cycles_total, CASE WHEN event_id%3>0 THEN 'fast' END AS tier,
    CASE WHEN event_id%11=0 THEN 'env_entry' WHEN event_id%13=0 THEN 'wait_env' ELSE 'rule'||event_id%5 END AS rule_id,
    CASE event_type WHEN 'error' THEN 'abort' WHEN 'signup' THEN 'flag' WHEN 'purchase' THEN 'ack' WHEN 'click' THEN 'warn' ELSE 'log' END AS action, 'event '||event_id AS message FROM events)"""


def _audit(t):
    k, e = F.col("event_id"), F.col("event_type")
    return t("events").select(
        F.col("user_id").alias("run_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (k % 977 * 10).alias("cycles_total"),
        F.when(k % 3 > 0, "fast").alias("tier"), F.when(k % 11 == 0, "env_entry").when(k % 13 == 0, "wait_env").otherwise(F.concat(F.lit("rule"), k % 5)).alias("rule_id"),
        F.when(e == "error", "abort").when(e == "signup", "flag").when(e == "purchase", "ack").when(e == "click", "warn").otherwise("log").alias("action"),
        F.concat(F.lit("event "), k).alias("message"))


@query("r1_event_log", oracle(
    """SELECT run_id, round(t,3) AS t, cycles_total, coalesce(tier,'')||'/'||rule_id AS rule, action, message,
    CASE WHEN action='abort' THEN 'red' WHEN action IN ('pause','warn','flag') THEN 'amber' ELSE 'grey' END AS colour FROM a""", ctes=AUDIT_SQL))
def _(t):
    return rounded(P.event_log(_audit(t), ["run_id"]), 3)


@query("r1_environment_record", oracle("SELECT run_id, round(t,3) AS t, rule_id, message FROM a WHERE rule_id IN ('env_entry','wait_env','env_band')", ctes=AUDIT_SQL))
def _(t):
    return rounded(P.environment_record(_audit(t), ["run_id"]), 3)


@query("r1_inventory", oracle("""SELECT CAST(c_custkey AS BIGINT) AS run_id, n.name, CAST(c_custkey*10+len(n.name) AS BIGINT) AS bytes FROM customer,
    (VALUES ('blocks.csv'),('state.JSON')) n(name)"""))
def _(t):
    names = F.explode(F.array(*[F.lit(n) for n in ("blocks.csv", "state.JSON", "frame.png", "clip.h264", "notes")])).alias("name")
    files = t("customer").select(F.col("c_custkey").alias("run_id"), names).withColumn("bytes", F.col("run_id") * 10 + F.length("name"))
    return P.inventory(files)


@query("r1_summaries", oracle(
    """, b AS (SELECT run_id, sum(CASE WHEN type='cycle' THEN cycles_done ELSE 0 END) AS cycles, sum(CASE WHEN type='cycle' THEN cycles_done ELSE 0 END)/4e0 AS act FROM blocks GROUP BY run_id),
    k AS (SELECT run_id, t FROM a WHERE action='ack'),
    o AS (SELECT run_id, string_agg(DISTINCT rule_id, ', ' ORDER BY rule_id) AS open FROM a WHERE action='flag' AND NOT EXISTS (SELECT 1 FROM k WHERE k.run_id=a.run_id AND k.t>=a.t) GROUP BY run_id),
    n AS (SELECT run_id, count(*) AS ne FROM a GROUP BY run_id), i AS (SELECT run_id, count(*) AS ni FROM interludes GROUP BY run_id)
    SELECT b.run_id, CASE WHEN b.run_id%5=0 THEN 'Milestone 5,000 passed, now at '||format('{:,}',CAST(cycles AS BIGINT))||' cycles; the run goes on'
      WHEN b.run_id%5=1 THEN 'FAILED at '||format('{:,}',CAST(cycles AS BIGINT))||' cycles: leakage' ELSE 'Reached its stop cap at '||format('{:,}',CAST(cycles AS BIGINT))||' cycles' END AS verdict,
    format('{:,}',CAST(cycles AS BIGINT))||' cycles | '||format('{:,}',CAST(round_even(act,0) AS BIGINT))||' s actuated | '||coalesce(ni,0)||' interludes | '||coalesce(ne,0)||' events' AS totals,
    coalesce('open amber flags: '||open, 'no open amber flags') AS amber FROM b LEFT JOIN n USING (run_id) LEFT JOIN i USING (run_id) LEFT JOIN o USING (run_id)""",
    "blocks", "interludes", ctes=AUDIT_SQL))
def _(t):
    from stamina.operators.rules import flag_lifecycle
    a, k = _audit(t), F.col("run_id")
    n = F.sum(F.when(F.col("type") == "cycle", F.col("cycles_done")).otherwise(0))
    runs = t.blocks.groupBy("run_id").agg(n.alias("cycles"), (n / 4.0).alias("actuated_s")).select(
        "*", F.when(k % 5 == 1, "failed").otherwise("complete").alias("disposition"), F.lit("leakage").alias("failure_mode"), F.when(k % 5 == 0, 5000).alias("milestone"))
    flags = flag_lifecycle(a.where("action = 'flag'").select("run_id", "event_id", "rule_id", F.col("t").alias("raised_at")),
                           a.where("action = 'ack'").select("run_id", F.col("t").alias("acked_at"), F.col("event_id").alias("acked_by")), ["run_id"])
    return P.summaries(runs, a, t.interludes, flags, ["run_id"])


@query("r5_campaign_report", oracle(
    """, c AS (SELECT grp, count(*) AS n, min(cycles) AS lo FROM survival GROUP BY grp)
    SELECT c.grp, c.n, round(b10,4) AS b10, CASE WHEN coalesce(b10,0)>=20000 THEN 'comply' ELSE 'deviate' END AS b10_status,
    CAST(round_even(2*5000e0,0) AS BIGINT) AS flat_required, CASE WHEN lo>=10000 THEN 'SATISFIES' ELSE 'FALLS SHORT of' END AS flat_says FROM c LEFT JOIN mrr USING (grp)""", "survival", ctes=QS.MRR))
def _(t):
    c = P.campaign_context(t.survival, S.fit_mrr(t.survival, ["grp"]), ["grp"])
    zero = F.lit(0.0)
    need = D.required_flat(F.lit(5000.0), zero, zero, F.lit(False), zero)
    return rounded(c.select("grp", "n", "b10", F.when(F.coalesce("b10", zero) >= 20000, "comply").otherwise("deviate").alias("b10_status"),
                            need.alias("flat_required"), D.advisory(F.col("min_cycles"), need).alias("flat_says")), 4)
