"""Queries over run tables: trends, rules, ledgers, registry."""

from pyspark.sql import functions as F

from stamina.operators import intervals as I
from stamina.operators import ledger as L
from stamina.operators import registry as G
from stamina.operators import rules as R
from stamina.operators import trend as T
from stamina.plans.bindings import oracle
from stamina.plans.registry import query, rounded

LEDGER = """led AS (SELECT *, CAST(sum(CASE WHEN type='cycle' THEN cycles_done ELSE 0 END) OVER w AS BIGINT) AS cycles_total,
 sum(CASE WHEN type='cycle' THEN cycles_done/freq_hz*0.5e0 ELSE cycles_done/10e0 END) OVER w AS actuated_s_total,
 sum(CASE WHEN type='cycle' THEN cycles_done/freq_hz ELSE cycles_done/10e0 END) OVER w AS wall_s_total
 FROM blocks WINDOW w AS (PARTITION BY run_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING))"""


def ledgered(t):
    n, cyc = F.col("cycles_done"), F.col("type") == "cycle"
    return L.ledger(t.blocks, ["run_id"], ["block_idx"], F.when(cyc, n),
                    L.dose(F.col("type"), n, F.col("freq_hz"), F.lit("SINE"), n / 10, F.lit(1.0)),
                    F.when(cyc, n / F.col("freq_hz")).otherwise(n / 10))


@query("w7_ledger", oracle(
    """SELECT run_id, block_idx, cycles_total, round(actuated_s_total,4) AS actuated_s_total, round(wall_s_total,4) AS wall_s_total FROM led""",
    "blocks", ctes=LEDGER))
def _(t):
    return rounded(ledgered(t).select("run_id", "block_idx", "cycles_total", "actuated_s_total", "wall_s_total"), 4)


EDGES = """tops AS (SELECT run_id, max(cycles_total) AS top FROM led WHERE type='cycle' GROUP BY run_id),
 nn AS (SELECT run_id, top, greatest(2, CAST(floor(log10(top)*24) AS INT)) AS n FROM tops WHERE top >= 10),
 edges AS (SELECT DISTINCT run_id, CAST(round_even(pow(10e0, log10(top)*i/CAST(n AS DOUBLE)),0) AS BIGINT) AS edge FROM
  (SELECT run_id, top, n, unnest(range(1,n+1)) AS i FROM nn) UNION SELECT run_id, 0 FROM nn
  UNION SELECT run_id, unnest([0, greatest(1, CAST(floor(top) AS BIGINT))]) FROM tops WHERE top < 10)"""


@query("a2_log_bins", oracle("SELECT run_id, edge FROM edges", "blocks", ctes=LEDGER + ", " + EDGES))
def _(t):
    tops = ledgered(t).where("type = 'cycle'").groupBy("run_id").agg(F.max("cycles_total").alias("top"))
    return T.bin_edges(tops, ["run_id"])


@query("j2_a1_binned_blocks", oracle(
    """, bins AS (SELECT run_id, edge AS lo, lead(edge) OVER (PARTITION BY run_id ORDER BY edge) AS hi FROM edges)
    SELECT b.run_id, lo AS cycles_lo, hi AS cycles_hi, count(*) AS n_blocks, round(avg(imean_ua),10) AS imean_ua,
    array_to_string(list_sort(list(DISTINCT counting)),';') AS counting FROM led b JOIN bins ON b.run_id=bins.run_id AND
    cycles_total>lo AND cycles_total<=hi WHERE type='cycle' GROUP BY ALL""", "blocks", ctes=LEDGER + ", " + EDGES))
def _(t):
    return rounded(T.binned_blocks(ledgered(t), ["run_id"]), 10)


JSONR = """base AS (SELECT *, last_value(CASE WHEN is_baseline THEN interlude_idx END IGNORE NULLS) OVER (PARTITION BY run_id
  ORDER BY interlude_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bi FROM interludes),
 rat AS (SELECT a.run_id, a.interlude_idx, a.is_baseline, a.disp_value/nullif(b.disp_value,0) AS disp_ratio,
  CASE WHEN b.run_id IS NOT NULL THEN a.leak_ua/greatest(abs(b.leak_ua),0.05e0) END AS leak_ratio, a.c_est_nf/nullif(b.c_est_nf,0) AS c_ratio,
  abs(a.c_est_nf/nullif(b.c_est_nf,0)-1) AS c_ratio_dev, CASE WHEN b.run_id IS NOT NULL THEN abs(a.rest_value-b.rest_value)/greatest(abs(CASE WHEN b.disp_value<>0
  THEN b.disp_value ELSE 1 END),1e-9) END AS zero_drift FROM base a LEFT JOIN interludes b ON a.run_id=b.run_id AND a.bi=b.interlude_idx
  AND NOT a.is_baseline)"""
RATIOS = ["disp_ratio", "leak_ratio", "c_ratio", "c_ratio_dev", "zero_drift"]


@query("j1_baseline_ratios", oracle(
    f"SELECT run_id, interlude_idx, {', '.join(f'round({c},6) AS {c}' for c in RATIOS)} FROM rat", "interludes", ctes=JSONR))
def _(t):
    return rounded(R.ratios(t.interludes, ["run_id"], ["interlude_idx"]).select("run_id", "interlude_idx", *RATIOS))


SLOW = """rules AS (SELECT * FROM (VALUES ('amplitude','disp_ratio','<',0.8e0,0.9e0,'abort'),('capacitance','c_ratio_dev','>',0.2e0,0.1e0,'abort'),
 ('leakage','leak_ratio','>',100e0,10e0,'abort'),('zero_drift','zero_drift','>',0.1e0,0.05e0,'warn')) r(rule_id,metric,op,threshold,flag_at,action)),
 met AS (SELECT run_id, interlude_idx, metric, value FROM (UNPIVOT rat ON disp_ratio, leak_ratio, c_ratio_dev, zero_drift INTO NAME metric VALUE value)),
 hit AS (SELECT m.run_id, m.interlude_idx, r.*, value, CASE op WHEN '<' THEN value<threshold ELSE value>threshold END AS hard,
  CASE op WHEN '<' THEN value<flag_at ELSE value>flag_at END AS amber FROM met m JOIN rules r USING (metric)),
 fires AS (SELECT run_id, interlude_idx, rule_id, value, threshold AS lim, action, false AS is_flag FROM hit WHERE hard UNION ALL
  SELECT run_id, interlude_idx, rule_id, value, flag_at, 'flag', true FROM (SELECT *, row_number() OVER (PARTITION BY run_id, rule_id
  ORDER BY interlude_idx) AS rn FROM hit WHERE amber AND NOT hard) WHERE rn=1)"""


def _slow(t):
    m = R.to_metrics(R.ratios(t.interludes, ["run_id"], ["interlude_idx"]), ["run_id", "interlude_idx"],
                     ["disp_ratio", "leak_ratio", "c_ratio_dev", "zero_drift"])
    return R.fire_slow(m, R.default_rules(t.spark), ["run_id"], ["interlude_idx"])


@query("w6_slow_rules", oracle(
    "SELECT run_id, interlude_idx, rule_id, round(value,6) AS value, lim AS \"limit\", action, is_flag FROM fires",
    "interludes", ctes=JSONR + ", " + SLOW))
def _(t):
    return rounded(_slow(t).drop("tier"))


@query("j5_rule_join", oracle(
    "SELECT run_id, interlude_idx, rule_id, round(value,6) AS value, threshold, action FROM hit WHERE hard",
    "interludes", ctes=JSONR + ", " + SLOW))
def _(t):
    m = R.to_metrics(R.ratios(t.interludes, ["run_id"], ["interlude_idx"]), ["run_id", "interlude_idx"],
                     ["disp_ratio", "leak_ratio", "c_ratio_dev", "zero_drift"])
    return rounded(R.fire_plain(m, R.default_rules(t.spark), "slow").select(
        "run_id", "interlude_idx", "rule_id", "value", "threshold", "action"))


@query("w5_first_cause", oracle(
    """SELECT run_id, arg_min(rule_id, (interlude_idx, rule_id)) AS failure_mode FROM fires WHERE action='abort' GROUP BY run_id""",
    "interludes", ctes=JSONR + ", " + SLOW))
def _(t):
    return R.first_cause(_slow(t), ["run_id"], ["interlude_idx"])


OVR = """ovr AS (SELECT c_custkey, CASE c_custkey%4 WHEN 0 THEN 'slow' WHEN 1 THEN 'fast' WHEN 2 THEN 'slow' ELSE 'warp' END AS tier,
 CASE c_custkey%4 WHEN 0 THEN 'amplitude' WHEN 1 THEN 'overcurrent' WHEN 2 THEN 'custom_'||c_nationkey ELSE 'x' END AS rule_id,
 CASE WHEN c_custkey%4=2 THEN 'rest_value' END AS metric, CASE WHEN c_custkey%3=0 THEN '>' WHEN c_custkey%7=0 THEN '!=' END AS op,
 CASE WHEN c_custkey%5<>0 THEN abs(c_acctbal) END AS threshold, CASE WHEN c_custkey%2=0 THEN 'warn' WHEN c_custkey%11=0 THEN 'explode' END AS action,
 CASE WHEN c_custkey%13=0 THEN 'colour' ELSE '' END AS extra FROM customer)"""


def _overrides(t):
    k = F.col("c_custkey")
    return t("customer").select(
        k, F.when(k % 4 == 0, "slow").when(k % 4 == 1, "fast").when(k % 4 == 2, "slow").otherwise("warp").alias("tier"),
        F.when(k % 4 == 0, "amplitude").when(k % 4 == 1, "overcurrent")
        .when(k % 4 == 2, F.concat(F.lit("custom_"), F.col("c_nationkey"))).otherwise("x").alias("rule_id"),
        F.when(k % 4 == 2, "rest_value").alias("metric"), F.when(k % 3 == 0, ">").when(k % 7 == 0, "!=").alias("op"),
        F.when(k % 5 != 0, F.abs("c_acctbal")).alias("threshold"),
        F.when(k % 2 == 0, "warn").when(k % 11 == 0, "explode").alias("action"),
        F.when(k % 13 == 0, F.array(F.lit("colour"))).otherwise(F.array().cast("array<string>")).alias("extra_keys"))


@query("p15_override_problems", oracle(
    """, k AS (SELECT *, tier||'/'||rule_id NOT IN ('slow/amplitude','fast/overcurrent') AS nw FROM ovr),
    p AS (SELECT c_custkey, concat_ws('; ', CASE WHEN tier='warp' THEN 'unknown tier warp' END,
     CASE WHEN nw AND metric IS NULL THEN 'new rule is missing metric' END, CASE WHEN nw AND op IS NULL THEN 'new rule is missing op' END,
     CASE WHEN nw AND threshold IS NULL THEN 'new rule is missing threshold' END, CASE WHEN nw AND action IS NULL THEN 'new rule is missing action' END,
     CASE WHEN op='!=' THEN 'unknown op !=' END, CASE WHEN action='explode' THEN 'unknown action explode' END,
     CASE WHEN extra<>'' THEN 'unknown keys '||extra END) AS problems FROM k) SELECT * FROM p WHERE problems<>''""", ctes=OVR))
def _(t):
    probs = R.rule_problems(R.known_rule_ids())
    return (_overrides(t).select("c_custkey", F.array_join(probs, "; ").alias("problems")).where("problems <> ''"))


@query("j6_merge_rules", oracle(
    """, d AS (SELECT * FROM (VALUES ('slow','amplitude','disp_ratio','<',0.8e0,'abort'),('fast','overcurrent','i_dev_ua','>=',100e0,'abort')) v(tier,rule_id,metric,op,threshold,action)),
    ds AS (SELECT c.c_custkey, d.* FROM d, (SELECT c_custkey FROM customer) c)
    SELECT c_custkey, tier, rule_id, coalesce(o.metric,ds.metric) AS metric, coalesce(o.op,ds.op) AS op,
    round(coalesce(o.threshold,ds.threshold),4) AS threshold, coalesce(o.action,ds.action) AS action
    FROM ds FULL JOIN (SELECT * FROM ovr WHERE tier<>'warp') o USING (c_custkey,tier,rule_id)""", ctes=OVR))
def _(t):
    cols = ["tier", "rule_id", "metric", "op", "threshold", "action"]
    pick = [r for r in R.DEFAULT_RULES if r[1] in ("amplitude", "overcurrent")]
    packs = F.array(*[F.struct(*[F.lit(r[i]).alias(c) for c, i in zip(cols, (0, 1, 2, 3, 4, 7))]) for r in pick])
    d = t("customer").select("c_custkey", F.explode(packs).alias("p")).select("c_custkey", "p.*")
    o = _overrides(t).where("tier <> 'warp'").select("c_custkey", *cols)
    return rounded(R.merge_rules(d, o, ["c_custkey"]), 4)


def island_sql(over, t="t_s"):
    return f"""x AS (SELECT *, {over} AS ov FROM telemetry WHERE ({over}) IS NOT NULL),
 y AS (SELECT *, sum(CASE WHEN ov THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY ts, sample_id ROWS UNBOUNDED PRECEDING) AS isl FROM x),
 z AS (SELECT *, min(t_s) OVER (PARTITION BY run_id, isl) AS since, row_number() OVER (PARTITION BY run_id, isl ORDER BY ts, sample_id) AS rn
  FROM y WHERE ov)"""


KEYS, ORDER = ["run_id"], ["ts", "sample_id"]


@query("w2_sustained", oracle(
    """SELECT run_id, min_by(sample_id, ts) AS sample_id, round(min(since),3) AS since FROM z WHERE t_s-since>=7200 GROUP BY run_id, isl""",
    "telemetry", ctes=island_sql("ua >= 6")))
def _(t):
    s = R.sustained(t.telemetry, KEYS, ORDER, "t_s", F.col("ua") >= 6, F.lit(7200.0))
    return s.select("run_id", "sample_id", F.round("since", 3).alias("since"))


@query("w3_watchdog", oracle(
    """SELECT run_id, min_by(sample_id, ts) AS sample_id, round(min_by(since, ts),3) AS since FROM z WHERE rn>1 AND t_s-since>=10800 GROUP BY run_id""",
    "telemetry", ctes=island_sql("CASE WHEN i_status='offscreen' THEN true WHEN ua IS NOT NULL THEN abs(ua-2)>=8 END")))
def _(t):
    w = R.watchdog(t.telemetry, KEYS, ORDER, "t_s", F.col("ua"), F.col("i_status") == "offscreen", 8.0, 10800.0, F.lit(2.0))
    return w.select("run_id", "sample_id", F.round("since", 3).alias("since"))


BLIND = """b0 AS (SELECT *, i_status <> 'invalid' AS okk FROM telemetry),
 b1 AS (SELECT *, sum(CASE WHEN okk THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS isl FROM b0),
 b2 AS (SELECT *, CASE WHEN NOT okk THEN t_s - min(CASE WHEN NOT okk THEN t_s END) OVER (PARTITION BY run_id, isl) END AS bs FROM b1),
 b3 AS (SELECT *, lag(bs) OVER (PARTITION BY run_id ORDER BY ts) AS pb FROM b2)"""


@query("w4_blind_ladder", oracle(
    """SELECT run_id, sample_id, round(bs,3) AS blind_s, CASE WHEN bs>=1800 THEN 'warn' ELSE 'recovered' END AS ladder FROM b3
    WHERE (bs>=1800 AND NOT coalesce(pb>=1800,false)) OR (okk AND pb>=1800)""", "telemetry", ctes=BLIND))
def _(t):
    b = R.blind_ladder(t.telemetry, KEYS, ORDER, "t_s", F.col("i_status") != "invalid", 1800.0)
    return b.where("ladder is not null").select("run_id", "sample_id", F.round("blind_s", 3).alias("blind_s"), "ladder")


@query("w4_monitor_loss", oracle(
    """, e AS (SELECT *, bs>=5400 AS ov FROM b2 WHERE bs>0),
    f AS (SELECT *, lag(ov) OVER (PARTITION BY run_id ORDER BY ts) AS po FROM e)
    SELECT run_id, sample_id, round(bs,3) AS blind_s FROM f WHERE ov AND NOT coalesce(po,false)""", "telemetry", ctes=BLIND))
def _(t):
    b = R.blind_ladder(t.telemetry, KEYS, ORDER, "t_s", F.col("i_status") != "invalid", 1800.0)
    s = R.sustained(b, KEYS, ORDER, "t_s", F.when(F.col("blind_s") > 0, F.col("blind_s") >= 5400), F.lit(0.0))
    return s.select("run_id", "sample_id", F.round("blind_s", 3).alias("blind_s"))


TIMED = """, a AS (SELECT *, CASE WHEN i_status='ok' THEN f_meas END AS f, lag(t_s) OVER w AS pt,
      last_value(CASE WHEN i_status='ok' THEN f_meas END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lf,
      count(CASE WHEN i_status='ok' THEN 1 END) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS isl
      FROM telemetry WINDOW w AS (PARTITION BY run_id ORDER BY ts)),
    b AS (SELECT *, min(CASE WHEN f IS NULL AND lf IS NOT NULL THEN t_s END) OVER (PARTITION BY run_id, isl) AS st FROM a),
    c AS (SELECT *, CASE WHEN f IS NOT NULL THEN f WHEN t_s-st<=3600 THEN lf END AS used FROM b),
    d AS (SELECT run_id, coalesce(sum(CASE WHEN t_s>pt THEN used*(t_s-pt) END),0) AS cy, bool_or(f IS NOT NULL AND NOT abs(f-3)/3<=0.02e0) AS mm FROM c GROUP BY run_id)"""


@query("w8_timed_count", oracle(
    TIMED + " SELECT run_id, round(cy,3) AS cycles, mm AS mismatch, CAST(floor(cy) AS BIGINT) AS credited FROM d", "telemetry"))
def _(t):
    f = F.when(F.col("i_status") == "ok", F.col("f_meas"))
    return rounded(L.timed_count(t.telemetry, KEYS, ORDER, "t_s", f, F.lit(3.0), 3600.0), 3)


@query("w20_evidence_ring", oracle(
    """, s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, sample_id) AS rn FROM telemetry),
    tr AS (SELECT run_id, sample_id AS trip, rn FROM s WHERE i_status='offscreen')
    SELECT s.run_id, tr.trip, s.sample_id, tr.rn-s.rn AS age FROM s JOIN tr ON s.run_id=tr.run_id AND s.rn BETWEEN tr.rn-119 AND tr.rn""", "telemetry"))
def _(t):
    trips = t.telemetry.where("i_status = 'offscreen'").withColumn("trip", F.col("sample_id"))
    return R.evidence_ring(t.telemetry, trips, KEYS, ORDER, "trip", 120).select("run_id", "trip", "sample_id", "age")


@query("w21_recent_events", oracle(
    """SELECT run_id, sample_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, sample_id DESC) AS rank FROM telemetry) WHERE rank<=10""",
    "telemetry"))
def _(t):
    return R.recent(t.telemetry, KEYS, ORDER).select("run_id", "sample_id", "rank")


@query("w25_cap_crossing", oracle(
    """SELECT run_id, block_idx, cycles_total, round(wall_s_total,4) AS wall_s_total, CASE WHEN cycles_total>=10000 THEN 'cycles' ELSE 'wall' END AS cap
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY block_idx) AS rn FROM led WHERE cycles_total>=10000 OR wall_s_total>=15000) WHERE rn=1""",
    "blocks", ctes=LEDGER))
def _(t):
    return rounded(L.cap_crossing(ledgered(t), ["run_id"], ["block_idx"], 10000, 15000.0), 4)


@query("w28_paused", oracle(
    """SELECT run_id, round(coalesce(sum(CASE WHEN p THEN nt-t_s END),0),3) AS paused_s, count(*) FILTER (p) AS pauses FROM
    (SELECT *, lead(t_s) OVER (PARTITION BY run_id ORDER BY ts, sample_id) AS nt FROM (SELECT *, i_status='invalid' AS p FROM telemetry
     WHERE i_status IN ('invalid','offscreen'))) GROUP BY run_id""", "telemetry"))
def _(t):
    e = t.telemetry.where("i_status in ('invalid','offscreen')")
    return rounded(L.paused_seconds(e, KEYS, ORDER, "t_s", F.col("i_status") == "invalid"), 3)


@query("j10_asof_backward", oracle(
    """, a AS (SELECT *, last_value(CASE WHEN i_status='offscreen' THEN sample_id END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts, sample_id
     ROWS UNBOUNDED PRECEDING) AS att, last_value(CASE WHEN i_status='offscreen' THEN t_s END IGNORE NULLS) OVER (PARTITION BY run_id
     ORDER BY ts, sample_id ROWS UNBOUNDED PRECEDING) AS att_t FROM telemetry)
    SELECT run_id, sample_id, att AS att_id, round(t_s-att_t,3) AS age_s FROM a WHERE i_status<>'offscreen'""", "telemetry"))
def _(t):
    left = t.telemetry.where("i_status <> 'offscreen'")
    right = t.telemetry.where("i_status = 'offscreen'")
    j = I.asof_join(left, right, KEYS, "ts", {"att_id": F.col("sample_id"), "att_t": F.col("t_s")}, ["sample_id"])
    return rounded(j.select("run_id", "sample_id", "att_id", (F.col("t_s") - F.col("att_t")).alias("age_s")), 3)


MARKS = [1000, 5000, 10000, 20000]
MILESTONE_SQL = oracle(
    """, n AS (SELECT *, lead(type) OVER (PARTITION BY run_id ORDER BY block_idx) AS nx FROM led),
    s AS (SELECT * FROM n WHERE type='cycle' AND coalesce(nx,'')<>'dc_hold')
    SELECT run_id, arg_min(block_idx, block_idx) AS block_idx, m AS milestone, min(cycles_total) AS cycles_total FROM s,
    (SELECT CAST(unnest([1000,5000,10000,20000]) AS BIGINT) AS m) WHERE cycles_total>=m GROUP BY run_id, m""", "blocks", ctes=LEDGER)


@query("j11_milestones", MILESTONE_SQL)
def _(t):
    return L.milestones(t.blocks, ["run_id"], ["block_idx"], F.when(F.col("type") == "cycle", F.col("cycles_done")),
                        "type", ["cycle"], ["dc_hold"], MARKS)


@query("j14_reconcile", oracle(
    """, s AS (SELECT run_id, CAST(sum(cycles_done) AS BIGINT) AS c, count(*) AS n FROM blocks GROUP BY run_id),
    k AS (SELECT c_custkey AS run_id, coalesce(c,0)+CASE WHEN c_custkey%5=0 THEN 1 ELSE 0 END AS cycles, coalesce(n,0)+CASE WHEN c_custkey%7=0 THEN 2 ELSE 0 END AS rws
     FROM customer LEFT JOIN s ON run_id=c_custkey)
    SELECT k.run_id, coalesce(c,0)-cycles AS cycles_diff, coalesce(n,0)-rws AS rows_diff, coalesce(c,0)=cycles AND coalesce(n,0)=rws AS reconciled
    FROM k LEFT JOIN s USING (run_id)""", "blocks"))
def _(t):
    k = F.col("c_custkey")
    s = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(F.floor(F.col("o_totalprice") / 100)).alias("c"), F.count(F.lit(1)).alias("n"))
    ck = t("customer").join(s, "c_custkey", "left").select(
        k.alias("run_id"), (F.coalesce("c", F.lit(0)) + F.when(k % 5 == 0, 1).otherwise(0)).alias("cycles"),
        (F.coalesce("n", F.lit(0)) + F.when(k % 7 == 0, 2).otherwise(0)).alias("block_rows"))
    return L.reconcile(t.blocks, ck, ["run_id"])


@query("j15_unregistered", oracle("SELECT run_id AS specimen_id, block_idx AS run_seq FROM blocks WHERE run_id%4=0", "blocks"))
def _(t):
    """Outcomes of specimens that the registry doesn't have."""
    known = t("customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("specimen_id"))
    return G.unregistered_outcomes(known, t.blocks.select(F.col("run_id").alias("specimen_id"), F.col("block_idx").alias("run_seq")))


@query("j15_upsert", oracle(
    """, o AS (SELECT run_id AS id, sum(cycles_done) AS c, sum(cycles_done/freq_hz*0.5e0) AS a, max(block_idx) AS lr, bool_or(counting='burst' AND block_idx%4=0) AS f,
      min(CASE WHEN counting='burst' AND block_idx%4=0 THEN block_idx END) AS fb FROM blocks GROUP BY run_id)
    SELECT c_custkey AS specimen_id, CASE WHEN c_custkey%10=0 OR coalesce(f,false) THEN 'failed' WHEN lr IS NOT NULL THEN 'suspended' ELSE 'in_test' END AS status,
    round(CAST(c_custkey+coalesce(c,0) AS DOUBLE),4) AS cycles_accum, round(coalesce(a,0),4) AS actuated_s_accum,
    CASE WHEN lr IS NULL THEN 'none' ELSE 'r'||lr END AS last_run_id, CASE WHEN c_custkey%10=0 THEN 'old' WHEN fb IS NOT NULL THEN CASE WHEN fb%8=0 THEN 'unspecified' ELSE 'leakage' END END AS failure_mode
    FROM customer LEFT JOIN o ON id=c_custkey""", "blocks"))
def _(t):
    k, b = F.col("c_custkey"), F.col("block_idx")
    reg = t("customer").select(
        k.alias("specimen_id"), F.when(k % 10 == 0, "failed").otherwise("in_test").alias("status"),
        k.cast("double").alias("cycles_accum"), F.lit(0.0).alias("actuated_s_accum"), F.lit("none").alias("last_run_id"),
        F.when(k % 10 == 0, "old").alias("failure_mode"))
    out = t.blocks.select(
        F.col("run_id").alias("specimen_id"), b.alias("run_seq"), F.concat(F.lit("r"), b).alias("run_id"),
        F.when((F.col("counting") == "burst") & (b % 4 == 0), "failed").otherwise("complete").alias("disposition"),
        F.col("cycles_done").cast("double").alias("cycles"), (F.col("cycles_done") / F.col("freq_hz") * 0.5).alias("actuated_s"),
        F.when(b % 8 != 0, "leakage").alias("failure_mode"))
    # outcomes of specimens that nobody registered must not enter
    strange = out.withColumn("specimen_id", -F.col("specimen_id") - 1)
    return rounded(G.upsert_outcomes(reg, out.unionByName(strange)), 4)


CAPS = """caps AS (SELECT s.*, least(coalesce(specimen_cap_kv, g.cap, 10e0), 10e0) AS cap_kv FROM specimens s LEFT JOIN
 (VALUES ('AUTOMOBILE',2e0),('BUILDING',2.5e0),('FURNITURE',10e0),('MACHINERY',2.5e0)) g(geometry,cap) USING (geometry))"""


def _caps(t):
    g = t.spark.createDataFrame([("AUTOMOBILE", 2.0), ("BUILDING", 2.5), ("FURNITURE", 10.0), ("MACHINERY", 2.5)],
                                "geometry string, cap_kv double")
    s = t.specimens
    return G.hard_cap(s, g, s.where("specimen_cap_kv is not null").select("specimen_id", F.col("specimen_cap_kv").alias("cap_kv")))


@query("j4_hard_cap", oracle("SELECT specimen_id, geometry, round(cap_kv,6) AS cap_kv FROM caps", "specimens", ctes=CAPS))
def _(t):
    return rounded(_caps(t).select("specimen_id", "geometry", "cap_kv"))


@query("p28_over_cap", oracle(
    """SELECT specimen_id, label, kv, CASE WHEN kv>cap_kv+1e-9 THEN 'above specimen cap' ELSE 'above amplifier' END AS problem FROM caps,
    (VALUES ('drive',1.5e0),('reference',1e0),('staircase',6e0),('hold',12e0)) v(label,kv) WHERE kv>cap_kv+1e-9 OR kv>10+1e-9""", "specimens", ctes=CAPS))
def _(t):
    lv = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(v).alias("kv")) for n, v in
                   (("drive", 1.5), ("reference", 1.0), ("staircase", 6.0), ("hold", 12.0))])
    return G.over_cap(_caps(t).select("specimen_id", "cap_kv", F.explode(lv).alias("l")).select("specimen_id", "cap_kv", "l.*")).drop("cap_kv")


@query("p23_verdict", oracle(
    """SELECT o_orderkey, CASE WHEN m IS NOT NULL THEN 'Milestone '||format('{:,}',m)||' passed, now at '||n||' cycles; the run goes on'
    WHEN d='failed' THEN 'FAILED at '||n||' cycles: leakage' WHEN d='complete' THEN 'Reached its stop cap at '||n||' cycles'
    WHEN d='suspended' THEN 'Suspended at '||n||' cycles' WHEN d='NOT_ZEROED' THEN 'ENDED WITH DRIVE NOT ZEROED' ELSE 'Run ended: '||d||' at '||n||' cycles' END AS verdict,
    CASE WHEN m IS NULL THEN CASE WHEN d='failed' THEN 'failed' ELSE 'suspended' END END AS enters_as
    FROM (SELECT o_orderkey, format('{:,}',CAST(floor(o_totalprice) AS BIGINT)) AS n,
    CASE WHEN o_orderkey%7=0 THEN CAST(floor(o_totalprice/1000)*1000 AS BIGINT) END AS m,
    CASE o_orderkey%5 WHEN 0 THEN 'failed' WHEN 1 THEN 'complete' WHEN 2 THEN 'suspended' WHEN 3 THEN 'NOT_ZEROED' ELSE 'aborted' END AS d FROM orders)"""))
def _(t):
    d = F.get(F.array(*[F.lit(x) for x in ("failed", "complete", "suspended", "NOT_ZEROED", "aborted")]), (F.col("o_orderkey") % 5).cast("int"))
    mark = F.when(F.col("o_orderkey") % 7 == 0, F.floor(F.col("o_totalprice") / 1000) * 1000)
    text, enters = G.verdict(d, F.floor("o_totalprice"), F.lit("leakage"), mark)
    return t("orders").select("o_orderkey", text.alias("verdict"), enters.alias("enters_as"))


@query("p24_health", oracle(
    """SELECT o_orderkey, CASE WHEN o_orderkey%6=0 OR o_orderstatus='F' THEN 'RED' WHEN o_orderkey%4>0 THEN 'AMBER' ELSE 'GREEN' END AS health FROM orders"""))
def _(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", G.health(k % 6 != 0, k % 4, F.when(F.col("o_orderstatus") == "F", "failed")
                                                     .otherwise("complete")).alias("health"))


CKPT = """ck AS (SELECT c_custkey AS run_id, md5(c_mktsegment) AS ckpt_sha, CASE WHEN c_custkey%3=0 THEN true WHEN c_custkey%3=1 THEN false END AS clean_shutdown
 FROM customer WHERE c_acctbal>0)"""


def _ckpt(t):
    k = F.col("c_custkey")
    return t("customer").where("c_acctbal > 0").select(k.alias("run_id"), F.md5("c_mktsegment").alias("ckpt_sha"),
                                                       F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("clean_shutdown"))


@query("p25_unclean", oracle("SELECT run_id FROM ck WHERE NOT coalesce(clean_shutdown,false)", ctes=CKPT))
def _(t):
    return G.unclean(_ckpt(t)).select("run_id")


@query("p26_resume", oracle(
    """, j AS (SELECT r.run_id, CASE WHEN ck.run_id IS NULL THEN 'no checkpoint' WHEN sha<>ckpt_sha THEN 'configuration changed' WHEN clean_shutdown THEN
    'clean end, nothing to resume' END AS reason FROM (SELECT c_custkey AS run_id, md5(CASE WHEN c_custkey%4=0 THEN 'BUILDING' ELSE c_mktsegment END) AS sha FROM customer) r
    LEFT JOIN ck USING (run_id)) SELECT run_id, reason IS NULL AS may_resume, reason FROM j""", ctes=CKPT))
def _(t):
    k = F.col("c_custkey")
    req = t("customer").select(k.alias("run_id"), F.md5(F.when(k % 4 == 0, "BUILDING").otherwise(F.col("c_mktsegment"))).alias("config_sha"))
    return G.resume_decision(req, _ckpt(t))


@query("p27_voltage", oracle(
    """SELECT id, round(CASE WHEN kv IS NOT NULL THEN kv WHEN fr IS NOT NULL AND ebd IS NOT NULL AND NOT coalesce(abs(25-rt)>5,false) THEN round(fr*ebd*50/1000,4) END,4) AS kv,
    CASE WHEN kv IS NOT NULL THEN NULL WHEN fr IS NULL THEN 'no voltage given' WHEN ebd IS NULL THEN 'no breakdown reference'
    WHEN abs(25-rt)>5 THEN 'reference temperature too far' END AS problem FROM (SELECT c_custkey AS id, CASE WHEN c_custkey%4=0 THEN 1.5e0 END AS kv,
    CASE WHEN c_custkey%5>0 THEN 0.1e0*(c_custkey%5) END AS fr, CASE WHEN c_custkey%7>0 THEN 20e0+c_custkey%7 END AS ebd,
    CASE WHEN c_custkey%3>0 THEN 15e0+c_nationkey END AS rt FROM customer)"""))
def _(t):
    k = F.col("c_custkey")
    kv, prob = G.resolve_voltage(F.when(k % 4 == 0, 1.5), F.when(k % 5 > 0, 0.1 * (k % 5)), F.when(k % 7 > 0, 20.0 + k % 7), F.lit(50.0),
                                 F.lit(25.0), F.when(k % 3 > 0, 15.0 + F.col("c_nationkey")))
    return rounded(t("customer").select(k.alias("id"), kv.alias("kv"), prob.alias("problem")), 4)


@query("p34_transitions", oracle(
    """, l AS (SELECT user_id AS specimen_id, event_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'in_test' WHEN 'signup' THEN 'retired'
      WHEN 'view' THEN 'suspended' ELSE 'lost' END AS status, CASE WHEN user_id%9=0 THEN 'cube' ELSE 'planar16' END AS geometry FROM events),
    p AS (SELECT *, lag(status) OVER (PARTITION BY specimen_id ORDER BY ts, event_id) AS pv FROM l),
    q AS (SELECT specimen_id, event_id, concat_ws('; ', CASE WHEN pv IN ('failed','retired') AND status='in_test' THEN pv||' specimen back in test' END,
      CASE WHEN geometry='cube' THEN 'unknown geometry' END, CASE WHEN status='lost' THEN 'unknown status' END) AS problems FROM p)
    SELECT * FROM q WHERE problems<>''""", "telemetry"))
def _(t):
    e = F.col("event_type")
    log = t("events").select(
        F.col("user_id").alias("specimen_id"), "event_id", "ts",
        F.when(e == "error", "failed").when(e == "click", "in_test").when(e == "signup", "retired").when(e == "view", "suspended")
        .otherwise("lost").alias("status"), F.when(F.col("user_id") % 9 == 0, "cube").otherwise("planar16").alias("geometry"))
    return G.transition_problems(log, ["ts", "event_id"]).select("specimen_id", "event_id", F.array_join("problems", "; ").alias("problems"))


@query("p35_stale_heartbeat", oracle(
    """, m AS (SELECT max(t_s) AS now FROM telemetry), l AS (SELECT run_id, max(t_s) AS u, max_by(i_status, t_s) AS s FROM telemetry GROUP BY run_id)
    SELECT run_id, s AS state, round(now-u,3) AS age_s, now-u>86400 AND s<>'NOT_ZEROED' AS stale FROM
    (SELECT run_id, u, CASE s WHEN 'invalid' THEN 'NOT_ZEROED' ELSE s END AS s FROM l), m""", "telemetry"))
def _(t):
    st = t.telemetry.select("run_id", F.col("t_s").alias("updated_s"),
                            F.when(F.col("i_status") == "invalid", "NOT_ZEROED").otherwise(F.col("i_status")).alias("state"))
    now = st.agg(F.max("updated_s").alias("m")).scalar()
    return rounded(G.stale_heartbeat(st, ["run_id"], now, 86400.0).drop("updated_s"), 3)


@query("a26_report_counts", oracle(
    """, i AS (SELECT run_id+CASE WHEN rest_value>4.5 THEN 1000000 ELSE 0 END AS run_id, count(*) AS interludes, count(*) FILTER (is_baseline) AS baselines FROM interludes GROUP BY 1),
    b AS (SELECT run_id, count(*) AS blocks, array_to_string(list_sort(list(DISTINCT counting)),';') AS modes FROM blocks GROUP BY run_id)
    SELECT run_id, coalesce(blocks,0) AS blocks, coalesce(modes,'') AS modes, coalesce(interludes,0) AS interludes,
    coalesce(baselines,0) AS baselines FROM b FULL JOIN i USING (run_id)""", "blocks", "interludes"))
def _(t):
    """All rows of both tables; the stiffest interludes stand for runs that have no blocks."""
    from stamina.operators.reports import counts
    return counts(t.blocks, t.interludes.withColumn("run_id", F.col("run_id") + F.when(F.col("rest_value") > 4.5, 1_000_000).otherwise(0)), ["run_id"])


@query("a27_medium_rules", oracle(
    """, m AS (SELECT run_id, block_idx, (block_idx%9)*1000e0/nullif(cycles_done,0) AS soft_flags_per_kcycle,
     CASE WHEN (15e0+block_idx%20) BETWEEN 15 AND 30 AND (890e0+block_idx) BETWEEN 900 AND 1100 THEN 0e0 ELSE 1e0 END AS env_out_of_band,
     imean_ua*60/2000 AS ipk_frac FROM blocks),
    u AS (UNPIVOT m ON soft_flags_per_kcycle, env_out_of_band, ipk_frac INTO NAME metric VALUE value)
    SELECT run_id, block_idx, CASE metric WHEN 'soft_flags_per_kcycle' THEN 'transient_cap' WHEN 'env_out_of_band' THEN 'env_band' ELSE 'ipk_headroom' END AS rule_id,
    round(value,8) AS value FROM u WHERE (metric='soft_flags_per_kcycle' AND value>5) OR (metric='env_out_of_band' AND value>=1) OR (metric='ipk_frac' AND value>0.9e0)""", "blocks"))
def _(t):
    b = t.blocks.withColumns({
        "soft_flags": F.col("block_idx") % 9, "env_t_c": 15.0 + F.col("block_idx") % 20, "env_p_mbar": 890.0 + F.col("block_idx"),
        "t_lo": F.lit(15.0), "t_hi": F.lit(30.0), "p_lo": F.lit(900.0), "p_hi": F.lit(1100.0), "ipk_ua": F.col("imean_ua") * 60})
    m = R.to_metrics(R.block_metrics(b), ["run_id", "block_idx"], ["soft_flags_per_kcycle", "env_out_of_band", "ipk_frac"])
    return rounded(R.fire_plain(m, R.default_rules(t.spark), "medium").select("run_id", "block_idx", "rule_id", "value"), 8)


@query("r2_trend_series", oracle(
    """, a AS (SELECT run_id, interlude_idx, CAST(epoch(t) AS DOUBLE) AS wall_s, interlude_idx*100e0 AS cycles, disp_value, leak_ua, c_est_nf FROM interludes),
    b AS (UNPIVOT a ON wall_s, cycles INTO NAME axis VALUE x), c AS (UNPIVOT b ON disp_value, leak_ua, c_est_nf INTO NAME metric VALUE y)
    SELECT run_id, interlude_idx, axis, round(x,4) AS x, metric, round(y,6) AS y FROM c""", "interludes"))
def _(t):
    i = t.interludes.select("run_id", "interlude_idx", F.unix_seconds(F.col("t").cast("timestamp")).cast("double").alias("wall_s"),
                            (F.col("interlude_idx") * 100.0).alias("cycles"), "disp_value", "leak_ua", "c_est_nf")
    return rounded(T.series(i, ["run_id", "interlude_idx"], ["wall_s", "cycles"], ["disp_value", "leak_ua", "c_est_nf"]), x=4)


@query("x9_flag_lifecycle", oracle(
    """, f AS (SELECT run_id, sample_id, t_s AS raised_at FROM telemetry WHERE i_status='offscreen'),
    k AS (SELECT run_id, sample_id, t_s FROM telemetry WHERE i_status='invalid')
    SELECT f.run_id, f.sample_id, round(f.raised_at,3) AS raised_at, 'op'||arg_min(k.sample_id, k.t_s) AS acked_by, round(min(k.t_s),3) AS acked_at
    FROM f LEFT JOIN k ON f.run_id=k.run_id AND k.t_s>=f.raised_at GROUP BY f.run_id, f.sample_id, f.raised_at""", "telemetry"))
def _(t):
    return rounded(R.flag_lifecycle(
        t.telemetry.where("i_status = 'offscreen'").select("run_id", "sample_id", F.col("t_s").alias("raised_at")),
        t.telemetry.where("i_status = 'invalid'").select("run_id", F.col("t_s").alias("acked_at"),
                                                         F.concat(F.lit("op"), F.col("sample_id")).alias("acked_by")), ["run_id"]), 3)
