"""Streaming queries: the given tables are replayed in several micro-batches; results are those of the batch operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from stamina.operators import rules as R
from stamina.plans import q_runs as QR
from stamina.plans.bindings import oracle
from stamina.plans.registry import query, rounded
from stamina.sources.readers import scratch
from stamina.streaming import processors as P
from stamina.streaming import windows as W
from stamina.streaming.engine import CLOSING, CurrentTable, accept, run_to_table, store_slices

K, ORDER = "run_id", ["sample_id"]
#: The last row comes this much later, so that the watermark passes all others.
CLOSE = "3650 days"
#: How rows are dealt to slices: by time, unless a test sets another column.
ARRIVAL: Column | None = None


def replayed(t, df, ts="ts"):
    return store_slices(df, ts, K, CLOSE, ARRIVAL)


def run(t, out, mode="append", **more):
    return run_to_table(out, mode, state_partitions=int(t.spark.conf.get("spark.sql.shuffle.partitions")), **more)


def processed(t, df, columns: dict, proc: P.Ordered, schema: str):
    """``proc`` over a replay of ``df`` (with columns run_id, sample_id and ts) and further ``columns``."""
    r = replayed(t, df)
    rows = r.stream(t.spark).select(K, "ts", CLOSING, "sample_id", "t_s", *[c.alias(n) for n, c in columns.items()])
    return run(t, P.apply(rows, proc, schema, lateness=r.lateness, buckets=r.buckets))


def windowed(t, df, make):
    """A windowed operator over a replay; the closing row is a group of its own, left out of the result."""
    r = replayed(t, df)
    return run(t, make(r.stream(t.spark), [K, CLOSING], r.lateness)).where(~F.col(CLOSING)).drop(CLOSING)


@query("x1_telemetry_source", oracle("SELECT run_id, sample_id, ua, i_status, kv FROM telemetry", "telemetry"))
def _(t):
    rows = store_slices(t.telemetry, "ts", K).stream(t.spark)
    return run(t, rows.select("run_id", "sample_id", "ua", "i_status", "kv"))


@query("x1_dead_letters", oracle(
    """, r AS (SELECT run_id, sample_id, CASE WHEN sample_id%101<>0 THEN epoch_us(ts) END AS us, kv,
      CASE WHEN sample_id%89=0 THEN 5 ELSE CAST(least(floor((epoch_us(ts)-lo)/((hi-lo)/5e0+1)),4) AS INT) END AS a FROM telemetry, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM telemetry)),
    g AS (SELECT *, us IS NULL AS none, coalesce(kv>=1.99, true) AS bad FROM r),
    top AS (SELECT a, max(us) FILTER (NOT none AND NOT bad) AS m FROM g GROUP BY a),
    s AS (SELECT t.a, max(u.m) AS seen FROM top t LEFT JOIN top u ON u.a<t.a GROUP BY t.a)
    SELECT run_id, sample_id, CASE WHEN none THEN 'no event time' WHEN bad THEN 'bad row' WHEN us<seen-86400000000 THEN 'late' ELSE 'accepted' END AS verdict FROM g JOIN s USING (a)""", "telemetry"))
def _(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = t.telemetry.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    on_time = F.least(F.floor((us - ends.lo) / ((ends.hi - ends.lo) / 5 + 1)), F.lit(4))
    dealt = t.telemetry.withColumn("arrival", F.when(F.col("sample_id") % 89 == 0, 5).otherwise(on_time))
    dealt = dealt.withColumn("ts", F.when(F.col("sample_id") % 101 != 0, F.col("ts")))
    folder = scratch(t.spark, "letters")
    rows = store_slices(dealt, "ts", K, arrival=F.col("arrival")).stream(t.spark)
    run(t, rows, sink=accept(folder, "ts", F.col("kv") >= 1.99, 86400.0))
    accepted, refused = (t.spark.read.parquet(f"{folder}/{part}") for part in ("accepted", "refused"))
    return accepted.select("run_id", "sample_id", F.lit("accepted").alias("verdict")).union(refused.select("run_id", "sample_id", "reason"))


SUSTAINED = "run_id bigint, sample_id bigint, since double"


@query("x2_sustained_stream", oracle(
    """SELECT run_id, min_by(sample_id, ts) AS sample_id, round(min(since),3) AS since FROM z WHERE t_s-since>=7200 GROUP BY run_id, isl""",
    "telemetry", ctes=QR.island_sql("ua >= 6")))
def _(t):
    return rounded(processed(t, t.telemetry, {"over": F.col("ua") >= 6}, P.Sustained(K, ORDER, 7200.0, ["sample_id"]), SUSTAINED), 3)


@query("x13_restart", oracle(
    """SELECT run_id, min_by(sample_id, ts) AS sample_id, round(min(since),3) AS since FROM z WHERE t_s-since>=7200 GROUP BY run_id, isl""",
    "telemetry", ctes=QR.island_sql("ua >= 6")))
def _(t):
    """X2 stopped between batches twice: each part of the input comes when the query before has ended, and another query, with other
    settings, goes on from the checkpoint and the sink's log; the last one finds nothing new."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    middle = t.telemetry.agg(F.percentile_approx(us, 0.5)).first()[0]
    checkpoint, folder = scratch(t.spark, "restart-checkpoint"), scratch(t.spark, "restart-out")
    path, out, buckets = None, None, None
    for k, part in enumerate((us <= middle, us > middle, None)):
        if part is not None:
            r = store_slices(t.telemetry.where(part), "ts", K, CLOSE if k == 1 else None, slices=2, append_to=path)
            path, buckets = r.path, buckets or r.buckets
        rows = r.stream(t.spark)
        rows = rows.withColumn(CLOSING, F.col(CLOSING) if CLOSING in rows.columns else F.lit(False))
        rows = rows.select(K, "ts", CLOSING, "sample_id", "t_s", (F.col("ua") >= 6).alias("over"))
        proc = P.Sustained(K, ORDER, 7200.0, ["sample_id"])
        out = run_to_table(P.apply(rows, proc, SUSTAINED, lateness="1 day", buckets=buckets), checkpoint=checkpoint, path=folder, state_partitions=4 + k)
    return rounded(out, 3)


@query("x3_watchdog_stream", oracle(
    """SELECT run_id, min_by(sample_id, ts) AS sample_id, round(min_by(since, ts),3) AS since FROM z WHERE rn>1 AND t_s-since>=10800 GROUP BY run_id""",
    "telemetry", ctes=QR.island_sql("CASE WHEN i_status='offscreen' THEN true WHEN ua IS NOT NULL THEN abs(ua-2)>=8 END")))
def _(t):
    over = F.when(F.col("i_status") == "offscreen", True).when(F.col("ua").isNotNull(), F.abs(F.col("ua") - 2) >= 8)
    return rounded(processed(t, t.telemetry, {"over": over}, P.Watchdog(K, ORDER, 10800.0, ["sample_id"]), SUSTAINED), 3)


@query("x4_blind_ladder_stream", oracle(
    """SELECT run_id, sample_id, round(bs,3) AS blind_s, CASE WHEN bs>=1800 THEN 'warn' ELSE 'recovered' END AS ladder FROM b3
    WHERE (bs>=1800 AND NOT coalesce(pb>=1800,false)) OR (okk AND pb>=1800)""", "telemetry", ctes=QR.BLIND))
def _(t):
    ladder = P.BlindLadder(K, ORDER, 1800.0, ["sample_id"])
    return rounded(processed(t, t.telemetry, {"readable": F.col("i_status") != "invalid"}, ladder, "run_id bigint, sample_id bigint, blind_s double, ladder string"), 3)


LIMITS = [(7200.0, "warn"), (14400.0, "pause")]
SILENCE_SQL = oracle(
    """, g AS (SELECT *, lead(t_s) OVER (PARTITION BY run_id ORDER BY ts, sample_id) AS nt FROM telemetry)
    SELECT run_id, round(t_s+lim,3) AS at, ladder, lim AS silent_s FROM g, (VALUES (7200e0,'warn'),(14400e0,'pause')) l(lim, ladder) WHERE nt IS NULL OR nt-t_s>=lim
    UNION ALL SELECT run_id, round(nt,3), 'recovered', round(nt-t_s,3) FROM g WHERE nt-t_s>=7200""", "telemetry")


@query("x4_silence_stream", SILENCE_SQL)
def _(t):
    return rounded(processed(t, t.telemetry, {}, P.SilenceLadder(K, ORDER, LIMITS), "run_id bigint, at double, ladder string, silent_s double"), 3)


@query("x4_silence_batch", SILENCE_SQL)
def _(t):
    return rounded(R.silence_ladder(t.telemetry, [K], ["ts", "sample_id"], "t_s", LIMITS), 3)


@query("x5_stale_runs", oracle(
    """, g AS (SELECT *, CASE WHEN t_s-lag(t_s) OVER w<7200 THEN 0 ELSE 1 END AS fresh FROM telemetry WINDOW w AS (PARTITION BY run_id ORDER BY ts)),
    h AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ses FROM g)
    SELECT run_id, round(min(t_s),3) AS first_update, round(max(t_s)+7200,3) AS stale_at, count(*) AS updates FROM h GROUP BY run_id, ses""", "telemetry"))
def _(t):
    out = windowed(t, t.telemetry.select("run_id", "ts", "sample_id"), lambda s, keys, late: W.stale_runs(s, keys, "ts", "2 hours", late))
    return rounded(out.select("run_id", *[(F.unix_micros(c) / 1e6).alias(c) for c in ("first_update", "stale_at")], "updates"), 3)


@query("x6_milestone_stream", oracle(
    """, c AS (SELECT *, sum(CAST(floor(kv*1000) AS BIGINT)) OVER (PARTITION BY run_id ORDER BY ts, sample_id ROWS UNBOUNDED PRECEDING) AS tot FROM telemetry)
    SELECT run_id, arg_min(sample_id, ts) AS sample_id, m AS milestone, CAST(min(tot) AS BIGINT) AS cycles_total FROM c, (SELECT CAST(unnest([1000,4000,8000]) AS BIGINT) AS m) WHERE tot>=m GROUP BY run_id, m""", "telemetry"))
def _(t):
    return processed(t, t.telemetry, {"cycles": F.floor(F.col("kv") * 1000)}, P.Ledger(K, ORDER, [1000, 4000, 8000], ["sample_id"]),
                     "run_id bigint, sample_id bigint, milestone bigint, cycles_total bigint")


@query("x6_boundary_milestones", QR.MILESTONE_SQL)
def _(t):
    blocks = t.blocks.select("run_id", F.col("t_start").cast("timestamp").alias("ts"), F.col("block_idx").alias("sample_id"), "type", "cycles_done",
                             F.unix_timestamp(F.col("t_start").cast("timestamp")).cast("double").alias("t_s"))
    marks = P.BoundaryMilestones(K, ORDER, QR.MARKS, ["cycle"], ["dc_hold"], "block_idx", close_s=3e8)
    r = store_slices(blocks, "ts", K, "7300 days", ARRIVAL)
    rows = r.stream(t.spark).select(K, "ts", CLOSING, F.col("sample_id").alias("block_idx"), "sample_id", "t_s", F.col("type").alias("kind"),
                                    F.when(F.col("type") == "cycle", F.col("cycles_done")).alias("cycles"))
    return run(t, P.apply(rows, marks, "run_id bigint, block_idx bigint, milestone bigint, cycles_total bigint", lateness=r.lateness, buckets=r.buckets))


@query("x6_timed_count_stream", oracle(QR.TIMED + " SELECT run_id, round(cy,3) AS cycles FROM d", "telemetry"))
def _(t):
    f = F.when(F.col("i_status") == "ok", F.col("f_meas"))
    out = processed(t, t.telemetry, {"f": f}, P.TimedCounter(K, ORDER, 3600.0), "run_id bigint, t_s double, cycles double")
    return rounded(out.groupBy("run_id").agg(F.max_by("cycles", "t_s").alias("cycles")), 3)


@query("x7_new_commands", oracle(
    """, c AS (SELECT *, max(seq) OVER (PARTITION BY run_id ORDER BY t_s, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT run_id, sample_id, t_s, sample_id//50+sample_id%5 AS seq FROM telemetry))
    SELECT run_id, sample_id, seq FROM c WHERE seq>coalesce(top,-1)""", "telemetry"))
def _(t):
    seq = F.floor(F.col("sample_id") / 50) + F.col("sample_id") % 5
    return processed(t, t.telemetry, {"seq": seq}, P.NewCommands(K, ORDER, ["sample_id", "seq"]), "run_id bigint, sample_id bigint, seq bigint")


@query("x8_latest_status", oracle(
    """SELECT run_id, CAST(floor(t_s/3600)*3600 AS BIGINT) AS slot, max_by(i_status, ts) AS status, round(max(t_s),3) AS updated FROM telemetry GROUP BY run_id, floor(t_s/3600)""", "telemetry"))
def _(t):
    out = windowed(t, t.telemetry.select("run_id", "ts", "sample_id", "i_status"), lambda s, keys, late: W.latest_status(s, keys, "ts", F.col("i_status"), "1 hour", late))
    return rounded(out.select("run_id", F.unix_seconds("slot").alias("slot"), "status", (F.unix_micros("updated") / 1e6).alias("updated")), 3)


@query("x8_current_status", oracle(
    """SELECT run_id, max_by(i_status, ts) AS status, round(max(t_s),3) AS updated FROM telemetry GROUP BY run_id""", "telemetry"))
def _(t):
    """The status stream kept as one row a run, through the keyed sink."""
    r = replayed(t, t.telemetry.select("run_id", "ts", "sample_id", "i_status"))
    status = W.latest_status(r.stream(t.spark), [K, CLOSING], "ts", F.col("i_status"), "1 hour", r.lateness)
    table = CurrentTable(t.spark, scratch(t.spark, "current"), status.schema, [K, CLOSING], "updated", buckets=16)
    run(t, status, sink=table.upsert)
    return rounded(table.read().where(~F.col(CLOSING)).select("run_id", "status", (F.unix_micros("updated") / 1e6).alias("updated")), 3)


@query("x9_flag_ack_stream", oracle(
    """, f AS (SELECT run_id, sample_id, t_s FROM telemetry WHERE i_status='offscreen'), k AS (SELECT run_id, sample_id, t_s FROM telemetry WHERE i_status='invalid')
    SELECT f.run_id, f.sample_id AS flag_id, arg_min(k.sample_id, k.t_s) AS acked_by, round(min(k.t_s)-any_value(f.t_s),3) AS wait_s FROM f JOIN k ON f.run_id=k.run_id AND k.t_s>=f.t_s GROUP BY f.run_id, f.sample_id""", "telemetry"))
def _(t):
    columns = {"id": F.col("sample_id"), "kind": F.when(F.col("i_status") == "offscreen", "flag").otherwise("ack")}
    out = processed(t, t.telemetry.where("i_status <> 'ok'"), columns, P.FlagAcks(K, ["id"]),
                    "run_id bigint, flag_id bigint, raised_at double, acked_by bigint, acked_at double")
    return rounded(out.select("run_id", "flag_id", "acked_by", (F.col("acked_at") - F.col("raised_at")).alias("wait_s")), 3)


@query("x10_rate_limiter", oracle(
    """, k AS (SELECT run_id, min(t_s) AS t, min(t_s) AS v, true AS slow FROM telemetry GROUP BY run_id
      UNION ALL SELECT run_id, n, CASE WHEN n>=v+18000 THEN n ELSE v END, n>=v+18000 FROM
        (SELECT k.run_id, k.v, min(s.t_s) AS n FROM k JOIN telemetry s ON s.run_id=k.run_id AND s.t_s>=k.t+7200 GROUP BY k.run_id, k.v))
    SELECT s.run_id, s.sample_id, k.slow FROM telemetry s JOIN k ON k.run_id=s.run_id AND k.t=s.t_s""", "telemetry"))
def _(t):
    return processed(t, t.telemetry, {}, P.RateLimiter(K, ORDER, 7200.0, ["sample_id"], slow_s=18000.0), "run_id bigint, sample_id bigint, slow boolean")


@query("x11_attestation_ttl", oracle(
    """, a AS (SELECT *, last_value(CASE WHEN i_status='offscreen' THEN sample_id END IGNORE NULLS) OVER w AS att, last_value(CASE WHEN i_status='offscreen' THEN t_s END IGNORE NULLS) OVER w AS att_t FROM telemetry
      WINDOW w AS (PARTITION BY run_id ORDER BY ts, sample_id ROWS UNBOUNDED PRECEDING))
    SELECT run_id, sample_id, CASE WHEN t_s-att_t<=7200 THEN att END AS att_id, CASE WHEN t_s-att_t<=7200 THEN round(t_s-att_t,3) END AS age_s FROM a WHERE i_status<>'offscreen'""", "telemetry"))
def _(t):
    last = P.LastAttestation(K, ORDER, 7200.0, ["sample_id"])
    return rounded(processed(t, t.telemetry, {"is_att": F.col("i_status") == "offscreen"}, last, "run_id bigint, sample_id bigint, att_id bigint, age_s double"), 3)


@query("x12_evidence_stream", oracle(
    """, s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, sample_id) AS rn FROM telemetry), tr AS (SELECT run_id, sample_id AS trip_id, rn FROM s WHERE i_status='offscreen')
    SELECT s.run_id, tr.trip_id, s.sample_id, tr.rn-s.rn AS age FROM s JOIN tr ON s.run_id=tr.run_id AND s.rn BETWEEN tr.rn-119 AND tr.rn""", "telemetry"))
def _(t):
    return processed(t, t.telemetry, {"trip": F.col("i_status") == "offscreen"}, P.EvidenceRing(K, ORDER, 120),
                     "run_id bigint, trip_id bigint, sample_id bigint, age bigint")


@query("x14_live_envelope", oracle(
    """SELECT run_id, CAST(floor(t_s/21600)*21600-21600*k AS BIGINT) AS slot, min(kv) AS lo, max(kv) AS hi, count(*) AS n FROM telemetry, (SELECT unnest([0,1]) AS k) GROUP BY ALL""", "telemetry"))
def _(t):
    out = windowed(t, t.telemetry.select("run_id", "ts", "sample_id", "kv"), lambda s, keys, late: W.live_envelope(s, keys, "ts", "kv", "12 hours", "6 hours", late))
    return out.select("run_id", F.unix_seconds("slot").alias("slot"), "lo", "hi", "n")
