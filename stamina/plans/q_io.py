"""Source and sink queries; files are written from the given tables and read back."""

from pyspark.sql import functions as F

from stamina.operators.measure import measure_pairs
from stamina.plans.bindings import oracle
from stamina.plans.registry import query, rounded
from stamina.sources import readers as R
from stamina.sources import sinks as K


def _event_folders(t):
    """Audit events as CSV run folders <root>/<specimen>/<run>/ written by the partitioned sink."""
    e = t("events").select(
        F.concat(F.lit("sp"), F.col("user_id") % 5).alias("specimen"), F.concat(F.lit("LC_"), F.col("user_id")).alias("run"),
        F.col("event_id").cast("string").alias("event_idx"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t_iso"),
        F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.col("value").cast("string")).alias("wall_s"),
        F.col("event_type").alias("action"), F.when(F.col("event_id") % 3 > 0, F.col("props")).alias("message"))
    path = R.scratch(t.spark, "events")
    out = K.project(e.withColumn("__s", F.col("specimen")).withColumn("__r", F.col("run")), [*R.EVENTS, "__s", "__r"])
    out.repartition("__s", "__r").write.partitionBy("__s", "__r").option("header", True).csv(path)
    return path


@query("s1_s3_run_tables", oracle(
    """SELECT 'LC_'||user_id AS run, CAST(event_id AS DOUBLE) AS event_idx, CASE WHEN event_id%4>0 THEN value END AS wall_s, event_type AS action,
    CASE WHEN event_id%3>0 THEN props END AS message FROM events"""))
def _(t):
    path = _event_folders(t)
    d = R.run_table(t.spark, f"{path}/*/*", R.EVENTS, files="*.csv")
    return d.select(F.regexp_replace("run_id", "^__r=", "").alias("run"), "event_idx", "wall_s", "action", "message")


LIST = """ls AS (SELECT event_id, 'camp'||user_id%7 AS root, CASE WHEN user_id%7=0 THEN 'camp0' ELSE 'camp'||user_id%7||'/n'||user_id%3 END AS parent, 'run'||user_id AS run, ts,
 CASE event_id%6 WHEN 0 THEN 'data.csv' WHEN 1 THEN 'data'||event_id%50||'.csv' WHEN 2 THEN 'DATA7.CSV' WHEN 3 THEN 'telemetry.csv' ELSE 'data_x.csv' END AS name, CASE WHEN event_id%2=0 THEN user_id ELSE event_id END AS folder FROM events)"""


def _listing(t):
    i, u = F.col("event_id"), F.col("user_id")
    root = F.concat(F.lit("camp"), u % 7)
    return t("events").select(
        i, root.alias("root"), F.when(u % 7 == 0, "camp0").otherwise(F.concat(root, F.lit("/n"), u % 3)).alias("parent"), F.concat(F.lit("run"), u).alias("run"), "ts",
        F.when(i % 6 == 0, "data.csv").when(i % 6 == 1, F.concat(F.lit("data"), i % 50, F.lit(".csv"))).when(i % 6 == 2, "DATA7.CSV").when(i % 6 == 3, "telemetry.csv")
        .otherwise("data_x.csv").alias("name"), F.when(i % 2 == 0, u).otherwise(i).alias("folder"))


@query("s4_pick_run_file", oracle(
    """SELECT folder, arg_min(name, (CASE WHEN lower(name)='data.csv' THEN 0 ELSE 1 END, coalesce(try_cast(regexp_extract(lower(name),'^data(\\d*)\\.csv$',1) AS INT),0), name)) AS name
    FROM ls WHERE regexp_matches(lower(name),'^data\\d*\\.csv$') GROUP BY folder""", ctes=LIST))
def _(t):
    return R.pick_run_file(_listing(t).select("folder", "name"))


@query("s5_newest_run", oracle(
    """, p AS (SELECT root, parent, count(*) AS n, arg_max(run,(ts,run)) AS run FROM ls GROUP BY root, parent), q AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY parent=root DESC, n DESC, parent) AS k FROM p)
    SELECT root, parent, n, run FROM q WHERE k=1""", ctes=LIST))
def _(t):
    return R.newest_runs(_listing(t).select("root", "parent", "run", F.col("ts").alias("modified")))


HDR, AHDR = "--- review settings ---", "--- scale anchor ---"


def _texts(t):
    k = F.col("c_custkey")
    nl = "\n"
    head = F.concat(F.lit("Specimen notes\nnominal diameter: "), F.lit(12) + k % 5, F.lit(" mm\naccept_conf: 0.1\n"))
    anchor = F.concat(F.lit(AHDR + nl + "method: "), F.when(k % 2 == 0, "circle-fit").otherwise("auto-verified"), F.lit("\ndiam_px: "), F.lit(500) + k % 90, F.lit(".25\nn_rounds: "),
                      F.when(k % 5 == 0, "many").otherwise("3.0"), F.lit("\nrounds_px: 577.1; x, 578.2;\ncal_mode: "), F.when(k % 3 == 0, "C").otherwise("twopoint"), F.lit("\nanchor_is_baseline: "),
                      k % 2, F.lit("\n\n"))
    tail = F.concat(F.lit(HDR + "\naccept_conf: 0."), F.lit(10) + k % 80, F.lit("\nunknown_key: 3\nspread_pct : "), k % 20, F.lit("\nbreakdown_ua: fifty\n"), F.when(k % 4 == 0, "diam_mm: 9.5\n").otherwise(""))
    return t("customer").select(k.alias("run_id"), F.concat(F.when(k % 7 > 0, head).otherwise("empty\n"), F.when(k % 6 > 0, anchor).otherwise(""), F.when(k % 9 > 0, tail).otherwise("")).alias("text"))


@query("s6_run_settings", oracle(
    """SELECT c_custkey AS run_id, s.setting, CASE s.setting WHEN 'accept_conf' THEN CASE WHEN c_custkey%9>0 THEN CAST('0.'||(10+c_custkey%80) AS DOUBLE) ELSE d END
     WHEN 'spread_pct' THEN CASE WHEN c_custkey%9>0 THEN CAST(c_custkey%20 AS DOUBLE) ELSE d END
     WHEN 'diam_mm' THEN CASE WHEN c_custkey%9>0 AND c_custkey%4=0 THEN 9.5e0 WHEN c_custkey%7>0 THEN CAST(12+c_custkey%5 AS DOUBLE) ELSE d END ELSE d END AS value
    FROM customer, (VALUES ('diam_mm',16e0),('accept_conf',0.75e0),('spread_pct',12e0),('audit_nostep_pct',15e0),('audit_bias_px',3e0),('breakdown_dev_ua',20e0),('breakdown_ua',50e0),('area_jump_pct',35e0),('wrinkle_ratio',1.4e0)) s(setting,d)"""))
def _(t):
    return R.settings_of(_texts(t), ["run_id"], HDR)


@query("s7_anchor_block", oracle(
    """SELECT c_custkey AS run_id, 500.25e0+c_custkey%90 AS diam_px, CASE WHEN c_custkey%5>0 THEN CAST(3 AS BIGINT) END AS n_rounds, 577.1e0+578.2e0 AS rounds_total, CASE WHEN c_custkey%3=0 THEN 'verify' ELSE 'twopoint' END AS cal_mode,
    c_custkey%2=1 AS anchor_is_baseline, CASE WHEN c_custkey%2=0 THEN 'circle-fit' ELSE 'auto-verified' END AS method, CAST(NULL AS DOUBLE) AS sigma_pct FROM customer WHERE c_custkey%6>0""".replace("577.1e0+578.2e0", "round(577.1e0+578.2e0,4)")))
def _(t):
    a = R.anchor_block(_texts(t), ["run_id"], AHDR)
    return rounded(a.select("run_id", "diam_px", "n_rounds", F.aggregate("rounds_px", F.lit(0.0), lambda s, x: s + x).alias("rounds_total"), "cal_mode",
                            "anchor_is_baseline", "method", "sigma_pct"), 4)


@query("s8_calibration_log", oracle(
    """SELECT event_id, event_type AS mode, CAST(user_id AS BIGINT) AS n, round(value,2) AS sigma_pct FROM events"""))
def _(t):
    line = F.concat(F.lit("CAL 2026-01-01 mode="), "event_type", F.lit(" n="), "user_id", F.lit(" sigma="), F.col("value"), F.lit("% mode=again frame=a=b"))
    d = R.log_records(t("events").select("event_id", line.alias("line")), ["event_id"])
    f = F.col("fields")
    return d.select("event_id", f["mode"].alias("mode"), f["n"].cast("bigint").alias("n"), F.round(F.regexp_replace(f["sigma"], "%", "").cast("double"), 2).alias("sigma_pct"))


@query("s9_state_json", oracle(
    """SELECT CAST(c_custkey AS BIGINT) AS run, CASE WHEN c_custkey%5>0 THEN 'accepted' ELSE 'quarantined' END AS outcome, CASE WHEN c_custkey%5>0 THEN CAST(c_custkey*10 AS BIGINT) END AS cycles FROM customer"""))
def _(t):
    k = F.col("c_custkey")
    doc = F.struct(F.when(k % 5 > 0, "run-state/1").otherwise("other/9").alias("schema"), k.alias("run"), (k * 10).alias("cycles"),
                   F.struct(F.lit(1.5).alias("disp_value")).alias("baseline"), F.array(F.struct(F.lit("amplitude").alias("id"))).alias("flags"))
    path = R.scratch(t.spark, "state")
    t("customer").select(F.to_json(doc).alias("value")).write.text(path)
    schema = "schema string, run bigint, cycles bigint, baseline struct<disp_value:double>, flags array<struct<id:string>>"
    accepted, quarantined = R.state_json(t.spark, path, schema, "run-state/1", one_per_file=False)
    return accepted.select("run", F.lit("accepted").alias("outcome"), "cycles").union(
        quarantined.select("run", F.lit("quarantined"), F.lit(None).cast("bigint")))


@query("s10_waveform_rows", oracle(
    """SELECT user_id AS file, event_id AS line_no, CASE WHEN user_id%10=0 THEN NULL WHEN event_id%7=1 THEN NULL ELSE value END AS value,
    CASE WHEN user_id%10=0 THEN 'header lacks a value column' WHEN event_id%7=1 THEN 'bad value' END AS problem FROM events WHERE event_id%7<>0"""))
def _(t):
    i, u = F.col("event_id"), F.col("user_id")
    lines = t("events").select(u.alias("file"), i.alias("line_no"), F.when(u % 10 == 0, "time,volts").otherwise("Time, Value").alias("header"),
                               F.when(i % 7 == 0, " , ").when(i % 7 == 1, "1,x").otherwise(F.concat(F.lit("0.1, "), F.col("value"))).alias("line"))
    good, bad = R.waveform_rows(lines, ["file"], "line_no", "header", "line")
    return good.unionByName(bad, allowMissingColumns=True)


@query("s11_trace_csv", oracle(
    """SELECT 'clip'||clip%20 AS clip, frame, finger, round(CASE finger WHEN 'a' THEN disp ELSE -disp END,4) AS dx, CAST(1 AS DOUBLE) AS n FROM trace, (VALUES ('a'),('b')) f(finger)""", "trace"))
def _(t):
    path = R.scratch(t.spark, "traces")
    head = ["frame", "t_s", "a_dx", "a_dy", "a_n", "b_dx", "b_dy", "b_n"]
    w = t.trace.select("frame", "t_s", F.col("disp").alias("a_dx"), F.lit(0.5).alias("a_dy"), F.lit(1).alias("a_n"), (-F.col("disp")).alias("b_dx"), F.lit(0.1).alias("b_dy"),
                       F.lit(1).alias("b_n"), F.concat(F.lit("clip"), F.col("clip") % 20).alias("c"))
    w.repartition(F.col("c"), F.pmod(F.xxhash64("frame"), F.lit(8))).write.partitionBy("c").option("header", True).csv(path)
    d = R.trace_csv(t.spark, path, head, r"/c=([^/]+)/")
    return rounded(R.long_trace(d, ["a", "b"]).select("clip", "frame", "finger", "dx", "n"), 4)


@query("s12_cached_listing", oracle(
    """, c AS (SELECT event_id, name FROM clips UNION ALL SELECT event_id, 'notes_'||event_id||'.txt' FROM events),
    n AS (SELECT DISTINCT name, event_id%2=0 AS early FROM c WHERE name LIKE '%.h264')
    SELECT 'first' AS listing, name FROM n WHERE early GROUP BY name UNION ALL SELECT 'share away', name FROM n GROUP BY name UNION ALL SELECT 'share back', name FROM n WHERE early GROUP BY name""", "clips"))
def _(t):
    """The share is listed, grows, goes away (the newest kept listing stands in), and is back with fewer clips."""
    names = t.clips.select("event_id", "name").union(t("events").select("event_id", F.concat(F.lit("notes_"), "event_id", F.lit(".txt"))))
    early = names.where("event_id % 2 = 0").select("name")
    kept = R.ListingSnapshots(t.spark, R.scratch(t.spark, "listing"))
    kept.read(lambda: early)
    kept.read(lambda: names)
    away, live = kept.read(lambda: t.spark.read.text(f"{kept.folder}/no-such-share").toDF("name"))
    back, again = kept.read(lambda: early)
    first, _ = kept.read(version=0)
    if live or not again:
        raise RuntimeError("the listing does not say where it came from")
    return (first.select(F.lit("first").alias("listing"), "name").union(away.select(F.lit("share away"), "name"))
            .union(back.select(F.lit("share back"), "name")))


@query("s14_every_nth", oracle("SELECT user_id AS folder, name FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY name) AS k FROM (SELECT user_id, 'f'||lpad(CAST(event_id AS VARCHAR),8,'0')||'.png' AS name FROM events)) WHERE (k-1)%4=0"))
def _(t):
    f = t("events").select(F.col("user_id").alias("folder"), F.concat(F.lit("f"), F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit(".png")).alias("name"))
    return R.every_nth(f, ["folder"], ["name"], 4)


@query("k1_append_projected", oracle("""SELECT user_id AS run_id, CAST(event_id AS VARCHAR) AS event_idx, event_type AS action, CAST(NULL AS VARCHAR) AS operator FROM events"""))
def _(t):
    path = R.scratch(t.spark, "append")
    e = t("events").select(F.col("user_id").alias("run_id"), F.col("event_id").cast("string").alias("event_idx"), F.col("event_type").alias("action"), "value")
    cols = ["run_id", "event_idx", "action", "operator"]
    K.append_rows(e.where("value < 10"), path, cols)
    K.append_rows(e.where("value >= 10"), path, cols)
    return t.spark.read.parquet(path)


@query("k2_event_numbering", oracle(
    """, o AS (SELECT user_id, max(event_id)+1 AS last FROM events WHERE ts<TIMESTAMP '2024-01-10' GROUP BY user_id)
    SELECT e.user_id, e.event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id)+coalesce(last,0) AS event_idx FROM events e LEFT JOIN o USING (user_id) WHERE e.ts>=TIMESTAMP '2024-01-10'""", "clips"))
def _(t):
    e = t("events").select("user_id", "event_id", "ts")
    old = e.where("ts < timestamp'2024-01-10'").withColumn("event_idx", F.col("event_id") + 1)
    return K.continue_numbering(e.where("ts >= timestamp'2024-01-10'"), old, ["user_id"], ["ts", "event_id"], "event_idx").select("user_id", "event_id", "event_idx")


@query("k4_schema_evolution", oracle("""SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS INTEGER) AS region, 'n' AS notes FROM nation UNION ALL SELECT r_regionkey, r_name, r_regionkey, 'r' FROM region"""))
def _(t):
    old = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("n").alias("notes"))
    new = t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("region"), F.lit("r").alias("notes"))
    return K.evolve(old, new)


@query("k5_manifest")
def _(t):
    return K.manifest(t.spark, t.path).select("name", "bytes", "sha256")


@query("k5_manifest_of_parts", oracle("SELECT c_nationkey AS nation, CAST(sum(length(c_name)+1) AS BIGINT) AS bytes, count(DISTINCT c_nationkey) AS files FROM customer GROUP BY 1"))
def _(t):
    """Files whose sizes the table tells: one of names for each nation, one line each."""
    path = R.scratch(t.spark, "parts")
    t("customer").select("c_nationkey", "c_name").repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    m = K.manifest(t.spark, f"{path}/*/*.txt")
    raw = t.spark.read.format("binaryFile").load(f"{path}/*/*.txt").select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_extract("path", "c_nationkey=(\\d+)/", 1).cast("int").alias("nation"), "content")
    # file names repeat over folders, so files are told apart by their hash; equal files count once
    same = raw.select("nation", F.sha2("content", 256).alias("sha256"))
    return same.join(m.distinct(), "sha256").groupBy("nation").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))


@query("k6_figure_spec", oracle(
    """SELECT 'fig'||c_nationkey%5 AS stem, CASE WHEN c_nationkey%5<4 THEN count(DISTINCT c_mktsegment) END AS n_runs,
    CASE c_nationkey%5 WHEN 4 THEN 'not valid JSON' WHEN 3 THEN 'no opts' WHEN 2 THEN 'written by a newer version' END AS problem FROM customer GROUP BY c_nationkey%5"""))
def _(t):
    """Specs as written, and after three kinds of damage to the files of some figures."""
    runs = t("customer").select((F.col("c_nationkey") % 5).alias("g"), F.col("c_mktsegment").alias("run"))
    spec = K.figure_spec(runs, {"mode": "area", "prepost": "true"}, F.concat(F.lit("fig"), "g"))
    hurt = F.when(F.col("stem") == "fig4", F.substring("spec", 1, 20)).when(F.col("stem") == "fig3", F.replace("spec", F.lit('"opts"'), F.lit('"odds"')))
    s = K.check_spec(spec.withColumn("spec", hurt.when(F.col("stem") == "fig2", F.replace("spec", F.lit('"spec_version":1'), F.lit('"spec_version":9'))).otherwise(F.col("spec"))))
    return s.select("stem", F.get_json_object("spec", "$.n_runs").try_cast("bigint").alias("n_runs"), "problem")


@query("k6_figure_runs", oracle("SELECT DISTINCT 'fig'||c_nationkey%5 AS stem, c_mktsegment AS run FROM customer"))
def _(t):
    return K.figure_runs(t("customer").select("c_nationkey", F.col("c_mktsegment").alias("run")), F.concat(F.lit("fig"), F.col("c_nationkey") % 5))


@query("k7_partitioned_summary", oracle("""SELECT vec_id AS clip, CASE WHEN label%2=0 THEN 'A' ELSE 'B' END AS series, CASE WHEN vec_id%11=0 THEN 'decode failed' END AS error FROM embeddings"""))
def _(t):
    path = R.scratch(t.spark, "summary")
    d = t("embeddings").select(F.col("vec_id").alias("clip"), F.when(F.col("label") % 2 == 0, "A").otherwise("B").alias("series"),
                               F.when(F.col("vec_id") % 11 == 0, "decode failed").alias("error"))
    K.write_summary(d, path)
    return t.spark.read.parquet(path).select("clip", F.col("series").cast("string").alias("series"), "error")


def byte_measure(content, rest):
    """A stand-in measurement: payload size against the rest frame."""
    if rest is None:
        raise ValueError("no rest frame")
    return {"value": float(len(content)), "rest_value": float(len(rest)), "quality": "ok", "notes": ""}


@query("r6_user_measurement", oracle(
    """SELECT doc_id, CASE WHEN doc_id%17>0 THEN CAST(octet_length(encode(text)) AS DOUBLE) END AS value, CASE WHEN doc_id%17>0 THEN CAST(octet_length(encode(lang)) AS DOUBLE) END AS rest_value,
    CASE WHEN doc_id%17>0 THEN 'ok' ELSE 'none' END AS quality, CASE WHEN doc_id%17=0 THEN 'ValueError: no rest frame' END AS error FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""))
def _(t):
    d = t("documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.when(F.col("doc_id") % 17 > 0, F.encode("lang", "UTF-8")).alias("rest"))
    return measure_pairs(d, ["doc_id"], byte_measure, t("labels").select("doc_id")).select("doc_id", "value", "rest_value", "quality", "error")
