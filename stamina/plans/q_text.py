"""String, date, math, array and JSON function queries."""

from pyspark.sql import functions as F

from stamina.functions import text as X
from stamina.functions import units as U
from stamina.plans.bindings import oracle
from stamina.plans.registry import query, rounded

PFX = "[(1e-12,'p'),(1e-9,'n'),(1e-6,'µ'),(1e-3,'m'),(1e0,''),(1e3,'k'),(1e6,'M'),(1e9,'G')]"


def si_sql(v, unit):
    return f"""CASE WHEN {v} IS NULL THEN '--' WHEN {unit} IN ('','°','rad') THEN rtrim(printf('%.4g',{v})||' '||{unit}) WHEN {v}=0 THEN '0 '||{unit} ELSE
    printf('%.4g', {v}/(CASE WHEN abs({v})>=1e9 THEN 1e9 WHEN abs({v})>=1e6 THEN 1e6 WHEN abs({v})>=1e3 THEN 1e3 WHEN abs({v})>=1 THEN 1e0 WHEN abs({v})>=1e-3 THEN 1e-3
    WHEN abs({v})>=1e-6 THEN 1e-6 WHEN abs({v})>=1e-9 THEN 1e-9 ELSE 1e-12 END))||' '||CASE WHEN abs({v})>=1e9 THEN 'G' WHEN abs({v})>=1e6 THEN 'M' WHEN abs({v})>=1e3 THEN 'k'
    WHEN abs({v})>=1 THEN '' WHEN abs({v})>=1e-3 THEN 'm' WHEN abs({v})>=1e-6 THEN 'µ' WHEN abs({v})>=1e-9 THEN 'n' ELSE 'p' END||{unit} END"""


@query("f_si_format", f"""SELECT event_id, {si_sql('v', 'u')} AS txt FROM (SELECT event_id, CASE WHEN event_id%17=0 THEN NULL WHEN event_id%19=0 THEN 0e0 ELSE value*1.0000003e0*pow(10e0, event_id%14-9) END AS v,
  ['F','Ω','','°'][event_id%4+1] AS u FROM events)""")
def _(t):
    i = F.col("event_id")
    v = F.when(i % 17 == 0, None).when(i % 19 == 0, 0.0).otherwise(F.col("value") * 1.0000003 * F.pow(F.lit(10.0), i % 14 - 9))
    u = F.get(F.array(*[F.lit(x) for x in ("F", "Ω", "", "°")]), (i % 4).cast("int"))
    u = F.when(u.isin("", "°"), u).otherwise(u)
    return t("events").select(i, v.alias("v"), u.alias("u")).select("event_id", X.si_format(F.col("v"), F.col("u")).alias("txt"))


@query("f_measurement_pair", f"""SELECT event_id, {si_sql('p', "'F'")} AS first, 'D: '||printf('%.4g',s)||'' AS second FROM (SELECT event_id, value*1.0000003e-9 AS p, value*1.0000003e0/1000 AS s FROM events)""".replace(
    "'D: '||printf('%.4g',s)||''", "rtrim('D: '||printf('%.4g',s))"))
def _(t):
    a, b = X.measurement_pair(F.lit("cpd"), F.col("value") * 1.0000003e-9, F.col("value") * 1.0000003 / 1000)
    return t("events").select("event_id", a.alias("first"), b.alias("second"))


@query("f_duration", """SELECT o_orderkey, (s//3600)||':'||lpad(CAST(s%3600//60 AS VARCHAR),2,'0')||':'||lpad(CAST(s%60 AS VARCHAR),2,'0') AS txt FROM
  (SELECT o_orderkey, CAST(round_even(o_totalprice,0) AS BIGINT) AS s FROM orders)""")
def _(t):
    return t("orders").select("o_orderkey", X.duration(F.col("o_totalprice")).alias("txt"))


@query("f_safe_name", "SELECT page_id, nullif(substr(regexp_replace(trim(url),'[^A-Za-z0-9_]','_','g'),1,16),'') AS txt FROM pages")
def _(t):
    return t("pages").select("page_id", X.safe_name(F.col("url")).alias("txt"))


@query("f_frame_name", oracle("""SELECT sample_id, 'run_s'||lpad(CAST(sample_id%60 AS VARCHAR),2,'0')||'_'||lpad(printf('%.2f',kv+0.00003e0),5,'0')||'kV_'||i_status||'.png' AS txt FROM telemetry""", "telemetry"))
def _(t):
    return t.telemetry.select("sample_id", X.frame_name("run", F.col("sample_id") % 60, F.col("kv") + 0.00003, F.col("i_status")).alias("txt"))


@query("f_capture_name", """SELECT event_id, regexp_replace(event_type||' x','[^A-Za-z0-9_-]','_','g')||'_'||printf('%04d',event_id)||'_'||strftime(ts,'%Y%m%d-%H%M%S')||
  CASE WHEN event_id%3=0 THEN '' ELSE '_'||translate(printf('%g',-value)||'V','-.','mp') END||'.png' AS txt FROM events""")
def _(t):
    v = F.when(F.col("event_id") % 3 != 0, -F.col("value"))
    return t("events").select("event_id", X.capture_name(F.concat("event_type", F.lit(" x")), F.col("event_id"), F.col("ts"), v).alias("txt"))


@query("f_leading_number", """SELECT event_id, CASE WHEN event_id%4=3 THEN NULL ELSE value END AS num FROM events""")
def _(t):
    i = F.col("event_id") % 4
    txt = F.when(i == 3, "off").otherwise(F.concat(F.col("value").cast("string"), F.get(F.array(F.lit("HZ"), F.lit("Vrms"), F.lit(" s")), i.cast("int"))))
    return t("events").select("event_id", X.leading_number(txt).alias("num"))


@query("f_plain_decimal", "SELECT event_id, CASE WHEN rtrim(rtrim(printf('%.12f',value*1e-6),'0'),'.')='' THEN '0' ELSE rtrim(rtrim(printf('%.12f',value*1e-6),'0'),'.') END AS txt FROM events")
def _(t):
    return t("events").select("event_id", X.plain_decimal(F.col("value") * 1e-6).alias("txt"))


@query("f_reading_fragment", oracle("""SELECT sample_id, CASE WHEN k IS NULL AND ua IS NULL THEN '' ELSE '  meas '||CASE WHEN k IS NULL THEN '?' ELSE printf('%.2f',k) END||' kV / '||
  CASE WHEN ua IS NULL THEN '?' ELSE printf('%.0f',ua+0.013e0) END||' µA' END AS txt FROM (SELECT *, CASE WHEN sample_id%3>0 THEN kv*3e0+0.00013e0 END AS k FROM telemetry)""", "telemetry"))
def _(t):
    k = F.when(F.col("sample_id") % 3 > 0, F.col("kv") * 3 + 0.00013)
    return t.telemetry.select("sample_id", X.reading_fragment(k, F.col("ua") + 0.013).alias("txt"))


@query("f_ascii_only", """SELECT doc_id, md5(regexp_replace(text,'[^\\x00-\\x7F]','?','g')) AS h FROM documents""")
def _(t):
    return t("documents").select("doc_id", F.md5(X.ascii_only(F.col("text"))).alias("h"))


@query("f_key_value_line", """SELECT event_id, concat_ws(' ','CAL','mode='||event_type,'n='||user_id,CASE WHEN event_id%2=0 THEN 'gate='||event_id END) AS line FROM events""")
def _(t):
    line = X.key_value_line({"mode": F.col("event_type"), "n": F.col("user_id"), "gate": F.when(F.col("event_id") % 2 == 0, F.col("event_id"))})
    return t("events").select("event_id", F.concat(F.lit("CAL "), line).alias("line"))


@query("f_html_escape", """SELECT page_id, md5(replace(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;'),'''','&#x27;')) AS h FROM pages""")
def _(t):
    return t("pages").select("page_id", F.md5(X.html_escape(F.col("html"))).alias("h"))


@query("f_dates", """SELECT o_orderkey, 'LC_'||strftime(o_orderdate,'%Y%m%d_%H%M%S') AS run_id, round(epoch(o_orderdate-(SELECT min(o_orderdate) FROM orders))/3600e0,4) AS hours_since,
  CAST(epoch(TIMESTAMP '2000-01-01'-o_orderdate) AS BIGINT) AS age_s FROM orders""")
def _(t):
    o = t("orders")
    sec = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    first = o.agg(F.min(sec).alias("v")).scalar()
    return rounded(o.select("o_orderkey", X.run_id(F.col("o_orderdate")).alias("run_id"), ((sec - first) / 3600.0).alias("hours_since"),
                            (F.unix_seconds(F.lit("2000-01-01").cast("timestamp")) - sec).alias("age_s")), 4)


@query("f_iso_gaps", """SELECT count(*) AS n, count(*) FILTER (ts IS NULL) AS bad FROM (SELECT try_cast(CASE WHEN event_id%9=0 THEN event_type ELSE strftime(ts,'%Y-%m-%dT%H:%M:%S') END AS TIMESTAMP) AS ts FROM events)""")
def _(t):
    txt = F.when(F.col("event_id") % 9 == 0, F.col("event_type")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return t("events").select(txt.try_cast("timestamp").alias("ts")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts").isNull()).alias("bad"))


@query("f_nice_ticks", """SELECT o_orderkey, len(tk) AS n, round(tk[1],4) AS first, round(tk[-1],4) AS last FROM (SELECT o_orderkey, CASE WHEN hi>lo THEN list_transform(range(CAST(ceil(lo/st) AS BIGINT), CAST(floor((hi+st*1e-9)/st) AS BIGINT)+1), lambda i: i*st) ELSE [lo] END AS tk
  FROM (SELECT *, dec*CASE WHEN sp/dec<=6 THEN 1 WHEN sp/(dec*2)<=6 THEN 2 WHEN sp/(dec*5)<=6 THEN 5 WHEN sp/(dec*10)<=6 THEN 10 ELSE 1 END AS st FROM (SELECT *, pow(10e0,floor(log10(sp/6))) AS dec FROM
  (SELECT o_orderkey, -(o_orderkey%100)*1e0 AS lo, o_totalprice AS hi, o_totalprice+(o_orderkey%100) AS sp FROM orders))))""")
def _(t):
    lo = -(F.col("o_orderkey") % 100).cast("double")
    o = t("orders").select("o_orderkey", X.nice_ticks(lo, F.col("o_totalprice")).alias("tk"))
    return rounded(o.select("o_orderkey", F.size("tk").cast("bigint").alias("n"), F.element_at("tk", 1).alias("first"), F.element_at("tk", -1).alias("last")), 4)


@query("f_scalar_math", oracle("""SELECT sample_id, round(least(2e0,greatest(0.1e0,kv)),6) AS rate, round(pi()*pow(kv*10,2)/4,6) AS area, round(2*sqrt(kv*100/pi()),6) AS diam, round_even(kv*1000,0)/1000 AS level FROM telemetry""", "telemetry"))
def _(t):
    k = F.col("kv")
    return rounded(t.telemetry.select("sample_id", X.clamp_rate(k).alias("rate"), U.disc_area(k * 10).alias("area"),
                                      (2 * F.sqrt(k * 100 / F.pi())).alias("diam"), (F.bround(k * 1000) / 1000).alias("level")))


@query("f_level_list", """SELECT event_id, CASE WHEN event_id%4<2 THEN list_sum([value, 2e0, CAST(user_id AS DOUBLE)]) END AS total FROM events""".replace("list_sum([value, 2e0, CAST(user_id AS DOUBLE)])", "round(list_sum([value, 2e0, CAST(user_id AS DOUBLE)]),6)"))
def _(t):
    i, v = F.col("event_id") % 4, F.col("value").cast("string")
    txt = (F.when(i == 0, F.concat(v, F.lit(", 2  "), "user_id")).when(i == 1, F.concat(v, F.lit(" 2,"), "user_id"))
           .when(i == 2, F.concat(v, F.lit(",x,"), "user_id")).otherwise("  "))
    a = X.level_list(txt)
    return rounded(t("events").select("event_id", F.aggregate(a, F.lit(0.0), lambda s, x: s + x).alias("total")))


@query("f_rounds", """SELECT event_id, printf('%.2f',value)||'; '||printf('%.2f',user_id+0.25e0) AS joined, 2 AS kept FROM events""".replace("2 AS kept", "CAST(2 AS BIGINT) AS kept"))
def _(t):
    e = t("events").select("event_id", X.joined_rounds(F.array("value", F.col("user_id") + 0.25)).alias("joined"))
    return e.withColumn("kept", F.size(X.split_rounds(F.concat("joined", F.lit("; junk;")))).cast("bigint"))


@query("f_int16", """SELECT vec_id, CAST(list_sum(q) AS BIGINT) AS total, CAST(list_max(q) AS BIGINT) AS top FROM (SELECT vec_id, list_transform(embedding, lambda x: greatest(-32768,least(32767,
  CAST(round_even(CAST(x AS DOUBLE)*m*(32767e0/greatest(1e0,list_max(list_transform(embedding, lambda y: abs(CAST(y AS DOUBLE)*m))))),0) AS INT)))) AS q FROM (SELECT *, 1e0+vec_id%5*4 AS m FROM embeddings))""")
def _(t):
    m = 1.0 + F.col("vec_id") % 5 * 4
    e = t("embeddings").select("vec_id", X.to_int16(F.transform("embedding", lambda x: x.cast("double") * m)).alias("q"))
    return e.select("vec_id", F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_max("q").cast("bigint").alias("top"))


@query("f_resample", """SELECT vec_id, k AS i, round(CAST(embedding[lo%64+1] AS DOUBLE)*(1-(x-lo))+CAST(embedding[(lo+1)%64+1] AS DOUBLE)*(x-lo),6) AS y FROM
  (SELECT vec_id, embedding, k, k*64/100e0 AS x, CAST(floor(k*64/100e0) AS BIGINT) AS lo FROM embeddings, (SELECT unnest(range(100)) AS k))""")
def _(t):
    a = F.transform("embedding", lambda x: x.cast("double"))
    return rounded(t("embeddings").select("vec_id", a.alias("a")).select("vec_id", F.posexplode(X.circular_resample(F.col("a"), 100)).alias("i", "y"))
                   .withColumn("i", F.col("i").cast("bigint")))


@query("s13_record_scaling", """SELECT vec_id, i, round(0.5e0+i*0.001e0,6) AS t, round((CAST(embedding[i+1] AS DOUBLE)*1000-3)*0.01e0+1.5e0,6) AS v FROM embeddings, (SELECT unnest(range(64)) AS i)""")
def _(t):
    raw = F.transform("embedding", lambda x: x.cast("double") * 1000)
    s = X.raw_to_volts(raw, F.lit(3.0), F.lit(0.01), F.lit(1.5), F.lit(0.5), F.lit(0.001))
    return rounded(t("embeddings").select("vec_id", F.posexplode(s).alias("i", "p")).select("vec_id", F.col("i").cast("bigint").alias("i"), "p.t", "p.v"))


@query("f_scale_samples", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)*1.5e0+0.2e0)),5) AS total,
  CAST(list_sum(list_transform(embedding, lambda x: greatest(0,least(255,CAST(round((floor(abs(CAST(x AS DOUBLE))*500)-16)*255e0/219) AS INT))))) AS BIGINT) AS grey FROM embeddings""")
def _(t):
    a = F.transform("embedding", lambda x: x.cast("double"))
    v = X.scale_samples(a, F.lit(3.0), F.lit(0.2))
    g = F.transform(a, lambda x: X.full_range(F.floor(F.abs(x) * 500)))
    return rounded(t("embeddings").select("vec_id", F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("total"),
                                          F.aggregate(g, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("grey")), 5)


@query("f_json_lookup", """SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events""")
def _(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.run.cycles").alias("missing"))


@query("f_flags_array", """SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type) FILTER (value>20)),';') AS open_flags, count(*) FILTER (value>20) AS n FROM events GROUP BY user_id HAVING count(*) FILTER (value>20)>0""")
def _(t):
    flags = F.filter(F.array(F.struct(F.col("event_type").alias("id"), (F.col("value") > 20).alias("open"))), lambda f: f["open"])
    e = t("events").select("user_id", F.explode(F.from_json(F.to_json(flags), "array<struct<id:string,open:boolean>>")).alias("f"))
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("f.id")), ";").alias("open_flags"), F.count(F.lit(1)).alias("n"))


@query("f_caps_map", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 2.5e0 WHEN 'MACHINERY' THEN 10e0 ELSE 2e0 END AS cap FROM customer""")
def _(t):
    caps = F.from_json(F.lit('{"BUILDING": 2.5, "MACHINERY": 10.0}'), "map<string,double>")
    return t("customer").select("c_custkey", F.coalesce(F.try_element_at(caps, F.col("c_mktsegment")), F.lit(2.0)).alias("cap"))


@query("f_calibration_mode", """SELECT event_id, CASE event_id%6 WHEN 0 THEN 'circle' WHEN 1 THEN 'twopoint' WHEN 2 THEN 'verify' WHEN 3 THEN 'verify' WHEN 4 THEN 'circle' END AS mode FROM events""")
def _(t):
    raw = F.get(F.array(*[F.lit(x) for x in ("A", "b", " C ", "Verify", "circle", "D")]), (F.col("event_id") % 6).cast("int"))
    return t("events").select("event_id", X.calibration_mode(raw).alias("mode"))


@query("u2_set_operations", """SELECT user_id, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b,x))),';') AS only_a, list_has_any(a,b) AS overlap,
  len(list_distinct(list_concat(a,b))) AS n_union FROM (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (value>15),[]) AS a, coalesce(list(DISTINCT event_type) FILTER (value<5),[]) AS b FROM events GROUP BY user_id)""")
def _(t):
    g = t("events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 15, F.col("event_type"))).alias("a"),
                                           F.collect_set(F.when(F.col("value") < 5, F.col("event_type"))).alias("b"))
    return g.select("user_id", F.array_join(F.array_sort(F.array_except("a", "b")), ";").alias("only_a"), F.arrays_overlap("a", "b").alias("overlap"),
                    F.size(F.array_union("a", "b")).cast("bigint").alias("n_union"))


@query("u2_table_difference", """SELECT user_id, event_type FROM events WHERE value>20 EXCEPT SELECT user_id, event_type FROM events WHERE value<2""")
def _(t):
    e = t("events")
    return e.where("value > 20").select("user_id", "event_type").distinct().join(
        e.where("value < 2").select("user_id", "event_type"), ["user_id", "event_type"], "left_anti")


@query("u3_sorted_distinct", """SELECT user_id, array_to_string(list_sort(list(DISTINCT CAST(floor(value) AS BIGINT))),';') AS lv FROM events GROUP BY user_id""")
def _(t):
    return (t("events").select("user_id", F.floor("value").alias("v")).distinct().groupBy("user_id")
            .agg(F.array_join(F.array_sort(F.collect_list("v")), ";").alias("lv")))
