"""The TESTDATA tables presented in the shapes of run tables, in Spark and as oracle SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stamina.operators.ordered import Ordered
from stamina.session import tune

RAW = ("region nation customer supplier part orders lineitem events documents embeddings pages "
       "benchmark labels conversations").split()


class Tables:
    """Lazy access to the parquet tables and their run-table views."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = tune(spark), path

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def telemetry(self) -> DataFrame:
        e = F.col("event_type")
        return self("events").select(
            F.col("user_id").alias("run_id"), F.col("event_id").alias("sample_id"), "ts",
            (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t_s"),
            F.when(~e.isin("error", "signup"), F.col("value")).alias("ua"),
            F.when(e == "error", "invalid").when(e == "signup", "offscreen").otherwise("ok").alias("i_status"),
            (F.col("value") * 0.01).alias("kv"), (F.col("event_id") % 7).cast("double").alias("f_meas"))

    @cached_property
    def snapshots(self) -> DataFrame:
        li = self("lineitem")
        order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
        rows = Ordered(li, ["l_partkey"], order).row_number("rn").result()
        return rows.select(
            F.col("l_partkey").alias("run_id"), (F.col("rn") - 1).alias("row_idx"),
            F.col("l_shipdate").alias("ts"), F.col("l_linenumber").cast("double").alias("kv"),
            F.when(F.col("l_tax") != 0.08, F.col("l_quantity") - 25).alias("ua"),
            F.when(F.col("l_discount") != 0.0, F.col("l_extendedprice")).alias("area_px"),
            F.when(F.col("l_returnflag") == "A", "post-ramp").when(F.col("l_returnflag") == "N", "pre-ramp")
            .otherwise("baseline").alias("tag"),
            (F.col("l_linestatus") == "F").alias("traced"), (0.5 + F.col("l_discount") * 5).alias("conf"))

    @cached_property
    def blocks(self) -> DataFrame:
        rows = Ordered(self("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).row_number("rn").result()
        price = F.col("o_totalprice")
        return rows.select(
            F.col("o_custkey").alias("run_id"), (F.col("rn") - 1).alias("block_idx"),
            F.col("o_orderdate").alias("t_start"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "dc_hold").otherwise("cycle").alias("type"),
            F.floor(price / 100).alias("cycles_done"),
            F.when(F.col("o_orderstatus") == "F", "burst").when(F.col("o_orderstatus") == "O", "timed")
            .otherwise("estimated").alias("counting"),
            F.when(F.col("o_orderpriority") != "2-HIGH", price / 10000).alias("imean_ua"),
            (0.25 * (1 + F.col("o_orderkey") % 4)).alias("freq_hz"))

    @cached_property
    def interludes(self) -> DataFrame:
        rows = Ordered(self("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).row_number("rn").result()
        k = F.col("o_orderkey")
        return rows.select(
            F.col("o_custkey").alias("run_id"), F.col("rn").alias("interlude_idx"),
            F.col("o_orderdate").alias("t"), (F.col("o_totalprice") / 1000).alias("disp_value"),
            ((k % 50) * 0.1).alias("leak_ua"), F.when(k % 9 != 0, 5 + (k % 13) * 0.1).alias("c_est_nf"),
            ((k % 11) * 0.5).alias("rest_value"), (k % 5 == 0).alias("is_baseline"))

    @cached_property
    def survival(self) -> DataFrame:
        return self("customer").select(
            F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("specimen_id"),
            ((F.col("c_acctbal") + 1100) * 100).alias("cycles"),
            F.when(F.col("c_custkey") % 3 == 0, "suspended").otherwise("failed").alias("status"))

    @cached_property
    def specimens(self) -> DataFrame:
        return self("customer").select(
            F.col("c_custkey").alias("specimen_id"), F.col("c_mktsegment").alias("geometry"),
            F.col("c_nationkey").alias("nationkey"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 1000).alias("c_est_nf"),
            F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal") / 1000).alias("specimen_cap_kv"))

    @cached_property
    def accepted(self) -> DataFrame:
        return self("labels").select(
            F.col("doc_id").alias("row_key"), "quality", "toxic",
            F.when(F.col("quality") == 1, 1000.0 + F.col("doc_id") % 97).alias("area_px"))

    @cached_property
    def trace(self) -> DataFrame:
        e = self("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("frame", "x"))
        return e.select(F.col("vec_id").alias("clip"), F.col("label").alias("series_no"), "frame",
                        (F.col("frame") / 32.0).alias("t_s"), (F.col("x").cast("double") * 100).alias("disp"))

    @cached_property
    def clips(self) -> DataFrame:
        return self("events").select("event_id", F.concat(
            F.lit("actuation_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".h264")).alias("name"))

    @cached_property
    def commands(self) -> DataFrame:
        return self("conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"),
                                            F.col("role").alias("cmd"), "text")


ORACLE_VIEWS = {
    "telemetry": """SELECT user_id AS run_id, event_id AS sample_id, ts, epoch_us(ts)/1e6 AS t_s,
  CASE WHEN event_type IN ('error','signup') THEN NULL ELSE value END AS ua,
  CASE WHEN event_type = 'error' THEN 'invalid' WHEN event_type = 'signup' THEN 'offscreen' ELSE 'ok' END AS i_status,
  value * 0.01e0 AS kv, CAST(event_id % 7 AS DOUBLE) AS f_meas FROM events""",
    "snapshots": """SELECT l_partkey AS run_id,
  CAST(ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS row_idx,
  l_shipdate AS ts, CAST(l_linenumber AS DOUBLE) AS kv,
  CASE WHEN l_tax = 0.08 THEN NULL ELSE l_quantity - 25 END AS ua,
  CASE WHEN l_discount = 0.0 THEN NULL ELSE l_extendedprice END AS area_px,
  CASE l_returnflag WHEN 'A' THEN 'post-ramp' WHEN 'N' THEN 'pre-ramp' ELSE 'baseline' END AS tag,
  l_linestatus = 'F' AS traced, 0.5e0 + l_discount * 5 AS conf FROM lineitem""",
    "blocks": """SELECT o_custkey AS run_id,
  CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS block_idx,
  o_orderdate AS t_start, CASE WHEN o_orderpriority = '1-URGENT' THEN 'dc_hold' ELSE 'cycle' END AS type,
  CAST(FLOOR(o_totalprice / 100) AS BIGINT) AS cycles_done,
  CASE o_orderstatus WHEN 'F' THEN 'burst' WHEN 'O' THEN 'timed' ELSE 'estimated' END AS counting,
  CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE o_totalprice / 10000 END AS imean_ua,
  0.25e0 * (1 + o_orderkey % 4) AS freq_hz FROM orders""",
    "interludes": """SELECT o_custkey AS run_id,
  CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS interlude_idx,
  o_orderdate AS t, o_totalprice / 1000 AS disp_value, (o_orderkey % 50) * 0.1e0 AS leak_ua,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 5 + (o_orderkey % 13) * 0.1e0 END AS c_est_nf,
  (o_orderkey % 11) * 0.5e0 AS rest_value, o_orderkey % 5 = 0 AS is_baseline FROM orders""",
    "survival": """SELECT c_nationkey AS grp, c_custkey AS specimen_id, (c_acctbal + 1100) * 100 AS cycles,
  CASE WHEN c_custkey % 3 = 0 THEN 'suspended' ELSE 'failed' END AS status FROM customer""",
    "specimens": """SELECT c_custkey AS specimen_id, c_mktsegment AS geometry, c_nationkey AS nationkey,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal / 1000 END AS c_est_nf,
  CASE WHEN c_custkey % 4 = 0 THEN c_acctbal / 1000 END AS specimen_cap_kv FROM customer""",
    "accepted": """SELECT doc_id AS row_key, quality, toxic, CASE WHEN quality = 1 THEN 1000e0 + doc_id % 97 END AS area_px FROM labels""",
    "trace": """SELECT e.vec_id AS clip, e.label AS series_no, CAST(i.i AS INT) AS frame, i.i / 32e0 AS t_s,
  CAST(e.embedding[i.i + 1] AS DOUBLE) * 100 AS disp
  FROM embeddings e CROSS JOIN (SELECT unnest(range(64)) AS i) i""",
    "clips": """SELECT event_id, CONCAT('actuation_', strftime(ts,'%Y%m%d_%H%M%S'), '.h264') AS name FROM events""",
    "commands": """SELECT conv_id AS run_id, turn AS seq, role AS cmd, text FROM conversations""",
}


def oracle(body: str, *views: str, ctes: str = "") -> str:
    """SQL with the named views as leading CTEs; ``ctes`` may add more."""
    parts = [f"{v} AS ({ORACLE_VIEWS[v]})" for v in views]
    if ctes:
        parts.append(ctes)
    if body.lstrip().startswith(","):
        parts.append(body.lstrip()[1:])
        body = ""
    return ("WITH RECURSIVE " + ", ".join(parts) + " " + body) if parts else body
