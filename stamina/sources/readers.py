"""Readers of run folders: tables, settings, anchors, logs, traces, state files."""

from __future__ import annotations

import os
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stamina.functions.text import NUMBER, calibration_mode, split_rounds
from stamina.operators.snapshots import SETTINGS

# Column names of the run tables, in file order.
BLOCKS = ("block_idx loop_path type role t_start_iso t_end_iso wall_s cycles_planned cycles_done counting cycles_total "
          "actuated_s_block actuated_s_total waveform freq_cmd_hz freq_meas_hz vpk_cmd_kv vmin_cmd_kv vmean_meas_kv vpk_meas_kv "
          "vvalley_meas_kv imean_ua ipk_ua ivalley_ua defl_metric defl_pk defl_valley env_t_c env_p_mbar env_age_s soft_flags verdict notes").split()
INTERLUDES = ("interlude_idx kind cycles_total actuated_s_total wall_s_total t_iso ref_kv disp_metric disp_value disp_baseline disp_ratio "
              "leak_ua leak_baseline_ua leak_ratio c_est_nf c_quality c_baseline_nf c_ratio zero_value zero_drift wrinkle_idx focus frames "
              "subrun_dir is_baseline verdict flags notes").split()
EVENTS = ("event_idx t_iso wall_s cycles_total actuated_s_total tier rule_id action value threshold message trace_file frame_file operator").split()
TELEMETRY = "t_s timestamp nominal_kV measured_kV measured_uA v_status i_status event".split()
SNAPSHOTS = ("snapshot step tag nominal_kV control_V measured_kV measured_uA t_planned_s timestamp frame_file active_area_px active_area_mm2 "
             "active_diam_mm wrinkle_idx notes").split()
SPECIMENS = ("specimen_id created_utc geometry material_preset elastomer electrode n_layers length_mm width_mm thickness_um_layer mass_mg c_est_nf "
             "ebd_ref_v_per_um ebd_ref_temp_c ebd_source status cycles_accum actuated_s_accum last_run_id failure_mode notes").split()
TEXT_COLUMNS = set("loop_path type role t_start_iso t_end_iso counting waveform defl_metric verdict notes kind t_iso disp_metric c_quality frames "
                   "subrun_dir is_baseline flags tier rule_id action message trace_file frame_file operator timestamp v_status i_status event tag "
                   "specimen_id created_utc geometry material_preset elastomer electrode ebd_source status last_run_id failure_mode snapshot value threshold".split())
# Typed keys of an anchor block.
ANCHOR_FLOATS = ("diam_px diam_mm mm_per_px auto_diam_px spread_px spread_pct sigma_pct se_pct fit_circ fit_conf fit_resid_px fit_arc_cov "
                 "prev_diam_px prev_implied_px").split()
ANCHOR_INTS = "n_rounds fit_n_edge reanchor_rows reanchor_blanked".split()


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def typed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Blank or junk numbers become null; text cells are trimmed and blank is null."""
    return df.select(*[c for c in df.columns if c not in columns], *[
        (F.nullif(F.trim(F.col(c)), F.lit("")) if c in TEXT_COLUMNS else F.trim(F.col(c)).try_cast("double")).alias(c)
        for c in columns if c in df.columns])


def run_table(spark: SparkSession, pattern: str, columns: list[str], files: str | None = None) -> DataFrame:
    """All files of one table over many run folders, with specimen and run from the path.

    A pattern without matches is an empty table. A byte order mark in the header is ignored. With ``files``, a pattern of file names,
    ``pattern`` names the run folders, which tasks then list: for very many runs without folders of their own below.
    """
    reader = spark.read.schema(text_schema(columns)).option("header", True).option("enforceSchema", False)
    if files:
        reader = reader.option("pathGlobFilter", files)
    try:
        raw = reader.csv(pattern)
    except Exception as e:  # only a missing path means "no table"
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], text_schema(columns))
        return typed(raw.withColumns({"specimen_id": F.lit(None).cast("string"), "run_id": F.lit(None).cast("string")}), columns)
    return typed(raw.select("*", folder_above(3).alias("specimen_dir"), folder_above(2).alias("run_id")), columns)


def folder_above(at: int) -> Column:
    """The part of a row's file path, counted from its end. No regular expression: one that is only bound to the end of the path is tried
    from each of its characters, for each row."""
    tail = F.substring_index("_metadata.file_path", "/", -at)
    return F.substring_index(tail, "/", 1)


def pick_run_file(files: DataFrame) -> DataFrame:
    """The run table of each folder: data.csv, else the lowest data<N>.csv; other files never match.

    ``files``: folder, name. One aggregation, no sort of the listing.
    """
    n = F.regexp_extract(F.lower("name"), r"^data(\d*)\.csv$", 1)
    hit = files.where(F.lower("name").rlike(r"^data\d*\.csv$"))
    rank = F.struct((F.lower("name") != "data.csv").alias("a"), F.coalesce(n.try_cast("int"), F.lit(0)).alias("b"), F.col("name").alias("c"))
    return hit.groupBy("folder").agg(F.min_by("name", rank).alias("name"))


def newest_runs(runs: DataFrame) -> DataFrame:
    """The newest run under each root, looking one level down where no run sits directly in it.

    ``runs``: root, parent (equal to root for direct runs), run, modified. A nested level is
    the child with most runs, first by name on ties.
    """
    per = runs.groupBy("root", "parent").agg(F.count(F.lit(1)).alias("n"), F.max_by("run", F.struct("modified", "run")).alias("run"))
    direct = F.col("parent") == F.col("root")
    best = F.struct(direct.cast("int").alias("d"), F.col("n").alias("n"))
    top = per.groupBy("root").agg(F.max(best).alias("b"))
    return (per.join(top, "root").where(best == F.col("b")).groupBy("root")
            .agg(F.min_by(F.struct("parent", "n", "run"), "parent").alias("p")).select("root", "p.parent", "p.n", "p.run"))


def settings_of(texts: DataFrame, key: list[str], header: str, defaults: dict = SETTINGS) -> DataFrame:
    """(key, setting, value): defaults overlaid by ``name: number`` lines after ``header``.

    A line '... nominal diameter: X mm' anywhere sets diam_mm unless the section does.
    """
    body = F.when(F.col("text").contains(header), F.element_at(F.split("text", F.concat(F.lit(r"\Q"), F.lit(header), F.lit(r"\E")), 2), 2))
    line = r"(?m)^\s*([a-z_]+)\s*:\s*(" + NUMBER + r")\s*$"
    t = texts.withColumn("__b", body).withColumn("__n", F.regexp_extract_all("__b", F.lit(line), 1)).withColumn(
        "__v", F.regexp_extract_all("__b", F.lit(line), 2))
    diam = F.nullif(F.regexp_extract("text", r"nominal diameter:\s*(" + NUMBER + r")\s*mm", 1), F.lit("")).try_cast("double")
    rows = F.array(*[F.struct(F.lit(k).alias("setting"), F.lit(float(v)).alias("default")) for k, v in defaults.items()])
    e = t.withColumn("__diam", diam).select(*key, "__n", "__v", "__diam", F.explode(rows).alias("r"))
    # the last line with a name wins, as when reading top to bottom
    hits = F.filter(F.arrays_zip("__n", "__v"), lambda p: p["__n"] == F.col("r.setting"))
    found = F.element_at(F.when(F.size(hits) > 0, hits), -1)["__v"].try_cast("double")
    fallback = F.when(F.col("r.setting") == "diam_mm", F.coalesce("__diam", F.col("r.default"))).otherwise(F.col("r.default"))
    return e.select(*key, F.col("r.setting").alias("setting"), F.coalesce(found, fallback).alias("value"))


def anchor_block(texts: DataFrame, key: list[str], header: str) -> DataFrame:
    """Typed fields of the anchor block after ``header``; absent or unparsable keys stay null."""
    pattern = r"\Q" + header + r"\E\n((?:[a-z_]+:[^\n]*\n?)*)"
    t = texts.withColumn("__b", F.regexp_extract("text", pattern, 1))
    line = F.lit(r"(?m)^([a-z_]+):[ \t]*(.*)$")
    t = t.withColumn("__p", F.arrays_zip(F.regexp_extract_all("__b", line, 1).alias("k"), F.regexp_extract_all("__b", line, 2).alias("v")))

    def field(name: str) -> Column:
        hit = F.filter("__p", lambda p: p["k"] == name)
        return F.trim(F.element_at(F.when(F.size(hit) > 0, hit), -1)["v"])
    rounds = split_rounds(field("rounds_px"))
    cols = {**{c: field(c).try_cast("double") for c in ANCHOR_FLOATS}, **{c: field(c).try_cast("double").cast("bigint") for c in ANCHOR_INTS},
            "rounds_px": F.when(F.size(rounds) > 0, rounds),
            "anchor_is_baseline": ~field("anchor_is_baseline").isin("0", "", "False"),
            "cal_mode": F.coalesce(calibration_mode(field("cal_mode")), field("cal_mode")), "method": field("method")}
    return t.select(*key, *[v.alias(k) for k, v in cols.items()]).where(F.coalesce("diam_px", F.lit(0.0)) != 0)


def log_records(lines: DataFrame, key: list[str]) -> DataFrame:
    """key=value tokens of a log line as a map; tokens without '=' are skipped."""
    tokens = F.filter(F.split("line", " "), lambda x: x.contains("="))
    pairs = F.transform(tokens, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v")))
    # a repeated key keeps its first value
    return lines.select(*key, F.map_from_entries(F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, p: F.when(
        F.exists(acc, lambda q: q["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(p))))).alias("fields"))


def state_json(spark: SparkSession, pattern: str, schema: str, schema_id: str, one_per_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) state documents, one a file or one a line; a wrong schema id or broken JSON is quarantined."""
    df = (spark.read.schema(schema + ", _corrupt_record string").option("multiLine", one_per_file).option("mode", "PERMISSIVE").json(pattern)
          .withColumn("path", F.col("_metadata.file_path")))
    ok = F.coalesce((F.col("schema") == schema_id) & F.col("_corrupt_record").isNull(), F.lit(False))
    return df.where(ok).drop("_corrupt_record"), df.where(~ok)


def waveform_rows(lines: DataFrame, key: list[str], line_no: str, header: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(samples, problems) of numeric waveform rows; blank lines are skipped, bad rows keep their number."""
    at = F.array_position(F.transform(F.split(F.lower(header), ","), lambda c: F.trim(c)), "value").cast("int")
    cells = F.split(text, ",")
    d = lines.withColumn("__at", at).withColumn("__blank", F.forall(cells, lambda c: F.trim(c) == ""))
    d = d.withColumn("value", F.when(F.col("__at") > 0, F.trim(F.get(cells, F.col("__at") - 1)).try_cast("double")))
    problem = F.when(F.col("__at") == 0, "header lacks a value column").when(F.col("value").isNull(), "bad value")
    d = d.where(~F.col("__blank")).withColumn("problem", problem)
    return (d.where("problem is null").select(*key, line_no, "value"), d.where("problem is not null").select(*key, line_no, "problem"))


def trace_csv(spark: SparkSession, pattern: str, header: list[str], clip_in_path: str = r"([^/]+)_traces\.csv$") -> DataFrame:
    """Trace tables with dynamic finger columns, everything double except the frame; the path names the clip."""
    raw = spark.read.schema(text_schema(header)).option("header", True).option("recursiveFileLookup", True).csv(pattern)
    clip = F.regexp_extract(F.col("_metadata.file_path"), clip_in_path, 1)
    return raw.select(clip.alias("clip"), *[F.trim(F.col(c)).try_cast("int" if c == "frame" else "double").alias(c) for c in header])


def long_trace(wide: DataFrame, fingers: list[str]) -> DataFrame:
    """(clip, frame, t_s, finger, dx, dy, n) from <finger>_dx, _dy, _n columns."""
    rows = F.array(*[F.struct(F.lit(f).alias("finger"), F.col(f"{f}_dx").alias("dx"), F.col(f"{f}_dy").alias("dy"), F.col(f"{f}_n").alias("n")) for f in fingers])
    return wide.select("clip", "frame", "t_s", F.explode(rows).alias("r")).select("clip", "frame", "t_s", "r.*")


def files_below(spark: SparkSession, pattern: str) -> DataFrame:
    """folder, name, size and time of files; file content is not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    return f.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"),
                    "length", F.col("modificationTime").alias("modified"), "path")


class ListingSnapshots:
    """Listings of a share, kept as versions of a table, for when the share is away.

    A version is whole once its writer's marker is there; readers take the newest whole one, or the one they name.
    """

    def __init__(self, spark: SparkSession, folder: str, suffix: str = ".h264"):
        self.spark, self.folder, self.suffix = spark, folder.rstrip("/"), suffix
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = [f.getPath() for f in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(p.getName()[2:]) for p in found if self._fs.exists(self._path(p, "_SUCCESS")))

    def keep(self, names: DataFrame) -> int:
        """Store ``name`` of the items with the suffix as the next version."""
        version = max(self.versions(), default=-1) + 1
        names.where(F.endswith("name", F.lit(self.suffix))).select("name").distinct().write.mode("overwrite").parquet(f"{self.folder}/v={version}")
        return version

    def read(self, live: Callable[[], DataFrame] | None = None, version: int | None = None) -> tuple[DataFrame, bool]:
        """(names, whether they are live): the live listing, which is kept as a new version; a kept one when it fails or a version is named."""
        if live is not None and version is None:
            try:
                version = self.keep(live())
                return self.spark.read.schema("name string").parquet(f"{self.folder}/v={version}"), True
            except (AnalysisException, Py4JJavaError, OSError):
                version = None
        known = self.versions()
        if not known or version is not None and version not in known:
            raise FileNotFoundError("the share is away and no listing of it is kept" if version is None else f"no listing {version} is kept")
        return self.spark.read.schema("name string").parquet(f"{self.folder}/v={known[-1] if version is None else version}"), False


def every_nth(files: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Every n-th item of each folder in name order."""
    from stamina.operators.ordered import Ordered
    return Ordered(files, keys, order).row_number("__k").result().where((F.col("__k") - 1) % n == 0).drop("__k")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    import uuid
    from stamina.session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark), "stamina", f"{name}-{uuid.uuid4().hex}")
