import hashlib
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from stamina.operators.measure import measure_pairs
from stamina.sources import readers, sinks


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_run_folders_with_byte_order_mark(spark):
    root = folder()
    for run, bom in (("LC_1", "﻿"), ("LC_2", "")):
        d = os.path.join(root, "sp1", run)
        os.makedirs(d)
        with open(os.path.join(d, "telemetry.csv"), "w", encoding="utf-8") as f:
            f.write(bom + ",".join(readers.TELEMETRY) + "\n0.5,2026-01-01T00:00:00,1.0, ,junk,ok,invalid,\n")
    t = readers.run_table(spark, f"{root}/*/*/telemetry.csv", readers.TELEMETRY).orderBy("run_id").collect()
    assert [(r.specimen_dir, r.run_id, r.t_s, r.measured_kV, r.measured_uA, r.i_status, r.event) for r in t] == [
        ("sp1", "LC_1", 0.5, None, None, "invalid", None), ("sp1", "LC_2", 0.5, None, None, "invalid", None)]
    assert readers.run_table(spark, f"{root}/none/*.csv", readers.TELEMETRY).count() == 0


def test_many_run_folders_are_listed_in_few_tasks(spark):
    root = folder()
    for k in range(300):
        d = os.path.join(root, f"sp{k % 3}", f"LC_{k}")
        os.makedirs(d)
        with open(os.path.join(d, "data.csv"), "w", encoding="utf-8") as f:
            f.write(",".join(readers.TELEMETRY) + f"\n{k}.5,2026-01-01T00:00:00,1.0,,,ok,ok,\n")
        open(os.path.join(d, "notes.txt"), "w").close()
    for at, more in (("*/*/*.csv", {}), ("*/*", {"files": "*.csv"})):
        spark.sparkContext.setJobGroup(at, "listing")
        t = readers.run_table(spark, f"{root}/{at}", readers.TELEMETRY, **more)
        tracker = spark.sparkContext.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup(at) for s in tracker.getJobInfo(j).stageIds]
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 256
        assert {(r.specimen_dir, r.run_id, r.t_s) for r in t.collect()} == {(f"sp{k % 3}", f"LC_{k}", k + 0.5) for k in range(300)}


def test_state_files_are_quarantined(spark):
    root = folder()
    for name, text in (("a", '{"schema": "s/1",\n "run": 1}'), ("b", '{"schema": "t/9", "run": 2}'), ("c", "{broken")):
        with open(os.path.join(root, f"{name}.json"), "w") as f:
            f.write(text)
    ok, bad = readers.state_json(spark, root, "schema string, run bigint", "s/1")
    assert [r.run for r in ok.collect()] == [1] and bad.count() == 2
    m = sinks.manifest(spark, root).collect()
    assert {r.name for r in m} == {"a.json", "b.json", "c.json"} and all(len(r.sha256) == 64 for r in m)
    names = {r.name for r in readers.files_below(spark, root).collect()}
    assert names == {"a.json", "b.json", "c.json"}


def test_spec_versions(spark):
    df = spark.createDataFrame([('{"spec_version": 1, "opts": {}, "n_runs": 2}',), ('{"spec_version": 9, "opts": {}, "n_runs": 1}',),
                                ('{"spec_version": 1, "n_runs": 1}',), ("nope",), ('{"spec_version": 1, "opts": {}, "n_runs": 0}',)], "spec string")
    assert [r.problem for r in sinks.check_spec(df).collect()] == [None, "written by a newer version", "no opts", "not valid JSON", "n_runs must be a positive integer"]
    runs = spark.createDataFrame([("f", "b"), ("f", "a"), ("f", "b"), ("g", None)], "stem string, run string")
    specs = [{r.stem: r.spec for r in sinks.figure_spec(d, {"m": "x"}, F.col("stem")).collect()} for d in (runs, runs.orderBy("run"))]
    assert specs[0] == specs[1] and '"n_runs":2' in specs[0]["f"]


def test_manifest_hashes_in_chunks(spark, monkeypatch):
    root, content = folder(), os.urandom(3 * (1 << 20) + 17)
    for name, raw in (("big.bin", content), ("empty.bin", b"")):
        with open(os.path.join(root, name), "wb") as f:
            f.write(raw)
    got = {r.name: (r.bytes, r.sha256) for r in sinks.manifest(spark, root).collect()}
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in (("big.bin", content), ("empty.bin", b""))}


def test_measurement_errors_become_rows(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc"), bytearray(b"a")), (2, bytearray(b"x"), None), (3, bytearray(b"y"), None)], "id int, content binary, rest binary")

    def measure(frame, rest):
        return {"value": float(len(frame) / len(rest)), "rest_value": 1.0, "quality": "ok", "notes": ""}
    out = {r.id: r for r in measure_pairs(df, ["id"], measure, df.where("id = 3")).collect()}
    assert out[1].value == 3.0 and out[2].error.startswith("TypeError") and 3 not in out


def test_listing_falls_back_to_the_newest_whole_version(spark):
    kept = readers.ListingSnapshots(spark, folder() + "/listing")
    away = lambda: spark.read.text("/tmp/no-such-share").toDF("name")
    with pytest.raises(FileNotFoundError):
        kept.read(away)
    for names in (["a.h264", "b.txt"], ["a.h264", "c.h264"]):
        df, live = kept.read(lambda names=names: spark.createDataFrame([(n,) for n in names], "name string"))
        assert live
    os.makedirs(f"{kept.folder}/v=2")                  # a writer that died
    df, live = kept.read(away)
    assert not live and {r.name for r in df.collect()} == {"a.h264", "c.h264"}
    assert {r.name for r in kept.read(version=0)[0].collect()} == {"a.h264"}
    with pytest.raises(FileNotFoundError):
        kept.read(version=7)
