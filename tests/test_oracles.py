"""Every registered query with an oracle, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

PATH = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# replays run in tests/test_streaming.py, with rows that arrive out of order
STREAMS = {n for n in QUERIES if n.startswith("x") and n not in ("x9_flag_lifecycle", "x4_silence_batch")}


@pytest.fixture(scope="module")
def con():
    return duck(PATH)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in STREAMS])
def test_query(spark, con, name):
    ok, msg = compare(spark, con, name, QUERIES[name], SQL.get(name), PATH)
    assert ok, msg


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_capture_numbers_of_five_digits(spark, tmp_path):
    """a number wider than its four places is printed whole."""
    spark.read.parquet(f"{PATH}/events.parquet").selectExpr("* except (event_id)", "event_id + 9990 as event_id").coalesce(1).write.parquet(f"file://{tmp_path}/events")
    (tmp_path / "events.parquet").write_bytes(next((tmp_path / "events").glob("part-*.parquet")).read_bytes())
    ok, msg = compare(spark, duck(str(tmp_path)), "f_capture_name", QUERIES["f_capture_name"], SQL["f_capture_name"], str(tmp_path))
    assert ok, msg
