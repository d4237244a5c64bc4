import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from oracle_check import make_spark
    from stamina.session import tune
    s = tune(make_spark({"spark.sql.shuffle.partitions": "4"}))
    yield s
    s.stop()


@pytest.fixture(params=[None, "5"], ids=["plain", "segmented"])
def segment(request, spark):
    """Runs a test once with plain windows and once with five-row segments."""
    if request.param:
        spark.conf.set("stamina.rowsPerSegment", request.param)
    yield request.param
    spark.conf.unset("stamina.rowsPerSegment")
