"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_SEGMENT = "stamina.rowsPerSegment"
DEFAULT_ROWS_PER_SEGMENT = 1_000_000


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings: adaptive plans with skew handling, UTC, full clustering keys, and listings in few tasks.

    ``requireAllClusterKeysForDistribution`` matters for skew: without it Spark
    accepts rows hashed on the entity key alone for a window over
    (entity, segment), which puts a hot entity back into one task. Without a bound
    on the tasks of a listing Spark starts one for each path, up to 10,000.
    """
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.requireAllClusterKeysForDistribution": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
    }.items():
        spark.conf.set(key, value)
    ship()
    return spark


def ship() -> None:
    """Python stages carry this package's functions by value, so that no worker has to import it.

    Files added to the application do not reach the worker that starts a stateful stream.
    """
    import stamina
    from pyspark.cloudpickle.cloudpickle import register_pickle_by_value
    register_pickle_by_value(stamina)


def rows_per_segment(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_SEGMENT, str(DEFAULT_ROWS_PER_SEGMENT)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of this machine's only if that is unset and Spark runs on it alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset; executors on other machines need a shared folder")
        current = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
