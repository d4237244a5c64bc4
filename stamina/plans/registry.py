"""Collects the named queries and, where SQL can express them, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stamina.plans.bindings import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


def rounded(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    """Round every double so both engines agree on the printed value."""
    return df.select(*[
        F.round(F.col(f.name), special.get(f.name, places)).alias(f.name)
        if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])
