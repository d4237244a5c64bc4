"""Writers of run tables, summaries, manifests and figure specifications."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPEC_VERSION = 1
CHUNK_BYTES = 1 << 20


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns: extras dropped, missing ones null."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])


def append_rows(df: DataFrame, path: str, columns: list[str], fmt: str = "parquet") -> None:
    out = project(df, columns)
    writer = out.write.mode("append")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def continue_numbering(new: DataFrame, existing: DataFrame, keys: list[str], order: list[str], idx: str) -> DataFrame:
    """Numbers new rows after the last number already stored for their run."""
    from stamina.operators.ordered import Ordered
    last = existing.groupBy(*keys).agg(F.max(idx).alias("__last"))
    o = Ordered(new, keys, order).row_number("__k").result()
    return o.join(last, keys, "left").withColumn(idx, F.col("__k") + F.coalesce("__last", F.lit(0))).drop("__k", "__last")


def evolve(old: DataFrame, new: DataFrame, before: str = "notes") -> DataFrame:
    """Union of both column sets, with unknown columns placed before ``before``."""
    both = old.unionByName(new, allowMissingColumns=True)
    extra = [c for c in new.columns if c not in old.columns]
    cols = list(old.columns)
    at = cols.index(before) if before in cols else len(cols)
    return both.select(*cols[:at], *extra, *cols[at:])


class FileHashes(DataSource):
    """Files as rows of (path, bytes, sha256); one partition a file, which is read a megabyte at a time, so that its size doesn't matter.

    Files are listed by Spark's reader beforehand; a task opens its file by the file system that its path names.
    """

    @classmethod
    def name(cls) -> str:
        return "stamina_file_hashes"

    def schema(self) -> str:
        return "path string, bytes bigint, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return FileHashReader(json.loads(self.options["paths"]))


class FileHashReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.fs as afs
        files, place = afs.FileSystem.from_uri(partition.value)
        digest, size = hashlib.sha256(), 0
        with files.open_input_stream(place) as f:
            while chunk := f.read(CHUNK_BYTES):
                digest.update(chunk)
                size += len(chunk)
        yield partition.value, size, digest.hexdigest()


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """Name, size and SHA-256 of every file, each hashed in chunks by a task of its own; the listing (no content) is the driver's."""
    paths = sorted(_files(spark, pattern))
    spark.dataSource.register(FileHashes)
    rows = spark.read.format("stamina_file_hashes").option("paths", json.dumps([_uri(p) for p in paths])).load()
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256")


def _files(spark: SparkSession, pattern: str) -> Iterator[str]:
    """Paths of the files that match, or lie below a folder that matches, empty ones included; hidden names are left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(at) or []:
        below = fs.listFiles(found.getPath(), True)
        while below.hasNext():
            path = below.next().getPath()
            if path.getName()[0] not in "._":
                yield path.toString()


def _uri(path: str) -> str:
    """file:/a and file:///a are one to Hadoop; only the longer one to others."""
    return re.sub(r"^file:/+", "file:///", path)


def figure_spec(runs: DataFrame, options: dict[str, str], stem: Column) -> DataFrame:
    """One JSON document per figure: version, options, how many runs it shows and a digest of them.

    The digest is a sum over the distinct runs, so that it is the same in any order and adds up without a figure's runs in one place;
    the runs themselves are rows, ``figure_runs``.
    """
    opts = F.create_map(*[x for k, v in sorted(options.items()) for x in (F.lit(k), F.lit(v))])
    each = F.conv(F.substring(F.sha2(F.coalesce(F.col("run").cast("string"), F.lit("")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    g = figure_runs(runs, stem).groupBy("stem").agg(F.count("*").alias("n_runs"), F.sum(each).cast("string").alias("digest"))
    return g.select("stem", F.to_json(F.struct(F.lit(SPEC_VERSION).alias("spec_version"), opts.alias("opts"), "n_runs", "digest", "stem")).alias("spec"))


def figure_runs(runs: DataFrame, stem: Column) -> DataFrame:
    """(stem, run): the runs of each figure, once each."""
    return runs.select(stem.alias("stem"), "run").distinct()


def check_spec(specs: DataFrame) -> DataFrame:
    """Problem of each spec document, null when it can be rendered again."""
    v = F.get_json_object("spec", "$.spec_version").try_cast("int")
    runs = F.get_json_object("spec", "$.n_runs").try_cast("bigint")
    return specs.withColumn("problem", F.when(F.get_json_object("spec", "$").isNull(), "not valid JSON")
                            .when(v.isNull() | (v < 1), "spec_version must be a positive integer").when(v > SPEC_VERSION, "written by a newer version")
                            .when(F.get_json_object("spec", "$.opts").isNull(), "no opts").when(runs.isNull() | (runs < 1), "n_runs must be a positive integer"))


def write_summary(df: DataFrame, path: str, by: str = "series") -> None:
    """Summary rows partitioned by series; failed items are rows with an error text."""
    df.write.mode("append").partitionBy(by).parquet(path)
