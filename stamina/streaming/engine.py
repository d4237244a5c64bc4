"""Stream sources, replay of stored rows, dead letters, a keyed current table, and running a stream into a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stamina.sources.readers import scratch

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATENESS = "10 minutes"
CLOSING = "closing_row"
SLICE_ROWS, FILE_ROWS, FEWEST_SLICES = 1_000_000, 250_000, 3
BUCKET_ROWS, FEWEST_BUCKETS = 25_000, 64


def telemetry_stream(spark: SparkSession, path: str, schema: T.StructType, ts: str = "ts",
                     files_per_trigger: int | None = 1, fmt: str = "parquet") -> DataFrame:
    """Explicit schema, event time as a zoned timestamp (a watermark refuses the other kind)."""
    r = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path).withColumn(ts, F.col(ts).cast("timestamp"))


@dataclass
class Replay:
    """Stored rows to stream from: a folder of ``files`` files for each slice, which a micro-batch takes whole, how far a row may come
    behind the newest one, and a number of buckets that bounds what a slice brings for one."""

    path: str
    schema: T.StructType
    lateness: str
    files: int
    buckets: int

    def stream(self, spark: SparkSession, ts: str = "ts") -> DataFrame:
        return telemetry_stream(spark, self.path, self.schema, ts, self.files)


def store_slices(df: DataFrame, ts: str, key: str | None = None, close_after: str | None = None, arrival: Column | None = None,
                 slices: int | None = None, append_to: str | None = None) -> Replay:
    """Stores rows as slices in time order, so that a stream reads several micro-batches.

    Slices are cut by the counted rows of the largest run, so that what a run brings at once is bounded however many rows it has, and the
    number of slices does not grow with the number of runs. Each is written by several tasks into as many files as any other, so that a
    micro-batch takes one slice. Rows without event time come in the last one. ``arrival`` (a small whole number) deals the rows by other
    than time. ``close_after`` adds a last file with one row that much later, marked in column ``CLOSING``: it moves the watermark past the
    data, so that all rows and windows of a finite replay are released. The lateness is the largest step back in time between two slices.
    """
    spark = df.sparkSession
    if close_after:
        df = df.withColumn(CLOSING, F.lit(False))
    path, staging = append_to or scratch(spark, "replay"), scratch(spark, "replay-slices")
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    if arrival is None:
        largest = 0 if slices else (df.groupBy(key).count().agg(F.max("count")).first()[0] or 0) if key else df.count()
        n = slices or max(FEWEST_SLICES, -(-largest // SLICE_ROWS))
        cuts = df.select(F.percentile_approx(us, [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else []
        arrival = F.coalesce(sum((us > F.lit(c)).cast("int") for c in cuts), F.lit(n - 1)) if cuts else F.lit(0)
    df.withColumn("__slice", arrival.cast("int")).write.partitionBy("__slice").parquet(staging)
    dealt = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__slice", T.IntegerType())])).parquet(staging)
    ends = dealt.groupBy("__slice").agg(F.min(us).alias("lo"), F.max(us).alias("hi"), F.count("*").alias("n")).orderBy("__slice").collect()
    most = max((e.n for e in ends), default=0)
    back, newest, files, stored = 0, None, max(1, -(-most // FILE_ROWS)), _files(spark, path)
    for e in ends:                                          # a row of the driver's a slice
        part = dealt.where(F.col("__slice") == e["__slice"]).drop("__slice")
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(path)
        stored += files
        for _ in range(stored - _files(spark, path)):       # a slice of very few rows: empty files fill it up
            spark.createDataFrame([], df.schema).write.mode("append").parquet(path)
        if e.lo is not None:
            back, newest = max(back, 0 if newest is None else newest - e.lo), e.hi if newest is None else max(newest, e.hi)
    if close_after:
        end = df.agg((F.max(ts) + F.expr(f"interval {close_after}")).alias(ts))
        end.select(*[F.col(c) if c == ts else F.lit(True).alias(c) if c == CLOSING else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]
                   ).write.mode("append").parquet(path)
    return Replay(path, df.schema, f"{back // 1_000_000 + 1} seconds", files, max(FEWEST_BUCKETS, -(-most // BUCKET_ROWS)))


def _files(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(at)) if fs.exists(at) else 0


def run_to_table(out: DataFrame, mode: str = "append", checkpoint: str | None = None, path: str | None = None,
                 state_partitions: int | None = None, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Drains the available input through the stream into Parquet and reads the result; ``sink`` takes the micro-batches instead.

    The checkpoint and the file sink's log make a restart continue without repeats.
    """
    spark = out.sparkSession
    path = path or scratch(spark, "stream-out")
    checkpoint = checkpoint or scratch(spark, "stream-checkpoint")
    keys = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    if state_partitions:
        keys["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        writer = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        q = writer.foreachBatch(sink).start() if sink else writer.format("parquet").start(path)
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return None if sink else spark.read.schema(out.schema).parquet(path)


def accept(folder: str, ts: str, bad: Column, lateness_s: float) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that parts rows into ``accepted`` and ``refused`` (with a reason) below ``folder``.

    Refused are rows without event time, those for which ``bad`` holds, and those more than ``lateness_s`` behind the newest row accepted
    before their batch. A batch's folders carry its number and are replaced as a whole, so a batch that comes again changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, us = batch.sparkSession, F.unix_micros(F.col(ts).cast("timestamp"))
        marks = spark.read.schema("newest bigint, batch bigint").option("recursiveFileLookup", True)
        seen = marks.parquet(f"{folder}/newest/batch={batch_id - 1}").first().newest if batch_id else None
        late = F.lit(False) if seen is None else us < seen - int(lateness_s * 1_000_000)
        reason = F.when(us.isNull(), "no event time").when(F.coalesce(bad, F.lit(True)), "bad row").when(late, "late")
        parted = batch.withColumn("reason", reason)
        parted.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{folder}/accepted/batch={batch_id}")
        parted.where("reason is not null").write.mode("overwrite").parquet(f"{folder}/refused/batch={batch_id}")
        newest = parted.agg(F.greatest(F.max(F.when(F.col("reason").isNull(), us)), F.lit(seen).cast("bigint")).alias("newest"), F.lit(batch_id).cast("bigint").alias("batch"))
        newest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/newest/batch={batch_id}")
    return write


class CurrentTable:
    """The newest row of each key, kept in buckets; a batch rewrites only the buckets it touches.

    ``<folder>/rows/v=<batch>/bucket=<b>`` holds the buckets a batch wrote, ``<folder>/pointers/v=<batch>`` which version each bucket is
    at after it. Readers follow the newest pointer, which is written last, so they see a batch as a whole or not at all; a batch that
    comes again starts from the pointer before it. A pointer has one row a bucket, so the number of buckets is chosen by the table's size.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], seq: str, buckets: int = 64):
        self.spark, self.folder, self.schema, self.keys, self.seq, self.buckets = spark, folder.rstrip("/"), schema, keys, seq, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, kind: str) -> list[int]:
        at = self._path(f"{self.folder}/{kind}")
        return sorted(int(f.getPath().getName()[2:]) for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _pointer(self, before: int | None = None) -> dict[int, int]:
        """The version of each bucket; only pointers whose writer finished count."""
        whole = [v for v in self._versions("pointers") if (before is None or v < before) and self._fs.exists(self._path(f"{self.folder}/pointers/v={v}/_SUCCESS"))]
        if not whole:
            return {}
        return {r.bucket: r.at for r in self.spark.read.schema("bucket int, at bigint").parquet(f"{self.folder}/pointers/v={whole[-1]}").collect()}

    def _rows(self, buckets: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/rows/v={v}/bucket={b}" for b, v in buckets.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self._pointer())

    def _latest(self, df: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.fieldNames() if c not in self.keys]
        return df.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(self.seq, *[c for c in rest if c != self.seq])).alias("r")).select(*self.keys, "r.*")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = self._latest(batch.select(*self.schema.fieldNames())).persist()
        touched = [r[0] for r in new.select(bucket).distinct().collect()]          # at most the number of buckets
        old = self._pointer(batch_id)
        both = self._latest(self._rows({b: v for b, v in old.items() if b in touched}).unionByName(new))
        both.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/v={batch_id}")
        now = old | {b: batch_id for b in touched}
        self.spark.createDataFrame(list(now.items()), "bucket int, at bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/pointers/v={batch_id}")
        new.unpersist()
        self._forget(batch_id, {*old.values(), *now.values()})

    def _forget(self, batch_id: int, used: set[int]) -> None:
        """Drop versions that neither this pointer nor the one before it names."""
        pointers = self._versions("pointers")[:-2]
        for kind, gone in (("pointers", pointers), ("rows", [v for v in self._versions("rows") if v < batch_id and v not in used])):
            for v in gone:
                self._fs.delete(self._path(f"{self.folder}/{kind}/v={v}"), True)
