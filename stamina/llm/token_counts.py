"""Token counts as delta-maintained rollups.

A batch brings changes of documents: inserted, deleted, or revised with another count. Against what the ledger has of those documents,
the changes become signed deltas, summed by source, language and tokenizer version; totals are the sums of all committed deltas.
A commit is one small file, named by its number alone, that appears whole (it is moved into place) after the attempt's ledger and delta
folders are; it names the batch and the attempt. Of two committers that saw the same state one gets the number; the other finds the
place taken, and takes its deltas again from the new ledger. A batch that is already committed is not applied again. Every attempt
writes to folders of its own, so lost jobs can be repeated. Every ``COMPACT_EVERY`` commits the ledger and the totals are written
anew as one base, so that reading does not grow with the number of batches.

Sums are partial before they are shuffled, so a source with a third of all rows is a few rows a task. The ledger is read for
the batch's documents only by a join on their ids; nothing but markers comes to the driver.

Defined results: several changes of one document and version in a batch count as the last: by ``seq``, then inserts before revisions before
deletes, then by count, source and language (nulls first). Inserting a document that is there revises it; deleting one that is not there
changes nothing; a null count is 0; null sources and languages are groups of their own. Changes without a document id are in no total;
``refused`` returns them. Empty batches commit nothing but their marker. Groups without documents are not in the totals. Extra
columns are ignored; one that is named as the count to be added gives way.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stamina.llm.common import discard, staged

#: Fixed value: the split pattern that belongs to the byte-level vocabulary.
BYTE_BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEDGER = "doc_id long, tokenizer string, source string, lang string, tokens long, alive boolean"
COMPACT_EVERY = 16
CHANGES = "doc_id long, tokenizer string, op string, source string, lang string, tokens long, seq long"
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", to: str = "tokens", pattern: str = BYTE_BPE_PATTERN) -> DataFrame:
    """``docs`` without the text and with its number of tokens; ``vocabulary``: a file of base64 tokens and ranks, read by the driver
    (its size is the vocabulary's, whatever the data) and sent to the tasks."""
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    kept = [c for c in docs.columns if c not in (text, to)]
    docs = docs.select(*kept, text)
    schema = T.StructType([*docs.select(kept).schema.fields, T.StructField(to, T.LongType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        coder = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        for batch in batches:
            n = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != at), pa.array(n, pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)


class Rollup:
    """Totals kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _log(self, kind: str = "commits") -> list[tuple[int, str, str]]:
        """(number, batch, attempt) of what is committed, in order."""
        at = self._path(f"{self.folder}/{kind}")
        if not self._fs.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(at))
        out = []
        for name in (n for n in names if n.isdigit()):
            stream = self._fs.open(self._path(f"{self.folder}/{kind}/{name}"))
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            out.append((int(name), *text.split("\n")))
        return out

    def committed(self) -> list[str]:
        """Ids of the committed batches, in the order of their commits."""
        return [batch for _, batch, _ in self._log()]

    def _claim(self, kind: str, number: int, batch: str, attempt: str) -> bool:
        """Move a whole file to the place of ``number``; False if that is taken."""
        self._fs.mkdirs(self._path(f"{self.folder}/{kind}"))
        made, place = (self._path(f"{self.folder}/{kind}/{n}") for n in (f".{attempt}", f"{number:09d}"))
        stream = self._fs.create(made, True)
        stream.write(f"{batch}\n{attempt}".encode())
        stream.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._fs.makeQualified(made), self._fs.makeQualified(place), options)
            return True
        except Py4JJavaError as e:
            self._fs.delete(made, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise

    def _read(self, kind: str, schema: str, log: list[tuple[int, str, str]]) -> DataFrame:
        """The newest base that ``log`` covers, and the batches after it; ``batch`` orders them."""
        bases = [b for b in self._log("bases") if b[0] <= len(log)]
        start, paths = (bases[-1][0], [(-1, f"base/{bases[-1][2]}/{kind}")]) if bases else (0, [])
        out = self.spark.createDataFrame([], f"{schema}, batch int")
        for order, path in paths + [(n, f"attempts/{attempt}/{kind}") for n, _, attempt in log[start:]]:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.folder}/{path}").withColumn("batch", F.lit(order)))
        return out

    def _ledger(self, log: list[tuple[int, str, str]]) -> DataFrame:
        keys = ["doc_id", "tokenizer"]
        last = self._read("ledger", LEDGER, log).groupBy(*keys).agg(F.max_by(F.struct("source", "lang", "tokens", "alive"), "batch").alias("e"))
        return last.select(*keys, "e.*")

    def ledger(self) -> DataFrame:
        """The last entry of each document and version."""
        return self._ledger(self._log())

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes (doc_id, tokenizer, op: insert, revise or delete, source, lang, tokens, seq) as batch ``batch``. False: it was there already."""
        if "/" in batch or "\n" in batch:
            raise ValueError("a batch id is one line without /")
        if batch in self.committed():
            return False
        held = staged(changes.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in CHANGES.split(", ")]), "changes")
        tokens = F.coalesce("tokens", F.lit(0)).alias("tokens")
        rank = F.when(F.col("op") == "delete", 2).when(F.col("op") == "revise", 1).otherwise(0)
        last = (held.where("doc_id is not null").groupBy("doc_id", "tokenizer").agg(F.max_by(
            F.struct("op", "source", "lang", tokens), F.struct("seq", rank, tokens, "source", "lang")).alias("new")))
        done, log = False, self._log()
        while not done and all(b != batch for _, b, _ in log):
            attempt = f"{batch}-{uuid.uuid4().hex[:12]}"
            self._write(attempt, last, log)
            held.where("doc_id is null").write.parquet(f"{self.folder}/attempts/{attempt}/refused")
            done = self._claim("commits", len(log), batch, attempt)
            if not done:                                    # another batch came first: again, from its ledger
                self._fs.delete(self._path(f"{self.folder}/attempts/{attempt}"), True)
                log = self._log()
            elif (len(log) + 1) % COMPACT_EVERY == 0:
                self.compact()
        discard(held)
        return done

    def _write(self, attempt: str, last: DataFrame, log: list[tuple[int, str, str]]) -> None:
        """Ledger entries and signed deltas of an attempt, against the state after ``log``."""
        keys, folder = ["doc_id", "tokenizer"], f"{self.folder}/attempts/{attempt}"
        if log:
            old = self._ledger(log).where("alive").select(F.col("doc_id").alias("d"), F.col("tokenizer").alias("z"), F.struct("source", "lang", "tokens").alias("old"))
            last = last.join(old, (F.col("doc_id") == F.col("d")) & F.col("tokenizer").eqNullSafe(F.col("z")), "left").drop("d", "z")
        else:
            last = last.withColumn("old", F.lit(None).cast("struct<source:string,lang:string,tokens:long>"))
        gone = F.col("new.op") == "delete"
        entry = last.where(~gone | F.col("old").isNotNull()).select(
            *keys, F.when(gone, F.col("old.source")).otherwise(F.col("new.source")).alias("source"),
            F.when(gone, F.col("old.lang")).otherwise(F.col("new.lang")).alias("lang"),
            F.when(gone, F.lit(0)).otherwise(F.col("new.tokens")).cast("long").alias("tokens"), (~gone).alias("alive"), "old")
        entry.write.parquet(f"{folder}/signed")
        entry = self.spark.read.schema(entry.schema).parquet(f"{folder}/signed")
        entry.drop("old").write.parquet(f"{folder}/ledger")
        signed = entry.where("alive").select("source", "lang", "tokenizer", F.lit(1).alias("docs"), "tokens").unionByName(
            entry.where("old is not null").select("old.source", "old.lang", "tokenizer", F.lit(-1).alias("docs"), (-F.col("old.tokens")).alias("tokens")))
        deltas = signed.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        deltas.write.parquet(f"{folder}/deltas")
        self._fs.delete(self._path(f"{folder}/signed"), True)

    def compact(self) -> None:
        """Write the ledger and the totals as they are now as one base; who finds the place taken leaves it."""
        log = self._log()
        attempt = uuid.uuid4().hex[:12]
        self._ledger(log).where("alive").write.parquet(f"{self.folder}/base/{attempt}/ledger")
        self._totals(log).write.parquet(f"{self.folder}/base/{attempt}/deltas")
        self._claim("bases", len(log), "base", attempt)

    def _totals(self, log: list[tuple[int, str, str]]) -> DataFrame:
        rows = self._read("deltas", DELTAS, log)
        return rows.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        return self._totals(self._log())

    def refused(self) -> DataFrame:
        """Changes of committed batches that have no document id."""
        out = self.spark.createDataFrame([], f"{CHANGES}, batch string")
        for _, batch, attempt in self._log():
            out = out.unionByName(self.spark.read.schema(CHANGES).parquet(f"{self.folder}/attempts/{attempt}/refused").withColumn("batch", F.lit(batch)))
        return out
