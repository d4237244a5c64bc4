"""Document fingerprints by locally consistent parsing.

A text's bytes are cut into phrases by what stands around each place alone: runs of one symbol are joined, deterministic coin
tossing turns neighbouring symbols into labels below six, and a phrase begins at every local maximum of the labels.
Phrases are named by a hash of their content, and the names are parsed again, so that names of higher levels stand for longer
phrases. Whether a phrase begins at a place depends on a few symbols near it, so equal substrings get equal phrases,
except at their ends, wherever they lie. The fingerprint is the bottom sketch (the ``SKETCH`` smallest hashes) of the names of
levels 2 to 4, filled up with level 1 where those are too few; the likeness of two fingerprints estimates the Jaccard similarity of their name sets.

``with_next`` pairs each document with the next in descending order of id without a global sort: sampled splitters cut the ids into
ranges, a range is sorted and read as a stream, and the first document of each range is sent along with the range before it.

Defined results: a null text is the empty text, whose fingerprint is empty; two empty fingerprints have likeness 1, one has 0. Null
ids come after all others; rows with one id follow each other by their text's hash, and repeated rows in any order: those that would fill a
range are dealt into pieces. Ids that are no whole numbers are refused by name. A single document is its own next one. Extra
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from stamina.llm.sharding import UNIT, _merged, _quantiles, _range_of, dealt_repeats
from stamina.llm.textvec import chunks, mix

LEVELS = 4
SKETCH = 64
RANGE_ROWS, MAX_RANGES = 2000, 50_000
CHUNK_BYTES = 1 << 20


def _toss(width: int) -> np.ndarray:
    """Table over (left, own) symbols below ``width``: twice the lowest bit where they differ, plus the own bit there."""
    left, own = np.meshgrid(np.arange(width), np.arange(width), indexing="ij")
    x = left ^ own
    k = np.bitwise_count((x & -x) - 1).astype(np.int64) * (x > 0)
    return (2 * k + (own >> k & 1)).astype(np.uint8).ravel()


BYTES, WIDE, MIDDLE, NARROW = _toss(256), _toss(128), _toss(16), _toss(8)
BYTE_NAMES = mix(np.arange(1, 257, dtype=np.uint64))
PLACES = mix(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)


def _again(label: np.ndarray, head: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """One more toss of small labels; the first label of a text is compared with its own with bit 0 turned."""
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[head] = label[head] ^ 1
    return table[left.astype(np.uint16) * np.uint16(width) + label]


def _labels(symbol: np.ndarray, head: np.ndarray) -> np.ndarray:
    if symbol.dtype == np.uint8:
        label = _again(symbol, head, BYTES, 256)
    else:
        left = np.empty_like(symbol)
        left[1:] = symbol[:-1]
        left[head] = symbol[head] ^ np.uint64(1)
        x = symbol ^ left
        k = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        label = (k << np.uint64(1) | (symbol >> k & np.uint64(1))).astype(np.uint8)
        label = _again(label, head, WIDE, 128)
    label = _again(label, head, MIDDLE, 16)
    return _again(label, head, NARROW, 8)


def _level(symbol: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each text; ``head`` is where texts begin, before and after."""
    starts = np.empty(len(symbol), bool)
    np.not_equal(symbol[1:], symbol[:-1], out=starts[1:])
    starts[head] = True
    if starts.all():
        length = None
    else:
        run = np.flatnonzero(starts)
        length = np.diff(run, append=len(symbol))
        symbol, head = symbol[run], np.searchsorted(run, head)
    label = _labels(symbol, head)
    cut = np.zeros(len(symbol), bool)
    np.logical_and(label[1:-1] > label[:-2], label[1:-1] > label[2:], out=cut[1:-1])
    cut[head[1:] - 1] = False                            # not the last symbol of a text
    cut[head] = True
    first = np.flatnonzero(cut)
    place = np.arange(len(symbol), dtype=np.int32)
    place -= np.repeat(first.astype(np.int32), np.diff(first, append=len(symbol)))
    name = BYTE_NAMES[symbol] if symbol.dtype == np.uint8 else symbol
    if length is not None:
        long = np.flatnonzero(length > 1)
        name = name.copy()
        name[long] = mix(name[long] + length[long].astype(np.uint64))
    return mix(np.add.reduceat(name * PLACES[place & 63], first)), np.searchsorted(first, head)


def sketches(raw: list[bytes]) -> list[np.ndarray]:
    """Sorted bottom sketch of each text's phrase names; names of level 1 are above all others, and so count only where those are too few."""
    size = np.array([len(r) for r in raw], np.int64)
    some = np.flatnonzero(size)
    out = [np.zeros(0, np.uint64)] * len(raw)
    if not len(some):
        return out
    symbol = np.frombuffer(b"".join(raw), np.uint8)
    head = np.cumsum(size[some]) - size[some]
    keys = []
    for level in range(1, LEVELS + 1):
        symbol, head = _level(symbol, head)
        low = mix(symbol + np.uint64(level)) >> np.uint64(33)
        of = np.repeat(np.arange(len(some), dtype=np.uint64), np.diff(head, append=len(symbol)))
        keys.append(of << np.uint64(32) | low)
    key = np.unique(np.concatenate(keys[1:]))
    few = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(some)) < SKETCH
    if few.any():
        fill = keys[0][few[(keys[0] >> np.uint64(32)).astype(np.int64)]] | np.uint64(1 << 31)
        key = np.unique(np.concatenate([key, fill]))
    edge = np.searchsorted(key, np.arange(len(some) + 1, dtype=np.uint64) << np.uint64(32))
    low = key & np.uint64(0xFFFFFFFF)
    for i, a, b in zip(some, edge[:-1], edge[1:]):
        out[i] = low[a:min(b, a + SKETCH)]
    return out


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest hashes of both that are in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.sort(np.concatenate([a, b]))
    twice = union[1:] == union[:-1]
    keep = np.concatenate([[True], ~twice])
    both = np.concatenate([twice, [False]])[keep][:SKETCH]
    return float(both.sum() / len(both))


@pandas_udf(T.StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    """The fingerprint of a text as hex digits."""
    out = []
    for raw in chunks(list(text), CHUNK_BYTES):
        out += [to_text(s) for s in sketches(raw)]
    return pd.Series(out, dtype=object)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 53) -> DataFrame:
    """(range, extra, k, t, id, text) such that, sorted by the first four, each document is followed by its next one.

    ``extra`` rows close a range and are no documents of it.
    """
    kind = docs.schema[doc_id].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise ValueError(f"column {doc_id} is ordered by number; it holds {kind.simpleString()}")
    rows = docs.select(F.coalesce(F.bitwise_not(F.col(doc_id).cast("long")), F.lit((1 << 63) - 1)).alias("k"), F.xxhash64(text).alias("t"),
                       F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # repeated rows (and null ids of one text) that fill a range are dealt into pieces
    rows = dealt_repeats(rows, "k", "t", F.lit(UNIT // RANGE_ROWS).cast("long"), "next")
    total = rows.count()
    parts = min(MAX_RANGES, -(-total // RANGE_ROWS))
    share = min(1.0, parts * 32 / max(1, total))
    picked = rows.where(F.pmod(F.xxhash64("k", "t", F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40))).select("k", "t").collect()
    sample = np.sort(np.array([(r[0], r[1], 1) for r in picked], dtype=[("k", "i8"), ("t", "i8"), ("w", "i8")]), order=["k", "t"])
    number = _range_of(_merged(_quantiles(sample, parts)))
    rows = rows.withColumn("range", number("k", "t"))
    # one row a range: at most MAX_RANGES, from two numbers of each document
    firsts = sorted((r["range"], *r["first"]) for r in rows.groupBy("range").agg(F.min(F.struct("k", "t")).alias("first")).collect())
    closing = [(firsts[i - 1][0], k, t) for i, (_, k, t) in enumerate(firsts)]
    spark = docs.sparkSession
    ends = F.broadcast(spark.createDataFrame(closing, "to int, ck long, ct long"))
    rows = rows.join(ends, (F.col("k") == F.col("ck")) & (F.col("t") == F.col("ct")), "left")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("extra"))
    also = F.when(F.col("to").isNotNull(), F.array(own, F.struct(F.col("to").alias("range"), F.lit(True).alias("extra")))).otherwise(F.array(own))
    rows = rows.select(F.explode(also).alias("x"), "k", "t", "id", "text").select("x.range", "x.extra", "k", "t", "id", "text")
    return rows.repartition("range").sortWithinPartitions("range", "extra", "k", "t")


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_chars, fingerprint, and of the text whose last half is replaced from the next document:
    edited_sha256, edited_fingerprint; near_edited and near_next are likenesses to that text and to the next document."""
    rows = with_next(docs, doc_id, text)
    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string(
        "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").fields])

    def judge(ids: list, texts: list[str], after: list[str]) -> pa.RecordBatch:
        half = [len(t) // 2 for t in texts]
        edited = [(t[:len(t) - h] + n[:h]).encode() for t, h, n in zip(texts, half, after)]
        own = sketches([t.encode() for t in texts])
        last = sketches([after[-1].encode()])
        changed = sketches(edited)
        follow = [*own[1:], last[0]]
        for i in range(len(texts) - 1):
            if after[i] is not texts[i + 1]:             # a range ended here
                follow[i] = sketches([after[i].encode()])[0]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, type=arrow_id), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            pa.array([to_text(s) for s in own]), pa.array([to_text(s) for s in changed]),
            pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, follow)], pa.float64())], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type
    arrow_id = to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, after, size, waiting = [], [], [], 0, None
        for batch in batches:
            for where, extra, key, value in zip(*(batch.column(c).to_pylist() for c in (0, 1, 4, 5))):
                if waiting is not None and waiting[0] == where:
                    ids.append(waiting[1])
                    texts.append(waiting[2])
                    after.append(value)
                    size += len(waiting[2]) + 1
                    waiting = None
                if not extra:
                    waiting = (where, key, value)
                if size >= CHUNK_BYTES or len(ids) >= 20_000:
                    yield judge(ids, texts, after)
                    ids, texts, after, size = [], [], [], 0
        if ids:
            yield judge(ids, texts, after)

    return rows.mapInArrow(run, schema)
