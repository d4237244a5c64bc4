"""Sharding by sampled splitters: range-partition records so that the shards' bytes are nearly equal.

Records are ordered by (key, tie): by default a hash of the text, then the id, so that equal texts lie together. A size-weighted sample
of that order gives the quantile boundaries of many more ranges than shards; the true bytes of each range are then summed,
and ranges that came out overfull are cut again by a sample of their own. Whole ranges, in order, fill the shards, and a
record's slot counts the records before it in its shard, by sums over ranges and a sort within each range.

A range is overfull by bytes or by rows: a record loads it by its share of both, and a range of several keys holds at most two of the
loads that fill one. So there are 64 ranges a shard and one more for each ``MAX_RANGE_ROWS`` rows, and the driver sees ``SAMPLE_PER_RANGE``
records and one row of each. Copies of one text stay in one shard unless they alone overfill four ranges; then they are cut by the tie.
Rows with equal key and tie (repeated rows, or null ids of one text) that overfill a range are dealt at random into pieces,
which are written once, and a piece is cut off like any other tie.

Defined results: a null text has no bytes; every record weighs 8 bytes more than its text. Null ties come first. Repeated rows lie
next to each other. An empty table gives an empty result; with fewer ranges than shards some shards stay empty. Ties count by their
upper 48 bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from stamina.llm.common import staged

RANGES_PER_SHARD = 64
SAMPLE_PER_RANGE = 16
MAX_RANGE_ROWS = 500_000
OVERFULL = 2.0
WHOLE_KEY = RANGES_PER_SHARD / 16          # a sixteenth of a shard
PIECE = 0.5
UNIT = 1 << 30                               # loads are whole numbers of these parts of a range, so that sums are exact
MAX_BROADCAST_ROWS = 100_000
PIECE_BITS = 16
RECORD_BYTES = 8


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def _range_of(splits: np.ndarray):
    """Number of splitters that are not above (key, tie)."""
    @pandas_udf(T.IntegerType())
    def number(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(np.int64), tie.to_numpy(np.int64)
        low, high = np.searchsorted(splits["k"], k, "left"), np.searchsorted(splits["k"], k, "right")
        tied = np.flatnonzero(low < high)                 # keys of splitters: their ties decide, one search a key
        of = low[tied]
        for first in np.unique(of):
            own = tied[of == first]
            low[own] += np.searchsorted(splits["t"][first:high[own[0]]], t[own], "right")
        return pd.Series(low.astype(np.int32))
    return number


def _sample(rows: DataFrame, load: Column, weight: float, seed: int) -> np.ndarray:
    """(k, t, w): records picked with probability load / weight, at most about total / weight of them; larger ones count as several."""
    unit = F.pmod(F.xxhash64("k", "t", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    hits = F.floor(load / float(UNIT) / weight + unit).cast("long")
    got = rows.select("k", "t", hits.alias("w")).where("w > 0").collect()
    out = np.array([tuple(r) for r in got], dtype=[("k", "i8"), ("t", "i8"), ("w", "i8")])
    return np.sort(out, order=["k", "t"])


LOWEST = -(1 << 63)


def _quantiles(sample: np.ndarray, parts: int) -> np.ndarray:
    """Up to ``parts`` - 1 sampled (k, t) at equal steps of the sampled weight."""
    if not len(sample) or parts < 2:
        return sample[:0]
    at = np.cumsum(sample["w"])
    picks = np.searchsorted(at, at[-1] * np.arange(1, parts) / parts, "left")
    return sample[np.minimum(picks, len(sample) - 1)]


def _at_keys(picks: np.ndarray, after: bool = False) -> np.ndarray:
    """Splitters where the picked keys begin, and where the next keys do if asked for."""
    out = picks.copy()
    out["t"] = LOWEST
    if after:
        beyond = out[out["k"] < (1 << 63) - 1].copy()
        beyond["k"] += 1
        out = np.concatenate([out, beyond])
    return out


def _merged(*splits: np.ndarray) -> np.ndarray:
    every = np.sort(np.concatenate(splits), order=["k", "t"])
    if not len(every):
        return every
    return every[np.concatenate([[True], (every["k"][1:] != every["k"][:-1]) | (every["t"][1:] != every["t"][:-1])])]


def loads(rows: DataFrame, size: str, shards: int) -> tuple[Callable[[str], Column], float]:
    """(what a record adds to its range by its size, by bytes and by rows, in ``UNIT`` parts of a range; the sum of that, in ranges)."""
    facts = rows.agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    ranges = shards * RANGES_PER_SHARD
    scale, each = UNIT * ranges / max(1, facts["bytes"] or 1), UNIT / MAX_RANGE_ROWS
    return lambda column: F.ceil(F.col(column) * scale + each).cast("long"), ranges + facts["rows"] / MAX_RANGE_ROWS if facts["rows"] else 0.0


def split_points(rows: DataFrame, load: Column, total: float, seed: int = 29) -> np.ndarray:
    """Splitters of ``rows`` (k, t, size): where keys begin, and inside a key only if that key alone overfills ranges."""
    none = np.zeros(0, dtype=[("k", "i8"), ("t", "i8"), ("w", "i8")])
    if not total:
        return none
    parts = int(np.ceil(total))
    splits = _merged(_at_keys(_quantiles(_sample(rows, load, 1 / SAMPLE_PER_RANGE, seed), parts)))
    cut = 0
    while True:
        number = _range_of(splits)
        sizes = rows.groupBy(number("k", "t").alias("r")).agg(
            F.sum(load).alias("load"), F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("t").alias("t0"), F.max("t").alias("t1"))
        many, one = F.col("load") > int(OVERFULL * UNIT), F.col("load") > int(WHOLE_KEY * UNIT)
        over = {r["r"]: r for r in sizes.where((F.col("k0") < F.col("k1")) & many | (F.col("k0") == F.col("k1")) & (F.col("t0") < F.col("t1")) & one).collect()}
        if not over:
            return splits
        inner = rows.where(number("k", "t").isin(list(over)))
        # the pieces of an overfull range come from a sample of these ranges alone, finer every time
        sample = _sample(inner, load, 1 / SAMPLE_PER_RANGE / (4 << cut), seed + 1 + cut)
        where = number.func(pd.Series(sample["k"]), pd.Series(sample["t"])).to_numpy()
        more = [none]
        for r, of in over.items():
            picks = _quantiles(sample[where == r], -(-2 * of["load"] // UNIT))
            more.append(_at_keys(picks, after=True) if of["k0"] < of["k1"] else picks)
        grown = _merged(splits, *more)
        if len(grown) == len(splits) and cut > 12:        # the sample has every record by then
            return splits
        splits, cut = grown, cut + 1


def dealt_repeats(rows: DataFrame, k: str, t: str, load: Column, label: str) -> DataFrame:
    """``rows`` with the low bits of ``t`` cleared, or, for equal (k, t) that load more than a range, with a number of a piece there.

    Equal rows are counted after partial sums; those of heavy ones are written with their piece, as a row's piece must stay what it is.
    """
    rows = rows.withColumn(t, F.col(t).bitwiseAND(F.lit(-1 << PIECE_BITS)))
    heavy = rows.groupBy(k, t).agg(F.sum(load).alias("__load")).where(F.col("__load") > UNIT)
    heavy = staged(heavy.select(F.col(k).alias("__hk"), F.col(t).alias("__ht"), F.least(F.ceil(F.col("__load") / (UNIT * PIECE)), F.lit((1 << PIECE_BITS) - 1)).alias("__pieces")),
                   f"{label}-heavy")
    n = heavy.count()
    if not n:
        return rows
    small = F.broadcast(heavy) if n <= MAX_BROADCAST_ROWS else heavy
    same = (F.col(k) == F.col("__hk")) & (F.col(t) == F.col("__ht"))
    pieces = rows.join(small, same, "inner").withColumn(t, F.col(t) + F.floor(F.rand(7) * F.col("__pieces"))).select(rows.columns)
    return rows.join(small, same, "left_anti").unionByName(staged(pieces, f"{label}-pieces"))


def assign(docs: DataFrame, shards: int, key: Column, tie: Column, size: Column) -> DataFrame:
    """``docs`` with __size, __shard and __slot (gapless from 0 in each shard, in order of key and tie)."""
    rows = docs.withColumn("__k", key.cast("long")).withColumn("__t", F.coalesce(tie.cast("long"), F.lit(-(1 << 63)))).withColumn("__size", size)
    load, total = loads(rows, "__size", shards)
    rows = dealt_repeats(rows, "__k", "__t", load("__size"), "shard")
    slim = staged(rows.select(F.col("__k").alias("k"), F.col("__t").alias("t"), F.col("__size").alias("size")), "shard-keys")
    number = _range_of(split_points(slim, load("size"), total))
    ranges = slim.groupBy(number("k", "t").alias("range")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("bytes").over(ahead), F.lit(0))
    middle = (before + F.col("bytes") / 2) / F.sum("bytes").over(Window.partitionBy(F.lit(0)))
    ranges = ranges.withColumn("__shard", F.least(F.floor(middle * shards), F.lit(shards - 1)).cast("int"))
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("rows").over(ahead.partitionBy("__shard")), F.lit(0)))
    table = staged(ranges.select(F.col("range").alias("__r"), "__shard", "__before"), "shard-ranges")
    rows = rows.withColumn("__range", number("__k", "__t"))
    placed = rows.join(F.broadcast(table), F.col("__range") == F.col("__r"))       # one row a range, as many as the splitters
    nth = F.row_number().over(Window.partitionBy("__range").orderBy("__k", "__t", "__size")) - 1
    return placed.withColumn("__slot", (F.col("__before") + nth).cast("long")).select(*docs.columns, "__size", "__shard", "__slot")


def shard(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Records by text digest and id: adds __size, __shard, __slot."""
    return assign(docs, shards, F.xxhash64(text), F.xxhash64(doc_id), record_size(F.col(text)))


def write_shards(docs: DataFrame, path: str, shards: int, **kw) -> None:
    """One folder per shard, rows in slot order, written by a task per shard."""
    placed = shard(docs, shards, **kw)
    (placed.repartition(shards, "__shard").sortWithinPartitions("__shard", "__slot").drop("__size", "__slot")
     .withColumnRenamed("__shard", "shard").write.partitionBy("shard").parquet(path))
