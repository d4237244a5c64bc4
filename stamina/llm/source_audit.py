"""How far the sources of each language diverge, and by which terms.

A term is a run of letters (and characters outside ASCII) with A-Z lower-cased; a language keeps those in at least ``min_docs`` of its documents.
A count c of a group with N kept words among V kept terms stands for the share p = 1 + floor(SCALE * (c + 2) / (N + 2 V)); two shares diverge by
floor((p - q)^2 / (p + q)). Part ``pair`` sums that over all kept terms for each two sources of a language; part ``term`` has the terms by
which a source leads its language most.

- Counting: each task folds its texts into counts by (language, source, term), given on whenever a stated number of them is held; so a
  frequent word or a source with a third of all rows is a few rows a task. Sums follow by the full key, then by (language, term).
- Pairs: terms are dealt into buckets by hash; a bucket holds a small dense matrix of shares, sources by terms, and sums each two sources.
- Terms: the divergence grows with the group's count and falls with the language's, and ties go to the earlier term, so a term that ``top``
  others beat or equal in all three (a higher or equal group count, a lower or equal count in the language, an earlier spelling) can't be
  among the first ``top``. Parts of a group keep the terms with fewer such others (their skyband), parts are merged 16 to 1 and thinned
  again, and the rest is ranked by the exact value.

All numbers are whole; products beyond 64 bits are taken as Python numbers. The table of groups has a row for each (language, source), far
fewer than the pairs that are the result; it is broadcast up to a counted number of rows.

Defined results: a null text, language or source counts as empty; every row is a document, repeated ones too; ids are not looked at and other
columns ignored. Groups without kept terms have their pairs (value 0 where the language keeps none) and no terms; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stamina.llm.common import staged

SCALE = 1_000_000_000
HELD_TERMS = 300_000
SLICE_BYTES = 1 << 20
BUCKET_ROWS = 100_000
PART_ROWS = 20_000
FAN_IN = 16
MATRIX_CELLS = 1 << 20
BROADCAST_GROUPS = 100_000
RESULT = "lang string, source string, part string, item string, value long, rank int"
#: Bytes of letters (A-Z as a-z) and of characters outside ASCII as they are, all others as spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _slices(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a megabyte at a time."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, in parts still to be summed; an empty term stands for the group itself."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (lang_, source_), (n, docs_) in held.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang_), len(terms) + 1), pa.repeat(pa.scalar(source_), len(terms) + 1), pa.array([b"", *terms], pa.binary()),
                     pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs_.__getitem__, terms)], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                n, docs_ = held.setdefault(key, (Counter(), Counter()))
                size -= len(n)
                seen: set[bytes] = set()
                for terms in _slices((batch.column(2)[k].as_py() or b"").translate(_LETTERS)):
                    n.update(terms)
                    seen.update(terms)
                docs_.update(seen)
                size += len(n)
                if size >= HELD_TERMS:
                    yield from given()
                    size = 0
        yield from given()

    return rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def share(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / whole), exactly."""
    count = np.asarray(count, np.int64) + 2
    if len(count) and int(count.max()) > np.iinfo(np.int64).max // SCALE:
        return np.array([1 + SCALE * int(c) // int(w) for c, w in zip(count, np.broadcast_to(whole, count.shape))], np.int64)
    return 1 + SCALE * count // whole


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def skyband(n: np.ndarray, total: np.ndarray, spelling: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows that fewer than ``k`` others dominate: no smaller ``n``, no larger ``total``, smaller ``spelling`` (its values differ)."""
    order = np.lexsort((spelling, total, -n))
    n, total, spelling = n[order], total[order], spelling[order]
    new = np.r_[True, (n[1:] != n[:-1]) | (total[1:] != total[:-1])] if len(n) else np.zeros(0, bool)
    place = np.arange(len(n)) - np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))
    order, total, spelling = (a[place < k] for a in (order, total, spelling))       # of equal counts the first k spellings
    kept = np.zeros(0, np.int64)
    for at in range(0, len(order), 256):
        t, s = total[at:at + 256], spelling[at:at + 256]
        before = (total[kept][:, None] <= t) & (spelling[kept][:, None] < s)
        inside = np.triu((t[:, None] <= t) & (s[:, None] < s), 1)                    # sorted by falling n, so n is no smaller before
        kept = np.r_[kept, at + np.flatnonzero(before.sum(0) + inside.sum(0) < k)]
    return order[kept]


def _pair_sums(kept: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums of divergence over the terms of a bucket for each two sources of its language; bucket 0 names all pairs even without terms."""
    groups = groups.sort_values("at")
    none = pd.DataFrame({"lang": pd.Series([], dtype=str), "a": np.zeros(0, np.int32), "b": np.zeros(0, np.int32), "value": np.zeros(0, np.int64)})
    if len(groups) < 2 or (not len(kept) and groups["bucket"].iat[0]):
        return none
    whole, s = groups["whole"].to_numpy(), len(groups)
    sums = np.zeros((s, s), np.int64)
    code, terms = pd.factorize(kept["term"])
    row, n = kept["at"].to_numpy(), kept["n"].to_numpy()
    step = max(1, MATRIX_CELLS // s)
    order = np.argsort(code, kind="stable")
    bounds = np.searchsorted(code[order], np.arange(0, len(terms) + step, step))
    for k in range(len(bounds) - 1):
        own = order[bounds[k]:bounds[k + 1]]
        if not len(own):
            continue
        width = min(step, len(terms) - k * step)
        p = np.repeat(share(np.zeros(s, np.int64), whole)[:, None], width, axis=1)
        p[row[own], code[own] - k * step] = share(n[own], whole[row[own]])
        for i in range(s - 1):
            sums[i, i + 1:] += divergence(p[i + 1:], p[i]).sum(axis=1)
    a, b = np.triu_indices(s, 1)
    return pd.DataFrame({"lang": groups["lang"].iat[0], "a": a.astype(np.int32), "b": b.astype(np.int32), "value": sums[a, b]})


def _leaders(rows: pd.DataFrame, top: int) -> pd.DataFrame:
    """The skyband of a part of a group, among terms whose share is above the language's."""
    p, q = share(rows["n"], rows["whole"].to_numpy()), share(rows["lang_n"], rows["lang_whole"].to_numpy())
    rows = rows.assign(value=divergence(p, q))[p > q]
    spelling = np.empty(len(rows), np.int64)
    spelling[np.argsort(rows["term"].to_numpy(), kind="stable")] = np.arange(len(rows))
    return rows.iloc[np.sort(skyband(rows["n"].to_numpy(), rows["lang_n"].to_numpy(), spelling, top))]


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """Columns of ``RESULT``: part ``pair`` ranks the other sources of a language by divergence, part ``term`` the leading terms of a source."""
    by_term = Window.partitionBy("lang", "term")
    counted = count_terms(docs, text, lang, source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = staged(counted.select("lang", "source", "term", "n", F.sum("n").over(by_term).alias("lang_n"), F.sum("docs").over(by_term).alias("lang_docs"),
                                 (F.min("source").over(by_term) == F.col("source")).alias("first"))
                  .where((F.col("lang_docs") >= min_docs) | (F.octet_length("term") == 0)).drop("lang_docs"), "audit-terms")
    real = F.octet_length("term") > 0
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count_if(real).alias("terms"), F.count_if(F.col("first") & real).alias("own"))
    whole_lang = Window.partitionBy("lang")
    v, words = F.sum("own").over(whole_lang), F.sum("words").over(whole_lang)
    groups = staged(per_group.select("lang", "source", "terms", (F.col("words") + 2 * v).alias("whole"), (words + 2 * v).alias("lang_whole"),
                                     (F.row_number().over(whole_lang.orderBy("source")) - 1).alias("at")), "audit-groups")
    n_groups, rows, largest = groups.agg(F.count("*"), F.coalesce(F.sum("terms"), F.lit(0)), F.coalesce(F.max("terms"), F.lit(0))).first()
    small = F.broadcast(groups) if n_groups <= BROADCAST_GROUPS else groups
    terms = kept.where(real).drop("first").join(small, ["lang", "source"])

    buckets = max(1, -(-rows // BUCKET_ROWS))
    dealt = terms.select("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "at", "term", "n")
    everywhere = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))), "at", "whole").toDF("lang", "bucket", "at", "whole")
    sums = (dealt.groupBy("lang", "bucket").cogroup(everywhere.groupBy("lang", "bucket"))
            .applyInPandas(_pair_sums, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("other")),
                                                 F.struct(F.col("b").alias("at"), F.col("a").alias("other")))).alias("p"), "value").select("lang", "p.*", "value")
    names = small.select("lang", F.col("at").alias("other"), F.col("source").alias("item"))
    pairs = both.join(small.select("lang", "at", "source"), ["lang", "at"]).join(names, ["lang", "other"]).withColumn("part", F.lit("pair"))

    parts, columns = max(1, -(-largest // PART_ROWS)), "lang string, source string, term binary, n long, lang_n long, whole long, lang_whole long, parts int, value long"
    left = terms.select("lang", "source", "term", "n", "lang_n", "whole", "lang_whole", F.ceil(F.col("terms") / PART_ROWS).cast("int").alias("parts"), F.lit(0).cast("long").alias("value"))
    while True:
        left = left.groupBy("lang", "source", F.pmod(F.xxhash64("term"), "parts")).applyInPandas(lambda rows: _leaders(rows, top), columns)
        if parts == 1:
            break
        parts, left = -(-parts // FAN_IN), left.withColumn("parts", F.ceil(F.col("parts") / FAN_IN).cast("int"))
    leaders = left.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")

    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    of_pairs = pairs.select("lang", "source", "part", "item", "value", ranked)
    return of_pairs.unionByName(leaders.select("lang", "source", "part", "item", "value", ranked).where(F.col("rank") <= top))
