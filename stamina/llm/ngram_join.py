"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles; two texts are linked when their sets' Jaccard similarity is at least 0.8. Texts with
the same set are one node from the start, so copies never meet each other. Nodes that agree on a band of MinHash values
meet in a bucket; there their signatures are compared a few values at a time, and a pair is dropped as soon as the
posterior probability (uniform prior) that its similarity reaches the threshold is below ``tolerance``. The pairs that
are left join their nodes into groups, and within a group every pair is verified on the exact sets.

Nothing is emitted per pair: a bucket gives the edges of a spanning forest, verification gives link counts and a forest. Buckets
and groups above ``tile`` nodes are dealt out as pairs of tiles, each a task's work of bounded size; two nodes meet in
exactly one pair of tiles. A pair at the threshold misses every band with probability (1 - 0.8^4)^24 < 4e-6.

Defined results: a null or empty text, or one without words, has the empty set; such texts are copies of each other and linked
to nothing else. A text of one to four words has one shingle of them all. Repeated rows are copies. ``class_id`` is
the smallest id of the class that is not null (null if all are). Empty tables give empty results. Columns other than
the id and the text are ignored by ``join`` and pass through ``keep_first`` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stamina.llm import textvec
from stamina.llm.common import staged, text_key
from stamina.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS, STEP = 24, 4, 16
TOLERANCE = 1e-6
TILE = 512
MAX_BROADCAST_ROWS = 1_000_000
SEED = 41


def fewest_matches(threshold: float, tolerance: float, values: int, step: int) -> dict[int, int]:
    """After so many compared values: the fewest matches whose posterior P(similarity >= threshold) is at least ``tolerance``.

    With a uniform prior the posterior of m matches in n is Beta(m + 1, n - m + 1); its upper tail is a binomial sum.
    """
    def tail(m: int, n: int) -> float:
        return sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
    return {n: next(m for m in range(n + 1) if m == n or tail(m, n) >= tolerance) for n in range(step, values + 1, step)}


def _sign(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, t1, t2 (text digests), d1, d2 (set digests), n (shingles), sig (MinHash values)."""
    k1, k2 = text_key(F.col(text))
    rows = docs.select(F.col(doc_id).alias("id"), k1.alias("t1"), k2.alias("t2"), F.col(text).alias("text"))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
                           T.StructField("n", T.IntegerType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for raw in textvec.chunks(textvec.texts_of(batch.column(3))):
                values, count = textvec.shingle_sets(raw, SHINGLE)
                d1, d2 = textvec.digests(values, count)
                sig = textvec.minhash(values, count, BANDS * BAND_ROWS, SEED)
                part = batch.slice(at, len(raw))
                at += len(raw)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(d1), pa.array(d2), pa.array(count.astype(np.int32)),
                     pa.array([s.tobytes() for s in sig], pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _tiled(rows: DataFrame, group: list[str], size: str, node: str, tile: int) -> DataFrame:
    """Adds own, ta, tb: each row once for every pair of tiles of its group that its own tile is part of."""
    many = F.ceil(F.col(size) / tile).cast("int")
    own = F.pmod(F.xxhash64(node, F.lit(5)), many).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
    return rows.withColumn("ta", F.least("own", "other")).withColumn("tb", F.greatest("own", "other")).drop("other")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first columns, passed on in tables that never cut a group."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        last = np.ones(table.num_rows, bool)
        for c in range(keys):
            v = table.column(c).to_numpy()
            last &= v == v[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _bounds(table: pa.Table, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """First row and end of each group."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for c in range(keys):
        v = table.column(c).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    first = np.flatnonzero(change)
    return first, np.append(first[1:], table.num_rows)


def _pieces(table: pa.Table, keys: int, rows: int) -> Iterator[pa.Table]:
    """The table in pieces of whole groups: about ``rows`` rows, or one larger group."""
    first, end = _bounds(table, keys)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(end, first[at] + rows, "right")))
        yield table.slice(int(first[at]), int(end[to - 1] - first[at]))
        at = to


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Smallest row number of each component, after adding edges a - b."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label[:] = nxt
        live = label[a] != label[b]
        a, b = a[live], b[live]


def _prune(table: pa.Table, least: dict[int, int], keys: int, pairs_at_once: int = 40_000):
    """Row numbers (member, representative) joined by the pairs that the posterior leaves."""
    first, end = _bounds(table, keys)
    n = table.num_rows
    band, own, ta, tb = (table.column(c).to_numpy() for c in ("band", "own", "ta", "tb"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(n, BANDS * BAND_ROWS)
    stop = np.repeat(end, end - first)
    partners = stop - np.arange(n) - 1
    upto = np.concatenate([[0], np.cumsum(partners)])
    label = np.arange(n)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(upto, upto[row] + pairs_at_once, "right")) - 1)
        count = partners[row:to]
        left = np.repeat(np.arange(row, to), count)
        right = np.arange(len(left)) - np.repeat(upto[row:to] - upto[row], count) + left + 1
        cross = (ta[left] == tb[left]) | (own[left] != own[right])
        left, right = left[cross], right[cross]
        row = to
        if not len(left):
            continue
        # a pair belongs to the first band on which it agrees
        same = sig[left] == sig[right]
        agree = same.reshape(-1, BANDS, BAND_ROWS).all(2)
        mine = agree.argmax(1) == band[left]
        left, right, same = left[mine], right[mine], same[mine]
        matches = np.zeros(len(left), np.int32)
        for upper, need in least.items():
            matches += same[:, upper - STEP:upper].sum(1, dtype=np.int32)
            live = matches >= need
            left, right, same, matches = left[live], right[live], same[live], matches[live]
        _merge(label, left, right)
    return label


def _candidates(nodes: DataFrame, threshold: float, tolerance: float, tile: int) -> DataFrame:
    """Edges (a, b) of forests over the nodes whose signatures leave them a chance."""
    each = nodes.where("n > 0").select("node", F.posexplode(F.array(*[
        F.xxhash64(F.lit(b), F.substring("sig", b * BAND_ROWS * 4 + 1, BAND_ROWS * 4)) for b in range(BANDS)])).alias("band", "bucket"))
    shared = each.groupBy(F.col("bucket").alias("k"), F.col("band").alias("kb")).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = each.join(shared, (F.col("bucket") == F.col("k")) & (F.col("band") == F.col("kb"))).select("bucket", "band", "size", "node")
    members = members.join(nodes.select(F.col("node").alias("m"), "sig"), F.col("node") == F.col("m")).drop("m")
    rows = _tiled(members, ["bucket", "band"], "size", "node", tile).select("bucket", "band", "ta", "tb", "own", "node", "sig")
    rows = rows.repartition("bucket", "band", "ta", "tb").sortWithinPartitions("bucket", "band", "ta", "tb", "node")
    least = fewest_matches(threshold, tolerance, BANDS * BAND_ROWS, STEP)

    def run(batches):
        for table in _groups(batches, 4):
            label = _prune(table, least, 4)
            node = table.column("node").to_numpy()
            got = np.flatnonzero(label != np.arange(len(label)))
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(node[got]), pa.array(node[label[got]])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _overlaps(values: list[np.ndarray], at_once: int = 1 << 19) -> np.ndarray:
    """Number of common values of every two of some sorted distinct arrays of 48-bit hashes.

    The hashes are taken in ranges of about ``at_once`` values, so that long texts cost time and not memory.
    """
    n = len(values)
    out = np.zeros((n, n), np.float32)
    ranges = 1 + sum(len(v) for v in values) // at_once
    bounds = (np.arange(1, ranges, dtype=np.float64) * (float(1 << 48) / ranges)).astype(np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(v, bounds), [len(v)]]) for v in values]
    width = max(1, (1 << 21) // n)
    for r in range(ranges):
        _, column, times = np.unique(np.concatenate([v[c[r]:c[r + 1]] for v, c in zip(values, cuts)]), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(n), [c[r + 1] - c[r] for c in cuts])
        shared = times[column] > 1
        of, column = of[shared], column[shared]
        if not len(of):
            continue
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        of, column = of[order], column[order]
        for low in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [low, low + width])
            m = np.zeros((n, width), np.float32)
            m[of[a:b], column[a:b] - low] = 1
            out += m @ m.T
    return out


def _verify(docs: DataFrame, nodes: DataFrame, groups: DataFrame, threshold: float, doc_id: str, text: str, tile: int) -> DataFrame:
    """(node, links, root): exact link counts per node and tile, and forests over linked nodes."""
    member = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    size = member.groupBy(F.col("root").alias("r")).agg(F.count(F.lit(1)).alias("size"))
    member = member.join(size, F.col("root") == F.col("r")).drop("r")
    wanted = nodes.select(F.col("node").alias("m"), "copies", F.col("first.id").alias("rid"), F.col("first.t1").alias("r1"), F.col("first.t2").alias("r2"))
    wanted = staged(member.join(wanted, F.col("node") == F.col("m")).drop("m"), "groups")
    if wanted.count() <= MAX_BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    k1, k2 = text_key(F.col(text))
    rows = docs.select(F.col(doc_id).alias("id"), k1.alias("t1"), k2.alias("t2"), F.col(text).alias("text"))
    rows = rows.join(wanted, (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2")) & F.col("id").eqNullSafe(F.col("rid")))
    rows = rows.select("root", "size", "node", "copies", "text").dropDuplicates(["node"])
    rows = _tiled(rows, ["root"], "size", "node", tile).select("root", "ta", "tb", "own", "node", "copies", "text")
    rows = rows.repartition("root", "ta", "tb").sortWithinPartitions("root", "ta", "tb", "node")

    def judge(sets, node, copies, own, crossing):
        n = len(sets)
        size = np.array([len(s) for s in sets], np.float64)
        common = _overlaps(sets).astype(np.float64)
        linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        if crossing:
            linked &= own[:, None] != own[None, :]
        label = np.arange(n)
        a, b = np.nonzero(np.triu(linked))
        _merge(label, a, b)
        return (linked * copies[None, :]).sum(1).astype(np.int64), node[label]

    def run(batches):
        for table in _groups(batches, 3):
            for piece in _pieces(table, 3, tile):
                first, end = _bounds(piece, 3)
                sets = []
                for raw in textvec.chunks(textvec.texts_of(piece.column("text"))):
                    values, count = textvec.shingle_sets(raw, SHINGLE)
                    sets += np.split(values, np.cumsum(count)[:-1])
                own, ta, tb, node, copies = (piece.column(c).to_numpy() for c in ("own", "ta", "tb", "node", "copies"))
                links, root = np.zeros(len(node), np.int64), node.copy()
                for a, b in zip(first, end):
                    if b - a > 1:
                        links[a:b], root[a:b] = judge(sets[a:b], node[a:b], copies[a:b], own[a:b], ta[a] != tb[a])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)], names=["node", "links", "root"])

    return rows.mapInArrow(run, "node long, links long, root long")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
         tile: int = TILE) -> DataFrame:
    """One row per document row: id, t1, t2, class_id, n_links (documents linked to it, copies included), first (of its class)."""
    signed = staged(_sign(docs, doc_id, text), "signatures")
    nodes = signed.groupBy("d1", "d2", "n").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"),
                                                F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")).alias("first"), F.first("sig").alias("sig"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    groups = components(_candidates(nodes, threshold, tolerance, tile))
    judged = staged(_verify(docs, nodes, groups, threshold, doc_id, text, tile), "links")
    links = judged.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(judged.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.join(classes.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").withColumn("root", F.coalesce("root", "node")).drop("m", "sig")
    known = known.join(links.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").drop("m")
    top = known.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("class_id"), F.min("first").alias("class_first"))
    known = known.join(top, F.col("root") == F.col("r")).select(
        F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n").alias("en"), "class_id", "class_first",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = signed.select("id", "t1", "t2", "d1", "d2", "n").join(known, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") == F.col("en")))
    is_first = (F.col("class_first.t1") == F.col("t1")) & (F.col("class_first.t2") == F.col("t2")) & F.col("class_first.id").eqNullSafe(F.col("id"))
    return rows.select("id", "t1", "t2", "class_id", "n_links", is_first.alias("first"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One document of each class, the one with the smallest id; all columns as they came."""
    found = staged(join(docs, doc_id, text, **kw), "classes")
    key = lambda rows: rows.select(F.col("id").alias("__rid"), F.col("t1").alias("__r1"), F.col("t2").alias("__r2"))
    same = (F.col("__t1") == F.col("__r1")) & (F.col("__t2") == F.col("__r2")) & F.col(doc_id).eqNullSafe(F.col("__rid"))
    k1, k2 = text_key(F.col(text))
    keyed = docs.withColumn("__t1", k1).withColumn("__t2", k2)
    later = key(found.where(~F.col("first")).select("id", "t1", "t2").distinct())
    repeated = staged(key(found.where("first").groupBy("id", "t1", "t2").agg(F.count(F.lit(1)).alias("k")).where("k > 1")), "repeated")
    later = staged(later, "later")
    side = lambda df: F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df
    kept = keyed.join(side(later), same, "left_anti")
    if not repeated.isEmpty():
        again = side(repeated)
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([doc_id, "__t1", "__t2"]))
    return kept.select(docs.columns)
