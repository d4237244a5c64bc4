"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words a source gives are fixed first: every source asks for its weight's share of all words, no source gives more than
``most`` times what it has, and what is above that goes to the others by weight. A source above its own size is taken
whole several times; of its last pass it gives a part. A source's documents lie in hashed blocks, a random permutation cut
into pieces of about ``block_docs``; the part is a run of whole blocks and a fitting choice from the one after them.

The blocks of all sources are then dealt to output shards: a tree over the shards splits the sources' exact block counts
with one multivariate hypergeometric draw at each node, which has the law of cutting one random permutation of all blocks.
Each shard owns a run of block numbers of every source, no two the same, and shuffles its documents locally.

Sums along a source go over blocks of blocks, so no task sees a whole source. Per-source tables hold one row a source.
All draws are hashes or seeded, so reruns agree.

Defined results: a null or empty text has size 0; it is taken as often as its source's whole passes, and costs nothing. A null
source is a source of its own, the last one. Rows that repeat an id, source and size are one bundle of that many documents.
Empty tables give empty results; extra columns pass through ``mix`` untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stamina.llm.common import staged

BLOCK_DOCS = 256
GROUP_BLOCKS = 1024
SHARDS = 16
HANDS = 4096
MAX_BROADCAST_SOURCES = 200_000
WORD_PATTERN = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, WORD_PATTERN), "")), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Adds ``weight``: the given ones in turn along the sources by code point, null last. One row a source."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth % len(weights) + 1))


def targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """Adds ``target`` to (source, words, docs, weight): shares of all words by weight, none above ``most`` x its words.

    Sources sorted by the level at which they are used up; the common level is the first that the sources before it,
    all used up, leave room for.
    """
    cap, level = F.col("words") * most, F.col("words") * most / F.col("weight")
    by = Window.orderBy(level)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    left = F.sum("words").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    s = sources.withColumn("__level", level).withColumn("__try", left / F.sum("weight").over(after))
    found = F.min(F.when(F.col("__try") <= F.col("__level"), F.struct("__level", "__try"))).over(every)["__try"]
    return s.withColumn("target", F.least(cap, F.coalesce(found, F.lit(float("inf"))) * F.col("weight"))).drop("__level", "__try")


def _split_nodes(nodes: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, quota) at the root down to (source, shard, quota), one level of the tree at a time."""
    def split(key, pdf):
        low, high = int(key[0]), int(key[1])
        if high - low == 1:
            return pdf
        pdf = pdf.sort_values(["order"], kind="stable")
        quota = pdf["quota"].to_numpy(np.int64)
        middle, total = (low + high) // 2, int(quota.sum())
        # leaves differ by one block at most
        left_total = (middle - low) * (total // (high - low)) + min(middle - low, total % (high - low))
        draw = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(quota, left_total, method="marginals")
        out = [pdf.assign(low=low, high=middle, quota=draw), pdf.assign(low=middle, high=high, quota=quota - draw)]
        return pd.concat(out)
    for _ in range(max(0, (shards - 1).bit_length())):
        nodes = nodes.groupBy("low", "high").applyInPandas(split, nodes.schema)
    return nodes


def nearest(size: np.ndarray, n: np.ndarray, gap: float, free: int = 16, steps: int = 200_000) -> np.ndarray:
    """How many of each bundle of a block, in permuted order, come nearest to ``gap`` words.

    The rows that fit one after the other are taken, but for the last ``free`` (a bundle without words counts as one); those and
    the rest of the block are chosen by their reachable sums, held as the bits of one number (in units that keep it under
    twice ``steps`` bits). A bundle's rows enter the sums as 1, 2, 4, ... and the remaining ones, so that any number can be taken.
    """
    took = np.zeros(len(size), np.int64)
    upto = np.cumsum(size * n)
    fits = int(np.searchsorted(upto, gap, side="right"))
    took[:fits] = n[:fits]
    if fits < len(size):
        took[fits] = int(gap - (upto[fits - 1] if fits else 0)) // size[fits]
    start, back = min(fits + 1, len(size)), free
    while start and back:
        start -= 1
        given = min(int(took[start]), back) if size[start] else int(took[start])
        took[start] -= given
        back -= given if size[start] else 1
    goal = gap - int((size * took).sum())
    unit = max(1, int(goal) // steps)
    items = []
    for i in range(start, len(size)):
        left = int(n[i] - took[i])
        if size[i]:                                      # beyond twice the goal no sum is nearer than none
            left = min(left, int(2 * goal // size[i]) + 1)
        some = 1
        while left:
            some = min(some, left)
            items.append((i, some, int(round(int(size[i]) * some / unit))))
            left -= some
            some *= 2
    g = int(round(goal / unit))
    mask = (1 << (2 * g + 2)) - 1
    sums = [1]
    for _, _, s in items:
        sums.append(sums[-1] | ((sums[-1] << s) & mask) if s <= 2 * g + 1 else sums[-1])
    below = (sums[-1] & ((1 << (g + 1)) - 1)).bit_length() - 1
    over = sums[-1] >> (g + 1)
    above = g + (over & -over).bit_length() if over else None
    at = above if above is not None and above - g < g - below else below
    for j in range(len(items) - 1, -1, -1):
        if not sums[j] >> at & 1:
            took[items[j][0]] += items[j][1]
            at -= items[j][2]
    return took


def plan(docs: DataFrame, weigh, doc_id: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None,
         most: float = 3.0, shards: int = SHARDS, block_docs: int = BLOCK_DOCS, seed: int = 17) -> DataFrame:
    """One row per bundle: id, source, size, n (rows), source_size, target, passes (whole), extra (rows taken once more),
    block, blocks (of the source), bounds (block numbers at which shards begin). ``weigh`` adds weights to the sources."""
    size = n_words(F.col(text)) if size is None else size
    digest = staged(docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), size.alias("size"))
                    .groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-rows")
    totals = digest.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"))
    facts = targets(weigh(totals), most).select(
        "source", "words", "target", F.greatest(F.ceil(F.col("docs") / block_docs), F.lit(1)).alias("blocks"),
        F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words") + 1e-9)).otherwise(0).cast("long").alias("passes"))
    facts = staged(facts.withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("words"), F.lit(0.0))), "mix-sources")
    small = facts.count() <= MAX_BROADCAST_SOURCES
    side = lambda df: F.broadcast(df) if small else df
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    order = F.xxhash64("id", "size", F.lit(seed))
    rows = digest.join(side(facts), same(digest, facts)).drop(facts["source"])
    unit = F.shiftrightunsigned(order, 11).cast("double") / float(1 << 53)
    rows = rows.withColumn("order", order).withColumn("key", F.xxhash64("source", "id", "size", F.lit(seed + 1))).withColumn(
        "block", F.least(F.floor(unit * F.col("blocks")), F.col("blocks") - 1))

    # words before each block of a source: sums over groups of blocks, then within a group
    block = (rows.groupBy("source", "block").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.first("rest").alias("rest"))
             .withColumn("group", F.floor(F.col("block") / GROUP_BLOCKS)))
    block = staged(block, "mix-blocks")
    ahead = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    group = block.groupBy("source", "group").agg(F.sum("words").alias("words")).withColumn(
        "group_at", F.coalesce(F.sum("words").over(ahead("source").orderBy("group")), F.lit(0))).drop("words")
    both = block.join(group.withColumnRenamed("source", "s").withColumnRenamed("group", "g"),
                      F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g"))).drop("s", "g")
    at = F.col("group_at") + F.coalesce(F.sum("words").over(ahead("source", "group").orderBy("block")), F.lit(0))
    begun = both.withColumn("at", at).where((F.col("rest") > 0) & (F.col("at") < F.col("rest")))
    # the last block begun in a source's partial pass, and the words that are still to come from it
    edge = staged(begun.groupBy("source").agg(F.max(F.struct("block", "at", "rest")).alias("e")).select(
        "source", F.col("e.block").alias("edge"), (F.col("e.rest") - F.col("e.at")).alias("gap")), "mix-edges")

    rows = rows.join(side(edge.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")

    def fill(pdf):
        pdf = pdf.sort_values(["order", "key"])
        took = nearest(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), float(pdf["gap"].iloc[0]))
        return pd.DataFrame({"k": pdf["key"], "took": took})

    part = (rows.where(F.col("block") == F.col("edge")).select("source", "block", "key", "order", "size", "n", "gap")
            .groupBy("source", "block").applyInPandas(fill, "k long, took long"))
    rows = rows.join(part, F.col("key") == F.col("k"), "left").withColumn(
        "extra", F.when(F.col("block") < F.col("edge"), F.col("n")).otherwise(F.coalesce("took", F.lit(0))))

    quota = facts.join(side(edge.withColumnRenamed("source", "s")), facts["source"].eqNullSafe(F.col("s")), "left")
    root = quota.select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "source",
                        (F.col("passes") * F.col("blocks") + F.coalesce(F.col("edge") + 1, F.lit(0))).alias("quota"),
                        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("order"))
    leaves = _split_nodes(root, shards, seed).groupBy(F.col("source").alias("s")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("low").alias("shard"), "quota"))).alias("own"))
    # each source's shards own runs of its block numbers, one after the other
    runs = F.aggregate("own", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["quota"])))
    bounds = staged(leaves.select("s", F.slice(runs, 1, shards).alias("bounds")), "mix-shards")
    rows = rows.join(side(bounds), F.col("source").eqNullSafe(F.col("s")), "left")
    return rows.select("id", "source", "size", "n", F.col("words").alias("source_size"), "target", "passes", "extra", "block", "blocks",
                       F.coalesce("bounds", F.array(F.lit(0).cast("long"))).alias("bounds"))


def shard_of(pass_no: Column, block: Column, blocks: Column, bounds: Column) -> Column:
    """The shard that owns a block of a pass."""
    number = pass_no * blocks + block
    return F.size(F.filter(bounds, lambda b: b <= number)) - 1


def placements(taken: DataFrame) -> Column:
    """Shards of the copies of a row with ``passes``, ``more`` (0 or 1), ``block``, ``blocks`` and ``bounds``."""
    copies = F.col("passes") + F.col("more")
    each = F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), lambda i: shard_of(i, F.col("block"), F.col("blocks"), F.col("bounds")))
    return F.when(copies > 0, each).otherwise(F.array().cast("array<int>"))


def takes(docs: DataFrame, weigh, **kw) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words), shards (of its copies)."""
    rows = plan(docs, weigh, **kw).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    rows = rows.withColumn("more", (F.col("__i") <= F.col("extra")).cast("long"))
    return rows.select("id", "source", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("more"))).alias("taken"),
                       placements(rows).alias("shards"))


def mix(docs: DataFrame, weigh, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17, **kw) -> DataFrame:
    """The mixed documents, a row for each copy, in shards that are shuffled locally; columns as they came."""
    planned = plan(docs, weigh, doc_id, source, text, seed=seed, **kw).select(
        F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("n").alias("__n"),
        "passes", "extra", "block", "blocks", "bounds").where("passes > 0 or extra > 0")
    own = docs.select(F.struct("*").alias("__doc"), F.col(doc_id).alias("__k"), F.col(source).alias("__s"),
                      n_words(F.col(text)).alias("__w"), F.xxhash64(text).alias("__t"))
    same = F.col("__k").eqNullSafe(F.col("__id")) & F.col("__s").eqNullSafe(F.col("__source")) & (F.col("__w") == F.col("__size"))
    rows = own.join(planned, same)
    nth = F.row_number().over(Window.partitionBy("__k", "__s", "__w").orderBy("__t"))
    rows = rows.withColumn("more", (F.when(F.col("__n") > 1, nth).otherwise(1) <= F.col("extra")).cast("long"))
    rows = rows.select("__doc", F.posexplode(placements(rows)).alias("__copy", "__shard"))
    by = F.xxhash64(F.col(f"__doc.{doc_id}"), F.col("__copy"), F.lit(seed + 2))
    # a shard of any size is written by as many tasks as there are: its rows are dealt in many small hands
    rows = rows.withColumn("__by", by).repartition("__shard", F.pmod("__by", F.lit(HANDS)))
    return rows.sortWithinPartitions("__shard", "__by").select("__doc.*")
