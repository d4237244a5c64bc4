"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

Lines with a word in them become IDs, ranked by a global sort of the distinct IDs that occur twice. Round by round, the rank of
a suffix by its first 2^(k+1) lines comes from sorting the distinct pairs (rank of its first 2^k lines, rank of the 2^k lines after
them) that occur twice; a suffix whose pair occurs once has no rank, it shares no longer prefix with any other. Two ranks that overlap
name a prefix of any length, and the suffixes with one name are a longest-common-prefix interval of that depth.

A run of lines counts when it has ``min_words`` words. Every maximal repeated run is the union of the shortest runs of
that many words that begin, and that end, at its lines: so these intervals are formed at those depths, the first
occurrence (by id, then place) of each stays, and the lines of all others are deleted. Since every line in a sequence has a word, depths
are at most ``min_words`` and the rounds at most log2(min_words) + 1, whatever the data.

Only aggregates of line IDs and pairs are sorted, so a line in a third of all documents is one row there; joins back to the
positions are plain equi-joins, which adaptive execution splits when they are skewed. Windows run inside one document.

Defined results: a null text stays null, with no lines; lines without words are kept and do not interrupt a run. Rows that repeat an id and
text are one document and get one result. Documents with null ids come first. Lines that are equal count as equal byte by byte. Extra
columns pass through ``dedup``. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stamina.llm.common import staged
from stamina.llm.mixing import n_words

MIN_WORDS = 50
MAX_BROADCAST_LINES = 2_000_000


def _ranked(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, rank): the key tuples that occur twice or more, numbered in their order."""
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(*keys).orderBy(*keys)
    return staged(twice.withColumn("rank", F.monotonically_increasing_id()), label)


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, t, line (number in the text), a, b (line ID), w (words): the lines with words."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n", -1)).alias("line", "value"))
    rows = rows.select("id", "t", "line", F.xxhash64("value").alias("a"), F.xxhash64(F.lit(3), "value").alias("b"), n_words(F.col("value")).alias("w"))
    return rows.where("w > 0")


def suffix_ranks(docs: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    """id, t, line, place (among lines with words), run, w, ranks: of the suffix by its first 1, 2, 4, ... lines, as far as others share them.

    ``run`` is a stretch of neighbouring lines that all occur elsewhere.
    """
    lines = _lines(docs, doc_id, text).dropDuplicates(["id", "t", "line"])      # repeated rows are one document before places are numbered
    lines = staged(lines.withColumn("place", F.row_number().over(Window.partitionBy("id", "t").orderBy("line")) - 1), "lines")
    known = _ranked(lines, ["a", "b"], "line-ranks")
    now = lines.join(known, ["a", "b"]).drop("a", "b")
    by = Window.partitionBy("id", "t").orderBy("place")
    now = staged(now.withColumn("run", F.col("place") - F.row_number().over(by)).withColumn("ranks", F.array("rank")), "suffixes")
    length = 1
    while 2 * length <= min_words:
        after = F.lead("rank", length).over(Window.partitionBy("id", "t", "run").orderBy("place"))
        pairs = now.withColumn("next", after).withColumnRenamed("rank", "own")
        pairs = staged(pairs, "pairs")
        known = _ranked(pairs.where("own is not null and next is not null"), ["own", "next"], "pair-ranks")
        if known.isEmpty():
            return pairs.withColumnRenamed("own", "rank")
        known = known.select(F.col("own").alias("o"), F.col("next").alias("x"), "rank")
        now = pairs.join(known, (F.col("own") == F.col("o")) & (F.col("next") == F.col("x")), "left").drop("own", "next", "o", "x")
        now = now.withColumn("ranks", F.concat("ranks", F.array("rank")))
        length *= 2
    return staged(now, "suffixes")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, t, lines: numbers of the lines to delete, of the documents that have any."""
    suffixes = suffix_ranks(docs, doc_id, text, min_words)
    inside = Window.partitionBy("id", "t", "run").orderBy("place")
    upto = suffixes.withColumn("c", F.sum("w").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    upto = upto.withColumn("s", F.col("c") - F.col("w"))
    # the shortest runs of enough words: from a line on, and up to a line
    onward = F.collect_list("c").over(inside.rowsBetween(0, min_words - 1))
    backward = F.collect_list("s").over(inside.rowsBetween(-min_words + 1, 0))
    both = upto.withColumn("onward", onward).withColumn("backward", backward)
    both = both.select("id", "t", "place",
                       (F.size(F.filter("onward", lambda c: c < F.col("s") + min_words)) + 1).alias("f"), F.size("onward").alias("fm"),
                       (F.size(F.filter("backward", lambda s: s > F.col("c") - min_words)) + 1).alias("b"), F.size("backward").alias("bm"))
    spans = both.select("id", "t", F.explode(F.array(
        F.when(F.col("f") <= F.col("fm"), F.struct(F.col("place").alias("at"), F.col("f").alias("len"))),
        F.when(F.col("b") <= F.col("bm"), F.struct((F.col("place") - F.col("b") + 1).alias("at"), F.col("b").alias("len"))))).alias("x"))
    spans = spans.where("x is not null").select("id", "t", "x.*").distinct()
    level = F.floor(F.log2(F.col("len") + 1e-9)).cast("int")
    spans = spans.withColumn("level", level).withColumn("second", (F.col("at") + F.col("len") - F.pow(F.lit(2.0), F.col("level"))).cast("int"))
    ranks = suffixes.select(F.col("id").alias("i"), F.col("t").alias("j"), F.col("place").alias("p"), "ranks")
    place = lambda at: F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("j")) & (F.col(at) == F.col("p"))
    for at, to in (("at", "r1"), ("second", "r2")):
        spans = spans.join(ranks, place(at)).withColumn(to, F.get("ranks", F.col("level"))).drop("i", "j", "p", "ranks").where(F.col(to).isNotNull())
    spans = staged(spans, "spans")
    interval = ["len", "r1", "r2"]
    first = spans.groupBy(*interval).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "t", "at")).alias("first")).where("times > 1")
    first = first.select(*[F.col(c).alias(f"f_{c}") for c in interval], "first")
    later = spans.join(first, [F.col(c) == F.col(f"f_{c}") for c in interval]).where(
        F.struct(F.col("id").isNotNull().alias("some"), "id", "t", "at") > F.col("first"))
    gone = later.select("id", "t", F.explode(F.sequence("at", F.col("at") + F.col("len") - 1)).alias("gone")).distinct()
    numbered = suffixes.select(F.col("id").alias("i"), F.col("t").alias("j"), F.col("place").alias("p"), "line")
    gone = gone.join(numbered, place("gone"))
    return gone.groupBy("id", "t").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs cut out of the text, and __lines, __removed (numbers of the lines cut out)."""
    gone = staged(repeated_lines(docs, doc_id, text, min_words).select(F.col("id").alias("__i"), F.col("t").alias("__j"), F.col("lines").alias("__gone")), "deleted")
    total = gone.agg(F.sum(F.size("__gone") + 4)).first()[0] or 0
    side = F.broadcast(gone) if total <= MAX_BROADCAST_LINES else gone
    rows = docs.withColumn("__t", F.xxhash64(text)).join(side, F.col(doc_id).eqNullSafe(F.col("__i")) & (F.col("__t") == F.col("__j")), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    cut = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept).alias(text)
    return rows.select(*[cut if c == text else F.col(c) for c in docs.columns], F.coalesce(F.size(lines), F.lit(0)).alias("__lines"),
                       F.coalesce("__gone", F.array().cast("array<int>")).alias("__removed"))
