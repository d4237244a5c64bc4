"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every training window.

Windows are ``n`` consecutive words; an item with fewer words, but not none, is one window of all its words. One scan
of the documents hashes each word window inside generated code and probes the broadcast set; equal hashes are then
compared word by word. The set is counted before it is broadcast: above ``MAX_BROADCAST_WINDOWS`` it is cut by hash into
slices below that size, each with a scan of its own, so the broadcast never grows with the data.

Defined results: a null or empty text has no words, no hits and is not contaminated. Repeated rows each give a row. Items
without words have no window; an item whose id is null counts as an item with an empty id. Extra columns pass through
``remove_documents`` and ``remove_spans`` untouched and are ignored by ``scan``. Empty tables give empty or hit-free results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stamina.llm.common import RAW_SEPARATORS, RAW_WORD, text_key, words

WINDOW = 13
#: Windows in one broadcast: about 200 bytes each.
MAX_BROADCAST_WINDOWS = 1_000_000


def _gram(length: int, first: Column | int) -> Column:
    """Hash of ``length`` words of the array ``w`` from position ``first`` on."""
    return F.xxhash64(F.lit(length), *[F.get("w", F.lit(first) + k) for k in range(length)])


def item_windows(items: DataFrame, n: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: h, size, gram, items (ids as strings that have it)."""
    w = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(n)))
    at = w.select("item", "size", F.explode(F.expr("transform(sequence(0, size(w) - size), i -> slice(w, i + 1, size))")).alias("w"))
    h = F.lit(None).cast("long")
    for length in range(1, n + 1):
        h = F.when(F.col("size") == length, _gram(length, 0)).otherwise(h)
    return (at.groupBy(h.alias("h"), "size", F.array_join("w", " ").alias("gram"))
            .agg(F.array_sort(F.collect_set("item")).alias("items")))


def scan(docs: DataFrame, items: DataFrame, n: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text", share: int = 20,
         max_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """One row per document row: id, __t1, __t2 (text digests), n_words, n_hit, spans, items, contaminated.

    Contaminated: some word is hit and the hit words times ``share`` reach the words of the document.
    """
    grams = item_windows(items, n, item_id, item_text)
    facts = items.select(F.size(words(F.col(item_text))).alias("k")).where("k > 0").groupBy(F.least("k", F.lit(n)).alias("size")).agg(
        F.sum(F.col("k") - F.least("k", F.lit(n)) + 1).alias("windows")).collect()
    sizes = sorted(r["size"] for r in facts) or [n]
    slices = -(-sum(r["windows"] for r in facts) // max_windows) or 1
    rows = docs.select(F.col(doc_id).alias("id"), *text_key(F.col(text)), words(F.col(text)).alias("w"))
    rows = rows.withColumn("n_words", F.size("w"))
    found = None
    for part in range(slices):
        wanted = grams if slices == 1 else grams.where(F.pmod("h", F.lit(slices)) == part)
        hits = _probe(rows, wanted, sizes, with_rows=part == 0)
        found = hits if found is None else found.unionByName(hits)
    per_text = found.groupBy("id", "__t1", "__t2").agg(
        F.sum(F.when(F.col("at") < 0, 1).otherwise(0)).alias("copies"), F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("at") >= 0, F.struct("at", "size")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, s: F.struct(
        F.greatest(a["end"], s["at"] + s["size"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(a["end"], s["at"]))).alias("n")), lambda a: a["n"])
    one = per_text.withColumn("n_hit", covered).withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    return one.select("id", "__t1", "__t2", "n_words", "n_hit", "spans", "items",
                      ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def _probe(rows: DataFrame, grams: DataFrame, sizes: list[int], with_rows: bool) -> DataFrame:
    """Windows of the documents that are in ``grams``; with a row at -1 for each document if asked for."""
    first = -1 if with_rows else 0
    at = rows.select("id", "__t1", "__t2", "n_words", "w", F.explode(
        F.sequence(F.lit(first), F.greatest(F.lit(first), F.col("n_words") - min(sizes)))).alias("at"))
    fits = {k: (F.col("at") >= 0) & (F.col("at") + k <= F.col("n_words")) for k in sizes}
    if len(sizes) == 1:
        k = sizes[0]
        at = at.select("*", F.lit(k).alias("size"), F.when(fits[k], _gram(k, F.col("at"))).alias("h"))
    else:
        # no lambda here: it would end the generated code, and every window would carry its document's words along
        each = F.array(*[F.struct(F.lit(k).alias("size"), F.when(fits[k], _gram(k, F.col("at"))).alias("h")) for k in sizes])
        at = at.select("*", F.explode(each).alias("__x")).select("id", "__t1", "__t2", "n_words", "w", "at", "__x.size", "__x.h")
        at = at.where(F.col("h").isNotNull() | ((F.col("at") < 0) & (F.col("size") == sizes[0])))
    set_ = F.broadcast(grams.select(F.col("h").alias("__h"), F.col("size").alias("__size"), "gram", "items"))
    # the words are compared after the probe: as part of the join they would be joined up for every window
    same = (F.col("size") == F.col("__size")) & (F.col("gram") == F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " "))
    hit = at.join(set_, F.col("h") == F.col("__h"), "left").where((F.col("at") < 0) | same)
    return hit.select("id", "__t1", "__t2", "n_words", "at", "size", "items")


def remove_documents(docs: DataFrame, items: DataFrame, text: str = "text", **kw) -> DataFrame:
    """The documents that are not contaminated, all columns as they came."""
    bad = scan(docs.select(F.lit(0).alias("__id"), F.col(text)), items, doc_id="__id", text=text, **kw)
    bad = bad.where("contaminated").select(F.col("__t1").alias("__b1"), F.col("__t2").alias("__b2")).distinct()
    k1, k2 = text_key(F.col(text))
    keyed = docs.withColumn("__t1", k1).withColumn("__t2", k2)
    return keyed.join(bad, (F.col("__t1") == F.col("__b1")) & (F.col("__t2") == F.col("__b2")), "left_anti").select(docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", **kw) -> DataFrame:
    """All documents, with every hit word and the separators after it cut out of the text."""
    hit = scan(docs.select(F.lit(0).alias("__id"), F.col(text)), items, doc_id="__id", text=text, **kw)
    hit = hit.where("n_hit > 0").select(F.col("__t1").alias("__b1"), F.col("__t2").alias("__b2"), F.col("spans").alias("__spans"))
    hit = hit.dropDuplicates(["__b1", "__b2"])
    k1, k2 = text_key(F.col(text))
    keyed = docs.withColumn("__t1", k1).withColumn("__t2", k2).join(
        hit, (F.col("__t1") == F.col("__b1")) & (F.col("__t2") == F.col("__b2")), "left")
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"{RAW_WORD}+{RAW_SEPARATORS}*"), F.lit(0))
    in_span = F.array_distinct(F.flatten(F.transform("__spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))
    kept = F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains(F.col("__cut"), i)), "")
    lead = F.regexp_extract(F.col(text), f"^{RAW_SEPARATORS}*", 0)
    out = keyed.withColumn("__cut", in_span).withColumn(
        text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.concat(lead, kept)))
    return out.select(docs.columns)
