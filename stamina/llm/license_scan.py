"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Templates and texts are five-word shingles. A template of T distinct shingles is looked for in windows of T + s - 1 shingles at every s-th
place (s = half of T, rounded up), so that an occurrence of T shingles lies whole in some window. A window that contains 0.8 of a
template has a Jaccard similarity to it of at least 0.8 / 1.7 = 0.47 or so; with ``BANDS`` bands of one value, a match meets its
template in no band with probability 0.53^32 < 2e-9. Windows that share no shingle with any template cannot agree on a band with one: one
scan probes a broadcast set of all template shingles inside generated code, and only windows around its hits are signed.

Templates are counted before they are broadcast; more than ``MAX_SHINGLES`` shingles are refused. Hits go back to their texts by a join
whose small side is broadcast up to a counted number of rows.

Defined results: a null or empty text, or one of under five words, has no license. Templates with fewer than five words are left out. Repeated rows each
give a row. Two templates of one name count as one license. Extra columns are ignored; empty tables give empty or hit-free results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stamina.llm.common import staged, text_key, words

SHINGLE = 5
BANDS = 32
TENTHS = 8
MAX_SHINGLES = 500_000
MAX_BROADCAST_ROWS = 1_000_000


def _shingle(first: Column) -> Column:
    return F.xxhash64(*[F.get("w", first + k) for k in range(SHINGLE)])


def _shingles(array: Column) -> Column:
    """Hashes of all five-word shingles of an array of words."""
    return F.when(F.size(array) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(array) - SHINGLE), lambda i: F.xxhash64(
        *[F.get(array, i + k) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<long>"))


def _bands(shingles: str) -> Column:
    """One MinHash value a band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k))))


def template_table(templates: DataFrame) -> DataFrame:
    """(license, text) to license, text_no, shingles (distinct), size, step, width."""
    t = templates.where("license is not null").select("license", F.xxhash64("text").alias("text_no"), words(F.col("text")).alias("w")).distinct()
    t = t.where(F.size("w") >= SHINGLE).select("license", "text_no", F.array_distinct(_shingles(F.col("w"))).alias("shingles"))
    t = t.withColumn("size", F.size("shingles")).withColumn("step", F.ceil(F.col("size") / 2).cast("int"))
    return t.withColumn("width", F.col("size") + F.col("step") - 1)


def scan(docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: id, n_words, matches (license, share: contained tenths at best as a double), sorted by license."""
    table = staged(template_table(templates), "templates")
    total = table.agg(F.sum("size")).first()[0] or 0
    if total > MAX_SHINGLES:
        raise ValueError(f"{total} template shingles; scan in groups of at most {MAX_SHINGLES}")
    grids = table.select("size", "step", "width").distinct()
    # which windows a hit at a place can be in, for each grid whose templates have the shingle
    probe = (table.select("size", "step", "width", F.explode("shingles").alias("__h")).distinct()
             .groupBy("__h").agg(F.collect_set(F.struct("size", "step", "width")).alias("grids")))
    rows = docs.select(F.col(doc_id).alias("id"), *text_key(F.col(text)), words(F.col(text)).alias("w")).withColumn("n_words", F.size("w"))
    at = rows.select("id", "__t1", "__t2", "n_words", "w", F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.col("n_words") - SHINGLE))).alias("at"))
    at = at.select("id", "__t1", "__t2", "n_words", "at", F.when(F.col("at") >= 0, _shingle(F.col("at"))).alias("h"))
    hit = at.join(F.broadcast(probe), F.col("h") == F.col("__h"), "left").where((F.col("at") < 0) | F.col("grids").isNotNull())
    starts = F.flatten(F.transform("grids", lambda g: F.transform(
        F.sequence(F.greatest(F.lit(0), F.ceil((F.col("at") - g["width"] + 1) / g["step"]).cast("int")), F.floor(F.col("at") / g["step"]).cast("int")),
        lambda k: F.struct(g["size"].alias("size"), (k * g["step"]).alias("start"), g["width"].alias("width")))))
    hit = hit.select("id", "__t1", "__t2", "n_words", "at", F.when(F.col("at") >= 0, starts).alias("starts"))
    per = staged(hit.groupBy("id", "__t1", "__t2").agg(
        F.sum(F.when(F.col("at") < 0, 1).otherwise(0)).alias("copies"), F.max("n_words").cast("long").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("starts"))).alias("windows")), "windows")

    near = staged(per.where(F.size("windows") > 0).select(F.col("__t1").alias("r1"), F.col("__t2").alias("r2"), "windows").dropDuplicates(["r1", "r2"]), "near")
    side = F.broadcast(near) if (near.agg(F.sum(F.size("windows") + 4)).first()[0] or 0) <= MAX_BROADCAST_ROWS else near
    k1, k2 = text_key(F.col(text))
    texts = docs.select(k1.alias("t1"), k2.alias("t2"), F.col(text).alias("text"))
    found = texts.join(side, (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2"))).select("t1", "t2", "windows", words(F.col("text")).alias("w"))
    # a text that many rows share is signed once
    found = found.select("t1", "t2", "w", F.explode("windows").alias("x")).select(
        "t1", "t2", "x.size", "x.start", F.slice("w", F.col("x.start") + 1, F.col("x.width") + SHINGLE - 1).alias("w")).dropDuplicates(["t1", "t2", "size", "start"])
    signed = found.withColumn("own", F.array_distinct(_shingles(F.col("w")))).drop("w")
    signed = signed.select("t1", "t2", "size", "start", "own", F.posexplode(_bands("own")).alias("band", "value"))
    keys = table.select("license", "text_no", "shingles", F.col("size").alias("z"), F.posexplode(_bands("shingles")).alias("b", "v"))
    met = signed.join(F.broadcast(keys), (F.col("size") == F.col("z")) & (F.col("band") == F.col("b")) & (F.col("value") == F.col("v")))
    common = F.size(F.array_intersect("own", "shingles"))
    sure = met.where(common * 10 >= F.col("size") * TENTHS).select("t1", "t2", "license", (common / F.col("size")).alias("share"))
    best = sure.groupBy("t1", "t2", "license").agg(F.max("share").alias("share"))
    best = best.groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("license", "share"))).alias("matches"))
    out = per.join(best, (F.col("__t1") == F.col("t1")) & (F.col("__t2") == F.col("t2")), "left")
    out = out.withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    return out.select("id", "n_words", F.coalesce("matches", F.array().cast("array<struct<license:string,share:double>>")).alias("matches"))
