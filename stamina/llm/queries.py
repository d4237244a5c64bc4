"""The registered queries of the operators, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stamina.llm import (crf_quality, decontamination, license_scan, line_dedup, mixing, ngram_join, phrases, pieces, sharding,
                         source_audit, token_counts, url_filter, whitening)
from stamina.llm.common import read, staged
from stamina.session import ensure_checkpoint_dir, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship()
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


SQL_HITS = f"""
  d AS (SELECT doc_id, {SQL_WORDS} AS w FROM {{docs}}),
  i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {SQL_WORDS} AS w FROM benchmark),
  g AS (SELECT DISTINCT item, k, array_to_string(w[p + 1:p + k], ' ') AS g FROM (
    SELECT item, w, least(len(w), 13) AS k, unnest(range(len(w) - least(len(w), 13) + 1)) AS p FROM i WHERE len(w) > 0)),
  dw AS (SELECT doc_id, k, p, array_to_string(w[p + 1:p + k], ' ') AS g FROM (
    SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
  h AS (SELECT doc_id, p, dw.k, item FROM dw JOIN g USING (k, g)),
  n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
  s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id),
  judged AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id)"""


@query("op7_benchmark_decontamination", "WITH" + SQL_HITS.format(docs="documents") + " SELECT * FROM judged")
def _(spark, sf_dir):
    found = decontamination.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _held_out(column):
    return F.crc32(column.cast("string").cast("binary")) % 5 == 0


@query("op3_quality_classifier")
def _(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = crf_quality.train(docs, read(spark, sf_dir, "labels").where(~_held_out(F.col("doc_id"))))
    scored = crf_quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= crf_quality.ACCEPT).cast("int").alias("predicted"))


@query("op4_mixing_sources")
def _(spark, sf_dir):
    taken = mixing.takes(read(spark, sf_dir, "documents"), mixing.cycle_weights)
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "shards")

SHARDS = 24


@query("op6_sharding")
def _(spark, sf_dir):
    # the digest columns are taken before the ranges are sorted, so that no text moves
    docs = read(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("key"), sharding.record_size(F.col("text")).alias("size"),
                                                   F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.assign(docs, SHARDS, F.col("key"), F.xxhash64("doc_id"), F.col("size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("__shard").alias("shard"),
                         F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op5_ngram_jaccard_join")
def _(spark, sf_dir):
    found = ngram_join.join(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links")


@query("op10_document_fingerprints")
def _(spark, sf_dir):
    return phrases.compare_with_next(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: Rules as (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: A small labelled table, written by hand for this query. All hosts end in a reserved name of which no page's host is part.
BLOCKED_URLS = [
    "http://online-casino-bonus.test/en/spin/12", "https://www.royal-casino-slots.test/de/jackpot", "http://poker-casino-club.test/fr/play/3",
    "http://viagra-pharmacy-discount.test/en/order", "https://pills-without-prescription.test/es/buy/7", "http://diet-pills-online.test/en/offer.html",
    "https://hot-adult-videos.test/en/watch/88", "http://www.adult-webcam-girls.test/de/chat", "http://adult-dating-tonight.test/en/join",
    "http://sports-betting-odds.test/en/bets/4", "https://m.live-betting-tips.test/es/bets", "http://best-bets-daily.test/fr/tips/2",
    "http://payday-loans-fast.test/en/apply", "https://www.instant-credit-loans.test/en/apply.html", "http://win-a-free-phone.test/en/claim/1",
    "http://lottery-winner-prize.test/es/claim", "https://free-prize-spinner.test/en/win/9", "http://seo-backlinks-farm.test/en/links/55",
    "http://cheap-backlinks.test/de/links/6", "http://link-farm-directory.test/en/spam/1", "https://ads-pop-tracker.test/en/click/77",
    "http://click-tracker-ads.test/fr/ads/8", "http://banner-ads-network.test/en/ads", "http://cheap-replica-watches.test/en/sale/5"]
ALLOWED_URLS = [
    "https://www.city-library.test/en/books/12", "http://county-museum.test/en/visit.html", "https://garden-notes.test/de/roses/4",
    "https://www.mountain-weather.test/fr/week", "http://river-history.test/es/chapter/3", "https://open-textbooks.test/en/algebra/7",
    "http://village-school.test/de/stundenplan", "https://blog.bread-and-salt.test/en/recipes/31", "http://astronomy-club.test/en/moon/2",
    "https://www.railway-timetables.test/de/plan", "https://news.harbour-times.test/en/2021/05/story.html", "http://folk-songs.test/fr/chansons/8",
    "https://university-press.test/en/journals/19", "http://www.bird-watching.test/en/species/40", "https://docs.sorting-library.test/en/guide/install",
    "http://local-council.test/es/actas/6", "https://chess-openings.test/en/sicilian", "http://marine-biology.test/en/corals/11",
    "https://m.theatre-programme.test/fr/saison", "http://thermal-engineering.test/en/pumps/5", "https://wiki.old-maps.test/de/karten/14",
    "http://translation-forum.test/es/hilo/70", "https://www.health-ministry.test/en/advice/3", "http://knitting-patterns.test/en/scarf/1"]


@query("op1_url_filters")
def _(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    labelled = spark.createDataFrame([(u, 1) for u in BLOCKED_URLS] + [(u, 0) for u in ALLOWED_URLS], "url string, block int")
    judged = url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules, url_filter.train(labelled))
    return judged.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"),
                         F.col("__verdict").alias("verdict"), F.col("__score").alias("score"))


TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_BROADCAST_IDS = 2_000_000


@query("op2_token_counts")
def _(spark, sf_dir):
    """All documents are inserted; toxic ones are deleted; those of bad quality are revised to their distinct lines, a batch that comes twice."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))

    def changes(rows, op):
        """Changes under two tokenizer versions: the byte-level vocabulary, and plain words."""
        rows = rows.withColumn("words", mixing.n_words(F.col("text")))
        counted = token_counts.count_tokens(rows, TOKENIZER_FILE)
        each = F.explode(F.array(F.struct(F.lit("byte_bpe_50k").alias("tokenizer"), "tokens"), F.struct(F.lit("words").alias("tokenizer"), F.col("words").alias("tokens"))))
        return counted.select("doc_id", "source", "lang", each.alias("c")).select("doc_id", "source", "lang", "c.*", F.lit(op).alias("op"), F.lit(0).alias("seq"))

    rollup = token_counts.Rollup(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex[:12]}")
    rollup.apply("load", changes(docs, "insert"))
    toxic = labels.where("toxic = 1").select("doc_id", F.explode(F.array(F.lit("byte_bpe_50k"), F.lit("words"))).alias("tokenizer"))
    none = F.lit(None).cast("string")
    rollup.apply("toxic", toxic.select("*", none.alias("source"), none.alias("lang"), F.lit(0).alias("tokens"), F.lit("delete").alias("op"), F.lit(0).alias("seq")))
    # ids alone are sent to the texts, up to a counted number of them
    ids = staged(labels.where("quality = 0 and coalesce(toxic, 0) <> 1").select("doc_id"), "poor-ids")
    poor = docs.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, "doc_id")
    revised = changes(poor.withColumn("text", F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n")), "revise")
    for _ in range(2):
        rollup.apply("distinct-lines", revised)
    return rollup.totals()


_LINES = r"""
  d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
  l0 AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS v FROM d),
  l AS (SELECT doc_id, line, v, len(regexp_extract_all(v, '[^\x20\x09-\x0D]+')) AS w FROM l0),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS p, sum(w) OVER (PARTITION BY doc_id ORDER BY line) AS c FROM l WHERE w > 0),
  spans AS (
    SELECT a.doc_id, a.p AS s, min(b.p) AS e FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.c - a.c + a.w >= 50 GROUP BY ALL
    UNION SELECT b.doc_id, max(a.p), b.p FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.c - a.c + a.w >= 50 GROUP BY b.doc_id, b.p),
  named AS (SELECT spans.doc_id, s, e, string_agg(v, chr(10) ORDER BY p) AS k FROM spans JOIN n ON n.doc_id = spans.doc_id AND p BETWEEN s AND e GROUP BY ALL),
  later AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM named),
  gone AS (SELECT DISTINCT n.doc_id, line FROM later JOIN n ON n.doc_id = later.doc_id AND p BETWEEN s AND e WHERE nth > 1)"""


@query("op8_line_dedup", "WITH" + _LINES + """
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(gone.line) AS BIGINT) AS n_removed,
    coalesce(string_agg(CAST(gone.line AS VARCHAR), ',' ORDER BY gone.line), '') AS removed_lines,
    sha256(coalesce(string_agg(v, chr(10) ORDER BY l.line) FILTER (gone.line IS NULL), '')) AS kept_sha256
  FROM l LEFT JOIN gone USING (doc_id, line) GROUP BY doc_id""")
def _(spark, sf_dir):
    cut = line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.size("__removed").cast("long").alias("n_removed"),
                      F.array_join(F.col("__removed").cast("array<string>"), ",").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: License notices as (license, text).
LICENSE_TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.")]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("op9_license_scans", "WITH templates(license, text) AS (VALUES " + ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in LICENSE_TEMPLATES) + f"""),
  t AS (SELECT license, row_number() OVER () AS t, {SQL_WORDS} AS w FROM templates),
  ts AS (SELECT DISTINCT license, t, array_to_string(w[p + 1:p + 5], ' ') AS g FROM (SELECT *, unnest(range(len(w) - 4)) AS p FROM t)),
  size AS (SELECT license, t, count(*) AS n, (count(*) + 1) // 2 AS step, count(*) + (count(*) + 1) // 2 - 1 AS width FROM ts GROUP BY ALL),
  d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
  dw AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 5], ' ') AS g FROM (SELECT *, unnest(range(len(w) - 4)) AS p FROM d WHERE len(w) >= 5)),
  hit AS (SELECT doc_id, p, dw.g, size.* FROM dw JOIN ts USING (g) JOIN size ON size.t = ts.t),
  win AS (SELECT doc_id, license, t, n, g, unnest(range(greatest(0, CAST(ceil((p - width + 1) / step) AS BIGINT)), p // step + 1)) AS k FROM hit),
  sure AS (SELECT doc_id, license, t, k, count(DISTINCT g) / any_value(n) AS share FROM win GROUP BY ALL HAVING count(DISTINCT g) * 10 >= any_value(n) * 8),
  best AS (SELECT doc_id, license, max(share) AS share FROM sure GROUP BY ALL),
  own AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses, count(*) AS k, max(share) AS share FROM best GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(k, 0) AS BIGINT) AS n_licenses, coalesce(licenses, '') AS licenses, round(share, 6) AS best_share
  FROM d LEFT JOIN own ON own.doc_id = d.doc_id""")
def _(spark, sf_dir):
    templates = spark.createDataFrame(LICENSE_TEMPLATES, "license string, text string")
    found = license_scan.scan(read(spark, sf_dir, "documents"), templates)
    return found.select(F.col("id").alias("doc_id"), "n_words", F.size("matches").cast("long").alias("n_licenses"),
                        F.array_join("matches.license", ",").alias("licenses"), F.round(F.array_max("matches.share"), 6).alias("best_share"))


def piece_model(path: str | None = None) -> bytes:
    """The model file, read by the driver; by default the public one of 32,000 pieces."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


@query("op13_sentencepiece_coding")
def _(spark, sf_dir):
    model = piece_model()
    coded = pieces.decode(pieces.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), model, packed=True), model)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"))


@query("op11_source_divergence", f"""WITH
  d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
  o AS (SELECT id, lang, source, unnest(w) AS t FROM d),
  k AS (SELECT lang, t, count(*) AS lc FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 10),
  g AS (SELECT DISTINCT lang, source FROM d),
  l AS (SELECT lang, count(t) AS v, coalesce(sum(lc), 0) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
  c AS (SELECT lang, source, t, count(*) AS c FROM o SEMI JOIN k USING (lang, t) GROUP BY ALL),
  dense AS (SELECT g.lang, g.source, k.t, lc, coalesce(c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
  gn AS (SELECT lang, source, sum(c) AS n FROM dense GROUP BY ALL),
  p AS (SELECT dense.*, CAST(1 + CAST(1000000000 AS HUGEINT) * (c + 2) // (gn.n + 2 * v) AS BIGINT) AS p,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (lc + 2) // (l.n + 2 * v) AS BIGINT) AS q FROM dense JOIN gn USING (lang, source) JOIN l USING (lang)),
  s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
  r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', t, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q)
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
  QUALIFY part = 'pair' OR rank <= 10""")
def _(spark, sf_dir):
    return source_audit.audit(read(spark, sf_dir, "documents"))


@query("op12_embedding_whitening")
def _(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings"))
