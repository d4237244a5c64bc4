"""Mixing, sharding, token counts, URL filter, quality, fingerprints: laws, plain versions, awkward tables."""

import hashlib
import random
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stamina.llm import crf_quality, mixing, phrases, queries, sharding, token_counts, url_filter
from stamina.session import ensure_checkpoint_dir


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


# mixing

def plain_targets(sizes, weights, most=3.0):
    """Hand out all words by weight; cap, and share the excess again."""
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else share[s] for s in sizes}
        full |= over


def test_mix_meets_its_targets(spark, nasty):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * 1 for _ in range(int(rng.paretovariate(1.2) * 10) % 3000)), None if i % 50 == 0 else f"s{min(i % 9, 4)}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.takes(docs, mixing.cycle_weights, shards=6, block_docs=20).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += n_words(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = plain_targets(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert len(r["shards"]) * r["size"] == r["taken"] and all(0 <= s < 6 for s in r["shards"])
    assert len(got) == len(rows)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 5
    again = mixing.takes(docs.repartition(7), mixing.cycle_weights, shards=6, block_docs=20).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_splitting_tree_keeps_quotas(spark):
    quota = {"a": 1000, "b": 37, "": 400, "c": 1}
    root = spark.createDataFrame([(0, 7, s, q, s) for s, q in quota.items()], "low int, high int, source string, quota long, order string")
    leaves = mixing._split_nodes(root, 7, 5).collect()
    assert {(r["low"], r["high"]) for r in leaves} == {(k, k + 1) for k in range(7)}
    by_source, by_shard = Counter(), Counter()
    for r in leaves:
        by_source[r["source"]] += r["quota"]
        by_shard[r["low"]] += r["quota"]
    assert dict(by_source) == quota and max(by_shard.values()) - min(by_shard.values()) <= 1
    a = [r["quota"] for r in leaves if r["source"] == "a"]
    assert np.std(a) < 15 and abs(np.mean(a) - 1000 / 7) < 1e-6       # hypergeometric: deviation of about 6


def test_nearest_sum():
    rng = np.random.default_rng(4)
    for _ in range(30):
        size, n = rng.integers(1, 60, 25), np.ones(25, int)
        gap = float(rng.integers(0, size.sum()))
        took = mixing.nearest(size, n, gap)
        assert ((took >= 0) & (took <= n)).all() and abs((took * size).sum() - gap) <= 1
    assert mixing.nearest(np.array([10, 0]), np.array([1, 1]), 3.0).sum() == 0


def test_nearest_sum_of_repeated_rows():
    assert mixing.nearest(np.array([10]), np.array([1000]), 5000.0).tolist() == [500]
    assert mixing.nearest(np.array([7]), np.array([10**9]), 3.5e9).tolist() == [500_000_000]
    rng = np.random.default_rng(6)
    for most in (2, 50, 100_000):
        for _ in range(10):
            size, n = rng.integers(1, 60, 25), rng.integers(1, most, 25)
            gap = float(rng.integers(0, (size * n).sum()))
            took = mixing.nearest(size, n, gap)
            assert ((took >= 0) & (took <= n)).all() and abs((took * size).sum() - gap) <= 1
    took = mixing.nearest(np.array([3, 0, 5]), np.array([4, 1000, 4]), 21.0)
    assert took[0] * 3 + took[2] * 5 == 21


def test_targets_with_repeated_rows(spark):
    """A source of one row a thousand times, one of null ids, and one of rows that come fifty times."""
    rows = [(1, "w " * 10, "one")] * 1000 + [(None, "v " * 10, "null")] * 1000
    rows += [(i, "u " * (5 + i % 11), "fifty") for i in range(20)] * 50 + [(i, "t " * 10, "single") for i in range(100, 1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weigh = lambda s: s.withColumn("weight", F.when(F.col("source") == "single", 3.0).otherwise(1.0))
    taken, target = Counter(), {}
    for r in mixing.takes(docs, weigh, shards=4).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    mixed = Counter()
    for r in mixing.mix(docs, weigh, shards=4).collect():
        mixed[r["source"]] += n_words(r["text"])
    assert mixed == taken and target["one"] < 10_000
    for s in target:
        assert abs(taken[s] - target[s]) <= 5, s


def test_mixed_rows(nasty, empty):
    out = mixing.mix(nasty, mixing.cycle_weights, shards=3, block_docs=4)
    assert out.columns == nasty.columns
    copies = Counter(map(tuple, out.collect()))
    there = Counter(map(tuple, nasty.collect()))
    assert set(copies) <= set(there) and all(copies[r] <= 3 * there[r] for r in copies)
    taken = Counter()
    for r in mixing.takes(nasty, mixing.cycle_weights, shards=3, block_docs=4).collect():
        taken[r["id"], r["source"]] += r["taken"]
    mixed = Counter()
    for r, k in copies.items():
        mixed[r[0], r[3]] += k * n_words(r[1])
    assert {k: v for k, v in mixed.items() if v} == {k: v for k, v in taken.items() if v}
    assert mixing.mix(empty, mixing.cycle_weights).count() == 0 and mixing.takes(empty, mixing.cycle_weights).count() == 0


# sharding

def laws(rows, shards):
    slots = defaultdict(list)
    size = Counter()
    for r in rows:
        slots[r["__shard"]].append(r["__slot"])
        size[r["__shard"]] += r["__size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < shards for s in slots)
    return [size[k] for k in range(shards)]


def test_shards_are_even_and_keep_copies(spark):
    rng = random.Random(2)
    texts = [f"text {i} " * rng.randint(1, 40) for i in range(1500)] + ["copy of one " * 20] * 1200 + ["few"] * 9
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard(docs, 6).collect()
    sizes = laws(rows, 6)
    assert len(rows) == len(texts) and max(sizes) < 1.06 * np.mean(sizes) and min(sizes) > 0.94 * np.mean(sizes)
    where = defaultdict(set)
    for r in rows:
        assert r["__size"] == len(r["text"].encode()) + 8
        where[r["text"]].add(r["__shard"])
    assert max(len(s) for t, s in where.items() if not t.startswith("copy")) == 1 and len(where["copy of one " * 20]) > 1
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shard(docs.repartition(5), 6).collect()))


def test_shards_of_awkward_tables(nasty, empty, spark):
    rows = sharding.shard(nasty, 4).collect()
    laws(rows, 4)
    assert len(rows) == nasty.count() and sharding.shard(nasty, 4).columns[:12] == nasty.columns
    assert sharding.shard(empty, 4).count() == 0
    laws(sharding.shard(spark.createDataFrame([(1, "only")], "doc_id long, text string"), 4).collect(), 4)
    same = spark.createDataFrame([(1, "same")] * 500, "doc_id long, text string")
    sizes = laws(sharding.shard(same, 3).collect(), 3)
    assert len(sizes) == 3 and max(sizes) < 1.4 * min(sizes)


def test_repeated_rows_are_dealt_to_all_shards(spark):
    rows = [(i, f"text {i} " * 5) for i in range(200)] + [(7, "again and again " * 3)] * 800
    sizes = laws(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect(), 8)
    assert max(sizes) < 1.1 * np.mean(sizes) and min(sizes) > 0.9 * np.mean(sizes)


def test_ranges_are_bounded_in_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_RANGE_ROWS", 100)
    rows = [(i, None if i % 2 else f"text {i}") for i in range(12_000)] + [(None, None)] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string").select(F.xxhash64("text").alias("k"), F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("t"), sharding.record_size(F.col("text")).alias("size"))
    load, total = sharding.loads(df, "size", 4)
    dealt = sharding.dealt_repeats(df, "k", "t", load("size"), "test").cache()
    number = sharding._range_of(sharding.split_points(dealt, load("size"), total))
    assert dealt.count() == len(rows) and max(r["count"] for r in dealt.groupBy(number("k", "t")).count().collect()) <= sharding.WHOLE_KEY * 100
    laws(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect(), 4)


def test_written_shards(nasty, spark):
    path = f"{ensure_checkpoint_dir(spark)}/written-shards-{uuid.uuid4().hex}"
    sharding.write_shards(nasty, path, 3)
    assert spark.read.parquet(path).count() == nasty.count()


# token counts

def test_rollup_follows_its_batches(spark):
    schema = "doc_id long, tokenizer string, op string, source string, lang string, tokens long, seq int"
    folder = f"{ensure_checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}"
    rollup = token_counts.Rollup(spark, folder)
    assert rollup.totals().count() == 0
    batches = [
        ("one", [(1, "v", "insert", "a", "x", 10, 0), (2, "v", "insert", "a", "x", 5, 0), (3, "v", "insert", None, "x", None, 0), (1, "u", "insert", "a", "x", 7, 0),
                 (4, "v", "insert", "b", None, 9, 0), (4, "v", "revise", "b", None, 11, 1), (None, "v", "insert", "a", "x", 99, 0)]),
        ("two", [(1, "v", "revise", "a", "x", 4, 0), (2, "v", "delete", None, None, None, 0), (9, "v", "delete", "a", "x", 3, 0), (4, "v", "revise", "c", "z", 2, 0)]),
        ("none", []),
        ("three", [(2, "v", "insert", "b", "x", 6, 0), (1, "v", "insert", "a", "x", 8, 0), (3, "v", "delete", None, None, None, 0), (3, "v", "delete", None, None, None, 0)])]
    state = {}
    for name, changes in batches:
        df = spark.createDataFrame(changes, schema)
        assert rollup.apply(name, df) and not rollup.apply(name, df)
        for d, z, op, s, g, n, _ in sorted((c for c in changes if c[0] is not None), key=lambda c: c[6]):
            if op == "delete":
                state.pop((d, z), None)
            else:
                state[d, z] = (s, g, n or 0)
        want = Counter()
        docs = Counter()
        for (d, z), (s, g, n) in state.items():
            want[s, g, z] += n
            docs[s, g, z] += 1
        got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in token_counts.Rollup(spark, folder).totals().collect()}
        assert got == {k: (docs[k], want[k]) for k in docs}
    # an attempt that died before its marker leaves no trace
    spark.createDataFrame([("q", "q", "v", 1, 1)], token_counts.DELTAS).write.parquet(f"{folder}/attempts/four/deltas")
    assert got == {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}


CHANGES = "doc_id long, tokenizer string, op string, source string, lang string, tokens long, seq int"


def test_two_committers_from_one_state(spark, monkeypatch):
    """The second one saw the log as it was before the first one's commit."""
    rollup = token_counts.Rollup(spark, f"{ensure_checkpoint_dir(spark)}/race-{uuid.uuid4().hex}")
    rollup.apply("insert", spark.createDataFrame([(1, "v", "insert", "a", "x", 10, 0)], CHANGES))
    stale = rollup._log()
    rollup.apply("first", spark.createDataFrame([(1, "v", "revise", "a", "x", 20, 0)], CHANGES))
    real, seen = rollup._log, []

    def log(kind="commits"):
        if kind == "commits" and len(seen) < 2:
            seen.append(1)
            return stale
        return real(kind)

    monkeypatch.setattr(rollup, "_log", log)
    assert rollup.apply("second", spark.createDataFrame([(1, "v", "revise", "a", "x", 30, 0)], CHANGES)) and len(seen) == 2
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "x", "v", 1, 30)] and rollup.ledger().first()["tokens"] == 30
    assert rollup.committed() == ["insert", "first", "second"]


def test_ties_refused_rows_and_compaction(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "COMPACT_EVERY", 3)
    rollup = token_counts.Rollup(spark, f"{ensure_checkpoint_dir(spark)}/ties-{uuid.uuid4().hex}")
    rows = [(1, "v", "insert", "a", "x", 5, 0), (1, "v", "insert", "b", "x", 5, 0), (2, "v", "delete", None, None, None, 0), (2, "v", "insert", "a", "x", 7, 0),
            (None, "v", "insert", "a", "x", 99, 0)]
    for k, order in enumerate((rows, rows[::-1])):
        assert rollup.apply(f"load{k}", spark.createDataFrame(order, CHANGES).coalesce(1))
        assert [tuple(r) for r in rollup.totals().collect()] == [("b", "x", "v", 1, 5)]
    for k in range(6):
        assert rollup.apply(f"more{k}", spark.createDataFrame([(10 + k, "v", "insert", "b", "x", 1, 0), (1, "v", "revise", "b", "x", k, 0)], CHANGES))
        assert [tuple(r) for r in rollup.totals().collect()] == [("b", "x", "v", 2 + k, k + k + 1)]
    assert len(rollup._log("bases")) == 2 and not rollup.apply("load0", spark.createDataFrame(rows, CHANGES))
    assert [(r["tokens"], r["batch"]) for r in rollup.refused().orderBy("batch").collect()] == [(99, "load0"), (99, "load1")]


def test_token_counts(spark, nasty, empty):
    import tiktoken
    import base64
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=token_counts.BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = token_counts.count_tokens(nasty.select("doc_id", F.col("text").alias("kept"), "text", F.lit("x").alias("tokens")), path).collect()
    assert all(r["tokens"] == (len(coder.encode_ordinary(r["kept"])) if r["kept"] else 0) for r in got) and len(got) == nasty.count()
    assert token_counts.count_tokens(empty, path).count() == 0


# URL filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("a.b.com", "/fr/x", "block"), (None, "/", "block")]


def plain_rule(url):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", after)[0]
    path = re.split(r"[?#]", after[len(host):])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, None)))


def test_url_rules_and_model(spark):
    urls = [None, "", "no scheme", "http://", "http://X.Example.ORG/es/1", "https://example.org/es", "http://example.org/en/12?q=/es/", "http://notexample.org/en/1",
            "http://www.b.com/fr/x", "http://a.b.com/fr/x#y", "http://org", "http://org/", "ftp://u:p@é.Org:80/a://b", "http://a.com?x=http://b.org/", "HTTP://COM/FR/", "x" * 50_000,
            "http://" + "a." * 3000 + "org/p", "http://example.org/es/1"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    labelled = spark.createDataFrame([(f"http://pills{i}.example.com/buy/{i}", 1) for i in range(9)] + [(f"http://garden{i}.example.net/rose/{i}", 0) for i in range(9)] + [("u", None)],
                                     "url string, block int")
    model = url_filter.train(labelled)
    got = url_filter.judge(pages, rules, model)
    assert got.columns == [*pages.columns, "__host", "__path", "__rule", "__score", "__verdict"]
    for r in got.collect():
        host, path, rule, verdict = plain_rule(r["url"])
        assert (r["__host"], r["__path"], r["__rule"]) == (host, path, rule)
        assert r["__verdict"] == (verdict or ("block" if r["__score"] >= 0.5 else "allow"))
    new = spark.createDataFrame([(1, "http://cheap-pills.example.org/buy/now"), (2, "http://garden-rose.example.org/rose/8")], "page_id long, url string")
    assert [r["__verdict"] for r in url_filter.judge(new, rules.limit(0), model).orderBy("page_id").collect()] == ["block", "allow"]
    assert url_filter.judge(pages.limit(0), rules, model).count() == 0
    none = url_filter.train(labelled.limit(0))
    assert {r["__score"] for r in url_filter.judge(pages, rules, none).collect()} == {0.0}


# quality

def test_labelled_urls_are_not_those_that_are_judged(spark):
    labelled = [u.split("://")[1].split("/")[0] for u in queries.BLOCKED_URLS + queries.ALLOWED_URLS]
    assert len(set(labelled)) == len(labelled)
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select(url_filter.host_of(F.col("url"))).distinct()
        assert not {r[0] for r in pages.collect()} & set(labelled)


def test_model_judges_hosts_it_has_not_seen(spark):
    """Precision and recall on a second hand-written table that shares no host with the first."""
    block = ["http://grand-casino-night.test/en/1", "https://discount-pharmacy-pills.test/de/5", "http://free-adult-stream.test/en/9", "http://football-bets-now.test/es/2",
             "https://quick-loans-today.test/en/apply", "http://lucky-lottery-prize.test/fr/claim", "http://spam-links-farm.test/en/3", "http://ads-click-tracker.test/en/4"]
    allow = ["https://national-library.test/en/books/2", "http://village-museum.test/de/besuch", "https://rose-garden.test/en/roses/1", "http://school-history.test/fr/3",
             "https://weather-station.test/en/week", "http://bird-songs.test/es/7", "https://press.biology-journal.test/en/19", "http://old-railway-maps.test/de/plan"]
    assert not {u.split("/")[2] for u in block + allow} & {u.split("/")[2] for u in queries.BLOCKED_URLS + queries.ALLOWED_URLS}
    labelled = spark.createDataFrame([(u, 1) for u in queries.BLOCKED_URLS] + [(u, 0) for u in queries.ALLOWED_URLS], "url string, block int")
    model = url_filter.train(labelled)
    rows = spark.createDataFrame([(u, u in block) for u in block + allow], "url string, bad boolean")
    judged = url_filter.judge(rows, spark.createDataFrame([], "host string, path string, verdict string"), model).collect()
    hit = sum(r["bad"] and r["__verdict"] == "block" for r in judged)
    said = sum(r["__verdict"] == "block" for r in judged)
    assert hit / len(block) >= 0.85 and hit / max(1, said) >= 0.85


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    score, turn = rng.normal(size=9) * 2, rng.normal(size=(2, 2))
    start, count = np.array([0, 4, 5]), np.array([4, 1, 4])
    p, pairs = crf_quality.marginals(score, turn, start, count)
    want, seen = [], np.zeros((2, 2))
    for s, n in zip(start, count):
        total, good, moves = 0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(score[s + k] * y[k] for k in range(n)) + sum(turn[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            good += w * np.array(y)
            for k in range(1, n):
                moves[y[k - 1], y[k]] += w
        want += list(good / total)
        seen += moves / total
    assert np.allclose(p, want) and np.allclose(pairs, seen)


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    from stamina.llm import queries
    got = queries.QUERIES["op3_quality_classifier"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95 and got.count() > 40
    kept = crf_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.join(labels.where("quality = 1"), "doc_id").count() > 0.98 * labels.where("quality = 1").count()


def test_quality_of_awkward_tables(spark, nasty, empty):
    labels = spark.createDataFrame([(5, 1), (6, 1), (15, 0), (15, 0), (17, 0), (7, None), (None, 1)], "doc_id long, quality int")
    model = crf_quality.train(nasty, labels)
    got = crf_quality.score(nasty, model)
    rows = got.collect()
    assert len(rows) == nasty.count() and all(0 <= r["score"] <= 1 for r in rows) and sorted(got.columns) == sorted(nasty.columns)
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["text"] or ""].add(round(r["score"], 9))
    assert all(len(s) == 1 for s in by_text.values())
    assert crf_quality.score(empty, model).count() == 0
    flat = crf_quality.train(nasty, labels.limit(0))
    assert {r["score"] for r in crf_quality.score(nasty, flat).collect()} == {0.5}
    assert crf_quality.train(empty, labels).score(["a"]) == [0.5]


# fingerprints

def test_equal_parts_get_equal_phrases():
    rng = random.Random(8)
    part = "".join(rng.choice("abcdefgh ") for _ in range(4000)).encode()
    a = phrases.sketches([part])[0]
    for shift in (1, 2, 7, 64):
        moved = phrases.sketches([bytes(rng.choices(range(97, 110), k=shift)) + part])[0]
        assert phrases.likeness(a, moved) > 0.9
    other = phrases.sketches(["".join(rng.choice("abcdefgh ") for _ in range(4000)).encode()])[0]
    assert phrases.likeness(a, other) < 0.2
    together = phrases.sketches([part, b"", b"x", b"x" * 5000, part, b"ab" * 3000])
    assert (together[0] == a).all() and (together[4] == a).all() and len(together[1]) == 0 and all(len(together[k]) for k in (2, 3, 5))
    assert phrases.likeness(together[1], together[1]) == 1 and phrases.likeness(together[1], a) == 0


def test_repetitive_texts_keep_their_small_phrases():
    """A paragraph repeated often has the phrases of the same paragraph repeated a few times."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(40)]
    part = (" ".join(words)[:100] + "\n").encode()
    few, many = phrases.sketches([part * 6])[0], phrases.sketches([part * 400])[0]
    assert phrases.likeness(few, many) > 0.8
    prose = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(2000)).encode()
    together = phrases.sketches([part * 400, prose, part * 6, b"x"])
    assert (together[0] == many).all() and (together[2] == few).all() and len(together[1]) == phrases.SKETCH and (together[1] < 1 << 31).all()


def plain_fingerprints(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (ident, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1] or ""
        text = text or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, changed, follow = (phrases.sketches([t.encode()])[0] for t in (text, edited, after))
        out[ident] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), phrases.to_text(own), phrases.to_text(changed), phrases.likeness(own, changed), phrases.likeness(own, follow))
    return out


@pytest.mark.parametrize("size", [3, 2000])
def test_next_documents(spark, size, monkeypatch):
    monkeypatch.setattr(phrases, "RANGE_ROWS", size)
    rng = random.Random(size)
    rows = [(i * 3 - 50, None if i == 7 else "".join(rng.choice("abé 𝄞\n") for _ in range(rng.choice([0, 1, 5, 300])))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: tuple(r)[1:] for r in phrases.compare_with_next(docs).collect()}
    assert got == plain_fingerprints(rows)


def test_repeated_rows_are_dealt_to_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANGE_ROWS", 100)
    rows = [(i, f"text {i}") for i in range(300)] + [(None, None)] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = phrases.with_next(df).where("not extra").groupBy("range").count().collect()
    assert max(r["count"] for r in sizes) < 500 and phrases.compare_with_next(df).count() == 1200


def test_ids_that_are_no_numbers_are_refused(spark):
    with pytest.raises(ValueError, match="doc_id"):
        phrases.compare_with_next(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_fingerprints_of_awkward_tables(spark, nasty, empty):
    got = phrases.compare_with_next(nasty).collect()
    assert len(got) == nasty.count()
    assert phrases.compare_with_next(empty).count() == 0
    one = phrases.compare_with_next(spark.createDataFrame([(1, "alone here")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    prints = nasty.select("text", phrases.fingerprint("text").alias("f")).collect()
    assert all(r["f"] == phrases.to_text(phrases.sketches([(r["text"] or "").encode()])[0]) for r in prints)
