"""Decontamination, near-duplicates, line dedup, license scans: against plain versions, and on awkward tables."""

from collections import Counter

import pytest
from brute import contamination, dedup_lines, near_classes, shingles
from pyspark.sql import functions as F

from stamina.llm import decontamination, license_scan, line_dedup, ngram_join
from stamina.llm.ngram_join import fewest_matches


@pytest.fixture(scope="module")
def items(spark, nasty):
    text = [r["text"] for r in nasty.where("doc_id = 5").collect()][0].split()
    rows = [(1, " ".join(text[10:40])), (2, " ".join(text[30:35])), (3, None), (4, ""), (None, "WORD"), (6, "never seen words at all"), (1, " ".join(text[100:120])), (7, "ünï Ünï ÜNÏ")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("most", [1_000_000, 5])
def test_contamination_equals_plain_scan(spark, nasty, items, most):
    got = decontamination.scan(nasty, items, max_windows=most).select("id", "n_words", "n_hit", "items", "contaminated").collect()
    rows = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    want = contamination([t for _, t in rows], [tuple(r) for r in items.collect()])
    expect = Counter((i, n, h, tuple(s), h > 0 and 20 * h >= n) for (i, _), (n, h, s) in zip(rows, want))
    assert Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got) == expect


def test_contaminated_documents_and_spans_go(spark, nasty, items):
    kept = decontamination.remove_documents(nasty, items)
    assert kept.columns == nasty.columns
    rows = [tuple(r) for r in nasty.collect()]
    bad = [20 * h >= n and h > 0 for n, h, _ in contamination([r[1] for r in rows], [tuple(r) for r in items.collect()])]
    assert Counter(map(tuple, kept.collect())) == Counter(r for r, b in zip(rows, bad) if not b)
    cut = decontamination.remove_spans(nasty, items)
    assert cut.count() == nasty.count() and cut.columns == nasty.columns
    short = spark.createDataFrame([(1, "..One two, THREE four! five")], "doc_id int, text string")
    two = spark.createDataFrame([(1, "two three")], "item_id int, text string")
    assert decontamination.remove_spans(short, two).first()["text"] == "..One four! five"


def test_contamination_of_empty_tables(spark, nasty, empty, items):
    assert decontamination.scan(empty, items).count() == 0
    assert decontamination.scan(nasty, items.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert decontamination.scan(nasty, items.limit(0)).count() == nasty.count()


@pytest.mark.parametrize("tile", [512, 2])
def test_near_classes_equal_all_pairs(nasty, tile):
    rows = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    got = ngram_join.join(nasty, tile=tile)
    want = near_classes(rows)
    assert Counter((r["id"], r["class_id"], r["n_links"]) for r in got.collect()) == Counter((i, c, n) for (i, _), (c, n) in zip(rows, want))


@pytest.mark.parametrize("tile", [512, 4])
def test_planted_near_copies(spark, tile):
    """Copies with more and more words changed: links must end where the exact similarity does."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(24):
        w = list(base)
        for j in range(k % 8):
            w[(j * 23 + k) % 200] = f"x{k}_{j}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(docs, tile=tile).collect()}
    assert [got[i] for i, _ in rows] == near_classes(rows)


def test_one_of_each_class_stays(nasty, empty):
    kept = ngram_join.keep_first(nasty)
    assert kept.columns == nasty.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    everything = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    classes = {shingles(t) for _, t in everything}
    assert {shingles(t) for _, t in rows} <= classes
    assert Counter(n for _, n in near_classes(rows)) == Counter({0: len(rows)})
    numbered = [(k, t) for k, (_, t) in enumerate(everything)]
    assert len(rows) == len({c for c, _ in near_classes(numbered)})
    assert ngram_join.join(empty).count() == 0 and ngram_join.keep_first(empty).count() == 0


def test_posterior_bounds():
    least = fewest_matches(0.8, 1e-6, 96, 16)
    assert list(least) == [16, 32, 48, 64, 80, 96] and all(0 < m < n for n, m in least.items())
    assert sorted(least.values()) == list(least.values())


def test_line_dedup_equals_direct_comparison(spark, nasty):
    got = {(r["doc_id"], r["text"]): r for r in nasty.select("doc_id", "text").collect()}
    cut = line_dedup.dedup(nasty.withColumn("old", F.col("text")))
    assert cut.columns == [*nasty.columns, "old", "__lines", "__removed"]
    want = dedup_lines(list(got))
    assert cut.count() == nasty.count()
    for r in cut.collect():
        gone = want[r["doc_id"], r["old"]]
        assert list(r["__removed"]) == gone
        lines = r["old"].split("\n") if r["old"] is not None else []
        assert r["__lines"] == len(lines)
        assert r["text"] == (None if r["old"] is None else "\n".join(v for k, v in enumerate(lines) if k not in set(gone)))


@pytest.mark.parametrize("least", [1, 3, 6])
def test_line_dedup_with_short_runs(spark, least):
    import random
    rng = random.Random(least)
    rows = [(i, "\n".join(rng.choice(["a", "b b", "c c c", "", "d"]) for _ in range(rng.randint(0, 14)))) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: list(r["__removed"]) for r in line_dedup.dedup(docs, min_words=least).collect()}
    assert got == {k[0]: v for k, v in dedup_lines(rows, least).items()}


@pytest.mark.parametrize("times", [2, 3])
def test_line_dedup_of_repeated_rows(spark, times):
    """A passage of several lines goes, also from a document whose row comes more than once."""
    passage = "\n".join(" ".join(f"p{k}_{j}" for j in range(15)) for k in range(6))
    other = "\n".join(" ".join(f"q{k}_{j}" for j in range(20)) for k in range(4))
    rows = [(1, "own first line\n" + passage)] + [(2, "another head\n" + passage + "\n\ntail")] * times
    rows += [(None, other)] * times + [(3, other + "\nend")] + [(4, "alone\n" + " ".join(f"z{j}" for j in range(70)))] * times
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("old", F.col("text")).repartition(4)).collect()
    want = dedup_lines(list(dict.fromkeys(rows)))
    assert len(got) == len(rows) and want[rows[1]] == list(range(1, 7)) and want[3, other + "\nend"] == [0, 1, 2, 3]
    assert all(list(r["__removed"]) == want[r["doc_id"], r["old"]] for r in got)


def test_line_dedup_of_nothing(empty):
    assert line_dedup.dedup(empty).count() == 0


def test_license_scan(spark, nasty, empty):
    templates = spark.createDataFrame([("A", " ".join(f"t{i}" for i in range(40))), ("B", "released under the b license"), ("C", "too short"), (None, "x " * 9), ("D", None)],
                                      "license string, text string")
    whole = " ".join(f"t{i}" for i in range(40))
    part = " ".join(f"t{i}" for i in range(34))
    less = " ".join(f"t{i}" for i in range(30))
    noise = " ".join(f"n{i}" for i in range(500))
    docs = spark.createDataFrame([(1, f"{noise} {whole} {noise}"), (2, f"{noise} {part}"), (3, less), (4, f"{noise}. Released under the B license!"), (5, None), (5, None),
                                  (6, "released under the"), (7, f"{whole} {noise} {whole} released under the b license")], "doc_id long, text string")
    got = Counter((r["id"], tuple(m["license"] for m in r["matches"])) for r in license_scan.scan(docs, templates).collect())
    assert got == Counter({(1, ("A",)): 1, (2, ("A",)): 1, (3, ()): 1, (4, ("B",)): 1, (5, ()): 2, (6, ()): 1, (7, ("A", "B")): 1})
    assert license_scan.scan(empty, templates).count() == 0
    assert license_scan.scan(nasty, templates.limit(0)).where(F.size("matches") > 0).count() == 0
    assert license_scan.scan(nasty, templates).count() == nasty.count()
