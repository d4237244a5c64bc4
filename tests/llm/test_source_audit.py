import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stamina.llm import source_audit


def plain(rows, min_docs=10, top=10):
    """The definitions, over (text, lang, source)."""
    docs = [(la or "", so or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))) for t, la, so in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, k in seen.items() if k >= min_docs}
        counts = {so: Counter(t for d in own if d[1] == so for t in d[2] if t in kept) for so in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())

        def shares(c):
            below = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // below for t in kept}

        p, q = {so: shares(c) for so, c in counts.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for so in counts:
            pairs = [(-sum(f(p[so][t], p[x][t]) for t in kept), x.encode()) for x in counts if x != so]
            terms = [(-f(p[so][t], q[t]), t.encode()) for t in kept if counts[so][t] and p[so][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, so, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(ranked)}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        lang, source = rng.choice(["en", "en", "en", "fr", None, ""]), rng.choice(["a", "a", "a", "b", "c", "é", None])
        words = [rng.choice("abcdefghijkl") * rng.randint(1, 2) + rng.choice(["", "é", "Z", "ß"]) for _ in range(int(rng.paretovariate(0.9)) % 90)]
        rows.append((rng.choice([None, ""]) if rng.random() < 0.05 else rng.choice([" ", "1", "\n"]).join(words), lang, source))
    rows += [("only one", "xx", "p"), (None, "xx", "q"), ("!!!", "yy", "r")] + [("same same text", "en", "a")] * 150
    return spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)


@pytest.mark.parametrize("sizes", [None, (40, 3, 7, 2, 16)])
def test_equals_the_definitions(corpus, sizes, monkeypatch):
    if sizes:
        for name, value in zip(("HELD_TERMS", "BUCKET_ROWS", "PART_ROWS", "FAN_IN", "MATRIX_CELLS"), sizes):
            monkeypatch.setattr(source_audit, name, value)
        monkeypatch.setattr(source_audit, "BROADCAST_GROUPS", 0)
        monkeypatch.setattr(source_audit, "SLICE_BYTES", 11)
    rows = [tuple(r) for r in corpus.collect()]
    assert found(source_audit.audit(corpus)) == plain(rows)
    assert found(source_audit.audit(corpus, min_docs=2, top=3)) == plain(rows, 2, 3)


def test_awkward_tables(nasty, empty):
    rows = [tuple(r) for r in nasty.select("text", "lang", "source").collect()]
    clashing = nasty.withColumns({"term": F.lit(1), "n": F.lit("x"), "at": F.lit(None), "rank": F.lit(2.0)})
    assert found(source_audit.audit(clashing, min_docs=2)) == plain(rows, 2)
    assert source_audit.audit(empty).count() == 0


def test_skyband_keeps_all_that_may_lead():
    rng = np.random.default_rng(1)
    for size, high in ((0, 5), (1, 5), (300, 4), (700, 40), (900, 10_000)):
        n, total, spelling = rng.integers(1, high, size), rng.integers(1, high, size), rng.permutation(size)
        dominated = ((n[:, None] >= n) & (total[:, None] <= total) & (spelling[:, None] < spelling)).sum(0)
        for k in (1, 3):
            assert set(source_audit.skyband(n, total, spelling, k).tolist()) == set(np.flatnonzero(dominated < k).tolist())


def test_shares_beyond_64_bits():
    assert source_audit.share(np.array([10**13]), 3 * 10**13).tolist() == [1 + 10**9 * (10**13 + 2) // (3 * 10**13)]
    assert source_audit.share(np.array([5, 7]), np.array([100, 200])).tolist() == [1 + 7 * 10**7, 1 + 45 * 10**6]
