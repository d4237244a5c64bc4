import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stamina.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, n int"


def plain(rows, k=16):
    """(vec_id, component) -> (n, deviation, |whitened|, explained), from the definitions with numpy's own decomposition."""
    good = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in good}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = np.array([[float(n * int(c) - int(s)) / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    total = (centred**2).sum() / n
    out = []
    for i, x in good:
        z = np.array([float(n * int(c) - int(s)) / n for c, s in zip(x, sums)])
        for j in range(len(values)):
            if values[j] > 1e-9 * total:
                out.append((i, j + 1, n, sum((n * int(c) - int(s))**2 for c, s in zip(x, sums)), abs(z @ vectors[:, j]) / math.sqrt(values[j]), values[j] / total))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA).repartition(3)


def same(df, rows, k=16):
    found = sorted((r.vec_id is not None, r.vec_id or 0, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in df.collect())
    want = sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in plain(rows, k))
    assert [f[:5] for f in found] == [w[:5] for w in want]
    np.testing.assert_allclose([f[5:] for f in found], [w[5:] for w in want], rtol=1e-6, atol=1e-6)


def test_query_equals_the_definitions(spark):
    path = "/root/testdata/sf0.001"
    df = queries.QUERIES["op12_embedding_whitening"](spark, path).cache()
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    same(df, rows)
    assert df.select("identity_error").distinct().count() == 1 and df.first().identity_error < 1e-9
    signs = {}
    for r in df.collect():
        signs.setdefault(r.component, []).append(r.whitened)
    assert all(min(v) < 0 < max(v) for v in signs.values())


def test_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(0, 1 + i % 3, 5)]) for i in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(40)] + [(None, rows[1][1]), (None, None), (7, rows[2][1]), (7, rows[2][1])]
    rows += [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [math.nan] * 5), (203, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    same(whitening.whiten(table(spark, rows)), rows)
    same(whitening.whiten(table(spark, rows), components=2), rows, 2)
    ragged = rows + [(300, [1.0, 2.0]), (301, []), (302, [1e30] * 5)]
    same(whitening.whiten(table(spark, ragged)), rows)
    kept = whitening.transform(table(spark, rows), whitening.fit(table(spark, rows)))
    assert kept.columns == ["vec_id", "label", "n", "whitened", "deviation"]


def test_no_spread_one_vector_no_rows(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])).count() == 0
    line = [(i, [float(i), 2.0 * i, 3.0]) for i in range(9)]
    same(whitening.whiten(table(spark, line)), line)
    one = [(i, [float(i * i)]) for i in range(5)]
    same(whitening.whiten(table(spark, one)), one)


@pytest.mark.parametrize("kind", ["random", "equal values", "blocks", "zero", "graded"])
def test_eigenvectors(kind):
    rng = np.random.default_rng(3)
    d = 40
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = {"random": rng.random(d), "equal values": np.repeat([5.0, 5.0 - 1e-9, 2.0, 1.0], d // 4), "blocks": np.arange(d, 0, -1.0), "zero": np.zeros(d),
              "graded": 10.0 ** -np.arange(d)}[kind]
    a = np.diag(values) if kind == "blocks" else basis @ np.diag(values) @ basis.T
    a = (a + a.T) / 2
    e, v = whitening.leading_eigen(a, 16)
    np.testing.assert_allclose(e, np.sort(np.linalg.eigvalsh(a))[::-1][:16], atol=1e-13 * max(1, np.abs(values).max()))
    np.testing.assert_allclose(v.T @ v, np.eye(16), atol=1e-12)
    assert np.abs(a @ v - v * e).max() < 1e-13 * max(1, np.abs(values).max()) * d


def test_sums_beyond_doubles():
    y = np.array([[2**40, -(2**39)], [3, 5]], np.int64)
    assert whitening._exact_square(y).tolist() == (y.astype(object).T @ y.astype(object)).tolist()
    z = np.random.default_rng(1).integers(-3000, 3000, (5000, 3))
    assert whitening._exact_square(z).tolist() == (z.T @ z).tolist()
    far = whitening.Components(10**9, [10**15, 10**15], 1.0, np.ones(1), np.ones((2, 1)))
    assert far.deviation(np.array([[10**6, 10**6], [10**6 + 2**20, 10**6]], np.int64)) == [0, None]
