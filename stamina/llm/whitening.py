"""Whitening of embeddings by the leading principal components.

Entries become whole numbers x = floor(SCALE * c) + SHIFT. Every distinct vector counts once in the fit. Its sums, and the sums of products of
entries centred by the whole number nearest their mean, are exact: tasks multiply blocks small enough that doubles hold every sum, and
add them up as whole numbers. From those the covariance is taken without loss (the mean's remainder is subtracted from the whole sums),
so it doesn't depend on how rows were dealt out. It is brought to tridiagonal form by Householder reflections; leading eigenvalues are
found by bisection on Sturm counts, eigenvectors by inverse iteration, those of close eigenvalues made orthogonal to one another.

The driver holds numbers by the square of the vectors' length, whatever the rows; the components are sent with the tasks and every row
is projected where it lies. Distinct vectors are one shuffle, partly done before it, so that a vector with a third of all rows is a few rows.

Defined results: rows whose vector is null, has null or non-finite entries or entries of 2^40 and more are left out, and so are vectors of
another length than most distinct ones have (of two lengths as frequent, the greater). Components without spread (an eigenvalue that is
zero to rounding) are not returned, so one distinct vector alone, or an empty table, gives no rows. ``deviation`` is null where it is
beyond 64 bits. Repeated rows and null ids give a row each; columns not kept are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stamina.llm.common import staged

SCALE, SHIFT, LARGEST = 64, 1_000_000, 2**40
COMPONENTS = 16
BLOCK_ROWS = 4096
CLUSTER = 1e-3
EXACT = 2**53


@dataclass
class Components:
    """n distinct vectors with sums S and total variance; unit eigenvectors as columns, eigenvalues falling; how far from white the fit is."""

    n: int
    sums: list[int]
    total: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact where it fits 64 bits, else whole Python numbers."""
        sums = np.array(self.sums, object)
        far = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        return x * self.n - sums.astype(np.int64) if far < 2**63 else x.astype(object) * self.n - sums

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n).astype(float) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, whole."""
        d = self.centred(x)
        most = int(np.abs(d).max(initial=0))
        if most * most * max(1, d.shape[1]) < 2**63:
            return (d.astype(np.int64)**2).sum(1).tolist()
        exact = (d.astype(object)**2).sum(1)
        return [int(v) if v < 2**63 else None for v in exact]


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflection vectors) of a symmetric matrix: a = H1 H2 .. T .. H2 H1 with H = 1 - 2 u u'."""
    a, reflections = a.astype(float).copy(), []
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        scale = np.abs(x[1:]).max()
        u = np.zeros(d)
        if scale > 0:
            x[0] += np.copysign(np.linalg.norm(x), x[0])
            u[k + 1:] = x / np.linalg.norm(x)
            p = a @ u
            w = p - u * (u @ p)
            a -= 2 * (np.outer(u, w) + np.outer(w, u))
        reflections.append(u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def sturm_count(diagonal: np.ndarray, squares: np.ndarray, at: np.ndarray, tiny: float) -> np.ndarray:
    """Number of eigenvalues below each of ``at``: the negative terms of the Sturm sequence."""
    count, q = np.zeros(len(at), int), np.ones(len(at))
    for k in range(len(diagonal)):
        q = diagonal[k] - at - (squares[k - 1] / q if k else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` greatest eigenvalues, falling, by bisection down to neighbouring doubles."""
    d = len(diagonal)
    reach = np.r_[0.0, np.abs(off)] + np.r_[np.abs(off), 0.0]
    span = max(np.abs(diagonal - reach).max(), np.abs(diagonal + reach).max(), np.finfo(float).tiny)
    tiny = max(np.finfo(float).eps**2 * span, np.finfo(float).tiny)
    low, high = np.full(k, (diagonal - reach).min() - span * 1e-15), np.full(k, (diagonal + reach).max() + span * 1e-15)
    wanted = d - np.arange(k)                       # the j-th greatest has d - j + 1 values not above it
    for _ in range(120):
        middle = (low + high) / 2
        below = sturm_count(diagonal, off**2, middle, tiny) >= wanted
        high, low = np.where(below, middle, high), np.where(below, low, middle)
        if np.all((high - low) <= np.spacing(np.maximum(np.abs(low), np.abs(high)))):
            break
    return (low + high) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) x = right for a tridiagonal T, by elimination with row exchanges."""
    d = len(diagonal)
    a, b, c = diagonal - shift, np.r_[off, 0.0], np.zeros(d)      # a row: a[k], b[k], c[k] in columns k, k + 1, k + 2
    x = right.copy()
    for k in range(d - 1):
        lower = off[k]
        if abs(lower) > abs(a[k]):
            row = lower, a[k + 1], b[k + 1]
            m = a[k] / lower
            a[k + 1], b[k + 1] = b[k] - m * row[1], c[k] - m * row[2]
            a[k], b[k], c[k] = row
            x[k], x[k + 1] = x[k + 1], x[k] - m * x[k + 1]
        else:
            m = lower / (a[k] if a[k] else tiny)
            a[k] = a[k] if a[k] else tiny
            a[k + 1] -= m * b[k]
            b[k + 1] -= m * c[k]
            x[k + 1] -= m * x[k]
    a = np.where(np.abs(a) < tiny, tiny, a)
    for k in range(d - 1, -1, -1):
        x[k] = (x[k] - (b[k] * x[k + 1] if k + 1 < d else 0.0) - (c[k] * x[k + 2] if k + 2 < d else 0.0)) / a[k]
        if abs(x[k]) > 1e150:
            x /= abs(x[k])
    return x


def leading_eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns; the greatest entry of each is positive."""
    d = len(a)
    k = min(k, d)
    if not a.any():
        return np.zeros(k), np.eye(d)[:, :k]
    diagonal, off, reflections = tridiagonal(a)
    values = leading_values(diagonal, off, k)
    norm = max(np.abs(diagonal).max(initial=0.0) + 2 * np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    tiny, rng = np.finfo(float).eps * norm, np.random.default_rng(0)
    vectors = np.zeros((d, k))
    first = 0
    for j in range(k):
        if j and values[j - 1] - values[j] > CLUSTER * norm:
            first = j
        shift = values[j] - 4 * tiny * (j - first)        # equal eigenvalues are told apart a little
        v = rng.standard_normal(d)
        for _ in range(5):
            v = _solve(diagonal, off, shift, v / np.linalg.norm(v), tiny)
            for _ in range(2):
                v /= np.linalg.norm(v)
                v -= vectors[:, first:j] @ (vectors[:, first:j].T @ v)
        vectors[:, j] = v / np.linalg.norm(v)
    for u in reversed(reflections):
        vectors -= 2 * np.outer(u, u @ vectors)
    vectors /= np.linalg.norm(vectors, axis=0)
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])


def whole(vectors: DataFrame, column: str) -> DataFrame:
    """Rows with a usable vector, which becomes ``__x``: whole numbers."""
    c = F.col(column)
    ok = F.coalesce(F.forall(c, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double")) < LARGEST), F.lit(False))), F.lit(False))
    return vectors.where(ok).withColumn("__x", F.transform(c, lambda e: F.floor(e.cast("double") * SCALE) + SHIFT))


def _matrices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, vectors) in blocks; all vectors have one length."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.column(at).slice(k, BLOCK_ROWS)
            yield k, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _exact_square(y: np.ndarray) -> np.ndarray:
    """y' y in whole numbers: by doubles in blocks that they hold, else by Python numbers."""
    most = int(np.abs(y).max(initial=0))**2
    if most >= EXACT // 64:
        return y.astype(object).T @ y.astype(object)
    rows, out = max(1, min(BLOCK_ROWS, EXACT // max(1, most))), np.zeros((y.shape[1], y.shape[1]), object)
    for k in range(0, len(y), rows):
        part = y[k:k + rows].astype(float)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def _summed(fit_rows: DataFrame, d: int, make) -> np.ndarray:
    """Sum over all blocks of ``make``'s array of ``d`` numbers; whole numbers stay whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, 0):
            part = make(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(v) for v in total.tolist()])], names=["at", "v"])

    rows = fit_rows.mapInArrow(run, "at int, v string").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = np.zeros(d, object)
    for r in rows:
        out[r.at] = int(r.v)
    return out


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Components | None:
    """Components of the distinct vectors; None without rows."""
    distinct = staged(whole(vectors, column).select("__x").distinct(), "distinct-vectors")
    lengths = distinct.groupBy(F.size("__x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    if lengths is None or lengths["d"] == 0:
        return None
    d, n = lengths["d"], lengths["count"]
    rows = distinct.where(F.size("__x") == d)
    sums = _summed(rows, d, lambda x: x.sum(0).astype(object))      # entries are below 2^47, blocks of 2^12 rows
    middle = np.array([(2 * int(s) + n) // (2 * n) for s in sums], np.int64)
    upper = np.triu_indices(d)
    products = _summed(rows, len(upper[0]), lambda x: _exact_square(x - middle)[upper])
    left = [int(s) - n * int(m) for s, m in zip(sums, middle)]                         # sums of the centred entries
    covariance = np.zeros((d, d))
    for i, j, p in zip(*upper, products):
        covariance[i, j] = covariance[j, i] = (n * int(p) - left[i] * left[j]) / (n * n)
    values, basis = leading_eigen(covariance, components)
    spread = values > d * np.finfo(float).eps * max(values.max(), 0.0)
    found = Components(n, [int(s) for s in sums], float(np.trace(covariance)), values[spread], basis[:, spread])
    found.identity_error = _identity_error(rows, found)
    return found


def _identity_error(rows: DataFrame, found: Components) -> float:
    """Largest entry of the whitened fit's covariance minus the identity, from the rows themselves, centred by their own mean."""
    k = len(found.values)
    if not k:
        return 0.0

    def of(make, width: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for _, x in _matrices(batches, 0):
                total += make(found.whiten(x))
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], names=["at", "v"])

        sums = {r.at: r.v for r in rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
        return np.array([sums[i] for i in range(width)])

    mean = of(lambda w: w.sum(0), k) / found.n
    covariance = of(lambda w: ((w - mean).T @ (w - mean)).ravel(), k * k) / found.n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())


def transform(vectors: DataFrame, found: Components, column: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Usable rows with the columns ``keep`` (all others by default) and ``whitened`` (an array) and ``deviation``."""
    new = ("whitened", "deviation")
    kept = [c for c in (vectors.columns if keep is None else keep) if c not in (column, *new)]
    rows = whole(vectors, column).where(F.size("__x") == len(found.sums)).select(*kept, "__x")
    schema = T.StructType([*rows.select(kept).schema.fields, T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())])
    last = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x in _matrices(iter([batch]), last):
                w = found.whiten(x)
                offsets = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32) if w.shape[1] else np.zeros(len(w) + 1, np.int32))
                part = batch.slice(k, len(x))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(last)), pa.ListArray.from_arrays(offsets, pa.array(w.ravel())),
                                                  pa.array(found.deviation(x), pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def whiten(vectors: DataFrame, id_: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    found = fit(vectors, column, components)
    kept = vectors.select(F.col(id_).alias("vec_id"), F.col(column).alias("v"))
    if found is None:
        found = Components(0, [], 1.0, np.zeros(0), np.zeros((0, 0)))
    rows = transform(kept, found, "v")
    explained = F.array(*[F.lit(float(v / found.total)) for v in found.values]) if len(found.values) else F.array().cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
                       F.try_element_at(explained, F.col("at") + 1).alias("explained"), F.lit(found.identity_error).alias("identity_error"))
