"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is labelled good or bad. Its features are counts of its own (letters, digits, symbols, repeated words, ...) and
those of the lines before and after. Marginals from forward and backward sums over the whole text, weighted by line
length, give the share of good text; a two-parameter calibration turns that share into the score.

Only documents are labelled, so lines of good documents count as good, and lines of bad documents are relabelled from the
marginals in a few rounds (at least one line of a bad document stays bad). The fit reads at most ``max_docs`` labelled
documents, picked by a hash of their id, of at most ``max_lines`` lines each; both are limits of the training sample alone.
All other work is done on every line of every document.

Defined results: a null or empty text is one empty line and gets a score like any other. Repeated rows each get the same
score. Labels that are null do not count; several labels of a document vote, ties being good. Without labels of both
kinds every text gets the share of good labels (0.5 without labels). Extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stamina.llm.textvec import texts_of

MAX_TRAINING_DOCS = 2000
MAX_TRAINING_LINES = 2000
ACCEPT = 0.3
CHUNK_BYTES = 1 << 20

UPPER, LOWER, DIGIT, LEAD, CONT, SPACE, PLAIN, SHOUT, ODD = range(9)


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, ODD, np.uint8)
    kind[65:91], kind[97:123], kind[48:58] = UPPER, LOWER, DIGIT
    kind[0x80:0xC0], kind[0xC0:] = CONT, LEAD
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    kind[[ord(c) for c in ".,;:?'\"-()"]] = PLAIN
    kind[ord("!")] = SHOUT
    return kind


KINDS = _byte_kinds()
WORD_CODE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * (KINDS != SPACE)


@dataclass
class Lines:
    """Features of the lines of some texts, one after the other."""

    features: np.ndarray     # lines x features
    weight: np.ndarray       # characters and one
    start: np.ndarray        # first line of each text
    count: np.ndarray        # lines of each text


def line_features(texts: list[str | None]) -> Lines:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    kind = KINDS[data]
    stop = np.flatnonzero(data == 10)
    begin = np.concatenate([[0], stop[:-1] + 1])
    size = np.add.reduceat
    counts = [size(kind == k, begin, dtype=np.int32).astype(np.float64) for k in range(9)]
    chars = sum(counts) - counts[CONT] - 1
    part = 1.0 / np.maximum(chars, 1)
    space = kind == SPACE
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    is_first = np.zeros(len(data), np.int8)
    is_first[first] = 1
    n_words = size(is_first, begin, dtype=np.int32)
    per_word = 1.0 / np.maximum(n_words, 1)
    odd_end = np.zeros(len(stop))
    repeats = np.zeros((2, len(stop)))
    if len(first):
        code = size(WORD_CODE[data], first)
        line = np.repeat(np.arange(len(stop)), n_words)
        last = np.flatnonzero(~space & np.concatenate([space[1:], [True]]))
        odd_end = np.bincount(line, kind[last] >= SHOUT, len(stop))
        near = np.zeros(len(first), bool)
        for lag in (1, 2, 3, 4):
            same = np.zeros(len(first), bool)
            same[lag:] = (code[lag:] == code[:-lag]) & (line[lag:] == line[:-lag])
            if lag == 1:
                repeats[0] = np.bincount(line, same, len(stop))
            near |= same
        repeats[1] = np.bincount(line, near, len(stop))
    letters = counts[UPPER] + counts[LOWER] + counts[LEAD]
    shares = [counts[UPPER] / np.maximum(letters, 1), counts[DIGIT] * part, (counts[SHOUT] + counts[ODD]) * part,
              odd_end * per_word, repeats[0] * per_word, repeats[1] * per_word]
    own = [np.log1p(np.maximum(chars, 0)) / 5, (n_words == 0) * 1.0, (chars < 20) * 1.0, counts[LEAD] * part,
           np.minimum((letters + counts[DIGIT]) * per_word / 10, 3)]
    for s in shares:
        own += [s, (s > 0.08) * 1.0, (s > 0.3) * 1.0]
    x = np.stack(own, 1)
    last_line = np.searchsorted(stop, ends)
    start = np.concatenate([[0], last_line[:-1] + 1])
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[start], after[last_line] = 0, 0
    edge = np.zeros((len(x), 2))
    edge[start, 0], edge[last_line, 1] = 1, 1
    return Lines(np.hstack([x, before, after, edge, np.ones((len(x), 1))]), np.maximum(chars, 0) + 1, start, last_line - start + 1)


def marginals(score: np.ndarray, turn: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected number of each (label, next label) pair.

    All texts advance together, the longest first, so that a step works on those that still have lines.
    """
    order = np.argsort(-count, kind="stable")
    start, count = start[order], count[order]
    good = np.exp(np.clip(score, -30, 30))
    local = np.stack([1 / (1 + good), good / (1 + good)], 1)
    move = np.exp(turn - turn.max())
    n = len(score)
    alpha, beta = np.empty((n, 2)), np.ones((n, 2))
    alive = np.searchsorted(-count, -np.arange(1, count[0] + 1), side="right") if len(count) else np.zeros(0, int)
    for t, k in enumerate(alive):
        at = start[:k] + t
        a = local[at] if t == 0 else (alpha[at - 1] @ move) * local[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for t in range(len(alive) - 2, -1, -1):
        at = start[:alive[t + 1]] + t
        b = (beta[at + 1] * local[at + 1]) @ move.T
        beta[at] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    inner = np.ones(n, bool)
    inner[start] = False
    i = np.flatnonzero(inner)
    pair = alpha[i - 1][:, :, None] * move * (beta[i] * local[i])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return p[:, 1], pair.sum(0)


@dataclass
class Model:
    weights: np.ndarray | None      # None: every text gets ``prior``
    turn: np.ndarray
    slope: float
    offset: float
    prior: float

    def good_share(self, lines: Lines) -> np.ndarray:
        p, _ = marginals(lines.features @ self.weights, self.turn, lines.start, lines.count)
        return np.add.reduceat(p * lines.weight, lines.start) / np.add.reduceat(lines.weight, lines.start)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-(self.slope * _bend(self.good_share(line_features(texts))) + self.offset)))


def _bend(share: np.ndarray) -> np.ndarray:
    """The good share on a scale that spreads out its ends."""
    return np.log(share + 1e-3) - np.log(1 - share + 1e-3)


def _fit_chain(lines: Lines, label: np.ndarray, w: np.ndarray, turn: np.ndarray, steps: int, ridge: float):
    """Maximum likelihood by adaptive gradient steps; starts from ``w`` and ``turn``."""
    inner = np.ones(len(label), bool)
    inner[lines.start] = False
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[i - 1], label[i]), 1)
    n = len(label)
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        p, pairs = marginals(lines.features @ w, turn, lines.start, lines.count)
        g = np.concatenate([lines.features.T @ (label - p) / n - ridge * w, ((seen - pairs) / n - ridge * turn).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        d = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)
        w, turn = w + d[:-4], turn + d[-4:].reshape(2, 2)
    return w, turn


def fit(texts: list[str | None], quality: np.ndarray, rounds: int = 3, steps: int = 60, ridge: float = 1e-4) -> Model:
    """Fit on a bounded sample that the caller holds in memory."""
    prior = float(np.mean(quality)) if len(quality) else 0.5
    if not len(quality) or not 0 < prior < 1:
        return Model(None, np.zeros((2, 2)), 0, 0, prior)
    lines = line_features(texts)
    of = np.repeat(np.arange(len(texts)), lines.count)
    bad = quality[of] == 0
    label = quality[of].astype(int)
    w, turn = np.zeros(lines.features.shape[1]), np.zeros((2, 2))
    for k in range(rounds):
        w, turn = _fit_chain(lines, label, w, turn, steps, ridge)
        if k < rounds - 1:
            p, _ = marginals(lines.features @ w, turn, lines.start, lines.count)
            worst = np.minimum.reduceat(p, lines.start)[of]
            label = np.where(bad, (p > 0.5) & (p > worst), 1).astype(int)
    model = Model(w, turn, 1.0, 0.0, prior)
    z = _bend(model.good_share(lines))
    ab = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):                                   # Newton with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        ab = ab + np.clip(np.linalg.solve(h, x.T @ (quality - p) - 1e-2 * (ab - [1, 0])), -2, 2)
    model.slope, model.offset = max(float(ab[0]), 1e-3), float(ab[1])
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality",
          max_docs: int = MAX_TRAINING_DOCS, max_lines: int = MAX_TRAINING_LINES) -> Model:
    """Fit on a sample of the labelled documents, at most about ``max_docs`` of them wherever they lie."""
    votes = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(
        (F.avg(quality) >= 0.5).cast("int").alias("__q"))
    share = min(1.0, max_docs / max(1, votes.count()))
    picked = votes.where((F.pmod(F.xxhash64("__id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000)))
    lines = F.size(F.split(F.col("__text"), "\n", -1))
    sample = (docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(picked, "__id")
              .where(F.coalesce(lines, F.lit(1)) <= max_lines).dropDuplicates(["__id"]).orderBy("__id"))
    rows = sample.select("__text", "__q").collect()
    return fit([r[0] for r in rows], np.array([r[1] for r in rows], float))


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the score of each text in column ``to``, in place of a column of that name."""
    docs = docs.drop(to)
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, chunk, size = [], [], 0
            for t in texts_of(batch.column(at)):
                chunk.append(t)
                size += len(t or "") + 1
                if size >= CHUNK_BYTES:
                    out.append(model.score(chunk))
                    chunk, size = [], 0
            if chunk:
                out.append(model.score(chunk))
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*names, to])

    return docs.mapInArrow(run, docs.withColumn(to, F.lit(0.0)).schema)


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The documents whose score reaches ``accept``, all columns as they came."""
    model = train(docs, labels, doc_id, text, **kw)
    return score(docs, model, text, "__score").where(F.col("__score") >= accept).select(docs.columns)
