"""Vectors of word and shingle hashes from batches of texts, with numpy inside tasks.

Words are the runs of bytes that are digits, letters (A-Z as a-z) or not ASCII, as in ``common.words``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[65:91] = _IS_WORD[128:] = True
_CODES = np.random.default_rng(11).integers(0, 2**64, 32 * 256, dtype=np.uint64)   # a value for each byte and place


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column, step: int = 1000) -> Iterator[str | None]:
    """The texts of an Arrow column, turned into Python strings a few at a time."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def chunks(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The texts as bytes (null as none), in lists of about ``limit`` bytes and at most 60,000 texts."""
    out, size = [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        out.append(raw)
        size += len(raw)
        if size >= limit or len(out) >= 60_000:
            yield out
            out, size = [], 0
    if out:
        yield out


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text)."""
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    at = np.flatnonzero(_IS_WORD[data])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    size = np.diff(np.concatenate([first, [len(at)]]))
    place = np.arange(len(at)) - np.repeat(first, size)
    code = _CODES[((place & 31) << 8) | _FOLD[data[at]]]
    words = mix(np.add.reduceat(code, first) + size.astype(np.uint64))
    upto = np.searchsorted(at[first], ends)
    return words, np.diff(np.concatenate([[0], upto]))


def shingle_sets(raw: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 48-bit shingle hashes of each text, one text after the other; how many each has).

    A text of fewer than ``n`` words, but some, has one shingle of all its words.
    """
    words, count = word_hashes(raw)
    of = np.repeat(np.arange(len(raw)), count)
    power = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    total = len(words)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    pad = np.concatenate([words, np.zeros(n, np.uint64)])
    doc = np.concatenate([of, np.full(n, -1)])
    acc = np.zeros(total, np.uint64)
    whole = np.zeros(total, np.uint64)
    for j in range(n):
        part = pad[j:j + total] * power[j]
        acc += part
        whole += np.where(doc[j:j + total] == of, part, np.uint64(0))   # of a short text
    full = doc[n - 1:n - 1 + total] == of
    start = np.concatenate([[True], of[1:] != of[:-1]])
    short = start & (count[of] < n)
    value = mix(np.where(short, whole + count[of].astype(np.uint64), acc))
    use = full | short
    key = np.unique((of[use].astype(np.uint64) << np.uint64(48)) | (value[use] >> np.uint64(16)))
    return key & np.uint64((1 << 48) - 1), np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=len(raw))


def minhash(values: np.ndarray, count: np.ndarray, k: int, seed: int) -> np.ndarray:
    """(texts, k) uint32: smallest of ``k`` multiply-shift hashes of each text's values; zeros for a text without any."""
    rng = np.random.default_rng(seed)
    factor, shift = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**64, k, dtype=np.uint64)
    out = np.zeros((len(count), k), np.uint32)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    first = np.concatenate([[0], np.cumsum(count[some])[:-1]])
    spread = mix(values)
    for j in range(k):
        out[some, j] = np.minimum.reduceat(((spread * factor[j] + shift[j]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def digests(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set of values."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0x3C6EF372FE94F82B):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(salt)), dtype=np.uint64)])
        end = np.cumsum(count)
        out.append(mix(total[end] - total[end - count] + count.astype(np.uint64)).view(np.int64))
    return out[0], out[1]
