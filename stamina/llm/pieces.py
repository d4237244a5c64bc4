"""Encoding texts to the pieces of a trained model with the place of every piece in the original bytes, and decoding them again.

A model file names the pieces with their scores, and a compiled character map: a double array of rules whose keys are byte sequences.
A text is rewritten from left to right: at each place the longest rule that fits gives the normal form, elsewhere a character stands for
itself (a byte that is no UTF-8 for U+FFFD). Each byte of the normal form keeps the place of its source, so that the pieces, found
there by merging the best-scored neighbours first, are projected to spans of original bytes.

Pieces never run from another character into a word mark, so what stands between word marks is merged by itself. New words of about a
megabyte of text are merged together, with arrays; results are kept for words seen again, up to a stated number. A long text is normalised a megabyte at a time; only an unfinished word
is carried on. Nothing is shuffled; the model (its size is its vocabulary's) is read by the driver and sent with the tasks.

Defined results: a null or empty text has no pieces but the begin and end marks; repeated rows give repeated rows; an empty table
gives an empty one. Columns that came with the names ``ids``, ``begins``, ``ends`` or ``decoded`` give way to the new ones.
Models other than pair-merge ones, with pieces of the user, with word marks at word ends or without word marks are refused by name.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
CHUNK_BYTES = 1 << 20
KEPT_WORDS = 200_000
KEPT_LETTERS = 64
NEVER = 2**31
OUT_BYTES = 4 << 20
#: Fixed values of the model format: kinds of pieces, and the fields that are read.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_FORMAT = {"piece": {1: "text", 2: "score", 3: "kind"},
           "trainer": {3: "method", 24: "mark_at_end", 35: "byte_fallback", 44: "unknown_text", 46: "begin", 47: "end"},
           "normalizer": {2: "map", 3: "prefix", 4: "squeeze", 5: "marks"}}

def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message in the wire format of protocol buffers."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = struct.unpack("<f" if kind == 5 else "<d", data[at:at + size])[0], at + size
        yield tag >> 3, value


def _message(data: bytes, kind: str) -> dict:
    return {_FORMAT[kind][n]: v for n, v in _fields(data) if n in _FORMAT[kind]}


class CharacterMap:
    """Rules of a compiled map: ``longest(data, at)`` gives (bytes of the key, normal form) or None."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.forms = blob[4 + size:]
        self.starts = bytes(b for b in range(256) if self.units and self._step(self._child(0), b) is not None)
        self.may_start = re.compile(b"[" + re.escape(self.starts) + b"]") if self.starts else None

    def _child(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        at = base ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        found, base = None, self._child(0)
        for k in range(at, len(data)):
            node = self._step(base, data[k])
            if node is None:
                break
            base = self._child(node)
            if self.units[node] >> 8 & 1:
                value = self.units[base] & 0x7FFFFFFF
                found = k + 1 - at, self.forms[value:self.forms.index(b"\0", value)]
        return found


class _Kept(dict):
    """Merged words by their letters; starts anew when it is full, and holds no very long words."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        value = self.make(word)
        if len(word) <= KEPT_LETTERS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value
        return value


class PieceModel:
    """A parsed model: ``encode`` one text to ids and spans, ``decode`` ids to text."""

    def __init__(self, data: bytes):
        codecs.register_error("stamina_bytewise", lambda e: ("�", e.start + 1))
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                pieces.append(_message(value, "piece"))
            elif number == 2:
                trainer |= _message(value, "trainer")
            elif number == 3:
                normalizer |= _message(value, "normalizer")
        self.texts = [p["text"].decode() for p in pieces]
        self.kinds = np.array([p.get("kind", NORMAL) for p in pieces])
        self.scores = {t: p.get("score", 0.0) for t, p, k in zip(self.texts, pieces, self.kinds) if k == NORMAL}
        self.ids = {t: i for i, t in reversed(list(enumerate(self.texts)))}
        self.prefix, self.squeeze = bool(normalizer.get("prefix", 1)), bool(normalizer.get("squeeze", 1))
        self.byte_fallback = bool(trainer.get("byte_fallback", 0))
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        self.begin, self.end = (self.ids[trainer.get(k, v).decode()] for k, v in (("begin", b"<s>"), ("end", b"</s>")))
        self._number_pairs()
        self.map = CharacterMap(normalizer.get("map", b""))
        unfit = [why for why, bad in (
            ("not a pair-merge model", trainer.get("method", 1) != 2), ("pieces of the user", np.isin(self.kinds, [USER, UNUSED]).any()),
            ("word marks at word ends", trainer.get("mark_at_end", 0)), ("no word marks", not normalizer.get("marks", 1)),
            ("pieces that run into a word mark", any(re.search(f"[^{MARK}]{MARK}", t) for t in self.scores))) if bad]
        if unfit:
            raise ValueError(f"model refused: {', '.join(unfit)}")
        self.merged, self.packed = _Kept(self._merge), _Kept(self._pack)
        unknown_text = trainer.get("unknown_text", " ⁇ ".encode())
        self.surfaces = [b"" if k == CONTROL else unknown_text if k == UNKNOWN else bytes([int(t[3:5], 16)]) if k == BYTE
                         else t.replace(MARK, " ").encode() for t, k in zip(self.texts, self.kinds)]

    def _rewrite(self, data: bytes, at: int, limit: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Rewrite ``data`` from ``at`` until ``limit`` is passed: (where it ended, bytes, source place of each, number of its rule's first byte)."""
        parts, places, firsts, n = [], [], [], 0

        def plain(upto: int) -> None:
            nonlocal n
            raw = data[at:upto]
            try:
                raw.decode()
                place = np.arange(at, upto)
            except UnicodeDecodeError:
                text, place, k = raw.decode("utf-8", "stamina_bytewise"), [], 0
                for c in map(str.encode, text):
                    place += [at + k] * len(c)
                    k += len(c) if raw.startswith(c, k) else 1
                raw = text.encode()
            parts.append(raw)
            places.append(np.asarray(place, np.int64))
            firsts.append(np.arange(n, n + len(raw)))
            n += len(raw)

        k = at
        while self.map.may_start and (hit := self.map.may_start.search(data, k, limit)):
            rule = self.map.longest(data, hit.start())
            if rule is None:
                k = hit.start() + 1
                continue
            plain(hit.start())
            size, form = rule
            parts.append(form)
            places.append(np.full(len(form), hit.start()))
            firsts.append(np.full(len(form), n))
            n += len(form)
            at = k = hit.start() + size
        if at < limit:
            plain(limit)
            at = limit
        return at, np.frombuffer(b"".join(parts), np.uint8), np.concatenate(places), np.concatenate(firsts)

    def normalise(self, data: bytes) -> Iterator[tuple[bytes, np.ndarray]]:
        """The normal form with word marks, in parts of whole words: (bytes, source place of each byte and of what follows them)."""
        at, after_space, started = 0, True, False
        held, held_places = b"", np.zeros(0, np.int64)
        while at < len(data):
            limit = min(len(data), at + CHUNK_BYTES)
            while limit < len(data) and data[limit] & 0xC0 == 0x80:
                limit += 1
            at, raw, place, first = self._rewrite(data, at, limit)
            space = raw == 32
            if self.squeeze and len(raw):
                before = np.concatenate([[after_space], space])[first]
                leading = np.cumsum(~space) - np.concatenate([[0], np.cumsum(~space)])[first] == 0
                keep = ~(leading & before)
                after_space = bool(space[-1])
                raw, place, space = raw[keep], place[keep], space[keep]
            if self.prefix and not started and len(raw):
                raw, place, space = np.r_[np.uint8(32), raw], np.r_[place[0], place], np.r_[True, space]
            started |= len(raw) > 0
            held += raw.tobytes().replace(b" ", _MARK)
            held_places = np.concatenate([held_places, np.repeat(place, np.where(space, len(_MARK), 1))])
            if at < len(data):                              # all but the last word is whole
                cut = _before_marks(held, len(held) if held.endswith(_MARK) else held.rfind(_MARK) + len(_MARK))
                if cut:
                    yield held[:cut], held_places[:cut + 1]
                    held, held_places = held[cut:], held_places[cut:]
        end = len(data)
        if self.squeeze and held.endswith(_MARK):
            cut = _before_marks(held, len(held))
            end, held, held_places = int(held_places[cut]), held[:cut], held_places[:cut]
        if held:
            yield held, np.r_[held_places, end]

    def _merge(self, word: str) -> bytes:
        """Pieces of one word, the best-scored neighbours joined first (the leftmost of equals): pairs of id and bytes passed, packed."""
        return b"".join(map(self.packed.__getitem__, self._joined(word)))

    def _pack(self, part: str) -> bytes:
        """Pairs of id and bytes passed of one final piece."""
        raw, id_ = part.encode(), self.ids.get(part)
        if id_ is not None and self.kinds[id_] != UNKNOWN:
            pairs = [(id_, len(raw))]
        elif self.byte_fallback:                            # the last byte carries the character
            pairs = [(self.ids[f"<0x{b:02X}>"], len(raw) if k == len(raw) - 1 else 0) for k, b in enumerate(raw)]
        else:
            pairs = [(self.unknown, len(raw))]
        return b"".join(struct.pack("<2I", *p) for p in pairs)

    def _joined(self, word: str) -> list[str]:
        """One word of any length: a heap of neighbours over a linked list."""
        parts: list[str] = list(word)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < n:
                score = self.scores.get(parts[a] + parts[b])
                if score is not None:
                    heapq.heappush(waiting, (-score, a, b, len(parts[a]) + len(parts[b])))

        for k in range(n - 1):
            offer(k, k + 1)
        while waiting:
            _, a, b, size = heapq.heappop(waiting)
            if not parts[a] or not parts[b] or len(parts[a]) + len(parts[b]) != size:
                continue
            parts[a], parts[b] = parts[a] + parts[b], ""
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return list(filter(None, parts))

    def _number_pairs(self) -> None:
        """Numbers for pieces and for letters inside pieces, and a sorted table of the neighbours that join: key, rank by score, number."""
        normal = [(i, t) for t, i in self.ids.items() if t in self.scores]
        letters = {c: len(self.texts) + k for k, c in enumerate(sorted({c for _, t in normal for c in t} - self.scores.keys()))}
        number = {t: i for i, t in normal} | letters
        self.letter = np.full(0x110000, -1, np.int32)
        for t, i in number.items():
            if len(t) == 1:
                self.letter[ord(t)] = i
        self.numbers = len(self.texts) + len(letters)
        self.sizes = np.array([len(t.encode()) for t in self.texts] + [0] * len(letters), np.uint32)
        order = {v: k for k, v in enumerate(sorted(set(self.scores.values()), reverse=True))}
        found = sorted((number[t[:k]] * self.numbers + number[t[k:]], order[self.scores[t]], i)
                       for i, t in normal for k in range(1, len(t)) if t[:k] in number and t[k:] in number)
        self.pair_keys, self.pair_ranks, self.pair_numbers = (np.array(c, np.int64) for c in (zip(*found) if found else ([], [], [])))
        self.lone = "".join(c for c in "\n\r\t" if self.letter[ord(c)] < 0)        # in no piece: they end a word
        self.words = re.compile(f"{MARK}*[^{MARK}{self.lone}]+|{MARK}+" + (f"|[{self.lone}]" if self.lone else ""))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, number of the joined piece) of neighbours; those that don't join have the rank ``NEVER``."""
        key = left.astype(np.int64) * self.numbers + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        hit = self.pair_keys[at] == key if len(self.pair_keys) else np.zeros(key.shape, bool)
        return np.where(hit, self.pair_ranks[at], NEVER), np.where(hit, self.pair_numbers[at], -1)

    def learn(self, words: set[str]) -> None:
        """Join the letters of many new words at once: in each round every word joins its best pair, so all get shorter by one."""
        new = words - self.merged.keys()
        if len(self.merged) + len(new) > KEPT_WORDS:
            self.merged.clear()
            new = words
        short = sorted((w for w in new if len(w) <= KEPT_LETTERS), key=len)
        for k in range(0, len(short), 2048):
            self._learn(short[k:k + 2048])

    def _learn(self, words: list[str]) -> None:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        parts = np.full((len(words), lengths[-1]), -1, np.int32)
        parts[np.arange(lengths[-1]) < lengths[:, None]] = self.letter[codes]
        own = np.flatnonzero((parts >= 0).sum(1) == lengths)                          # words with other letters are joined one by one
        parts = parts[own]
        rank, joined = self._pairs(parts[:, :-1], parts[:, 1:])
        while len(own):
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(own), np.int64)
            going = rank[np.arange(len(own)), best] < NEVER if rank.shape[1] else np.zeros(len(own), bool)
            self._keep([words[i] for i in own[~going]], parts[~going])
            own, parts, rank, joined, best = own[going], parts[going], rank[going], joined[going], best[going]
            if not len(own):
                break
            rows, width = np.arange(len(own)), parts.shape[1] - 1
            parts[rows, best] = joined[rows, best]
            move = np.arange(width) + (np.arange(width) > best[:, None])
            parts = np.take_along_axis(parts, move, 1)
            rank, joined = np.take_along_axis(rank, move[:, :-1], 1), np.take_along_axis(joined, move[:, :-1], 1)
            for at, some in ((best - 1, best > 0), (best, best < width - 1)):
                r, c = rows[some], at[some]
                rank[r, c], joined[r, c] = self._pairs(parts[r, c], parts[r, c + 1])

    def _keep(self, words: list[str], parts: np.ndarray) -> None:
        pieces = parts < len(self.texts)
        for i in np.flatnonzero(~pieces.all(1)):                                      # a letter that is no piece by itself
            self.merged[words[i]] = self._merge(words[i])
        done = pieces.all(1)
        parts = parts[done]
        flat = parts[parts >= 0]
        raw = np.stack([flat.astype(np.uint32), self.sizes[flat]], 1).astype("<u4").tobytes()
        ends = 8 * np.cumsum((parts >= 0).sum(1))
        at = 0
        for word, end in zip((w for w, d in zip(words, done) if d), ends.tolist()):
            self.merged[word] = raw[at:end]
            at = end

    def encode_all(self, texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``encode`` of each text; new words of about a megabyte of short texts are learned together."""
        waiting, size = [], 0
        for data in texts:
            if len(data) < CHUNK_BYTES:
                waiting.append([(form, places, self.words.findall(form.decode())) for form, places in self.normalise(data)])
                waiting[-1].append(len(data))
                size += len(data)
            if size >= CHUNK_BYTES or len(data) >= CHUNK_BYTES:
                yield from self._waiting(waiting)
                waiting, size = [], 0
            if len(data) >= CHUNK_BYTES:
                yield self.encode(data)
        yield from self._waiting(waiting)

    def _waiting(self, waiting: list[list]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self.learn({w for *forms, _ in waiting for form in forms for w in form[2]})
        for *forms, size in waiting:
            yield self._coded(forms, size)

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids with begin and end marks, first byte, byte after the last) of each piece of a text, as unsigned 32-bit numbers."""
        def forms():
            for form, places in self.normalise(data):
                words = self.words.findall(form.decode())
                self.learn(set(words))
                yield form, places, words
        return self._coded(forms(), len(data))

    def _coded(self, forms: Iterable[tuple[bytes, np.ndarray, list[str]]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, begins, ends = [[self.begin]], [[0]], [[0]]
        for _, places, words in forms:
            packed = b"".join(map(self.merged.__getitem__, words))
            pairs = np.frombuffer(packed, "<u4").reshape(-1, 2)
            passed = np.cumsum(pairs[:, 1], dtype=np.int64)
            ids.append(pairs[:, 0])
            begins.append(places[passed - pairs[:, 1]])
            ends.append(places[passed])
        parts = [np.concatenate(p).astype("<u4") for p in (ids + [[self.end]], begins + [[size]], ends + [[size]])]
        if not self.byte_fallback:                          # neighbouring unknown pieces are one
            unknown = parts[0] == self.unknown
            more = unknown & np.r_[False, unknown[:-1]]
            last = np.flatnonzero(~np.r_[more[1:], False])
            parts = [parts[0][~more], parts[1][~more], parts[2][last]]
        return parts[0], parts[1], parts[2]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks as spaces without the one before the text, runs of byte pieces as UTF-8 (U+FFFD for each byte that is none)."""
        surfaces = list(map(self.surfaces.__getitem__, ids.tolist()))
        if self.prefix or self.squeeze:
            for k in np.flatnonzero(self.kinds[ids] != CONTROL).tolist():
                id_ = int(ids[k])
                if self.kinds[id_] == NORMAL and self.texts[id_].startswith(MARK):
                    surfaces[k] = surfaces[k][1:]
                    if self.squeeze and not surfaces[k]:
                        continue
                break
        return b"".join(surfaces).decode("utf-8", "stamina_bytewise")


_MARK = MARK.encode()


def _before_marks(form: bytes, end: int) -> int:
    """Where the word marks that stand before ``end`` begin."""
    while form.endswith(_MARK, 0, end):
        end -= len(_MARK)
    return end if end >= len(_MARK) else 0


def _packed(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    if pa.types.is_binary(kind):
        return pa.array([a.tobytes() for a in arrays], kind)
    offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(docs: DataFrame, model: bytes, text: str = "text", packed: bool = False) -> DataFrame:
    """``docs`` without the text but with ``ids``, ``begins`` and ``ends``: arrays of int, or, if ``packed``, binaries of little-endian
    unsigned 32-bit numbers. Spans are bytes of the text in UTF-8; of the bytes of one character outside the vocabulary only the last has a span."""
    kept = [c for c in docs.columns if c not in (text, "ids", "begins", "ends")]
    rows = docs.select(*kept, F.col(text).cast("binary").alias(text))
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    schema = T.StructType([*rows.select(kept).schema.fields, *(T.StructField(c, kind) for c in ("ids", "begins", "ends"))])
    arrow = pa.binary() if packed else pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceModel(model)
        for batch in batches:
            yield from _in_parts(batch, lambda texts: coder.encode_all(t or b"" for t in texts), lambda found: sum(a.nbytes for a in found),
                                 lambda found: [_packed([f[k] for f in found], arrow) for k in range(3)], schema.names)

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: bytes, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids have none."""
    packed = encoded.schema[ids].dataType == T.BinaryType()
    kept = [c for c in encoded.columns if c not in (ids, to)] + [ids]
    rows = encoded.select(kept)
    schema = T.StructType([*rows.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceModel(model)

        def text_of(found) -> str | None:
            return None if found is None else coder.decode(np.frombuffer(found, "<u4") if packed else np.asarray(found, np.int64))

        for batch in batches:
            yield from _in_parts(batch, lambda found: map(text_of, found), lambda t: len(t or ""), lambda texts: [pa.array(texts, pa.string())], schema.names, drop=False)

    return rows.mapInArrow(run, schema).select(*[c for c in encoded.columns if c != to], to)


def _in_parts(batch: pa.RecordBatch, make: Callable, size: Callable, columns: Callable, names: list[str], drop: bool = True) -> Iterator[pa.RecordBatch]:
    """``make`` over the values of the last column of ``batch``, given back in batches of a few megabytes."""
    done, last, made, weight = 0, batch.num_columns - 1, [], 0
    for k, value in enumerate(make(batch.column(last)[k].as_py() for k in range(batch.num_rows))):
        made.append(value)
        weight += size(value)
        if weight >= OUT_BYTES or k == batch.num_rows - 1:
            part = batch.slice(done, len(made))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(batch.num_columns - drop)), *columns(made)], names=names)
            done, made, weight = k + 1, [], 0
