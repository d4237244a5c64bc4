"""Encoding, spans and decoding against the installed library, whose models are not trained here."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from stamina.llm import pieces, queries

LETTERS = [" ", " ", "  ", "a", "e", "th", "▁", "é", "日", "\n", "𝄞", "1", "<", ".", "́", "ing", " the", "①", "ｶ", "ﾞ", "　", "¨", "ﬁ", "Å", "Ⅷ",
           "​", "㌔", "\t", "…", "½", "한", "ᄒ", "ᅡ", "ᆫ", "﻿", " ", "\x00", "#", "###", "<0x0A>", "</s>"]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    return ["", " ", "▁", "   ", "x" * 3000] + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30))) * rng.choice([1, 1, 1, 40]) for _ in range(n)]


@pytest.fixture(scope="module", params=["as it is", "nmt_nfkc", "nfkc_cf"])
def model(request):
    """The public model, also with character maps that the library compiles in (later fields of a model file add to earlier ones)."""
    raw = queries.piece_model()
    return raw if request.param == "as it is" else raw + sentencepiece.SentencePieceNormalizer(rule_name=request.param).serialized_model_proto()


@pytest.mark.parametrize("chunk", [1 << 20, 7, 50])
def test_ids_spans_and_texts_are_the_librarys(model, chunk, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK_BYTES", chunk)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.PieceModel(model)
    for text in random_texts(300):
        ids, begins, ends = own.encode(text.encode())
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text
        found = library.encode(text, return_type="proto").pieces
        assert [(p.id, p.begin, p.end) for p in found] == list(zip(ids.tolist(), begins.tolist(), ends.tolist()))[1:-1], text
        assert own.decode(ids) == library.decode(ids.tolist()), text


def test_any_ids_decode_as_in_the_library():
    model = queries.piece_model()
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.PieceModel(model)
    rng = random.Random(1)
    for _ in range(1000):
        ids = [rng.choice([0, 1, 2, 3, 100, 200, 227, 228, 229, 259, 260, 29871, rng.randrange(32000)]) for _ in range(rng.randint(0, 9))]
        assert own.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_long_words_and_full_memory(monkeypatch):
    model = queries.piece_model()
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.PieceModel(model)
    monkeypatch.setattr(pieces, "KEPT_WORDS", 3)
    rng = random.Random(2)
    for n in (40, 64, 65, 500, 20_000):
        text = "".join(rng.choice("etaoinshr") for _ in range(n))
        assert own.encode(text.encode())[0].tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert len(own.merged) <= 3


def test_bytes_that_are_no_text_become_replacement_characters():
    own = pieces.PieceModel(queries.piece_model())
    ids, begins, ends = own.encode(b"a\xff\xe6\x97 b")
    assert own.decode(ids) == "a��� b"
    assert ends.tolist()[-1] == 6 and begins.tolist() == sorted(begins.tolist())


def test_other_models_are_refused_by_name():
    model = queries.piece_model()
    with pytest.raises(ValueError, match="pair-merge"):
        pieces.PieceModel(model + b"\x12\x02\x18\x01")
    with pytest.raises(ValueError, match="of the user"):
        pieces.PieceModel(model + b"\x0a\x05\x0a\x01q\x18\x04")


def test_unknown_pieces_without_byte_pieces():
    messages = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    parsed = messages.ModelProto.FromString(queries.piece_model())
    kept = [p for p in parsed.pieces if p.type != pieces.BYTE]
    del parsed.pieces[:]
    parsed.pieces.extend(kept)
    parsed.trainer_spec.byte_fallback = False
    model = parsed.SerializeToString()
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.PieceModel(model)
    for text in ["a\n\nb", "\x01\x02 x\x03", "q\n"]:
        ids, begins, ends = own.encode(text.encode())
        found = library.encode(text, return_type="proto").pieces
        assert [(p.id, p.begin, p.end) for p in found] == list(zip(ids.tolist(), begins.tolist(), ends.tolist()))[1:-1], text
        assert own.decode(ids) == library.decode(ids.tolist())


@pytest.mark.parametrize("packed", [True, False])
def test_tables(spark, nasty, empty, packed):
    model = queries.piece_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    clashing = nasty.withColumns({"ids": F.lit(1), "ends": F.lit("x"), "decoded": F.lit(2.0)})
    coded = pieces.decode(pieces.encode(clashing, model, packed=packed), model)
    assert coded.columns == [c for c in nasty.columns if c != "text"] + ["ids", "begins", "ends", "decoded"]
    key = F.coalesce(F.col("doc_id"), F.lit(-1))
    want = sorted((r[0], library.encode(r[1] or "", add_bos=True, add_eos=True)) for r in nasty.select(key, "text").collect())
    unpack = (lambda b: np.frombuffer(b, "<u4").tolist()) if packed else list
    rows = coded.select(key, "ids", "begins", "ends", "decoded").collect()
    assert sorted((r[0], unpack(r[1])) for r in rows) == want
    assert all(len(unpack(r[1])) == len(unpack(r[2])) == len(unpack(r[3])) and r[4] == library.decode(unpack(r[1])) for r in rows)
    assert pieces.decode(pieces.encode(empty, model, packed=packed), model).count() == 0


def test_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    path = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.QUERIES["op13_sentencepiece_coding"](spark, path).collect()}
    for doc_id, text in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert rows[doc_id].n_tokens == len(ids)
        assert rows[doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
