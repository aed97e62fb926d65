"""Piece ids and texts against the sentencepiece library itself."""

from __future__ import annotations

import hashlib
import os
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tyche.llm.pieces import PieceCoder, decode_pieces, encode_pieces
from tyche.llm.queries import QUERIES
from tyche.llm.shared import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a ", "▁", "a▁ b", "\n\n x", "\r\n", "a\x00b", "<s>", "</s> <0x41><unk>", "日本語 と", "😀 😀a", "áé", "  　x", "퟿"]


@pytest.fixture(scope="module")
def own():
    return PieceCoder(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*" \n\tabcehtinr.é日本\x00▁😀", "the", "   ", "<s>", "<0x41>", "ing", "▁▁", "\r\n", "aaaa"]), max_size=40))
def test_any_text(own, library, parts):
    text = "".join(parts)
    assert own.encode(text).tolist() == library.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_characters(own, library, text):
    assert own.encode(text).tolist() == library.encode(text)


def test_rows_of_pieces(own, library):
    rng = random.Random(1)
    pieces = list(own.ids)
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 6)))
        assert own.encode(text).tolist() == library.encode(text)


def test_long_texts_without_spaces(own, library):
    rng = random.Random(2)
    pieces = [p for p in own.ids if "▁" not in p]
    for text in (" " * 50_000, "a" * 100_001, "日本語" * 20_000, "".join(rng.choices(pieces, k=20_000)), "\U0001f600" * 5000, *ODD):
        assert own.encode(text).tolist() == library.encode(text)


def test_caches_stay_bounded_and_change_nothing(library):
    own = PieceCoder(MODEL)
    own.words.most = own.cores.most = own.fits.most = 7
    text = "some words come back and some words do not, unlike others " * 3
    assert own.encode(text).tolist() == library.encode(text) and len(own.words) <= 7 and len(own.fits) <= 7


def test_a_model_of_another_kind_is_an_error(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as model_file

    model = model_file.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        PieceCoder(str(tmp_path / "other.model"))


def test_tables(spark, library):
    rows = list(enumerate(ODD)) + [(3, ODD[3]), (None, "no id"), (50, None), (51, "long words " * 20_000), (52, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, "en", 5, "d") for r in rows], "doc_id long, text string, lang string, ids int, decoded string")
    encoded = encode_pieces(docs, MODEL)
    found = sorted((tuple(r) for r in decode_pieces(encoded, MODEL).collect()), key=str)
    wanted = [(i, library.encode(t or ""), library.decode(library.encode(t or "")) if t else "") for i, t in rows]
    assert found == sorted(wanted, key=str) and encoded.columns == ["doc_id", "ids"]
    assert encode_pieces(docs.limit(0), MODEL).count() == 0 and decode_pieces(encoded.limit(0), MODEL).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [tuple(r) for r in decode_pieces(none, MODEL).collect()] == [(1, None, "")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_query(spark, library):
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    wanted = []
    for r in table(spark, "/root/testdata/sf0.001", "documents").collect():
        ids = library.encode(r.text or "")
        wanted.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    assert sorted(map(tuple, QUERIES["op13_sentencepiece"](spark, "/root/testdata/sf0.001").collect())) == sorted(wanted)
