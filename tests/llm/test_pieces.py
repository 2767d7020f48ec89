"""Encoding and decoding against the library that the model file belongs to."""

from hashlib import sha256

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from inductra.llm import pieces
from inductra.llm.pieces import CharacterMap, Model
from inductra.llm.queries import op9_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OURS = Model(PATH)
ODD = "aaab the ing  \n\t\x1c\x85　 ▁▁é漢😀ñ12²Ⅷ'_-!!<s>\0﻿<0x0A>"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ODD, max_size=50))
def test_ids_and_decoded_text_equal_the_library(text):
    found = OURS.encode([text])
    ids = LIBRARY.encode(text)
    assert found.field("ids")[0].as_py() == ids
    assert found.field("decoded")[0].as_py() == LIBRARY.decode(ids) == OURS.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(3, 258) | st.integers(259, 31999), max_size=12))
def test_any_ids_decode_like_the_library(ids):
    assert OURS.decode(ids) == LIBRARY.decode(ids)


def test_spans_lead_back_to_the_original_bytes():
    text = "héllo  wörld 漢😀 a▁b"
    row = OURS.encode([text])[0].as_py()
    raw = text.encode()
    for i, start, end in zip(row["ids"], row["starts"], row["ends"]):
        piece = LIBRARY.id_to_piece(i)
        source = raw[start:end].decode()
        if piece.startswith("<0x"):
            assert bytes([int(piece[1:-1], 16)]) in source.encode()
        else:
            assert source.replace(" ", "▁") == piece or "▁" + source == piece
    assert row["ends"][-1] == len(raw)


def test_long_chunks_take_the_other_path_with_equal_result():
    for text in ("ab" * 400, "thing" * 100 + " and", "x" * 3000, "漢" * 200):
        assert OURS.encode([text]).field("ids")[0].as_py() == LIBRARY.encode(text)


def normaliser(prefix, squeeze):
    other = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = proto.ModelProto()
    spec.ParseFromString(other.serialized_model_proto())
    model = Model(PATH)
    model.map = CharacterMap(spec.normalizer_spec.precompiled_charsmap)
    model.prefix, model.squeeze = prefix, squeeze
    return model, other


MAPPED, MAPPER = normaliser(True, True)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ＡＢＣ ﬁ①㌔ éｶﾞabc  \t\n½…Ⅷ漢😀각", max_size=25))
def test_character_map_equals_the_library(text):
    out, start, end = MAPPED.normalise(text)
    assert out == MAPPER.normalize(text)
    assert len(out) == len(start) == len(end)
    assert all(0 <= a <= b <= len(text.encode()) for a, b in zip(start.tolist(), end.tolist()))


def test_mapped_characters_keep_their_source():
    out, start, end = MAPPED.normalise("ﬁ ㌔")
    raw = "ﬁ ㌔".encode()
    assert out == "▁fi▁キロ"
    assert [raw[a:b].decode() for a, b in zip(start, end)] == ["", "ﬁ", "ﬁ", " ", "㌔", "㌔"]


def test_table_form(texts, clashing):
    rows = [(1, "the cat"), (1, "the cat"), (2, None), (3, ""), (None, "naïve 漢字"), (4, "word " * 3000)]
    out = pieces.encode(clashing(texts(rows)), PATH).collect()
    assert sorted((r.doc_id or 0, len(r.encoded.ids)) for r in out) == sorted(
        (i or 0, len(LIBRARY.encode(t or ""))) for i, t in rows
    )
    assert {r.n_tokens for r in out} == {"kept"}
    assert pieces.encode(texts([]), PATH).collect() == []
    back = pieces.encode(texts(rows), PATH).select("text", pieces.decode(F.col("encoded.ids"), PATH).alias("back"))
    assert all(r.back == (r.text or "") for r in back.collect())


def test_query(spark, documents, sf_dir):
    known = {r.doc_id: r.text for r in documents.collect()}
    for r in op9_sentencepiece(spark, sf_dir).collect():
        ids = LIBRARY.encode(known[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(LIBRARY.decode(ids).encode()).hexdigest()
