import hashlib

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import sentencepiece_bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def entries():
    return B.read_ranks(PATH)


@pytest.fixture(scope="module")
def codec(entries):
    return B.Codec(entries, P.PATTERN)


@pytest.fixture(scope="module")
def reference(entries):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={x: i for i, x in enumerate(entries)}, special_tokens={})


ODD = ["", " ", "\n\n  \t x", "it's I'LL 123 4567", "日本語 🎉🎉🎉 \x1c\x85\xa0​", "a" * 9000, "<unk> ▁ <|endoftext|>", "\x00\x01", "ſſ ǅ"]


def test_model_is_a_sentencepiece_bpe(entries):
    sp = sentencepiece.SentencePieceProcessor(model_proto=B.model_proto(entries))
    assert sp.get_piece_size() == len(entries) + 1
    assert sp.unk_id() == len(entries)
    assert [sp.get_score(i) for i in (0, 1, 50000)] == [0.0, -1.0, -50000.0]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(codec, reference, text):
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(codec, reference, text):
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text) and codec.decode(ids).decode() == text


def test_every_entry_that_is_text_is_one_token(entries, codec, reference):
    for i, x in enumerate(entries[:3000]):
        try:
            assert codec.pre_token(x.decode()) == [i]
        except UnicodeDecodeError:
            pass


def test_query_rows(both, reference):
    got = {tuple(r) for r in B.round_trip(both, PATH, P.PATTERN).collect()}
    want = set()
    for i, t in both.collect():
        ids = reference.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want


def test_encode_then_decode(documents):
    encoded = B.encode(documents, PATH, P.PATTERN)
    texts = {r["doc_id"]: bytes(r["bytes"]).decode() for r in B.decode(encoded, PATH).collect()}
    assert texts == {r["doc_id"]: r["text"] for r in documents.collect()}


def test_empty(empty):
    assert B.round_trip(empty, PATH, P.PATTERN).collect() == []
